"""Byte-pair encoding by a deterministic automaton over tokens, compiled from the merges.

The automaton starts with one state and an arc for each byte. Each merge ``u v -> w`` in rank order adds its gadget:
where a path ``p -u-> q -v-> r`` exists, ``p`` gets the arc ``w`` to ``r``, and the arcs ``u`` lead to a new state, the
copy of ``q`` without the arc ``v``. A sequence of tokens is the correct encoding of its string exactly if the automaton
reads it, and every beginning of a string has exactly one such sequence.

All arcs of one label end in the same state. The transition table is kept by rows: the row of a state maps tokens to the
next state, or to CLOSED. Entries follow from the gadgets, and are filled in when they are first asked for.

Texts are cut into units where the pre-split pattern always begins a new piece. Each distinct unit of a slice is told by
a 64-bit hash and encoded once; ids, decimal digits and labels of whole slices are gathered by numpy.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.scan import CASED_VALUE, gather, hashes, slices, text_buffer
from fieldloom.llm.word_ids import KeptIds

#: The published pre-split pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of a worker's tables. What is beyond them is computed again, with the same result.
KEPT_UNITS = 1_000_000
KEPT_ARCS = 200_000
NEVER = 1 << 40
CLOSED = -1
ROOT = 0


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class MergeAutomaton:
    """States, arcs and the transition table, built by successive merge gadgets.

    A state other than ROOT was made by a gadget of its owner ``u`` at rank ``since``; it lacks the arcs that this and
    the earlier gadgets of ``u`` took away, and those that the state ``base[u]`` lacked, where the arcs ``u`` led first.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()
        self.owner, self.since = [-1], [-1]  # of each state
        self.base: dict[int, int] = {}
        self.state_after: dict[int, int] = {vocab[x]: ROOT for x in letters if x in vocab}
        self.left: dict[int, int] = {}
        self.made = dict.fromkeys(self.state_after, -1)
        self.taken: dict[tuple[int, int], int] = {}  # (u, v) -> rank of the gadget that took the arc v away after u
        self.rows: dict[int, dict[int, int]] = {}
        self.filled = 0
        for rank, (left, right) in enumerate(merges):
            self._gadget(rank, vocab[left], vocab[right], vocab[left + right])
        of = {x: b for b, x in enumerate(letters)}
        self.label = {i: bytes(of[c] for c in t) for t, i in vocab.items() if all(c in of for c in t)}
        self.by_label = {self.label[i]: i for i in self.state_after if i in self.label}
        self.prefixes = {x[:k] for x in self.by_label for k in range(1, len(x) + 1)}

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        q = self.state_after.get(u)
        if q is None or v not in self.state_after or w in self.state_after or not self._has_arc(q, v):
            return  # no path reads u v: the merge never applies
        self.state_after[w], self.left[w], self.made[w] = self.state_after[v], u, rank
        self.base.setdefault(u, q)
        self.taken[u, v] = rank
        self.state_after[u] = len(self.owner)
        self.owner.append(u)
        self.since.append(rank)

    def _has_arc(self, state: int, token: int) -> bool:
        """Whether a state has an arc, told from the gadgets.

        When ``w`` was made of ``u v``, the states with an arc ``u`` got one ``w``. So a state has the arc ``w`` if it
        is older than ``w`` and has the arc ``u``, or if it is younger and its gadgets didn't take ``w`` away.
        """
        while state != ROOT:
            u, since = self.owner[state], self.since[state]
            x, until = token, NEVER
            while True:
                if self.taken.get((u, x), NEVER) <= min(since, until):
                    return False
                if x not in self.left:
                    break
                x, until = self.left[x], self.made[x]
            state = self.base[u]
        return True

    def step(self, state: int, token: int) -> int:
        """The transition table: the state that the arc leads to, or CLOSED."""
        row = self.rows.get(state)
        if row is None:
            row = self.rows[state] = {}
        following = row.get(token)
        if following is None:
            if self.filled >= KEPT_ARCS:
                self.rows, self.filled = {state: row}, len(row)
            following = row[token] = self.state_after[token] if self._has_arc(state, token) else CLOSED
            self.filled += 1
        return following

    def encode(self, piece: bytes) -> list[int]:
        """The one path that reads the piece, the longest arcs tried first; a position is tried once."""
        whole = self.by_label.get(piece)
        if whole is not None:
            return [whole]
        n, failed = len(piece), set()
        path: list[int] = []
        at, state, choices = 0, ROOT, self._labels(piece, 0)
        behind: list[tuple[int, int, list[tuple[int, int]]]] = []
        while at < n:
            while choices:
                token, end = choices.pop()
                if end not in failed and (following := self.step(state, token)) != CLOSED:
                    behind.append((at, state, choices))
                    path.append(token)
                    at, state, choices = end, following, self._labels(piece, end)
                    break
            else:
                failed.add(at)
                if not path:
                    raise ValueError("the vocabulary lacks bytes of this text")
                path.pop()
                at, state, choices = behind.pop()
        return path

    def _labels(self, piece: bytes, at: int) -> list[tuple[int, int]]:
        """(token, end) of the labels that the piece has at a position, the longest last."""
        found, end, prefixes, by_label = [], at + 1, self.prefixes, self.by_label
        while end <= len(piece) and (x := piece[at:end]) in prefixes:
            token = by_label.get(x)
            if token is not None:
                found.append((token, end))
            end += 1
        return found


_CLASS = np.array([1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if 32 < b < 127 else 0 for b in range(128)] + [0] * 128, np.uint8)
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13]] = True


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a unit begins: at rows' beginnings, and at some of the places where a piece of PATTERN surely begins.

    These are the last white space before a character that is surely none; that character too if no blank stands before
    it; a break behind a visible ASCII character; and changes between ASCII letters, digits and signs, but not behind
    an apostrophe.
    """
    n = len(data)
    starts = np.zeros(n, bool)
    if not n:
        return starts
    kind, after = _CLASS[data], np.r_[data[1:], np.uint8(0)]
    # White space beyond ASCII: U+0085, U+00A0, U+1680, U+180E, U+2000 to U+205F, U+3000.
    odd = (data == 0xC2) & ((after == 0x85) | (after == 0xA0)) | (data == 0xE1) & ((after == 0x9A) | (after == 0xA0))
    odd |= (data == 0xE2) & ((after == 0x80) | (after == 0x81)) | (data == 0xE3) & (after == 0x80)
    solid = ((data >= 0xC2) & ~odd) | (kind > 0)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    last = ((data[:-1] == 0x20) | _BREAK[data[:-1]]) & solid[1:] & ~edge[1:-1]  # white space that ends its run
    starts[:-1] = last
    starts[1:] |= last & (data[:-1] != 0x20) | (kind[:-1] > 0) & _BREAK[data[1:]]
    starts[1:] |= (kind[:-1] != kind[1:]) & (kind[:-1] > 0) & (kind[1:] > 0) & (data[:-1] != 0x27)
    starts |= edge[:-1]
    return starts


class AutomatonTokenizer:
    """Whole texts to ids and back, for byte-level BPE files of the tokenizers library."""

    _loaded: dict[tuple[str, int], AutomatonTokenizer] = {}

    def __init__(self, path: str, kept: int = KEPT_UNITS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(spec["model"]["vocab"], merges)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        label = self.automaton.label | {i: t for t, i in self.special.items()}
        self._special = regex.compile(b"|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        self._pattern = regex.compile(PATTERN)
        self._kept = KeptIds(kept)
        most = max(label) + 1
        self.labels, self.label_at, self.label_size = _rows([label.get(i, b"") for i in range(most)])
        self.digits, self.digits_at, self.digits_size = _rows([b"%d," % i for i in range(most)])

    @classmethod
    def load(cls, path: str, kept: int = KEPT_UNITS) -> AutomatonTokenizer:
        """The worker's own copy; ``kept`` bounds its table where workers also serve other stages."""
        if (path, kept) not in cls._loaded:
            cls._loaded[path, kept] = cls(path, kept)
        return cls._loaded[path, kept]

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids of each unit)."""
        ids: list[int] = []
        sizes = np.zeros(len(units), np.int64)
        pieces, encode = self._pattern.findall, self.automaton.encode
        for k, unit in enumerate(units):
            before = len(ids)
            if unit in self.special:
                ids.append(self.special[unit])
            else:
                for piece in pieces(unit.decode()):
                    ids += encode(piece.encode())
            sizes[k] = len(ids) - before
        return np.array(ids, np.uint32), sizes

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's begin and end) of a slice of texts."""
        starts = unit_starts(data, offsets)
        raw = data.tobytes()
        for m in self._special.finditer(raw) if self.special and any(t in raw for t in self.special) else ():
            row = int(np.searchsorted(offsets, m.start(), "right")) - 1
            a, b = int(offsets[row]), int(offsets[row + 1])
            if m.end() > b:
                continue  # it lies across two texts
            parts = [k for s in self._special.finditer(raw[a:b]) for k in (a + s.start(), a + s.end()) if k < b]
            starts[a:b] = False
            starts[[a, *parts]] = True
        start = np.flatnonzero(starts)
        stop = np.r_[start[1:], len(data)] if len(start) else start
        names, first, again = np.unique(hashes(data, start, stop, CASED_VALUE), return_index=True, return_inverse=True)
        flat, at, size = self._kept.find(names, lambda new: self._encode_units([raw[start[i] : stop[i]] for i in first[new]]))
        ends = np.r_[0, np.cumsum(size[again])]
        return gather(flat, at[again], size[again]), ends[np.searchsorted(start, offsets)]

    def encode(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_rows(data, np.array([0, len(data)]))[0]

    def decode_rows(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows, where each row's begin and end): the labels of the ids' arcs, one after the other."""
        size = self.label_size[ids]
        return gather(self.labels, self.label_at[ids], size), np.r_[0, np.cumsum(size)][ends]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_rows(ids, np.array([0, len(ids)]))[0].tobytes()

    def decimal_rows(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows, where each row's begin and end): decimal ids, each with a comma behind it."""
        size = self.digits_size[ids]
        return gather(self.digits, self.digits_at[ids], size), np.r_[0, np.cumsum(size)][ends]


def _rows(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


def _digests(data: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> pa.Array:
    raw = memoryview(data)
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(begins.tolist(), stops.tolist())], pa.string())


def bpe_digests(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, row by row: equal or null ids change nothing.

    Null text counts as empty: no ids, empty text. A text is held by one task as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = AutomatonTokenizer.load(tokenizer)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in slices(offsets):
                ids, ends = auto.encode_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                digits, at = auto.decimal_rows(ids, ends)
                encoded = _digests(digits, at[:-1], np.maximum(at[1:] - 1, at[:-1]))  # without the last comma
                decoded, at = auto.decode_rows(ids, ends)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(ends)), encoded, _digests(decoded, at[:-1], at[1:])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def bpe_round_trip(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", kept: int = KEPT_UNITS // 5
) -> DataFrame:
    """doc_id, ids (array<int>), text: the ids of every row and the text that they decode to, in one pass.

    Null text counts as empty: no ids, empty text. Equal or null ids change nothing; all other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = AutomatonTokenizer.load(tokenizer, kept)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in slices(offsets):
                ids, ends = auto.encode_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                decoded, at = auto.decode_rows(ids, ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))),
                        pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(decoded)]),
                    ],
                    ["doc_id", "ids", "text"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, text string"
    )
