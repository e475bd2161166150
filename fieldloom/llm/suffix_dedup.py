"""Suffix-array dedup: byte strings that repeat across documents, by a distributed merge sort that keeps common prefixes.

Every string of ``span`` bytes holds an anchor: the position of its smallest gram (``gram`` bytes, by hash; the first of
equal ones). Equal strings have their anchor at the same place, so it is enough to sort the suffixes that begin at anchors,
about one position in fourteen, and to look left of them.

1. Which grams occur in two different texts is counted by hash; suffixes whose gram occurs in one text only equal no other
   suffix for ``span`` bytes and go no further.
2. Tasks sort the suffixes left, keep of equal contexts in a chunk the one of the smallest document, and exchange front-coded
   sorted runs (length of the prefix shared with the suffix before, remaining bytes), bucketed by gram.
3. A bucket's runs meet in a loser tree whose nodes remember the prefix that the loser shares with the last suffix taken:
   candidates with different known prefixes are decided without looking at bytes, others are compared behind it. It gives
   the bucket's suffix array with its common-prefix lengths; the bytes left of the anchors are sorted in the same way, from
   right to left. A string that begins o bytes before its anchor is the pair of its classes in both orders, and the smallest
   document of each such pair tells who keeps it.

A text that copies another one whole is settled by its digest. Grams that very many texts hold (a line on every page) would
meet in one bucket: their strings are sorted whole, by suffixes that begin at the string itself, and spread by all their
bytes, of which a chunk sends each only once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.scan import U64, mix, slices, text_buffer
from fieldloom.session import cut, shuffle_partitions

_LOW = U64(0xFFFFFFFF)
_FACTORS = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)]


@dataclass(frozen=True)
class Settings:
    span: int = 50  # bytes of a string that counts as a repetition
    gram: int = 24  # bytes of an anchor, 24 at most
    chunk_bytes: int = 10 << 20  # text that a task gathers before it sorts a run
    part_bytes: int = 16 << 20  # text for each bucket, on average
    hot: int = 8192  # texts that may hold a gram before its strings are sorted whole ...
    most_hot: int = 500_000  # ... or more, so that no more grams than these are hot (they are sent to all tasks)


# Anchors.


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a big-endian number; bytes behind the end count as 0."""
    x = np.zeros(len(data) + 8, U64)
    x[: len(data)] = data
    x = (x[:-1] << U64(8)) | x[1:]
    x = (x[:-2] << U64(16)) | x[2:]
    return ((x[:-4] << U64(32)) | x[4:])[: len(data)]


def _at(eights: np.ndarray, position: np.ndarray) -> np.ndarray:
    inside = position < len(eights)
    return np.where(inside, eights[np.minimum(position, len(eights) - 1)], U64(0))


def anchors(data: np.ndarray, offsets: np.ndarray, eights: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """(row, anchor, first and last string that it serves, hash of its gram), by position.

    Strings are told by their first byte and lie within their row.
    """
    n, width = len(data), s.span - s.gram + 1
    if n < s.span:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64))
    words = [eights[8 * j : n - s.gram + 1 + 8 * j] for j in range(s.gram // 8)]
    if s.gram % 8:
        words.append(eights[s.gram - 8 : n - 7])
    grams = words[0] * _FACTORS[0]
    for word, factor in zip(words[1:], _FACTORS[1:]):
        grams += word * factor
    grams = mix(grams)
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=U64)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & _LOW).astype(np.int64)
    valid = np.ones(len(anchor) + 2, bool)  # one place before the first and after the last string
    valid[[0, -1]] = False
    for end in offsets[1:-1].tolist():
        valid[max(1, end - s.span + 2) : end + 1] = False
    differs = np.r_[True, anchor[1:] != anchor[:-1], True]
    inside = valid[1:-1]
    first = np.flatnonzero(inside & (differs[:-1] | ~valid[:-2]))
    last = np.flatnonzero(inside & (differs[1:] | ~valid[2:]))
    row = np.searchsorted(offsets, first, "right") - 1
    return row, anchor[first], first, last, grams[anchor[first]]


def _chunks(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.Table]:
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.column(text).nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _scan(column: pa.Array, s: Settings) -> Iterator[tuple]:
    """(first row, data, offsets, eights, anchors) of slices of a text column."""
    data, offsets = text_buffer(column)
    for first, last in slices(offsets):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        eights = _eights(part)
        yield first, part, at, eights, anchors(part, at, eights, s)


# 1. Grams that two texts hold.

_ASK = "part int, gram_high binary, gram_low binary, many binary, size binary, doc binary, digest binary, at binary, known_doc binary, known_digest binary, known_at binary"
_TOLD = "kind int, a long, b long, at int, n long"


def _ask(parts: int, s: Settings):
    """Of each chunk every gram once, with the document to tell; documents whose gram a second text of the chunk holds are told at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, "text", s.chunk_bytes):
            doc, digest = (table.column(c).to_numpy() for c in ("doc", "digest"))
            order = np.lexsort((doc, digest))
            order = np.sort(order[np.r_[True, digest[order][1:] != digest[order][:-1]]])  # copies: the smallest document
            doc, digest = doc[order], digest[order]
            found = []
            for base, _, _, _, (row, _, _, _, gram) in _scan(_column(table.take(order), "text"), s):
                number = np.arange(len(row)) - np.searchsorted(row, row)
                found.append((gram, base + row, number))
            gram, row, number = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((number, row, gram))
            gram, row, number = gram[order], row[order], number[order]
            fresh = np.r_[True, gram[1:] != gram[:-1]] if len(gram) else np.zeros(0, bool)
            once = fresh | np.r_[True, row[1:] != row[:-1]] if len(gram) else fresh  # a gram's first place in each text
            gram, row, number, fresh = gram[once], row[once], number[once], fresh[once]
            begins = np.flatnonzero(fresh)
            texts = np.diff(np.r_[begins, len(gram)])
            shared = np.repeat(texts > 1, texts)
            known_row, known_at = row[shared], number[shared]
            gram, row, number = gram[begins], row[begins], number[begins]
            part, known_part = (gram >> U64(40)).astype(np.int64) % parts, known_row % parts
            order, known = np.lexsort((row, part)), np.argsort(known_part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            known_edges = np.searchsorted(known_part[known], np.arange(parts + 1))
            for k in range(parts):
                i, j = order[edges[k] : edges[k + 1]], known[known_edges[k] : known_edges[k + 1]]
                if not len(i) and not len(j):
                    continue
                rows, size = np.unique(row[i], return_counts=True)
                cells = [
                    (gram[i] >> U64(32)).astype(np.uint16), (gram[i] & _LOW).astype(np.uint32), texts[i].astype(np.uint32), size.astype(np.uint32),
                    doc[rows], digest[rows], number[i].astype(np.uint32), doc[known_row[j]], digest[known_row[j]], known_at[j].astype(np.int32),
                ]
                yield _row(k, cells, _ASK)

    return run


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _row(part: int, cells: list[np.ndarray], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32())] + [pa.array([c.tobytes()], pa.binary()) for c in cells], _names(schema))


def _cells(table: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]


def _gathered(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([*_cells(table, name, kind), np.zeros(0, kind)])


def _tell(hot: int):
    """Of one hash range: (0, document, digest, place of an anchor) where a second text holds the gram; (1, gram, -, -, texts) of hot grams; (2, -, -, -, anchors)."""

    def run(table: pa.Table) -> pa.Table:
        gram = (_gathered(table, "gram_high", np.uint16).astype(U64) << U64(32)) | _gathered(table, "gram_low", np.uint32)
        many, at = _gathered(table, "many", np.uint32).astype(np.int64), _gathered(table, "at", np.uint32).astype(np.int32)
        size = _gathered(table, "size", np.uint32)
        doc, digest = (np.repeat(_gathered(table, c, np.int64), size) for c in ("doc", "digest"))
        order = np.argsort(gram, kind="stable")
        gram, many, at, doc, digest = (x[order] for x in (gram, many, at, doc, digest))
        begins = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
        size = np.diff(np.r_[begins, len(gram)])
        low, high, texts = (f.reduceat(x, begins) if len(gram) else x for f, x in ((np.minimum, digest), (np.maximum, digest), (np.add, many)))
        shared = np.repeat((low != high) | (texts > size), size) & (many == 1)
        often = texts > hot
        kinds = [
            (0, np.r_[doc[shared], _gathered(table, "known_doc", np.int64)], np.r_[digest[shared], _gathered(table, "known_digest", np.int64)], np.r_[at[shared], _gathered(table, "known_at", np.int32)], None),
            (1, gram[begins[often]].astype(np.int64), None, None, texts[often]),
            (2, np.zeros(1, np.int64), None, None, np.array([many.sum()])),
        ]
        fill = lambda x, like, kind: np.zeros(len(like), kind) if x is None else x.astype(kind)
        return pa.Table.from_arrays(
            [
                pa.array(np.concatenate([np.full(len(a), k, np.int32) for k, a, *_ in kinds])),
                pa.array(np.concatenate([a for _, a, *_ in kinds])),
                *[pa.array(np.concatenate([fill(x[c], x[1], kind) for x in kinds])) for c, kind in ((2, np.int64), (3, np.int32), (4, np.int64))],
            ],
            _names(_TOLD),
        )

    return run


# 2. Sorted runs.

_RUN = "part int, common binary, length binary, tail binary, left_length binary, left binary, doc binary, digest binary, place binary, known_doc binary, known_digest binary, known_from binary, known_to binary"
_SPANS = "doc long, digest long, first int, last int"


def _words(eights: np.ndarray, at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """``n`` big-endian words from ``at`` on, bytes from ``length`` on set to 0."""
    out = np.zeros((len(at), n), U64)
    for j in range(n):
        have = np.clip(length - 8 * j, 0, 8).astype(U64)
        mask = np.where(have > 0, ~U64(0) << (U64(64) - U64(8) * np.maximum(have, U64(1))), U64(0))
        out[:, j] = _at(eights, at + 8 * j) & mask
    return out


def _bytes(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(words.astype(">u8")).view(np.uint8).reshape(len(words), 8 * words.shape[1])


def common_prefix(words: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before it (0 for the first)."""
    out = np.zeros(len(words), np.int64)
    if len(words) > 1:
        differs = _bytes(words[1:]) != _bytes(words[:-1])
        out[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), differs.shape[1])
    return out


def _contexts(base, eights, back, size, offsets, found, wanted, hot, s: Settings) -> dict[str, np.ndarray]:
    """The contexts of the wanted anchors: bytes from the anchor on, bytes before it from right to left, and where they stand."""
    row, anchor, first, last, gram = (x[wanted] for x in found)
    whole = np.isin(gram & U64(2**48 - 1), hot)
    if whole.any():  # each string by itself
        many = (last - first + 1)[whole]
        each = np.repeat(first[whole], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, anchor, first, last = np.r_[row[~whole], np.repeat(row[whole], many)], np.r_[anchor[~whole], each], np.r_[first[~whole], each], np.r_[last[~whole], each]
        gram = np.r_[gram[~whole], np.zeros(len(each), U64)]
    length, left = last + s.span - anchor, anchor - first
    right_words = _words(eights, anchor, length, -(-s.span // 8))
    left_words = _words(back, size - anchor, left, -(-(s.span - s.gram) // 8))
    spread = np.where(gram == 0, mix(mix(right_words * U64(0x9E3779B97F4A7C15)).sum(axis=1, dtype=U64)), gram)
    return {
        "right": right_words, "length": length, "left": left_words, "left_length": left, "row": base + row, "place": anchor - offsets[row], "spread": spread,
    }


def _sort_runs(parts: int, hot: np.ndarray, s: Settings):
    """The suffixes of shared grams of each chunk as front-coded sorted runs, one for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, "text", s.chunk_bytes):
            doc, digest, ats = table.column("doc").to_numpy(), table.column("digest").to_numpy(), _column(table, "at")
            found = []
            for base, data, offsets, eights, got in _scan(_column(table, "text"), s):
                row, gram = got[0], got[4]
                told = ats.slice(base, len(offsets) - 1)
                owner = np.repeat(np.arange(len(told)), told.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                place = told.flatten().to_numpy(zero_copy_only=False)
                key = gram ^ mix(row.astype(U64) + U64(1))  # a gram counts wherever its document has it
                begins = np.searchsorted(row, np.arange(len(told)))
                wanted = np.isin(key, key[begins[owner] + place])
                if wanted.any():
                    found.append(_contexts(base, eights, _eights(data[::-1]), len(data), offsets, got, wanted, hot, s))
            if not found:
                continue
            x = {name: np.concatenate([f[name] for f in found]) for name in found[0]}
            who = doc[x["row"]]
            order = np.lexsort((who, x["left_length"], *x["left"].T[::-1], x["length"], *x["right"].T[::-1]))
            x, who = {name: v[order] for name, v in x.items()}, who[order]
            same = np.r_[False, (x["right"][1:] == x["right"][:-1]).all(1) & (x["left"][1:] == x["left"][:-1]).all(1) & (x["length"][1:] == x["length"][:-1]) & (x["left_length"][1:] == x["left_length"][:-1])]
            least = who[np.maximum.accumulate(np.where(same, 0, np.arange(len(who))))]
            gone = who > least  # a smaller document of this chunk has the same context
            known = _joined(x["row"][gone], x["place"][gone] - x["left_length"][gone], x["place"][gone] + x["length"][gone] - s.span)
            x = {name: v[~gone] for name, v in x.items()}
            part, known_part = (x["spread"] >> U64(24)).astype(np.int64) % parts, known[0] % parts
            for k in range(parts):
                i, j = np.flatnonzero(part == k), np.flatnonzero(known_part == k)
                if not len(i) and not len(j):
                    continue
                length, left = x["length"][i], x["left_length"][i]
                common = np.minimum(common_prefix(x["right"][i]), np.minimum(length, np.r_[0, length[:-1]]))
                place = np.arange(8 * x["right"].shape[1])
                cells = [
                    common.astype(np.uint8), length.astype(np.uint8), _bytes(x["right"][i])[(place >= common[:, None]) & (place < length[:, None])],
                    left.astype(np.uint8), _bytes(x["left"][i])[np.arange(8 * x["left"].shape[1]) < left[:, None]],
                    doc[x["row"][i]], digest[x["row"][i]], x["place"][i].astype(np.uint32),
                    doc[known[0][j]], digest[known[0][j]], known[1][j].astype(np.int32), known[2][j].astype(np.int32),
                ]
                yield _row(k, cells, _RUN)

    return run


def _joined(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of strings of each row, those that meet joined into one."""
    order = np.lexsort((first, row))
    row, first, last = row[order], first[order], last[order]
    apart = np.ones(len(row), bool)
    if len(row):
        apart[1:] = (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)
    begins = np.flatnonzero(apart)
    return row[begins], first[begins], np.maximum.reduceat(last, begins) if len(row) else last


# 3. Merging.


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, bytes shared with the suffix before) of all suffixes in order, by a loser tree that keeps common prefixes.

    A run is its sorted suffixes and the number of bytes that each shares with the one before it. Every node holds the
    loser of its game and how much that shares with the last suffix taken. The candidate that shares more is the smaller;
    only where both share the same are bytes compared, from there on.
    """
    count, leaves = len(runs), 1
    while leaves < count:
        leaves *= 2
    head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (leaves - count)
    at = [0] * count
    loser, shares = [0] * leaves, [0] * leaves

    def game(c: int, h: int, t: int, g: int) -> tuple[int, int, int, int]:
        """(winner, its shared bytes, loser, its shared bytes)."""
        a, b = head[c], head[t]
        if b is None or (a is not None and h > g):
            return c, h, t, g
        if a is None or h < g:
            return t, g, c, h
        most = min(len(a), len(b))
        while h < most and a[h] == b[h]:
            h += 1
        if h == len(a) or (h < len(b) and a[h] < b[h]):
            return c, g, t, h
        return t, g, c, h

    winner = list(range(leaves))
    for level in range(leaves.bit_length() - 2, -1, -1):
        nodes = range(1 << level, 2 << level)
        nxt = []
        for k, node in enumerate(nodes):
            w, _, loser[node], shares[node] = game(winner[2 * k], 0, winner[2 * k + 1], 0)
            nxt.append(w)
        winner = nxt
    top, share = winner[0], 0
    while head[top] is not None:
        yield top, at[top], share
        at[top] = i = at[top] + 1
        keys, common = runs[top]
        head[top], share = (keys[i], common[i]) if i < len(keys) else (None, 0)
        node = (leaves + top) >> 1
        while node:
            t, g = loser[node], shares[node]
            if head[top] is None or share <= g:
                top, share, loser[node], shares[node] = game(top, share, t, g)
            node >>= 1


def _suffixes(common: np.ndarray, length: np.ndarray, tail: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for c, n in zip(common.tolist(), length.tolist()):
        last = last[:c] + tail[at : at + n - c]
        at += n - c
        out.append(last)
    return out


def _merge(s: Settings):
    """(document, digest, first, last) of ranges of strings that a smaller document holds, of one bucket."""

    def run(table: pa.Table) -> pa.Table:
        commons, lengths = _cells(table, "common", np.uint8), _cells(table, "length", np.uint8)
        runs = [(_suffixes(c, n, t), c.tolist()) for c, n, t in zip(commons, lengths, table.column("tail").to_pylist())]
        base = np.cumsum([0] + [len(c) for c in commons])
        n = int(base[-1])
        order, shared = np.zeros(n, np.int64), np.zeros(n, np.int64)
        begin = base.tolist()
        for k, (r, i, share) in enumerate(merge_runs(runs)):
            order[k], shared[k] = begin[r] + i, share
        del runs
        take = lambda name, kind: _gathered(table, name, kind)[order]
        length, left_length = take("length", np.uint8).astype(np.int64), take("left_length", np.uint8).astype(np.int64)
        doc, digest, place = take("doc", np.int64), take("digest", np.int64), take("place", np.uint32).astype(np.int64)
        flat, size = _gathered(table, "left", np.uint8), _gathered(table, "left_length", np.uint8).astype(np.int64)
        width = 8 * -(-(s.span - s.gram) // 8)
        left = np.zeros((n, width), np.uint8)
        left[np.arange(width) < size[:, None]] = flat
        left = left[order].view(">u8").astype(U64).reshape(n, width // 8)
        by_left = np.lexsort(left.T[::-1]) if n else np.zeros(0, np.int64)
        left_shared = common_prefix(left[by_left])
        left_class = np.zeros(n, np.int64)
        held = np.zeros((n, s.span - s.gram + 1), bool)
        for o in range(s.span - s.gram + 1):  # strings that begin o bytes before their anchor
            i = np.flatnonzero((left_length >= o) & (length >= s.span - o))
            if len(i) < 2:
                continue
            left_class[by_left] = np.cumsum(left_shared < o)
            key = (np.cumsum(shared < s.span - o)[i] << 32) | left_class[i]
            sort = np.argsort(key, kind="stable")
            begins = np.flatnonzero(np.r_[True, np.diff(key[sort]) != 0])
            least = np.minimum.reduceat(doc[i][sort], begins)
            held[i[sort], o] = np.repeat(least, np.diff(np.r_[begins, len(i)])) < doc[i][sort]
        which, o = np.nonzero(held)
        code = which * (2**32) + place[which] - o
        order = np.argsort(code)
        row, first = which[order], (place[which] - o)[order]
        row, first, last = _joined(row, first, first)
        known = [_gathered(table, c, kind) for c, kind in (("known_doc", np.int64), ("known_digest", np.int64), ("known_from", np.int32), ("known_to", np.int32))]
        columns = [np.r_[doc[row], known[0]], np.r_[digest[row], known[1]], np.r_[first.astype(np.int32), known[2]], np.r_[last.astype(np.int32), known[3]]]
        return pa.Table.from_arrays([pa.array(c) for c in columns], _names(_SPANS))

    return run


# The operator.

_OUT = "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary"


def _take_out(span: int):
    """Removed byte ranges and the bytes that stay, of rows with the ranges of strings that a smaller document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            copies = batch.column("copy").to_numpy(zero_copy_only=False)
            spans = batch.column("spans")
            for begin, end in slices(offsets):
                removed, kept = [], []
                for i in range(begin, end):
                    body = data[offsets[i] : offsets[i + 1]]
                    edge = np.zeros(len(body) + 1, np.int64)
                    if copies[i] and len(body) >= span:
                        edge[0] = 1
                    elif spans[i].is_valid:
                        flat = spans[i].values.flatten()
                        np.add.at(edge, flat[0].to_numpy(), 1)
                        np.subtract.at(edge, flat[1].to_numpy() + span, 1)
                    gone = np.cumsum(edge[:-1]) > 0
                    change = np.flatnonzero(np.diff(np.r_[False, gone, False])).reshape(-1, 2)
                    removed.append([{"start": a, "end": b} for a, b in change.tolist()])
                    kept.append(body[~gone].tobytes())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin), pa.array(np.diff(offsets[begin : end + 1])), pa.array(removed, kind), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "removed", "kept"],
                )

    return run


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, removed (byte ranges) and kept (the other bytes) of every row's text.

    Texts are UTF-8 bytes; every byte goes that lies in a string of ``span`` bytes, within its text, that also begins in a
    row with a smaller id. Null texts are empty; texts shorter than ``span`` lose nothing. Rows without an id neither lose
    bytes nor take them from others. Rows with one id are alike: neither is smaller. Further columns are ignored. A text of
    any length is held by one task.
    """
    s, spark = settings, docs.sparkSession
    if not 8 <= s.gram <= 24 or s.span <= s.gram:
        raise ValueError("gram must be 8 to 24 bytes, and span longer")
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(0)).alias("doc"), F.xxhash64("text").alias("digest"), "text"
    )
    size = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // s.part_bytes))
    long = whole.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= s.span))
    told = long.select("doc", "digest", "text").mapInArrow(_ask(parts, s), _ASK).groupBy("part").applyInArrow(_tell(s.hot), _TOLD)
    told = cut(told.groupBy("kind", "a", "b").agg(F.collect_list("at").alias("at"), F.sum("n").alias("n")))
    total = told.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    often = told.where(F.col("kind") == 1).where(F.col("n") > total // s.most_hot).select("a")
    hot = np.array([r.a for r in often.collect()], np.int64).astype(U64)  # most_hot grams at most: their sizes sum to total

    marks = told.where("kind = 0").select(F.col("a").alias("doc"), F.col("b").alias("digest"), "at")
    second = F.xxhash64(F.lit(29), "text", F.octet_length("text")).alias("second")
    first = whole.where("doc_id is not null").select("doc", "digest", second).groupBy("digest", "second").agg(F.min("doc").alias("doc"))
    small = first.select("doc", "digest").distinct().join(marks, ["doc", "digest"], "left").withColumn("first", F.lit(True)).hint("shuffle_hash")
    joined = whole.join(small, ["doc", "digest"], "left")
    # with doc_id, so that both joins of the texts read one shuffle
    runs = joined.where("at is not null").select("doc_id", "doc", "digest", "text", "at").mapInArrow(_sort_runs(parts, hot, s), _RUN)
    spans = runs.groupBy("part").applyInArrow(_merge(s), _SPANS)
    spans = spans.groupBy("doc", "digest").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    final = small.select("doc", "digest", "first").join(spans, ["doc", "digest"], "left").hint("shuffle_hash")
    out = whole.join(final, ["doc", "digest"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return out.select("doc_id", "text", copy.alias("copy"), F.when(F.col("doc_id").isNotNull(), F.col("spans")).alias("spans")).mapInArrow(_take_out(s.span), _OUT)
