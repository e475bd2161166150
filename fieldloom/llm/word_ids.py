"""Token ids of whole texts by way of their words, for tokenizers whose words don't depend on each other.

Texts are cut at ASCII white space, and after a run of ASCII letters before a sign. Each distinct word of a slice is
told by a 64-bit hash; a word that isn't in the worker's bounded table goes through the tokenizers library once, and the
ids of a text are gathered from the table. This holds where the tokenizer drops white space and never lets a piece go
on from a letter to a sign, which ``WordIds`` checks. A slice with a special token in it isn't cut before signs.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from fieldloom.llm.scan import BYTE_VALUE, CASED_VALUE, SPACE, U64, gather, slices, text_buffer, words

#: Words kept in a worker, about 40 bytes each. Others are encoded again in each slice, with the same result.
KEPT_WORDS = 1_500_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.array([b < 128 and chr(b).isprintable() and not chr(b).isalnum() and b != 32 for b in range(256)])


class KeptIds:
    """A worker's bounded table from 64-bit hashes of words to ids.

    When it is full, what was asked for again since it last filled stays; the rest makes room for newer words.
    """

    def __init__(self, most: int, longest: int = 64):
        self.most, self.longest = most, longest
        self._keep(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _keep(self, names: np.ndarray, at: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        self.names, self.at, self.size, self.flat = names, at, size, flat
        self.asked = np.zeros(len(names), bool)

    def find(self, names: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, size) of ascending names; ``encode`` takes the indexes of unknown ones.

        It gives their ids in a row and the number of ids of each.
        """
        place = np.minimum(np.searchsorted(self.names, names), max(len(self.names) - 1, 0))
        known = self.names[place] == names if len(self.names) else np.zeros(len(names), bool)
        at, size = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        at[known], size[known] = self.at[place[known]], self.size[place[known]]
        self.asked[place[known]] = True
        new = np.flatnonzero(~known)
        if not len(new):
            return self.flat, at, size
        ids, sizes = encode(new)
        size[new], at[new] = sizes, np.cumsum(sizes) - sizes + len(self.flat)
        flat = np.concatenate([self.flat, ids])
        new = new[sizes <= self.longest]
        if len(self.names) + len(new) > self.most:
            stay = self.asked if 2 * self.asked.sum() <= self.most else np.zeros(len(self.names), bool)
            sizes = self.size[stay]
            self._keep(self.names[stay], np.cumsum(sizes) - sizes, sizes, gather(self.flat, self.at[stay], sizes))
        if len(self.names) + len(new) <= self.most:
            into, first = np.searchsorted(self.names, names[new]), len(self.flat)
            self.flat = np.concatenate([self.flat, gather(flat, at[new], size[new])])
            starts = first + np.cumsum(size[new]) - size[new]
            self.at, self.size = np.insert(self.at, into, starts), np.insert(self.size, into, size[new])
            self.asked, self.names = np.insert(self.asked, into, False), np.insert(self.names, into, names[new])
        return flat, at, size


class WordIds:
    """ids(texts): the ids of each text in a row, each text with the end id."""

    _loaded: dict[str, WordIds] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        whole = self.tokenizer.encode("Ab.c  'd 12", add_special_tokens=False).ids
        if whole != [i for w in ("Ab", ".c", "'d", "12") for i in self.tokenizer.encode(w, add_special_tokens=False).ids]:
            raise ValueError("the words of this tokenizer depend on each other")
        folds = self.tokenizer.encode("ÀBC", add_special_tokens=False).ids == self.tokenizer.encode("àbc", add_special_tokens=False).ids
        self.values = BYTE_VALUE if folds else CASED_VALUE
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept = KeptIds(KEPT_WORDS)

    @classmethod
    def load(cls, path: str) -> WordIds:
        """The worker's own copy."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids of each word): the words as one text; a token belongs to the word it starts in."""
        ids, sizes = [], []
        for at in range(0, len(texts), 20_000):
            part = texts[at : at + 20_000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.cumsum([0] + [len(w) + 1 for w in part])
            begins[-1] += 1
            token_starts = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
            ids.append(np.asarray(found.ids, np.uint32))
            sizes.append(np.diff(np.searchsorted(token_starts, begins)))
        return np.concatenate(ids), np.concatenate(sizes)

    def ids(self, column: pa.Array, end_id: int, kind: str = "<u4") -> pa.Array:
        """A binary array: the ids of each text and the end id; null and empty texts have the end id alone."""
        data, offsets = text_buffer(column)
        parts = []
        for a, b in slices(offsets):
            part, ends = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            split = not self.special or not any(s in part.tobytes() for s in self.special)
            parts.append(self._slice(part, ends, end_id, kind, split))
        return pa.chunked_array(parts, pa.binary()).combine_chunks() if parts else pa.array([], pa.binary())

    def _slice(self, data: np.ndarray, ends: np.ndarray, end_id: int, kind: str, split: bool) -> pa.Array:
        row, name, start, stop = words(data, ends, SPACE, self.values, (_LETTER, _SIGN) if split else None)
        names, first, again = np.unique(name, return_index=True, return_inverse=True)
        raw = data.tobytes()
        flat, at, size = self.kept.find(names, lambda new: self._encode([raw[start[i] : stop[i]].decode() for i in first[new]]))
        rows = len(ends) - 1
        size, at = size[again], at[again]
        total = int(size.sum())
        out = np.empty(total + rows, kind)
        out[np.arange(total) + np.repeat(row, size)] = gather(flat, at, size)
        per_row = np.bincount(row, size, rows).astype(np.int64) + 1
        stops = np.cumsum(per_row)
        out[stops - 1] = end_id
        width = np.dtype(kind).itemsize
        return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((np.r_[0, stops] * width).astype(np.int32)), pa.py_buffer(out)])
