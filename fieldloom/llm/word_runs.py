"""Periodic runs of words, caught online: dyadic blocks watch the words that are appended after them.

Every aligned block of 2**k words that has been completed becomes a catcher for periods q with 2**k <= q < 2**(k + 1):
each appended word completes the suffix that lies q words behind the block, and a block that reads the same q words later
is the middle of a square of period q. Caught squares wait until enough words have come to tell whether they belong to a
run of the wanted exponent; then the run is opened, extended to the left, and kept open while appended words go on with
its period. Squares inside an open or closed run of a smaller period are powers of it and are let go.

Blocks and suffixes are compared by prefix sums of 64-bit word values, all of a chunk of appended words at once; runs are
confirmed word by word on exact word numbers. A word takes part in one comparison for each level, so the work is n log n.
Documents follow one another in one stream, parted by words that occur nowhere else. Spark only maps over the table:
nothing is shuffled, and no document waits for another.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.scan import _BASE, U64, mix, powers, slices, text_buffer

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 16
_CHUNK = 1 << 16


class RunCatcher:
    """Maximal stretches of smallest period q with length >= max(min_length, min_exponent * q), over appended numbers.

    Any division into ``append`` calls gives the same runs. ``min_exponent`` is 4 or more: a shorter square needn't
    hold a whole block in its middle. Runs are (start, end, period).
    """

    def __init__(self, min_length: int = 6, min_exponent: int = 4, longest: int | None = None):
        if min_exponent < 4:
            raise ValueError("min_exponent must be 4 or more")
        self.min_length, self.min_exponent = min_length, min_exponent
        self.longest = longest  # no stretch of a single period is longer than this (the longest document)
        self.n = 0
        self._words, self._sums = np.zeros(1024, np.int64), np.zeros(1025, U64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []  # by level: starts and periods of caught squares
        self._runs: list[list[list[int]]] = []  # by level

    def append(self, words: np.ndarray) -> None:
        """Take further words, given as non-negative numbers (equal words: equal numbers)."""
        for at in range(0, len(words), _CHUNK):
            self._append(np.asarray(words[at : at + _CHUNK], np.int64))

    def _append(self, words: np.ndarray) -> None:
        before, n = self.n, self.n + len(words)
        if n > len(self._words):
            grown = max(n, 2 * len(self._words))
            self._words, self._sums = np.resize(self._words, grown), np.resize(self._sums, grown + 1)
        self._words[before:n] = words
        factor = powers(_BASE, len(words)) * U64(pow(_BASE, before, 2**64))
        self._sums[before + 1 : n + 1] = self._sums[before] + np.cumsum(mix(words.astype(U64) + U64(1)) * factor)
        self.n = n
        for run in itertools.chain.from_iterable(self._runs):
            if run[1] == before:
                run[1] = self._reach(run[2], before)
        level = 0
        while (size := 1 << level) * self.min_exponent <= min(n, self.longest or n):
            new = level == len(self._runs)  # the first words long enough for a level: its blocks so far are caught up with
            if new:
                self._runs.append([])
                self._waiting.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            self._catch(level, size, 0 if new else before)
            level += 1

    def _catch(self, level: int, size: int, before: int) -> None:
        sums, n = self._sums, self.n
        at = np.arange(max(size, before - size + 1), n - size + 1)  # suffixes of the block's size that are now complete
        block = ((at >> level) - 1) << level
        match = (sums[block + size] - sums[block]) * powers(_BASE, 2 * size)[at - block] == sums[at + size] - sums[at]
        start, period = block[match], (at - block)[match]
        new = ~self._inside(level, start, start + period + size)
        start = np.r_[self._waiting[level][0], start[new]]
        period = np.r_[self._waiting[level][1], period[new]]
        need = np.maximum(self.min_length, self.min_exponent * period) - size + 1
        ready = start + need <= n
        self._waiting[level] = start[~ready], period[~ready]
        start, period, need = start[ready], period[ready], need[ready]
        whole = ~self._inside(level, start, start + need)
        start, period, need = start[whole], period[whole], need[whole]
        rest = need - period
        shift = powers(_BASE, 2 * size)[period]
        same = (sums[start + rest] - sums[start]) * shift == sums[start + need] - sums[start + period]
        order = np.lexsort((start[same], period[same]))
        start, period = start[same][order], period[same][order]
        known: dict[int, list[list[int]]] = defaultdict(list)
        for run in self._runs[level]:
            known[run[2]].append(run)
        i = 0
        while i < len(start):
            a, q = int(start[i]), int(period[i])
            run = known[q][-1] if known[q] else None  # squares of a period come by start: no other run can hold this one
            if run is None or a + q > run[1]:
                run = [self._back(q, a), self._reach(q, a + q), q]
                if run[1] - run[0] >= 2 * q:  # else the sums misled
                    known[q].append(run)
                    self._runs[level].append(run)
            last = int(np.searchsorted(period, q, "right"))
            i += 1 + int(np.searchsorted(start[i + 1 : last], run[1] - q))  # squares inside the run are part of it

    def _inside(self, level: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each stretch lies in a run of a lower level, whose period is then a divisor."""
        lower = sorted(r for runs in self._runs[:level] for r in runs)
        if not lower or not len(start):
            return np.zeros(len(start), bool)
        begin = np.array([r[0] for r in lower])
        far = np.maximum.accumulate(np.array([r[1] for r in lower]))
        at = np.searchsorted(begin, start, "right") - 1
        return (at >= 0) & (far[np.maximum(at, 0)] >= end)

    def _reach(self, period: int, at: int) -> int:
        """The first word from ``at`` on that differs from the word ``period`` before it."""
        step = 64
        while at < self.n:
            end = min(self.n, at + step)
            odd = np.flatnonzero(self._words[at:end] != self._words[at - period : end - period])
            if len(odd):
                return at + int(odd[0])
            at, step = end, 2 * step
        return at

    def _back(self, period: int, at: int) -> int:
        """The first word of the stretch to the left of ``at`` whose words equal those ``period`` later."""
        step = 64
        while at > 0:
            begin = max(0, at - step)
            odd = np.flatnonzero(self._words[begin:at] != self._words[begin + period : at + period])
            if len(odd):
                return begin + int(odd[-1]) + 1
            at, step = begin, 2 * step
        return at

    def runs(self) -> list[tuple[int, int, int]]:
        """The runs of the words so far, by start, then period."""
        return sorted((s, e, q) for runs in self._runs for s, e, q in runs if e - s >= max(self.min_length, self.min_exponent * q))


def word_numbers(text: bytes, number: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers, piece by piece; ``number`` gives each new word the next number."""
    parts, at = [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + _PIECE)
        end = cut.start() if cut else len(text)
        found = text[at:end].split()  # bytes split at exactly [\x20\x09-\x0D]
        parts.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def dropped_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of ``n`` words lies in some run after that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, end, period in runs:
        edge[start + period] += 1
        edge[end] -= 1
    return np.cumsum(edge[:-1]) > 0


def _of_slice(texts: list[bytes], min_length: int, min_exponent: int) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """(number of words, runs, text without repeated periods) of each text."""
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    docs = [word_numbers(t, number) for t in texts]
    words, longest = list(number), max((len(d) for d in docs), default=0)
    catcher = RunCatcher(min_length, min_exponent, longest)
    parted = [part for k, ids in enumerate(docs) for part in (ids, [len(words) + k])]  # a word of its own after each document
    catcher.append(np.concatenate(parted) if docs else np.zeros(0, np.int64))
    begins = np.cumsum([0, *(len(d) + 1 for d in docs[:-1])]).tolist()
    found, all_runs = 0, catcher.runs()
    for begin, ids in zip(begins, docs):
        runs = []
        while found < len(all_runs) and all_runs[found][0] < begin + len(ids):
            s, e, q = all_runs[found]
            runs.append((s - begin, e - begin, q))
            found += 1
        kept = ids[~dropped_words(len(ids), runs)] if runs else ids
        text = b" ".join(b" ".join(map(words.__getitem__, kept[at : at + _CHUNK].tolist())) for at in range(0, len(kept), _CHUNK))
        yield len(ids), runs, text.decode()


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed (the text without repeats) of every row.

    Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``. A run is a stretch of words with smallest period q (words q
    apart are identical) and at least ``max(min_length, min_exponent * q)`` words that can't be extended. ``collapsed``
    joins by one space the words that no run contains after its first q words. Null and empty texts have no words, no
    runs and an empty ``collapsed``; repeated rows and null ids are rows like any other; further columns are ignored.
    A text of any length is held by one task.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for first, last in slices(offsets):
                found = list(_of_slice([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(first, last)], min_length, min_exponent))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array([[{"start": s, "length": e - s, "period": q} for s, e, q in x[1]] for x in found], kind),
                        pa.array([x[2] for x in found], pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    id_kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {id_kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
