"""Benchmark decontamination: item-sized windows by SimHash and multi-index Hamming blocks, verified exactly.

Each benchmark item is a bag of five-word shingles. A document window of the item's length is contaminated if the
weighted Jaccard similarity of the two bags reaches the threshold. Windows that share no shingle with any item of their
length have similarity 0 and are passed over; the others get a 128-bit SimHash of their shingles. Fingerprints are cut into
eight blocks of 16 bits: of two fingerprints within 31 bits one block differs in 3 bits at most. The index holds every
item under all values within 2 bits of its blocks, and a window asks for all values within 1 bit of its own, so that no
item within the radius is missed. What is found and is within the radius is verified on the bags themselves.

The radius bounds the search, the verification decides. Bags at similarity 0.8 are 19 bits apart on average, with a
deviation of 4; a test holds the share of similar windows within the radius above 0.99.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.scan import U64, gather, mix, shingles, slices, text_buffer, words

#: Everything of ASCII but letters and digits separates words.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SHINGLE = 5
BITS, BLOCK_BITS, RADIUS = 128, 16, 31
BLOCKS = BITS // BLOCK_BITS
#: Items in one index, about 8 KB an item in a task, and indexes that one pass over the documents searches.
INDEX_ITEMS, PASS_INDEXES = 4096, 8
_FILTER_BITS = 22
_SPAN = 1 << 14


def nearby(bits: int) -> np.ndarray:
    """All block masks with at most ``bits`` bits set."""
    some = [sum(1 << k for k in c) for n in range(bits + 1) for c in itertools.combinations(range(BLOCK_BITS), n)]
    return np.array(some, np.uint16)


#: Two fingerprints within the radius have a block within RADIUS // BLOCKS bits: these are shared out.
ASKED, HELD = nearby(1), nearby(RADIUS // BLOCKS - 1)


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words of a text column, in lower case."""
    data, offsets = text_buffer(pc.utf8_lower(column))
    return words(data, offsets, SIGNS)[:2]


def simhash(groups: np.ndarray) -> np.ndarray:
    """Fingerprints, two 64-bit integers each, of rows of hashes: the majority of their bits."""
    wide = np.stack([groups, mix(groups ^ U64(0x2545F4914F6CDD1D))], axis=2)
    ones = np.unpackbits(wide.view(np.uint8).reshape(*groups.shape, BITS // 8), axis=2).sum(axis=1, dtype=np.int32)
    return np.packbits(ones * 2 > groups.shape[1], axis=1).view(U64)


def window_starts(at: np.ndarray, row: np.ndarray, first: np.ndarray, length: int, size: int) -> np.ndarray:
    """Starts of all windows of ``length`` words that lie in a row and hold a shingle at one of ``at`` (ascending)."""
    own = row[at]
    low, high = np.maximum(at - length + size, first[own]), np.minimum(at, first[own + 1] - length)
    low, high = low[low <= high], high[low <= high]
    low[1:] = np.maximum(low[1:], high[:-1] + 1)  # intervals rise with the shingles: what they share counts once
    return gather(np.arange(len(row)), low, np.maximum(high - low + 1, 0)) if len(low) else low


def window_prints(value: np.ndarray, windows: np.ndarray, places: int) -> np.ndarray:
    """``simhash`` of the ``places`` hashes from each of the windows on (ascending), by running counts of every bit.

    Memory follows the part of the row that the windows cover, not windows times places.
    """
    out = np.zeros((len(windows), BITS // 64), U64)
    k = 0
    while k < len(windows):
        end = int(np.searchsorted(windows, windows[k] + _SPAN))
        some = windows[k:end]
        covered = int(some[-1] - some[0]) + places
        if len(some) * places <= covered or len(some) == 1 and places <= _SPAN:
            out[k:end] = simhash(value[some[:, None] + np.arange(places)])
        else:
            ones, at = np.zeros((len(some), BITS), np.int32), int(some[0])
            running = np.zeros(BITS, np.int32)
            begin, until = some - at, some - at + places
            for p in range(0, covered, _SPAN):  # counts before each place, a stretch at a time
                part = value[at + p : at + min(p + _SPAN, covered)]
                wide = np.stack([part, mix(part ^ U64(0x2545F4914F6CDD1D))], axis=1)
                before = np.zeros((len(part) + 1, BITS), np.int32)
                np.cumsum(np.unpackbits(wide.view(np.uint8), axis=1), axis=0, out=before[1:], dtype=np.int32)
                before += running
                here = (until > p) & (until <= p + len(part))
                ones[here] += before[until[here] - p]
                here = (begin > p) & (begin <= p + len(part))
                ones[here] -= before[begin[here] - p]
                running = before[-1]
            out[k:end] = np.packbits(ones * 2 > places, axis=1).view(U64)
        k = end
    return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class BlockIndex:
    """Multi-index of fingerprints: for each block the values within reach of an item, ascending, and their items."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.tables = []
        for values in prints.view(np.uint16).reshape(-1, BLOCKS).T:
            near = (values[:, None] ^ HELD).ravel()
            order = np.argsort(near, kind="stable")
            self.tables.append((near[order], order // len(HELD)))

    def within(self, asked: np.ndarray) -> np.ndarray:
        """(row, item, Hamming distance) of all pairs within the radius, ordered."""
        pairs = []
        for (keys, items), values in zip(self.tables, asked.view(np.uint16).reshape(-1, BLOCKS).T):
            near = (values[:, None] ^ ASKED).ravel()
            lo, hi = np.searchsorted(keys, near, "left"), np.searchsorted(keys, near, "right")
            row = np.repeat(np.arange(len(near)) // len(ASKED), hi - lo)
            pairs.append(row * len(self.prints) + gather(items, lo, hi - lo))
        row, item = np.divmod(np.unique(np.concatenate(pairs)), len(self.prints))
        distance = apart(asked[row], self.prints[item])
        return np.stack([row, item, distance], axis=1)[distance <= RADIUS]


def sequence(word: np.ndarray) -> np.ndarray:
    """The shingles of a word sequence, one after the other."""
    return shingles(np.zeros(len(word), np.int64), word, SHINGLE)[1]


def bag(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a word sequence and their counts."""
    return np.unique(sequence(word), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][at], b[1][bt]).sum())
    return both / max(int(a[1].sum() + b[1].sum()) - both, 1)


@dataclass
class Items:
    """A block of benchmark items, ready to be searched: sent to the tasks, about 1 KB an item."""

    ids: list = field(default_factory=list)
    bags: list = field(default_factory=list)
    #: length in words -> (item numbers, fingerprints)
    by_length: dict = field(default_factory=dict)
    #: length in words -> block index, built by the task that needs it
    indexes: dict = field(default_factory=dict)
    #: shingle length -> (sorted shingles, length of their item), one row for each pair
    anchors: dict = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        out, found = cls(), {}
        row, word = text_words(pa.array([t for _, t in rows], pa.string()))
        lengths: dict[int, list[int]] = {}
        for k, (item, _) in enumerate(rows):
            own = word[row == k]
            if not len(own):
                continue
            n = len(out.ids)
            out.ids.append(item)
            out.bags.append(bag(own))
            lengths.setdefault(len(own), []).append(n)
            found.setdefault(min(SHINGLE, len(own)), []).extend((int(v), len(own)) for v in out.bags[n][0])
            out.by_length.setdefault(len(own), []).append(sequence(own))
        for length, numbers in lengths.items():
            out.by_length[length] = (np.array(numbers), simhash(np.stack(out.by_length[length])))
        for size, pairs in found.items():
            pairs = sorted(set(pairs))
            values = np.array([v for v, _ in pairs], U64)
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[values >> U64(64 - _FILTER_BITS)] = True
            out.anchors[size] = (values, np.array([n for _, n in pairs]), np.packbits(seen).tobytes())
        return out

    def search(self, row: np.ndarray, word: np.ndarray, threshold: float) -> dict[tuple[int, int], tuple[float, int, int, int]]:
        """(row, item number) -> (similarity, word position in the row, Hamming distance, words) of the best window.

        A row shorter than an item is its one window for it.
        """
        starts: dict[int, list[np.ndarray]] = {}
        following: dict[int, np.ndarray] = {}  # shingle length -> the shingle that begins at a word
        short: dict[int, set[int]] = {}  # item length -> shorter documents that may come up to the threshold as a whole
        first = np.searchsorted(row, np.arange(row[-1] + 2)) if len(row) else np.zeros(1, np.int64)
        for size, (values, lengths, packed) in self.anchors.items():
            seen = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
            at, value = shingles(row, word, size, short=False)
            following[size] = np.zeros(len(word), U64)
            following[size][at] = value
            maybe = seen[value >> U64(64 - _FILTER_BITS)]
            at, value = at[maybe], value[maybe]
            lo, hi = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            while len(at):
                for length in np.unique(lengths[lo]):
                    p = at[lengths[lo] == length]
                    starts.setdefault(int(length), []).append(window_starts(p, row, first, int(length), size))
                    docs = np.unique(row[p])
                    n = first[docs + 1] - first[docs]
                    near = (n < length) & (n - size + 1 >= threshold * (length - size + 1))
                    short.setdefault(int(length), set()).update(docs[near].tolist())
                lo = lo + 1
                at, lo, hi = at[lo < hi], lo[lo < hi], hi[lo < hi]
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for length, parts in starts.items():
            numbers, prints = self.by_length[length]
            if length not in self.indexes:
                self.indexes[length] = BlockIndex(prints)
            windows = np.unique(np.concatenate(parts))
            size = min(SHINGLE, length)
            places = length - size + 1
            for k in range(0, len(windows), _SPAN):
                some = windows[k : k + _SPAN]
                found = self.indexes[length].within(window_prints(following[size], some, places))
                owner, item = row[some[found[:, 0]]], found[:, 1]
                order = np.lexsort((found[:, 0], item, owner))
                edges = np.flatnonzero(np.r_[True, (owner[order][1:] != owner[order][:-1]) | (item[order][1:] != item[order][:-1])]) if len(found) else order
                for group in np.split(order, edges[1:]) if len(found) else ():
                    doc, number = int(owner[group[0]]), int(numbers[item[group[0]]])
                    self._verify(best, (doc, number), word, following[size], some[found[group, 0]], found[group, 2], first[doc], length, places, threshold)
        for length, docs in short.items():
            numbers, prints = self.by_length[length]
            for doc in docs:
                own = word[first[doc] : first[doc + 1]]
                distance, own_bag = apart(simhash(sequence(own)[None]), prints), bag(own)
                for i in np.flatnonzero(distance <= RADIUS).tolist():
                    score = similarity(own_bag, self.bags[numbers[i]])
                    if score >= threshold:
                        best[doc, int(numbers[i])] = (score, 0, int(distance[i]), len(own))
        return best

    def _verify(self, best, pair, word, following, windows, distances, first, length, places, threshold) -> None:
        """The best of the windows of a document that are near an item, the likeliest first.

        A window shares no more than its shingles that the item has: the rest needn't be looked at once that is too few.
        """
        own_bag = self.bags[pair[1]]
        low = int(windows[0])
        hits = np.zeros(int(windows[-1]) - low + places + 1, np.int64)
        np.cumsum(np.isin(following[low : int(windows[-1]) + places], own_bag[0]), out=hits[1:])
        most = hits[windows - low + places] - hits[windows - low]
        bound = most / np.maximum(2 * places - most, 1)
        for k in np.lexsort((windows, -bound)).tolist():
            known = best.get(pair)
            if bound[k] < threshold or (known is not None and bound[k] < known[0]):
                break
            score = similarity(bag(word[windows[k] : windows[k] + length]), own_bag)
            if score >= threshold:
                new = (score, int(windows[k] - first), int(distances[k]), int(length))
                if known is None or (-new[0], new[1]) < (-known[0], known[1]):
                    best[pair] = new


def _passes(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[Items]]:
    """The benchmark in lists of at most PASS_INDEXES indexes of about INDEX_ITEMS items; the driver holds one list."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where(
        "item_id is not null and text is not null"
    )
    count = -(-items.count() // (INDEX_ITEMS * PASS_INDEXES))
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").collect()
        found = [(r.item_id, r.text) for r in rows]
        yield [Items.of(found[a : a + INDEX_ITEMS]) for a in range(0, len(found), INDEX_ITEMS)]


def _scan(column: pa.Array, indexes: list[Items], threshold: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(row, item id, similarity, position, distance, words) of a batch's texts, slice by slice."""
    _, offsets = text_buffer(column)
    for a, b in slices(offsets):
        row, word = text_words(column.slice(a, b - a))
        for items in indexes:
            for (doc, item), (score, at, distance, words) in items.search(row, word, threshold).items():
                yield a + doc, items.ids[item], score, at, distance, words


def contaminated_windows(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, similarity, position, n_words, distance): the best window of each contaminated pair.

    Best: the highest similarity, then the first position (in words, from 0). Null ids, null or wordless texts and
    wordless items take no part; rows with the same id count as one document; repeated items each give rows, the same
    item id once. Documents are read once for each 32,768 items and never shuffled; a text is held by one task as a whole.
    An empty table on either side gives no rows.
    """
    slim = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, similarity double, position int, n_words int, distance int"
    out = None
    for indexes in _passes(benchmark, "item_id", "text"):

        def search(batches: Iterator[pa.RecordBatch], indexes: list[Items] = indexes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.column("doc_id")
                found = list(_scan(batch.column("text"), indexes, threshold))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            names.take(pa.array([f[0] for f in found])),
                            pa.array([f[1] for f in found], pa.int64()),
                            pa.array([f[2] for f in found]),
                            pa.array([f[3] for f in found], pa.int32()),
                            pa.array([f[5] for f in found], pa.int32()),
                            pa.array([f[4] for f in found], pa.int32()),
                        ],
                        ["doc_id", "item_id", "similarity", "position", "n_words", "distance"],
                    )

        part = slim.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max_by(F.struct("similarity", "position", "n_words", "distance"), F.struct("similarity", -F.col("position")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no contaminated window; rows and columns are otherwise as they were."""
    schema = docs.schema
    for indexes in _passes(benchmark, "item_id", "text"):

        def clean(batches: Iterator[pa.RecordBatch], indexes: list[Items] = indexes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in _scan(batch.column(text), indexes, threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, schema)
    return docs
