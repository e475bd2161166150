"""Toxicity by compression distance with two trained zstandard dictionaries.

One dictionary is trained on ordinary sample texts, the other on the passages of toxic sample texts that ordinary texts
hardly have: the runs of character grams that are found in many different contexts and mostly in toxic texts. (Counting
contexts instead of occurrences keeps copies from looking typical.) A window is a word with a fixed preamble behind it,
compressed with either; the toxic side knows both dictionaries, so that the difference in length is what the toxic one
saves. The preamble makes the shortest window compressible. Saved bytes are turned into likelihood ratios, and a logistic
regression over a document's windows, fitted on a part of the sample that trained no dictionary, gives its calibrated score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.scan import CASED_VALUE, SPACE, hashes, mix, slices, text_buffer, words
from fieldloom.llm.word_ids import KeptIds

LONGEST = 64  # bytes of a window; longer words are cut
LOW, HIGH = -6, 14  # saved bytes are clipped to this range
BINS = HIGH - LOW + 1
PREAMBLE = bytes(range(128, 256))
GRAM, CONTEXT = 6, 8  # bytes
KEPT_WINDOWS = 300_000


@dataclass(frozen=True)
class Limits:
    """Bounds of the fit's sample and sizes of its dictionaries. Every document is scored over its whole text."""

    toxic_rows: int = 2000  # labelled documents to fit on, those with the smallest hash
    ordinary_rows: int = 4000
    row_bytes: int = 3000  # times the rows of a class: the bytes of their texts
    toxic_bytes: int = 8192  # of dictionary
    ordinary_bytes: int = 32768
    z: float = 6.0  # least deviation of a gram's share of toxic contexts, in standard errors
    share: float = 0.6  # least share of toxic contexts
    contexts: int = 3  # least number of toxic contexts


@dataclass(frozen=True)
class Model:
    toxic: bytes  # contents of the trained dictionaries
    ordinary: bytes
    ratio: np.ndarray  # log likelihood ratio by saved bytes
    weights: np.ndarray | None  # None: a constant score
    prior: float


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, byte after the last) of the words of texts, longer ones in pieces of LONGEST bytes."""
    row, _, start, stop = words(data, offsets, SPACE, CASED_VALUE)
    pieces = np.maximum(-(-(stop - start) // LONGEST), 1)
    step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    row, start, stop = np.repeat(row, pieces), np.repeat(start, pieces) + LONGEST * step, np.repeat(stop, pieces)
    return row, start, np.minimum(stop, start + LONGEST)


class Saver:
    """Counts of windows by the bytes that the toxic dictionary saves; a worker's bounded table remembers windows."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as z

        settings = z.ZstdCompressionParameters(
            strategy=z.STRATEGY_GREEDY, min_match=5, hash_log=16, chain_log=16, search_log=5, window_log=17,
            write_checksum=0, write_content_size=0, write_dict_id=0,
        )

        def compressor(content: bytes):
            known = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=settings)
            return z.ZstdCompressor(compression_params=settings, dict_data=known).compress

        self.toxic, self.ordinary = compressor(toxic + ordinary + PREAMBLE), compressor(ordinary + PREAMBLE)
        self.kept = KeptIds(KEPT_WINDOWS)

    def _saved(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        toxic, ordinary = self.toxic, self.ordinary
        saved = [len(ordinary(w)) - len(toxic(w)) for w in (b" %b %b" % (x, PREAMBLE) for x in found)]
        return (np.clip(np.array(saved, np.int64), LOW, HIGH) - LOW).astype(np.uint32), np.ones(len(found), np.int64)

    def counts(self, column: pa.Array) -> np.ndarray:
        """One row of counts for each text; none for null and blank texts."""
        _, offsets = text_buffer(column)
        out = []
        for a, b in slices(offsets):
            part, ends = text_buffer(pc.utf8_lower(column.slice(a, b - a)))
            row, start, stop = windows(part, ends)
            raw = part.tobytes()
            names, first, again = np.unique(hashes(part, start, stop, CASED_VALUE), return_index=True, return_inverse=True)
            flat, at, _ = self.kept.find(names, lambda new: self._saved([raw[start[i] : stop[i]] for i in first[new]]))
            rows = b - a
            bins = flat[at][again] if len(row) else np.zeros(0, np.int64)
            out.append(np.bincount(row * BINS + bins, minlength=rows * BINS).reshape(rows, BINS))
        return np.concatenate(out) if out else np.zeros((0, BINS), np.int64)


def features(counts: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Of documents (rows of window counts), what a weight vector is applied to.

    The constant, the sum of the windows' ratios as such and by the root of their number, the sum of the three largest
    ones, the largest one, and the logarithm of the number of windows.
    """
    counts = counts.astype(float)
    n = counts.sum(1)
    total = counts @ ratio
    order = np.argsort(-ratio, kind="stable")
    left = 3 - np.cumsum(counts[:, order], 1) + counts[:, order]
    top = np.clip(np.minimum(counts[:, order], left), 0, None) @ ratio[order]
    best = np.where(n > 0, ratio[order][np.argmax(counts[:, order] > 0, 1)], 0.0)
    return np.stack([np.ones(len(n)), total / 5, total / np.sqrt(np.maximum(n, 1)), top, best, np.log1p(n)], 1)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def telling_passages(texts: list[bytes], toxic: list[int], limits: Limits) -> list[bytes]:
    """The runs of toxic texts that are covered by grams with mostly toxic contexts (the bytes before the gram)."""
    data = np.frombuffer(b"".join(bytes(CONTEXT) + t for t in texts), np.uint8)
    if len(data) < GRAM + CONTEXT:
        return []
    label = np.repeat(np.array(toxic, bool), [len(t) + CONTEXT for t in texts])[CONTEXT : 1 - GRAM]
    part = np.zeros(len(label), np.uint8)  # grams are counted an eighth at a time
    for k in range(GRAM):
        part += data[CONTEXT + k : CONTEXT + k + len(label)] * np.uint8(2 * k + 1)
    part >>= np.uint8(5)

    def packed(at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(n):
            out |= data[at + k].astype(np.uint64) << np.uint64(8 * k)
        return out

    counted = []
    for k in range(8):
        at = np.flatnonzero(part == k)
        gram = packed(at + CONTEXT, GRAM)
        _, once = np.unique(mix(mix(gram) ^ packed(at, CONTEXT)), return_index=True)
        grams, back = np.unique(gram[once], return_inverse=True)
        counted.append((grams, np.bincount(back, label[at[once]], len(grams)), np.bincount(back, minlength=len(grams))))
    share = sum(a.sum() for _, a, _ in counted) / max(sum(n.sum() for _, _, n in counted), 1)
    spread = max(share * (1 - share), 1e-9)
    covered = np.zeros(len(data) + 1, bool)
    for k, (grams, a, n) in enumerate(counted):
        mostly = (a >= limits.contexts) & (a >= limits.share * n) & (a - n * share >= limits.z * np.sqrt(n * spread))
        at = np.flatnonzero((part == k) & label)
        hit = at[np.isin(packed(at + CONTEXT, GRAM), grams[mostly])] + CONTEXT
        for j in range(GRAM):
            covered[hit + j] = True
    edges = np.flatnonzero(np.diff(np.r_[False, covered].astype(np.int8)))
    return [data[a:b].tobytes() for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def train(samples: list[bytes], size: int, k: int) -> bytes:
    """Content of a dictionary of at most ``size`` bytes trained by zstandard.

    Too few samples for its trainer are a dictionary as they are, the last ``size`` bytes of them.
    """
    import zstandard as z

    try:
        whole = z.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]
    # The entropy tables end with three repeat offsets; what follows them is the content.
    start = whole.find(b"".join(x.to_bytes(4, "little") for x in (1, 4, 8)))
    return whole[start + 12 :]


def fit_sample(docs: DataFrame, labels: DataFrame, limits: Limits) -> tuple[list[tuple[str, int]], float]:
    """((text, toxic) of the bounded sample outside the held-out third, share of toxic ones among all labels there)."""
    known = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    )
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    bounds = ((1, limits.toxic_rows), (0, limits.ordinary_rows))
    some = [known.where(F.col("toxic") == y).orderBy(*order).limit(n) for y, n in bounds]
    chosen = some[0].unionByName(some[1])
    rows = docs.where("text is not null").join(F.broadcast(chosen), "doc_id")  # at most toxic_rows + ordinary_rows ids
    by_hash = W.partitionBy("toxic").orderBy(*order, F.xxhash64("text"))
    rows = rows.select("doc_id", "toxic", "text", F.row_number().over(by_hash).alias("n"), F.sum(F.octet_length("text")).over(by_hash).alias("bytes"))
    most = F.when(F.col("toxic") == 1, limits.toxic_rows).otherwise(limits.ordinary_rows)
    kept = rows.where((F.col("n") <= most) & (F.col("bytes") <= most * limits.row_bytes)).select("toxic", "n", "text").collect()
    return [(r.text, r.toxic) for r in sorted(kept, key=lambda r: (r.n, r.toxic))], prior


def fit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> Model:
    """Dictionaries and calibration from the bounded sample, which is all that reaches the driver."""
    sample, prior = fit_sample(docs, labels, limits)
    constant = Model(b"", b"", np.zeros(BINS), None, prior)
    if len({y for _, y in sample}) < 2:
        return constant
    own = [(t, y) for k, (t, y) in enumerate(sample) if k % 8 < 6]
    rest = [(t, y) for k, (t, y) in enumerate(sample) if k % 8 >= 6]
    if any(len({y for _, y in half}) < 2 for half in (own, rest)):
        own = rest = sample
    distinct = sorted(set(own))
    texts = [b" %b " % b" ".join(t.lower().encode().split()) for t, _ in distinct]
    toxic = train(telling_passages(texts, [y for _, y in distinct], limits), limits.toxic_bytes, 16)
    if not toxic:
        return constant
    plain = [t[i : i + 128] for t, (_, y) in zip(texts, distinct) if not y for i in range(0, len(t), 128)]
    ordinary = train(plain, limits.ordinary_bytes, 64)
    x, y = Saver(toxic, ordinary).counts(pa.array([t for t, _ in rest])), np.array([y for _, y in rest])
    odds = [(x[y == v].sum(0) + 1) / (x[y == v].sum() + BINS) for v in (0, 1)]
    ratio = np.log(odds[1] / odds[0])
    weights = logistic(features(x, ratio), y)
    weights[0] += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))  # the classes' shares in the sample are set
    return Model(toxic, ordinary, ratio, weights, prior)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1) of each whole text; null and blank texts have no windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        saver = Saver(model.toxic, model.ordinary) if model.weights is not None else None
        for batch in batches:
            if saver is None:
                found = np.full(batch.num_rows, model.prior)
            else:
                found = 1 / (1 + np.exp(-np.clip(features(saver.counts(batch.column(text)), model.ratio) @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, score])

    if score in docs.columns:
        raise ValueError(f"the table has a column {score}: name another one for the score")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below the threshold; columns stay as they are."""
    score = "score"
    while score in docs.columns:
        score = f"_{score}"
    return score_toxicity(docs, model, text, score).where(F.col(score) < threshold).drop(score)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, limits: Limits = Limits()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text; other columns are ignored).

    Held out: crc32 of the id as text leaves 1 when divided by 3 (null ids: no). Labels outside 0 and 1 and null ids
    are not learnt from; several labels of one id count as the largest. Without toxic and ordinary labelled rows, or
    without passages that tell them apart, the score is the share of toxic ones (0 without any). Equal texts get equal
    scores; an empty table gives no rows.
    """
    slim = docs.select("doc_id", "text")
    scored = score_toxicity(slim, fit(slim, labels, limits))
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
