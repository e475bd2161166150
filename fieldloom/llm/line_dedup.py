"""Line dedup: drop lines whose key repeats across documents, as compressed keep bitmaps.

Line keys are hashed in the JVM and range-partitioned by (hash, document, position), so that even one line that a
third of all documents hold spreads over several partitions. Each partition streams its sorted run; the few keys that
cross a partition border are settled from border summaries (two rows a partition). What leaves the stream is the
dropped places, gathered as one zlib-packed bitmap for each document; the texts are not part of it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.scan import free_names
from fieldloom.session import cut, shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, ASCII letters in lower case."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """h1, h2 (128 bits of the key), doc, copy (digest of the whole text), pos: one row for each line that may go."""
    body = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.where(F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("doc"), F.xxhash64(body).alias("copy"), F.posexplode(F.split(body, "\n", -1)))
        .select("doc", "copy", "pos", line_key(F.col("col")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2"), "doc", "copy", "pos")
    )


def _runs(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    h1, h2, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc"))
    new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
    new_doc = new_key | np.r_[True, doc[1:] != doc[:-1]]
    return h1, h2, doc, new_key, new_doc


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one sorted partition: for its first and its last key the first and last document and the documents' number."""
    from pyspark import TaskContext

    part, first, last = TaskContext.get().partitionId(), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, new_key, new_doc = _runs(batch)
        edges = np.r_[np.flatnonzero(new_key), len(h1)]
        for s in sorted({0, len(edges) - 2}):
            lo, hi = edges[s], edges[s + 1]
            run = [int(h1[lo]), int(h2[lo]), int(doc[lo]), int(doc[hi - 1]), int(new_doc[lo:hi].sum())]
            if last and last[:2] == run[:2]:  # the run goes on from the batch before
                last[4] += run[4] - (last[3] == run[2])
                last[3] = run[3]
            else:
                last = run
                first = first or run
    rows = [] if first is None else [first] if first is last else [first, last]
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(rows), pa.int32())] + [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)],
            ["part", "h1", "h2", "top", "low", "docs"],
        )


def _settle(rows: list) -> dict[tuple[int, int], tuple[int, int]]:
    """Key -> (largest document, number of documents), for the keys at partition borders."""
    keys: dict[tuple[int, int], list[int]] = {}
    for r in sorted(rows, key=lambda r: r.part):
        known = keys.get((r.h1, r.h2))
        if known is None:
            keys[r.h1, r.h2] = [r.top, r.docs, r.low]
        else:
            known[1] += r.docs - (known[2] == r.top)  # a document cut by the border counts once
            known[2] = r.low
    return {k: (top, docs) for k, (top, docs, _) in keys.items()}


def _dropped(borders: dict, min_docs: int):
    """Streams the lines to drop of one sorted partition; a run is told by its first row, the largest document."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last run so far, while too few documents are known
        known = dict(borders)  # key -> (largest document, number of documents); holds every partition's last key
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            h1, h2, doc, new_key, new_doc = _runs(table)
            starts = np.flatnonzero(new_key)
            docs, top = np.add.reduceat(new_doc.astype(np.int64), starts), doc[starts].copy()
            for s in {0, len(starts) - 1}:
                key = int(h1[starts[s]]), int(h2[starts[s]])
                if key in known:
                    top[s], docs[s] = known[key]
                elif s == len(starts) - 1 and docs[s] >= min_docs:
                    known = borders | {key: (int(top[s]), int(docs[s]))}
            wait = starts[-1] if docs[-1] < min_docs and (int(h1[-1]), int(h2[-1])) not in borders else len(h1)
            held = table.slice(wait) if wait < len(h1) else None
            run = np.cumsum(new_key) - 1
            gone = ((docs[run] >= min_docs) & (doc != top[run]))[:wait]
            if gone.any():
                yield from table.slice(0, wait).select(["doc", "copy", "pos"]).filter(pa.array(gone)).to_batches()

    return stream


def pack(positions: list[int]) -> bytes:
    """Dropped positions as a zlib-packed bitmap of kept lines (1: kept) up to the last dropped one."""
    bits = np.ones((max(positions) // 8 + 1) * 8, np.uint8)
    bits[np.asarray(positions)] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    """One boolean a line; lines beyond the bitmap are kept."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines].astype(bool)
    return np.r_[bits, np.ones(n_lines - len(bits), bool)]


def _pack_all(positions: pd.Series) -> pd.Series:
    return positions.map(pack)


def keep_bitmaps(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """(doc, copy, n_dropped, bitmap) of each document that loses lines; ``copy`` is the digest of its text.

    A line's key is the line without white space at its ends, ASCII letters in lower case. Keys of at least
    ``min_chars`` code points that at least ``min_docs`` documents hold lose all lines but those of the largest
    document. Rows with the same id count as one document. Null ids take no part; null texts are one empty line.
    """
    spark = docs.sparkSession
    parts = 2 * shuffle_partitions(spark)
    lines = cut(_lines(docs, doc_id, text, min_chars))  # the range sampling reads it a second time
    ranged = cut(
        lines.repartitionByRange(parts, "h1", "h2", F.desc("doc"), "pos").sortWithinPartitions(
            "h1", "h2", F.desc("doc"), "pos"
        )
    )
    borders = _settle(
        ranged.select("h1", "h2", "doc")
        .mapInArrow(_borders, "part int, h1 long, h2 long, top long, low long, docs long")
        .collect()  # two rows a partition
    )
    gone = ranged.mapInArrow(_dropped(borders, min_docs), "doc long, copy long, pos int")
    return gone.groupBy("doc", "copy").agg(
        F.countDistinct("pos").cast("long").alias("n_dropped"), F.pandas_udf(_pack_all, "binary")(F.collect_set("pos")).alias("bitmap")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str, str]:
    """The rows of ``docs`` with their bitmap and number of dropped lines (null where nothing goes), joined by id and text
    digest, and the names of these two columns, which are none of ``docs``."""
    doc, copy, digest, bitmap, dropped = free_names(docs.columns, "_doc", "_copy", "_digest", "_bitmap", "_dropped")
    keyed = docs.withColumn(copy, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    marks = bitmaps.select(F.col("doc").alias(doc), F.col("copy").alias(digest), F.col("bitmap").alias(bitmap), F.col("n_dropped").alias(dropped))
    return keyed.join(marks, (keyed[doc_id] == marks[doc]) & (keyed[copy] == marks[digest]), "left").drop(copy, doc, digest), bitmap, dropped


def kept_text(text: str | None, bitmap: bytes | None) -> str:
    if bitmap is None:
        return text or ""
    lines = (text or "").split("\n")
    keep = unpack(bitmap, len(lines))
    return "\n".join(x for x, k in zip(lines, keep) if k)


def with_kept_text(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; all other columns stay as they are."""
    joined, bitmap, _ = apply_bitmaps(docs, bitmaps, doc_id, text)
    schema = docs.schema

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column(text), batch.column(bitmap)
            new = [
                t if b is None else kept_text(t, b) for t, b in zip(texts.to_pylist(), marks.to_pylist())
            ]
            columns = [pa.array(new, pa.string()) if c == text else batch.column(c) for c in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return joined.select(*[F.col(f"`{c}`") for c in schema.names], bitmap).mapInArrow(rebuild, schema)


def line_dedup_digests(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row, from the bitmaps applied to the whole texts."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked, bitmap, dropped = apply_bitmaps(slim, keep_bitmaps(slim, "doc_id", "text", min_chars, min_docs))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, sums = [], []
            for t, b in zip(batch.column("text"), batch.column(bitmap)):
                t = t.as_py() or ""
                lines.append(t.count("\n") + 1)
                sums.append(hashlib.sha256(kept_text(t, b.as_py()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lines, pa.int64()), batch.column("n_dropped"), pa.array(sums, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return marked.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", bitmap, F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped")
    ).mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
