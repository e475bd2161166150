"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank in the corpus (0: most frequent), and ranks take 1 to 4 bytes. Two bits a value, four
values to a control byte, tell the length; control bytes and data bytes are kept apart, so decoding is a table lookup
on the control bytes and one masked copy. Blocks are rows of a Parquet table: Spark's own writer commits them, survives
lost executors, and any store that Spark reads can hold them.

One block: magic, version, number of documents, number of ids, then the documents' ids count (unsigned 32-bit),
control bytes, data bytes. All integers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm.word_ids import WordIds
from fieldloom.session import remove, shared_dir, shuffle_partitions

HEADER = struct.Struct("<4sIII")
MAGIC = b"RKVB"
#: Ids in a block: bounds what a task holds (one document may be longer).
BLOCK_IDS = 1 << 20
#: For each control byte the four lengths.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def encode_block(counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    return HEADER.pack(MAGIC, 1, len(counts), len(ranks)) + counts.astype("<u4").tobytes() + control + data


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids count of each document, ranks)."""
    magic, version, docs, n = HEADER.unpack_from(block)
    if magic != MAGIC or version != 1:
        raise ValueError("not a block of ranked ids")
    at = HEADER.size + 4 * docs
    counts = np.frombuffer(block, "<u4", docs, HEADER.size)
    control = block[at : at + -(-n // 4)]
    return counts, decode_ranks(control, block[at + len(control) :], n)


def id_type(tokenizer: str, end_id: int) -> str:
    size = WordIds.load(tokenizer).tokenizer.get_vocab_size()
    return "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"


def token_table(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, ids binary) of every row, each document with the end id; ids take 2 bytes where all fit, else 4.

    Null and empty texts have the end id alone; equal or null ids change nothing.
    """
    kind = id_type(tokenizer, end_id)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.load(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids = words.ids(part.column("text"), end_id, kind)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        tokenise, "doc_id long, ids binary"
    )


def _counter(kind: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            column = batch.column("ids")
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            if not len(column) or column.buffers()[2] is None:
                continue
            more = np.bincount(np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind))
            if len(more) > len(total):
                total = np.r_[total, np.zeros(len(more) - len(total), np.int64)]
            total[: len(more)] += more
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["id", "n"])

    return count


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Tokenise every text, rank the ids by their frequency in the corpus and write ``path``/blocks and ``path``/ranks.

    Files follow the ascending order of ``doc_id`` (null first, equal ids by a digest of their token ids). Null or empty text: the
    end id alone. An empty table writes no blocks. The texts are tokenised once; ids are range-partitioned and sorted.
    """
    spark, kind = docs.sparkSession, id_type(tokenizer, end_id)
    token_table(docs, tokenizer, end_id, doc_id, text).write.option("compression", "zstd").parquet(f"{path}/tokens")
    tokens = spark.read.parquet(f"{path}/tokens")
    counted = tokens.select("ids").mapInArrow(_counter(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranks = counted.orderBy(F.desc("n"), "id").collect()  # at most one row for each id of the vocabulary
    spark.createDataFrame([(i, r.id, r.n) for i, r in enumerate(ranks)], "rank long, id long, n long").coalesce(
        1
    ).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max((r.id for r in ranks), default=0) + 1, np.uint32)
    rank_of[[r.id for r in ranks]] = np.arange(len(ranks))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, start = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, start, size
            ids = np.concatenate(held)
            block = encode_block(np.array([len(x) for x in held]), rank_of[ids])
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([names], pa.list_(pa.int64())),
                    pa.array([block], pa.binary()),
                ],
                ["file", "block", "start", "n_ids", "doc_ids", "data"],
            )
            number, start, size = number + 1, start + len(ids), 0
            names.clear()
            held.clear()
            return row

        for batch in batches:
            for name, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                names.append(name)
                held.append(np.frombuffer(ids.as_buffer(), kind))
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    # Equal ids are told apart by a digest, so that the range sampling brings no token arrays to the driver.
    keyed = tokens.withColumn("digest", F.xxhash64("ids"))
    ordered = keyed.repartitionByRange(shuffle_partitions(spark), "doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    ordered.select("doc_id", "ids").mapInArrow(
        blocks, "file int, block int, start long, n_ids long, doc_ids array<long>, data binary"
    ).write.option("compression", "none").parquet(f"{path}/blocks")
    remove(spark, f"{path}/tokens")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids binary) from the files: ``start`` counts the ids of all documents before."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # the vocabulary
    id_of = np.array([r.id for r in ranks], "<u4")
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    bases = files.select(  # one row a file
        F.col("file").alias("_file"),
        F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, names, data in zip(
                batch.column("start").to_pylist(), batch.column("doc_ids"), batch.column("data")
            ):
                counts, ranks = decode_block(data.as_py())
                ids = id_of[ranks] if len(ranks) else ranks
                starts = np.r_[0, np.cumsum(counts, dtype=np.int64)]
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        names.values,
                        pa.array(starts[:-1] + base),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())], pa.binary()),
                    ],
                    ["doc_id", "start", "ids"],
                )

    return (
        blocks.join(F.broadcast(bases), blocks["file"] == bases["_file"])
        .select((F.col("start") + F.col("base")).alias("start"), "doc_ids", "data")
        .mapInArrow(decode, "doc_id long, start long, ids binary")
    )


def token_file_digests(
    docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the token files to a new folder in the shared directory, read them back and digest each document's ids."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end_id, doc_id, text)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.as_buffer() for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("start"),
                    pa.array([x.size // 4 for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return read_token_files(spark, path).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
