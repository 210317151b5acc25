"""Token-id files: canonical Huffman blocks in ascending document order.

A corpus is a folder with three Parquet tables (so that Spark's commit protocol covers lost
and repeated tasks on any file system): ``code`` has the code length of each id; ``blocks``
has independent blocks (part, seq, n_ids, doc_ids, doc_lengths, checkpoints, payload), where
payload is the bit stream of the block's ids and checkpoints the bit offset of every 256th;
(part, seq) ascends with doc_id. A document lies in one block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.llm import encoding, store
from parcelflow.llm.huffman import Code, code_lengths
from parcelflow.llm.words import slices

BLOCK_IDS = 1 << 18
#: Ids of a part, a sorted range of documents.
PART_IDS = 1 << 23
SYMBOLS = 1 << 16
_BLOCKS = "part int, seq int, n_ids long, doc_ids binary, doc_lengths binary, checkpoints binary, payload binary"


def _encode(path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", encoding.SLICE):
                ids, bounds = encoding.encoder(path).encode(part.column("text"))
                docs = part.num_rows
                ends = bounds + np.arange(docs + 1)
                full = np.insert(ids, bounds[1:], np.uint16(end_id))
                counts += np.bincount(full, minlength=SYMBOLS)
                data = pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(full.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), data, pa.nulls(docs, pa.binary())], ["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["doc_id", "ids", "counts"])

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS, dtype=np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            total += np.frombuffer(raw, dtype="<i8")
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])


def _blocks(lengths: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seq = Code(np.frombuffer(lengths, dtype=np.uint8)), TaskContext.get().partitionId(), 0
        docs, ids, n = [], [], 0

        def block() -> pa.RecordBatch:
            lens = np.fromiter(map(len, ids), dtype="<u4", count=len(ids))
            data, marks = code.encode(np.concatenate(ids))
            row = [[part], [seq], [n], [np.array(docs, dtype="<i8").tobytes()], [lens.tobytes()], [marks.astype("<u4").tobytes()], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4], strict=True)], ["part", "seq", "n_ids", "doc_ids", "doc_lengths", "checkpoints", "payload"])

        for batch in batches:
            for d, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                docs.append(d)
                ids.append(np.frombuffer(raw.as_buffer(), dtype="<u2"))
                n += len(ids[-1])
                if n >= BLOCK_IDS:
                    yield block()
                    docs, ids, n, seq = [], [], 0, seq + 1
        if docs:
            yield block()

    return run


def write(spark: SparkSession, docs: DataFrame, folder: str, path: str, end_id: int = encoding.END_ID) -> None:
    """Writes the ids of each row of docs (doc_id, text), end_id after each, to folder.

    Ascending by doc_id; rows of one id by their ids' bytes. Defined cases: a null text is
    empty; a null doc_id comes before all others; repeated rows are written one by one; a very
    long text is one document of one block, which it makes as large as itself; an empty table
    gives files without blocks; other columns, also of clashing names, are ignored. Ids take two
    bytes: a vocabulary of more than 65,536 ids raises OverflowError.
    """
    scratch = store.Scratch(spark, "token-files")
    rows = docs.select(store.known_id().alias("doc_id"), "text")
    told = scratch.put(rows.mapInArrow(_encode(path, end_id), "doc_id long, ids binary, counts binary"), "ids")
    counts = np.zeros(SYMBOLS, dtype=np.int64)
    for r in told.where("counts is not null").select("counts").mapInArrow(_sum_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/code")
    parts = max(1, -(-int(counts.sum()) // PART_IDS), min(spark.sparkContext.defaultParallelism, -(-int(counts.sum()) // BLOCK_IDS)))
    ranged = told.where("counts is null").select("doc_id", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    ranged.mapInArrow(_blocks(lengths.tobytes()), _BLOCKS).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{folder}/blocks")
    scratch.drop("ids")


def _read(lengths: bytes, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, dtype=np.uint8))
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                ids = code.decode(row["payload"].as_py(), np.frombuffer(row["checkpoints"].as_py(), dtype="<u4"), row["n_ids"].as_py()).astype("<u4")
                lens = np.frombuffer(row["doc_lengths"].as_py(), dtype="<u4").astype(np.int64)
                ends = np.cumsum(lens)
                raw = memoryview(ids.tobytes())
                own = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                m = len(lens)
                out = [
                    pa.array(np.full(m, row["part"].as_py(), np.int32)), pa.array(np.full(m, row["seq"].as_py(), np.int32)), pa.array(ends - lens),
                    pa.array(np.frombuffer(row["doc_ids"].as_py(), dtype="<i8")), pa.array(lens), pa.array([zlib.crc32(x) for x in own], pa.int64()),
                ]
                names = ["part", "seq", "before", "doc_id", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array(list(map(bytes, own)), pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, ids_crc32 and, with_ids, ids (little-endian 32-bit) of each document."""
    lengths = np.zeros(SYMBOLS, dtype=np.uint8)
    for r in spark.read.schema("id int, length int").parquet(f"{folder}/code").collect():
        lengths[r["id"]] = r["length"]
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    run = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n")).select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = blocks.select("part", "seq", "n_ids").withColumn("_in", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, F.col("part") == F.col("_part"))
    at = at.select(F.col("part").alias("_part"), F.col("seq").alias("_seq"), (F.col("_base") + F.col("_in")).alias("_start"))
    kind = "part int, seq int, before long, doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    docs = blocks.mapInArrow(_read(lengths.tobytes(), with_ids), kind)
    docs = docs.join(at, (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq")))
    return docs.select(store.given_id().alias("doc_id"), (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op5_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    scratch = store.Scratch(spark, "corpus")
    write(spark, store.table(spark, sf_dir, "documents"), scratch.root, path or encoding.default_path())
    return read(spark, scratch.root, with_ids=False)
