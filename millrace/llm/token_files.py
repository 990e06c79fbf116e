"""Token ids as files: blocks of separately compressed documents that share one trained zstandard dictionary.

A file set is a Parquet dataset (so Spark's committer writes it and any store can hold it) with one row per block:

    part int, block int        the block's place; parts are ranges of doc_id in order, blocks follow one another in a part
    dictionary long            the first 8 bytes of the SHA-256 of the dictionary, which `<path>/dictionary` holds
    first long, last long      the least and the greatest doc_id that isn't null
    doc_id array<long>         ascending, null first
    at array<int>              byte offset of each document's frame in data, one more entry than documents
    token_at array<long>       ids before each document within the part, one more entry than documents
    data binary                the frames, each an array of little-endian unsigned 16-bit ids (32-bit if wide)
    wide boolean

and one small row per part, in `<path>/parts`, with the ids before it. Row groups hold few blocks, so a reader skips all
whose first and last don't enclose the doc_id that it looks for; of the block that has it, only the document's own frame
is decompressed. The dictionary is trained on at most SAMPLE documents (the least hashes of
doc_id, at most SAMPLE_IDS ids of each): it changes sizes, never contents; all documents are written.

Defined cases: a null or empty text gives one id, the end id; a text of any length is encoded whole, in a stream;
repeated rows and equal doc_ids are written once each, in no fixed order among themselves; null doc_ids come first and
can't be looked up; further columns are ignored, whatever their names; an empty table gives an empty file set.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_tokenizer, transducer
from .common import remove, scratch

SAMPLE, SAMPLE_IDS, DICTIONARY_BYTES = 2000, 4096, 64 << 10
BLOCK_DOCS, BLOCK_BYTES, GROUP_BYTES = 4096, 1 << 20, 2 << 20
BLOCK = "part int, block int, dictionary long, first long, last long, doc_id array<long>, at array<int>, token_at array<long>, data binary, wide boolean"


def digest(dictionary: bytes) -> int:
    return int.from_bytes(hashlib.sha256(dictionary).digest()[:8], "little", signed=True)


def train(samples: list[bytes]) -> bytes:
    """A dictionary for the samples, empty where they are too few or too short to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _coder(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    """Encodes every whole text of docs (doc_id, text), appends end_id to each, and writes the file set to path."""
    spark, source = docs.sparkSession, tokenizer or default_tokenizer()
    wide = max(transducer(source).bytes_of, default=0) > 0xFFFF or end_id > 0xFFFF
    kind = "<u4" if wide else "<u2"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def serialized(text: str | None) -> tuple[int, bytes]:
        ids = transducer(source).encode_text(text)
        ids.append(end_id)
        return len(ids), np.array(ids, kind).tobytes()

    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.join(F.broadcast(chosen), "doc_id", "left_semi").where("text is not null")  # SAMPLE ids
    sample = texts.select(F.substring("text", 1, 4 * SAMPLE_IDS)).limit(SAMPLE).collect()
    dictionary = train([serialized(r[0])[1][: SAMPLE_IDS * (4 if wide else 2)] for r in sample])
    spark.createDataFrame([(digest(dictionary), bytearray(dictionary))], "dictionary long, data binary").write.parquet(f"{path}/dictionary")
    held = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3, write_checksum=False, **_coder(held.value))
        for b in batches:
            got = [serialized(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([z.compress(x) for _, x in got], pa.binary())], ["doc_id", "n", "frame"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = blocks = tokens = size = 0
        ids: list = []
        frames: list[bytes] = []
        starts: list[int] = []

        def block() -> pa.RecordBatch:
            at = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            known = [i for i in ids if i is not None]
            row = {"part": part, "block": blocks, "dictionary": digest(held.value), "first": min(known, default=None), "last": max(known, default=None), "doc_id": ids, "at": at.tolist(), "token_at": [*starts, tokens], "data": b"".join(frames), "wide": wide}
            types = {"part": pa.int32(), "block": pa.int32(), "first": pa.int64(), "last": pa.int64(), "at": pa.list_(pa.int32()), "doc_id": pa.list_(pa.int64()), "token_at": pa.list_(pa.int64()), "data": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([v], types.get(k)) for k, v in row.items()], list(row))

        for b in batches:
            for i, n, f, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if frames and (len(frames) >= BLOCK_DOCS or size + len(f) > BLOCK_BYTES):
                    yield block()
                    ids, frames, starts, size, blocks = [], [], [], 0, blocks + 1
                part = p
                ids.append(i)
                frames.append(f)
                starts.append(tokens)
                tokens += n
                size += len(f)
        if frames:
            yield block()

    frames_at = scratch(spark, "frames")  # not encoded again for the range bounds
    docs.mapInArrow(encode, "doc_id long, n long, frame binary").write.parquet(frames_at)
    encoded = spark.read.schema("doc_id long, n long, frame binary").parquet(frames_at)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = encoded.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    placed.withColumn("part", F.spark_partition_id()).mapInArrow(pack, BLOCK).write.option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/blocks")
    remove(spark, frames_at)
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # one row per part, of which there are as many as shuffle partitions
    sums = [(r[0], r[1]) for r in blocks.groupBy("part").agg(F.max(F.element_at("token_at", -1))).orderBy("part").collect()]
    base, rows = 0, []
    for p, n in sums:
        rows.append((p, base, n))
        base += n
    spark.createDataFrame(rows, "part int, base long, n long").coalesce(1).write.parquet(f"{path}/parts")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a file set, each with `base`, the ids before its part."""
    parts = spark.read.schema("part int, base long, n long").parquet(f"{path}/parts")
    return spark.read.schema(BLOCK).parquet(f"{path}/blocks").join(F.broadcast(parts.select("part", "base")), "part")


def _dictionary(spark: SparkSession, path: str) -> tuple[int, bytes]:
    r = spark.read.schema("dictionary long, data binary").parquet(f"{path}/dictionary").first()
    return r[0], bytes(r[1])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids of every document of a file set."""
    return _read(spark, path, "ids array<long>", lambda x: x.tolist(), pa.list_(pa.int64()))


def _read(spark: SparkSession, path: str, column: str, make, kind: pa.DataType) -> DataFrame:
    want, dictionary = _dictionary(spark, path)
    if digest(dictionary) != want:
        raise ValueError("the dictionary isn't the one that its hash names")
    held = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor(**_coder(held.value))
        for b in batches:
            for row in b.to_pylist():
                if row["dictionary"] != want:
                    raise ValueError("a block was written with another dictionary")
                data, at = memoryview(row["data"]), row["at"]
                ids = [np.frombuffer(z.decompress(data[i:j]), "<u4" if row["wide"] else "<u2") for i, j in zip(at, at[1:], strict=False)]
                start, n = [row["base"] + t for t in row["token_at"][:-1]], [len(x) for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array([make(x) for x in ids], kind)], ["doc_id", "start", "n_tokens", column.split()[0]])

    blocks = frames(spark, path).select("dictionary", "doc_id", "at", "token_at", "data", "wide", "base")
    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def holding(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The frames (f, wide) of a document: the range conditions reach the scan, which skips the row groups of all other blocks."""
    place = F.array_position("doc_id", F.lit(doc_id)).cast("int")
    piece = F.substring(F.col("data"), F.element_at("at", place) + 1, F.element_at("at", place + 1) - F.element_at("at", place))
    near = spark.read.schema(BLOCK).parquet(f"{path}/blocks").where((F.col("first") <= doc_id) & (F.col("last") >= doc_id))
    return near.where(F.array_contains("doc_id", F.lit(doc_id))).select(piece.alias("f"), "wide")


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document, None if there is none: only row groups whose blocks can hold it are read, only its frame is decompressed."""
    r = holding(spark, path, doc_id).first()
    if r is None:
        return None
    z = zstandard.ZstdDecompressor(**_coder(_dictionary(spark, path)[1]))
    return np.frombuffer(z.decompress(bytes(r[0])), "<u4" if r[1] else "<u2").tolist()


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write(docs, path := scratch(spark, "token-files"))
    return _read(spark, path, "ids_crc32 long", lambda x: zlib.crc32(x.astype("<u4").tobytes()), pa.int64())
