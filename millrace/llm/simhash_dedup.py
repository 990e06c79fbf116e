"""SimHash near-duplicate groups, candidates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits. If two fingerprints differ in at most two
bits, some segment t has no error and the next one (cyclically) at most two errors, so the pair shares the exact value
of segment t. Segment t + 1 is decoded in the perfect binary Golay code (23, 12): a word within two of its codeword has
that codeword's index as its only key, any other word the indices of the six codewords within distance four; two words
that differ in at most two bits always share a key. Each fingerprint so has three to eighteen keys (t, exact segment,
codeword index); pairs that share one are verified by their Hamming distance.

Where a key has more than `hot` fingerprints, its members are not paired. They are linked through the balls of radius
one around each: two fingerprints lie within two bits exactly when their balls meet, a ball's point has at most 65
distinct fingerprints around it and those all lie within two bits of each other, so linking each to the least of them
gives the same components with rows in proportion to the members.

Defined cases: a null or word-less text has fingerprint zero and is linked like any other; a null doc_id is kept and is
never a component_id unless its whole component has none (then null); repeated rows come out once each; an empty table
gives an empty table; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import components, pin

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codewords by index; for each syndrome the error pattern; for each syndrome the indices to add for further keys (-1: none)."""
    index = np.arange(4096, dtype=np.int64)
    rest = index << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    code = (index << 11) | rest  # systematic: the index is in the upper 12 bits
    one = np.int64(1) << np.arange(23, dtype=np.int64)
    two = np.array([one[i] | one[j] for i in range(23) for j in range(i)])
    three = np.array([one[i] | one[j] | one[k] for i in range(23) for j in range(i) for k in range(j)])
    error = np.concatenate([[0], one, two, three])
    table = np.zeros(2048, np.int64)
    table[_syndrome(error)] = error
    sevens = code[np.array([int(x).bit_count() == 7 for x in code])]
    more = np.full((2048, 5), -1, np.int64)
    for e, s in zip(three, _syndrome(three), strict=True):
        more[s] = sevens[(sevens & e) == e] >> 11
    return code, table, more


def _syndrome(x: np.ndarray) -> np.ndarray:
    rest = x.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


def golay_keys(x: np.ndarray) -> np.ndarray:
    """For each word of at most 23 bits its six keys, codeword indices; -1 where it has no more."""
    _, error, more = _golay()
    s = _syndrome(x)
    own = (x ^ error[s]) >> 11
    further = more[s]
    return np.column_stack([own, np.where(further < 0, -1, own[:, None] ^ further)])


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of fingerprints (as signed longs): the position of the fingerprint, the key."""
    u = fps.view(np.uint64)
    part = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for t in range(3):
        near = golay_keys(part[(t + 1) % 3])
        at = np.nonzero(near >= 0)
        rows.append(at[0])
        keys.append((t << 34) | (part[t][at[0]] << 12) | near[at])
    return np.concatenate(rows), np.concatenate(keys)


def simhash(data: bytes | None, shingle: int = 3) -> int:
    """The fingerprint of a UTF-8 text: a bit is set if over half of the shingles' XXH64 hashes have it."""
    ws = (data or b"").lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not ws:
        return 0
    grams = map(b" ".join, zip(*(ws[i:] for i in range(shingle)), strict=False)) if len(ws) >= shingle else [b" ".join(ws)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, 42) for g in grams], np.uint64)
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        count += np.unpackbits(h[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("b")).mapInArrow(run, f"doc_id {kind}, fp long")


def links(fps: DataFrame, bits: int = 2, hot: int = 64) -> DataFrame:
    """Edges a < b between distinct fingerprints of column fp, whose components are those of the graph of all pairs within `bits` (0 to 2) bits."""
    if not 0 <= bits <= 2:
        raise ValueError("Golay keys cover at most two differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            if len(fp):
                rows, keys = fuzzy_keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])

    keys = fps.select("fp").distinct().mapInArrow(run, "key long, fp long")
    keys = pin(keys)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = pin(sizes)
    pairs = sizes.where("n = 2").select("a", "b")
    some = keys.join(sizes.where(f"n > 2 and n <= {hot}").select("key"), "key")
    pairs = pairs.union(some.select("key", F.col("fp").alias("a")).join(some.select("key", F.col("fp").alias("b")), "key").where("a < b").select("a", "b"))
    near = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    crowd = keys.join(sizes.where(f"n > {hot}").select("key"), "key").select("fp").distinct()
    return near.union(_ball_links(crowd, bits)).distinct()


def _ball_links(fps: DataFrame, bits: int) -> DataFrame:
    """For crowded keys. With fewer than two bits the ball is cut down: to the point itself, or to one half of each fingerprint's flips."""
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    if bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a < b")
    around = fps.select("fp", F.explode(flips).alias("at"))
    if bits == 1:  # two fingerprints differ in one bit: one of them is the other's flip
        return around.where("fp != at").join(fps.select(F.col("fp").alias("at")), "at", "left_semi").select(F.least("fp", "at").alias("a"), F.greatest("fp", "at").alias("b"))
    balls = around.groupBy("at").agg(F.sort_array(F.collect_set("fp")).alias("s")).where("size(s) > 1")  # at most 65 in a set
    return balls.select(F.element_at("s", 1).alias("a"), F.explode(F.slice("s", 2, 65)).alias("b"))


def near_groups(docs: DataFrame, shingle: int = 3, bits: int = 2, hot: int = 64) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    fps = pin(fingerprints(docs, shingle))
    each = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(each, bits, hot))
    each = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    each = pin(each)
    named = each.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(each.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex16(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies of docs: texts whose 5-word shingles have a Jaccard similarity of 0.8 or more.

    Those differ in ten fingerprint bits on average and in up to twenty, far beyond what Golay keys find, so candidates
    come from near_copies. The row with the least doc_id stays; see there for nulls, ties and repeated rows.
    """
    return near_copies.dedup(docs)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select("doc_id", hex16().alias("fingerprint"), "component_id")
