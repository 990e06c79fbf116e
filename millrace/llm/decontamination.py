"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, then exact weighted similarity.

1. Every 5-word shingle of every document is hashed and joined with the shingles of the items. A window of an item's
   length can only reach the similarity if enough of its shingles (8 of 9 at `at_least` 0.8) are shared with items of
   that length, in whatever order; the running count of shared positions gives every start of which this holds, and a
   window is laid at each. Windows with equal words are looked at once.
2. Each window and each item of that length has a 64-bit SimHash of its weighted shingles. Fingerprints that differ in
   up to RADIUS bits differ in at most RADIUS // BLOCKS of them in one of BLOCKS blocks, by the pigeonhole principle. So
   an item is looked for under every value of each block that is that near to its own (probes; the benchmark is the
   small side), a window under its own values: the join on (length, block, value) meets every pair within the radius,
   and a pair counts at the first block that it meets in. Of pairs of unrelated fingerprints six in ten meet, once; their
   whole distance is next. At the default radius of 20 bits a pair of similarity 0.8 (about 10 differing bits expected)
   is missed with a probability under one in a thousand.
3. The weighted Jaccard similarity of the shingles, each with its number of occurrences as weight, decides exactly.

Step 1 lays windows without regard to which item they resemble; all windows of all documents can't be fingerprinted (a
window at every word for every length of an item), and those left out can't reach the similarity.

Items with fewer than five words count as one shingle of all their words; runs of as many words of the documents are
hashed beside the 5-word shingles where such items occur. Spark expressions only.

Defined cases: a null or word-less text matches nothing, nor does a word-less item; texts and items of any length are
taken whole; rows that share a doc_id are one document in matches(), and each a row of its own in filter_documents();
rows with a null doc_id are scanned like any other; equal items are reported each; columns of docs of any name stay in
filter_documents(); an empty table, or an empty benchmark, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bag_common, broadcast_if, let, lower_ascii, pin, words

SHINGLE, AT_LEAST, RADIUS, BLOCKS = 5, 0.8, 20, 7
#: Shingles (16 bytes each) and documents (8 bytes each) that may be broadcast; beyond, both sides are shuffled.
BROADCAST_SHINGLES, BROADCAST_IDS = 500_000, 2_000_000


def shingle_hashes(ws: Column, n: int = SHINGLE) -> Column:
    """A 64-bit hash for each n-word shingle of an array of words; of all words where there are fewer; none for none."""
    at = F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1)))
    return F.when(F.size(ws) > 0, F.transform(at, lambda i: F.xxhash64(F.slice(ws, i, n)))).otherwise(F.array().cast("array<bigint>"))


def placed_hashes(ws: Column, short: list[int]) -> Column:
    """Rows p, h: place and hash of each shingle, and of each run of words of the lengths in short."""
    if not short:
        return F.posexplode(shingle_hashes(ws)).alias("p", "h")
    none = F.array().cast("array<struct<p: int, h: bigint>>")

    def runs(n: int) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.struct(i.alias("p"), F.xxhash64(F.slice(ws, i + 1, n)).alias("h")))
        return F.when(F.size(ws) >= n, at).otherwise(none)

    whole = F.transform(shingle_hashes(ws), lambda h, i: F.struct(i.alias("p"), h.alias("h")))
    return F.inline(F.concat(whole, *map(runs, short)))


def _lanes() -> Column:
    """For each two bits a long with one 32-bit lane for each of them."""
    return F.array(*(F.lit((n & 1) + ((n >> 1) << 32)) for n in range(4)))


def simhash(hashes: Column) -> Column:
    """The SimHash of up to two billion hashes: a bit is set if over half of them have it."""

    def summed(hs: Column) -> Column:
        two = lambda h, k: (F.shiftrightunsigned(h, 2 * k).bitwiseAND(3) + 1).cast("int")
        zero = F.struct(*(F.lit(0).cast("long").alias(f"s{k}") for k in range(32)))
        return let(
            _lanes(),
            lambda t: F.aggregate(hs, zero, lambda a, h: F.struct(*((a[f"s{k}"] + F.element_at(t, two(h, k))).alias(f"s{k}") for k in range(32)))),
        )

    def bits(sums: Column, n: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(32):
            for j in range(2):
                b = 2 * k + j
                count = F.shiftrightunsigned(sums[f"s{k}"], 32 * j).bitwiseAND(0xFFFFFFFF)
                out = out.bitwiseOR(F.when(count * 2 > n, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
        return out

    return let(hashes, lambda hs: let(summed(hs), lambda s: bits(s, F.size(hs))))


def edges(n: int) -> list[tuple[int, int]]:
    """The first bit and the bits of each of n blocks."""
    at = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def block(fp: Column, i: int, n: int) -> Column:
    begin, width = edges(n)[i]
    return F.shiftrightunsigned(fp, begin).bitwiseAND((1 << width) - 1)


def own_values(fp: Column, n: int) -> Column:
    """array<struct<block, bits>>: the n blocks of a fingerprint."""
    return F.array(*(F.struct(F.lit(i).alias("block"), block(fp, i, n).alias("bits")) for i in range(n)))


def near_values(fp: Column, n: int, flips: int) -> Column:
    """array<struct<block, bits>>: for each block all values that differ from the fingerprint's in up to `flips` bits."""

    def near(i: int) -> Column:
        every = F.sequence(F.lit(0).cast("long"), F.lit((1 << edges(n)[i][1]) - 1).cast("long"))
        some = F.filter(every, lambda x: F.bit_count(x.bitwiseXOR(block(fp, i, n))) <= flips)
        return F.transform(some, lambda x: F.struct(F.lit(i).alias("block"), x.alias("bits")))

    return F.concat(*map(near, range(n)))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of hashes, each distinct one weighted by its occurrences."""
    return let(bag_common(a, b), lambda c: c / (F.size(a) + F.size(b) - c))


def near_pairs(windows: DataFrame, items: DataFrame, radius: int, n: int = BLOCKS) -> DataFrame:
    """The pairs of rows of windows (len, wfp, others) and items (len, item_id, ifp) of one length within `radius` bits, each once."""
    flips = radius // n
    if max(w for _, w in edges(n)) > 16:
        raise ValueError("blocks of over 16 bits have too many values to probe")
    keyed = windows.withColumn("v", F.explode(own_values(F.col("wfp"), n)))
    probes = items.select("len", "item_id", "ifp", F.explode(near_values(F.col("ifp"), n, flips)).alias("v_")).withColumnRenamed("len", "len_")
    met = keyed.join(probes, (F.col("len") == F.col("len_")) & (F.col("v.block") == F.col("v_.block")) & (F.col("v.bits") == F.col("v_.bits")))
    apart = F.col("wfp").bitwiseXOR(F.col("ifp"))
    earlier = F.lit(False)
    for i in range(n - 1):
        earlier = earlier | ((F.col("v.block") > i) & (F.bit_count(block(apart, i, n)) <= flips))
    return met.where((F.bit_count(apart) <= radius) & ~earlier).drop("v", "v_", "len_")


def passages(docs: DataFrame, benchmark: DataFrame, at_least: float = AT_LEAST, radius: int = RADIUS) -> DataFrame:
    """doc_id, tid (hash of the text), item_id, at_word, len, similarity of every window that is that similar to an item."""
    items = benchmark.select("item_id", words(lower_ascii(F.col("text"))).alias("iw")).where("size(iw) > 0")
    items = items.select("item_id", F.size("iw").alias("len"), shingle_hashes(F.col("iw")).alias("ih"))
    items = pin(items.withColumn("ifp", simhash(F.col("ih"))))
    anchors = items.select("len", "item_id", F.posexplode("ih").alias("q", "h")).select("h", "len", "q").distinct()
    anchors = pin(anchors)
    anchors = broadcast_if(anchors, anchors.count(), BROADCAST_SHINGLES)
    docs = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    ws = docs.select("doc_id", "tid", words(lower_ascii(F.col("text"))).alias("ws"))  # a test of the words here would split every text twice
    short = sorted(r[0] for r in items.where(F.col("len") < SHINGLE).select("len").distinct().collect())  # four at most
    hits = ws.select("doc_id", "tid", F.size("ws").alias("of"), placed_hashes(F.col("ws"), short)).join(anchors, "h")
    shared = hits.groupBy("doc_id", "tid", "of", "len").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    # Both sides' shingles are counted: a window reaches the similarity only with so many shared ones.
    last, own = F.greatest(F.col("of") - F.col("len"), F.lit(0)), F.greatest(F.least("of", "len") - (SHINGLE - 1), F.lit(1))
    least = F.ceil((own + F.greatest(F.col("len") - (SHINGLE - 1), F.lit(1))) * at_least / (1 + at_least) - 1e-9).cast("int")
    shared = shared.select("doc_id", "tid", "len", "ps", last.alias("last"), own.alias("own"), F.greatest(least, F.lit(1)).alias("least")).where("size(ps) >= least")

    def laid(k: Column) -> Column:
        """The starts of windows that hold the shared shingles k to k + least - 1 (and not the one before k, laid already)."""
        low = F.greatest(F.element_at("ps", k + F.col("least") - 1) - F.col("own") + 1, F.coalesce(F.get("ps", k - 2), F.lit(-1)) + 1, F.lit(0))
        return F.struct(low.alias("low"), F.least(F.element_at("ps", k), "last").alias("high"))

    runs = F.filter(F.transform(F.sequence(F.lit(1), F.size("ps") - F.col("least") + 1), laid), lambda r: r["low"] <= r["high"])
    starts = shared.select("doc_id", "tid", "len", F.explode(runs).alias("r")).select("doc_id", "tid", "len", F.explode(F.sequence("r.low", "r.high")).alias("s"))
    starts = starts.select("doc_id", "tid", F.struct("len", "s").alias("w")).distinct()
    per_doc = pin(starts.groupBy("doc_id", "tid").agg(F.collect_set("w").alias("wins")))  # windows of one document
    per_doc = broadcast_if(per_doc.select(F.col("doc_id").alias("i"), F.col("tid").alias("k"), "wins"), per_doc.agg(F.sum(F.size("wins") + 2)).first()[0] or 0, BROADCAST_IDS)
    # The windows' words, by content. Only documents with windows are split again.
    ws = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tid") == F.col("k"))).select("doc_id", "tid", "wins", words(lower_ascii(F.col("text"))).alias("ws"))
    cut = ws.select("doc_id", "tid", F.explode(F.transform("wins", lambda w: F.struct(w["s"].alias("s"), w["len"].alias("len"), F.slice(F.col("ws"), w["s"] + 1, w["len"]).alias("x")))).alias("w")).where("size(w.x) > 0")
    cut = cut.select("doc_id", "tid", F.col("w.s").alias("at_word"), F.col("w.len").alias("len"), F.xxhash64("w.x").alias("k1"), F.xxhash64(F.lit(1), "w.x").alias("k2"), shingle_hashes(F.col("w.x")).alias("wh"))
    cut = pin(cut)
    texts = cut.groupBy("len", "k1", "k2").agg(F.first("wh").alias("wh"))  # equal keys have equal words
    texts = pin(texts.withColumn("wfp", simhash(F.col("wh"))))
    near = near_pairs(texts.select("len", "k1", "k2", "wfp"), items.select("len", "item_id", "ifp"), radius).select("len", "k1", "k2", "item_id")
    near = near.join(texts.select("len", "k1", "k2", "wh"), ["len", "k1", "k2"]).join(items.select("item_id", F.col("len").alias("len_"), "ih"), "item_id").where("len = len_")
    exact = near.withColumn("similarity", similarity(F.col("wh"), F.col("ih"))).where(F.col("similarity") >= at_least).select("len", "k1", "k2", "item_id", "similarity")
    return cut.select("doc_id", "tid", "at_word", "len", "k1", "k2").join(exact, ["len", "k1", "k2"]).select("doc_id", "tid", "item_id", "at_word", "len", "similarity")


def matches(docs: DataFrame, benchmark: DataFrame, at_least: float = AT_LEAST, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, at_word (from 0), n_words, similarity of the best window of each document and item."""
    best = F.min(F.struct((-F.col("similarity")).alias("d"), F.col("at_word"), F.col("len")))
    found = passages(docs, benchmark, at_least, radius).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return found.select("doc_id", "item_id", F.col("b.at_word").cast("long").alias("at_word"), F.col("b.len").cast("long").alias("n_words"), (-F.col("b.d")).alias("similarity"))


def filter_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a passage of the benchmark."""
    lost = pin(passages(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("i"), F.col("tid").alias("k")).distinct())
    held = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    lost = broadcast_if(lost, lost.count(), BROADCAST_IDS)
    return held.join(lost, F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("k")), "left_anti").select("row.*")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "at_word", "n_words", F.round(1000 * F.col("similarity")).cast("long").alias("similarity_thousandths"))
