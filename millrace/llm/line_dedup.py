"""Removal of lines that many documents share, with levelled sorted runs of line hashes.

The index keeps, for every line key (128 bits of hashes), in how many documents it was found and the largest doc_id. It
consists of runs, tables that are bucketed and sorted by key, of two kinds:

* key runs, in which every key of the index stands exactly once, with what the batch that brought it knew of it;
* increment runs: what later batches add to keys that were there already.

A batch of documents is aggregated to its keys, which are merge-anti-joined with the key runs: what is left over is new
and becomes a key run of level 0, the rest becomes an increment run. Runs and batches share their bucketing, so these
joins move nothing. When a level has FANOUT runs they are merged to one of the next level, so a row is rewritten once a
level and a look-up meets at most FANOUT - 1 runs a level. In the end each key run is joined with the summed increments;
a key's total is right only because the anti-join let it into one key run. A line is dropped where its key was found in
at least `min_docs` documents and the document isn't the one with the largest doc_id.

Keys that many documents share are few: at most as many as there are rows over the limit of the hot ones. Those are
broadcast, so their rows stay where they are; the other keys are joined by a shuffle.

Defined cases: a null or empty text is one empty line, which is never dropped; rows that share a doc_id count as one
document and lose the same lines; a null doc_id doesn't count as a document and never holds the kept copy; a line that
occurs several times in a document is counted once and dropped or kept at every place; columns of docs stay, whatever
their names (kept_text, n_lines and n_dropped are replaced); work is linear in a text's lines; an empty table gives an
empty table.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, lower_ascii, pin, remove, scratch, stored

MIN_CHARS, MIN_DOCS, FANOUT, BATCHES = 20, 3, 3, 4
RUN = "h1 long, h2 long, n_docs long, top long"
KEY = ["h1", "h2"]
#: Keys (32 bytes each) that may be broadcast; beyond, the join is shuffled for all but the hot ones.
BROADCAST_KEYS = 200_000


def line_key(line: Column) -> Column:
    return F.trim(lower_ascii(line), F.lit(SPACE_CHARS))


def key_hash(key: Column) -> Column:
    """128 bits, from two hashes with different seeds."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineIndex:
    """Levelled sorted runs in a shared folder. keys and more: level and table of each run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.keys, self.more = spark, path, [], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame) -> str:
        """A run: one file a bucket, since df is dealt by its key over as many partitions."""
        name = f"millrace_run_{uuid.uuid4().hex}"
        df.select("h1", "h2", "n_docs", "top").write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _drop(self, *names: str) -> None:
        for n in names:
            self.spark.sql(f"drop table {n}")
            remove(self.spark, f"{self.path}/{n}")

    def _compact(self, runs: list[tuple[int, str]]) -> list[tuple[int, str]]:
        level = 0
        while len(full := [t for k, t in runs if k == level]) >= FANOUT:
            merged = self._write(total([self.spark.table(t) for t in full]))
            runs = [(k, t) for k, t in runs if k != level] + [(level + 1, merged)]
            self._drop(*full)
            level += 1
        return runs

    def add(self, rows: DataFrame) -> None:
        """rows: h1, h2, doc_id of one batch, whose documents are in no other batch."""
        batch = self._write(rows.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("top")))
        if self.keys:
            fresh = again = self.spark.table(batch)
            for _, run in self.keys:
                fresh = fresh.join(self.spark.table(run).select(*KEY), KEY, "left_anti")
            new = self._write(fresh)
            again = again.join(self.spark.table(new).select(*KEY), KEY, "left_anti")
            self.more = self._compact([*self.more, (0, self._write(again))])
            self._drop(batch)
            batch = new
        self.keys = self._compact([*self.keys, (0, batch)])

    def totals(self) -> DataFrame:
        """One row a key: every key run with the increments of its keys."""
        if not self.keys:
            return self.spark.createDataFrame([], RUN)
        runs = [self.spark.table(t) for _, t in self.keys]
        if self.more:
            add = total([self.spark.table(t) for _, t in self.more]).withColumnsRenamed({"n_docs": "n", "top": "t"})
            runs = [r.join(add, KEY, "left").select(*KEY, (F.col("n_docs") + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("top", "t").alias("top")) for r in runs]
        return reduce(DataFrame.union, runs)

    def close(self) -> None:
        """Forgets the runs and deletes their files."""
        self._drop(*(t for _, t in [*self.keys, *self.more]))
        self.keys, self.more = [], []


def total(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, runs).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("top").alias("top"))


def text_id(text: Column) -> Column:
    """With the doc_id this names a row's lines: rows with equal texts lose the same ones."""
    return F.xxhash64(F.lit(2), text)


def keys_of(docs: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """doc_id, tid, at, h1, h2, batch: the lines (at, from 0) of each document that are long enough, by key."""
    keys = F.filter(F.transform(lines_of(F.col("text")), lambda x, i: F.struct(line_key(x).alias("k"), i.alias("at"))), lambda x: F.char_length(x["k"]) >= min_chars)
    found = F.transform(keys, lambda x: F.struct(x["at"].alias("at"), key_hash(x["k"]).alias("h")))
    rows = docs.select("doc_id", text_id(F.col("text")).alias("tid"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), F.explode(found).alias("l"))
    return rows.select("doc_id", "tid", "l.at", "l.h.h1", "l.h.h2", "batch")


def index_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> tuple[LineIndex, DataFrame, str]:
    """The index of docs, added batch by batch; the stored lines, and where they are."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "line-keys")
    keys_of(docs, batches, min_chars).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, tid long, at int, h1 long, h2 long, batch int").parquet(path)
    index = LineIndex(spark, scratch(spark, "line-runs"))
    for b in range(batches):
        index.add(lines.where(F.col("batch") == b).select("h1", "h2", "doc_id"))
    return index, lines, path


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, tid, lost (the places of the lines it loses), for the documents that lose any; the index is gone afterwards."""
    index, lines, path = index_lines(docs, batches, min_chars)
    wide = pin(index.totals().where((F.col("n_docs") >= min_docs) & F.col("top").isNotNull()))
    lines = lines.select("doc_id", "tid", "at", *KEY)
    n, most = wide.agg(F.count("*"), F.sum("n_docs")).first()
    if n <= BROADCAST_KEYS:
        hit = lines.join(F.broadcast(wide), KEY)
    else:
        limit = max(1000, -(-most // BROADCAST_KEYS))  # at most BROADCAST_KEYS keys have as many documents
        hot = F.broadcast(wide.where(F.col("n_docs") >= limit))
        cold = lines.join(hot.select(*KEY), KEY, "left_anti").join(wide.where(F.col("n_docs") < limit), KEY)
        hit = lines.join(hot, KEY).unionByName(cold)
    hit = hit.where(~F.col("doc_id").eqNullSafe(F.col("top")))
    lost = stored(hit.groupBy("doc_id", "tid").agg(F.collect_set("at").alias("lost")), "lost-lines")  # at most a document's own lines
    index.close()
    remove(docs.sparkSession, path)
    return lost


def strip_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with kept_text, n_lines (before) and n_dropped."""
    lost = dropped_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_docs, batches, min_chars)
    lost = lost.select(F.col("doc_id").alias("i"), F.col("tid").alias("t"), "lost")
    keep = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"))
    joined = held.join(lost, F.col("row.doc_id").eqNullSafe(F.col("i")) & text_id(F.col("row.text")).eqNullSafe(F.col("t")), "left")
    out = joined.withColumn("lines", lines_of(F.col("row.text")))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    kept = F.when(F.col("lost").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(F.transform(places, lambda p: F.get("lines", p)), "\n"))
    return out.select("row.*", kept.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"))


def clean_documents(docs: DataFrame) -> DataFrame:
    """docs with the shared lines taken out of text; the columns of docs."""
    held = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all"))
    out = strip_lines(held)
    pick = {c: F.col(f"all.`{c}`") for c in docs.columns}
    if "n_chars" in docs.columns:
        pick["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(pick["n_chars"])
    pick["text"] = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(pick["text"])
    return out.select(*(v.alias(k) for k, v in pick.items()))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return strip_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE = rf"""
with l as (select doc_id, rid, p, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as k
  from (select doc_id, rid, unnest(ls) as line, generate_subscripts(ls, 1) as p from (select doc_id, row_number() over () as rid, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
s as (select k, max(doc_id) as top from l where length(k) >= {MIN_CHARS} group by k having count(distinct doc_id) >= {MIN_DOCS})
select doc_id, count(*) as n_lines, count(*) filter (s.k is not null and doc_id <> top) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by p) filter (s.k is null or doc_id = top), '')) as kept_sha256
from l left join s using (k) group by rid, doc_id
"""
