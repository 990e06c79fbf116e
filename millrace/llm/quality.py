"""Quality rules whose limits are learnt from quantile sketches per language and source.

Per document, with Spark expressions only: counts of words, characters, symbols, repeated lines and words in repeated
8-word windows. Fixed base rules reject very short and highly repetitive texts. The verdict on the rest compares four
rates with limits that come from the texts of the document's own language and source that pass the base rules.

Sketches are integer histograms with buckets of seven significant bits (relative error under 1/64), so merging is adding
counts: order does not matter and the result is the same on every run. A language's sketch is its own counts with those
of all texts added at the weight of PRIOR texts, and a group's is its own counts with its language's added at that
weight: a group of any size has limits, small ones lean on what is known beyond them, and nothing switches by size.

With q the quantiles of a sketch, and p those of its values above zero, a rate's upper limit is

* q50 + SPREAD * (q50 - q25) + slack where over half of the texts have some of what it counts. The lower half alone
  gives the spread, so limits stand still while under half of a group is bad. For the length of words there is a lower
  limit at the same distance, too.
* else, for what hardly any good text has (symbols), p25 / 2: half of what those that have any begin with;
* else, for what good texts have now and then (repeated lines and words), p75 + FENCE * (p75 - p25).

Limits are kept within a floor (no good text is rejected for less) and a cap (below what a text can have; that of
repeated words is under the base rule's 300 per mille).

Defined cases: a null or word-less text has zero counts and fails the base rules (under 20 words); null lang or source
form groups of their own; a null doc_id is kept as it is; repeated rows are judged and returned once each and count
once each; columns of docs of any name stay as they are in filter_documents; an empty table gives an empty table.
Windows are compared by a 64-bit hash within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, broadcast_if, let, pin, stored, words

WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
SPREAD, FENCE, PRIOR, BITS = 8, 2, 200, 7
#: Rates in thousandths (length of words: hundredths of a character), the rule where most texts have none, floor, cap.
RATES = {
    "symbols": ("1000 * n_symbols / word_chars", "scarce", 30, 250),
    "dup_lines": ("1000 * n_dup_lines / n_lines", "common", 350, 700),
    "repeats": ("1000 * n_repeat_words / n_words", "common", 250, 290),
    "word_length": ("100 * word_chars / n_words", "common", 100, 3000),
}
SLACK = 40
BASE_FAILED = f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words)"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(ws: Column) -> Column:
    """Words of an array that lie in windows of WINDOW words found twice or more in it."""
    return let(ws, _repeated)  # the array once, wherever the optimizer puts its expression


def _repeated(ws: Column) -> Column:
    last = F.size(ws) - WINDOW
    hashes = F.when(last >= 1, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def covered(hs: Column) -> Column:
        placed = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))

        # Windows in order: each adds its words past the end of the one before.
        begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        add = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end"))
        return let(placed, lambda s: F.aggregate(twice(s), begin, add)["n"])

    return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs)))


def measure(docs: DataFrame) -> DataFrame:
    """docs (with columns lang and source for sketches()) with the counts of each text; columns of docs with their names, or named __words or __lines, are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumn("__words", words(F.col("text"))).withColumn("__lines", lines)
    return out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("__words")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
        }
    ).drop("__words", "__lines")


def bucket(rate: Column) -> Column:
    """The lower end of a rate's bucket: its leading bits."""
    cut = F.greatest(F.char_length(F.bin(rate)) - BITS, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", rate, cut), cut)


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, rate, bucket, n: one mergeable histogram for each language, source and rate, of texts that pass the base rules."""
    rates = F.array(*(F.struct(F.lit(k).alias("rate"), F.expr(f"cast({e} as bigint)").alias("v")) for k, (e, *_) in RATES.items()))
    rows = measured.where(f"not {BASE_FAILED}").select("lang", "source", F.explode(rates).alias("r"))
    return rows.groupBy("lang", "source", F.col("r.rate").alias("rate"), bucket(F.col("r.v")).alias("bucket")).agg(F.count("*").alias("n"))


def blended(own: DataFrame, prior: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """keys, rate, bucket, w: own counts (n) in thousandths of a text, with a prior's (shared, rate, bucket, w) at the weight of PRIOR texts."""
    share = F.floor(F.lit(1000.0 * PRIOR) * (F.col("w") / F.sum("w").over(Window.partitionBy(*shared, "rate")))).cast("bigint")
    prior = prior.select(*(F.col(k).alias(f"_{k}") for k in shared), F.col("rate").alias("_rate"), "bucket", share.alias("w"))  # under 2000 buckets for each of shared and rate
    groups, match = own.select(*keys, "rate").distinct(), F.col("rate") == F.col("_rate")
    for k in shared:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    prior = groups.join(prior, match)
    rows = own.select(*keys, "rate", "bucket", (1000 * F.col("n")).alias("w")).unionByName(prior.select(*keys, "rate", "bucket", "w"))
    return rows.groupBy(*keys, "rate", "bucket").agg(F.sum("w").alias("w"))


def limits(sketch: DataFrame) -> DataFrame:
    """lang, source, and for each rate the least and the greatest value that is kept (min_, max_)."""
    every = sketch.groupBy("rate", "bucket").agg(F.sum("n").alias("w"))
    by_lang = blended(sketch.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n")), every, ["lang"], [])
    own = blended(sketch, by_lang, ["lang", "source"], ["lang"])
    part = Window.partitionBy("lang", "source", "rate")  # under 2000 buckets
    up = part.orderBy("bucket")
    above = F.when(F.col("bucket") > 0, F.col("w")).otherwise(0)
    seen = own.withColumns({"cum": F.sum("w").over(up), "total": F.sum("w").over(part), "cum_": F.sum(above).over(up), "total_": F.sum(above).over(part)})
    q = lambda k: F.min(F.when(F.col("cum") * 100 >= F.col("total") * k, F.col("bucket"))).alias(f"q{k}")
    p = lambda k: F.min(F.when((F.col("bucket") > 0) & (F.col("cum_") * 100 >= F.col("total_") * k), F.col("bucket"))).alias(f"p{k}")
    got = seen.groupBy("lang", "source", "rate").agg(q(25), q(50), p(25), p(75))

    def limit(rule: str, floor: int, cap: int) -> Column:
        some = F.col("q50") + SPREAD * (F.col("q50") - F.col("q25")) + SLACK
        none = F.floor(F.col("p25") / 2).cast("bigint") if rule == "scarce" else F.col("p75") + FENCE * (F.col("p75") - F.col("p25"))
        return F.greatest(F.lit(floor), F.least(F.lit(cap), F.coalesce(F.when(F.col("q50") > 0, some).otherwise(none), F.lit(cap))))

    most = [F.max(F.when(F.col("rate") == k, limit(*rule))).alias(f"max_{k}") for k, (_, *rule) in RATES.items()]
    least = F.max(F.when(F.col("rate") == "word_length", F.col("q50") - SPREAD * (F.col("q50") - F.col("q25")) - SLACK)).alias("min_word_length")
    return got.groupBy(F.col("lang").alias("lang_"), F.col("source").alias("source_")).agg(*most, least)


def judge(measured: DataFrame) -> DataFrame:
    """measured (as measure() gives, read twice: pass a stored table) with base_failed and kept."""
    most = pin(limits(sketches(measured)))
    most = broadcast_if(most, most.count(), 50_000)
    joined = measured.join(most, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    fine = F.lit(True)
    for k, (e, *_) in RATES.items():
        rate = F.expr(f"cast(if(n_words > 0, {e}, 0) as bigint)")
        fine = fine & F.coalesce(rate <= F.col(f"max_{k}"), F.lit(True))
        if k == "word_length":
            fine = fine & F.coalesce(rate >= F.col("min_word_length"), F.lit(True))
    failed = F.expr(BASE_FAILED)
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text", "lang", "source")
    measured = stored(measure(held).drop("text"), "quality")
    return judge(measured).where("kept").select("row.*")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    measured = pin(measure(docs).drop("text"))
    return judge(measured).select("doc_id", *COUNTS, "base_failed", "kept")


_W = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
with d as (select doc_id, lang, source, coalesce(text, '') as t, row_number() over () as rid from documents),
w as (select *, regexp_extract_all(t, '{_W}') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) as ls from d),
win as (select rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') as k from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
dup as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as n from win) where n > 1),
rep as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 8)) as p from dup) group by rid),
m as (select doc_id, lang, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
  coalesce(rep.n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines from w left join rep using (rid)),
g as (select * from m where not {BASE_FAILED}),
r as (select lang, source, rate, case when v < {1 << BITS} then v else ((v >> (length(bin(v)) - {BITS})::int) << (length(bin(v)) - {BITS})::int) end as b from (
  {" union all ".join(f"select lang, source, '{k}' as rate, ({e.replace('/', '//')})::bigint as v from g" for k, (e, *_) in RATES.items())})),
s1 as (select lang, source, rate, b, count(*) as n from r group by all),
a1 as (select rate, b, floor({1000.0 * PRIOR} * (sum(n)::double / sum(sum(n)) over (partition by rate)::double))::bigint as w from s1 group by rate, b),
l1 as (select lang, rate, b, sum(w)::bigint as w from (select lang, rate, b, 1000 * n as w from s1 union all select lang, rate, b, w from (select distinct lang from s1) cross join a1) group by all),
l2 as (select lang, rate, b, floor({1000.0 * PRIOR} * (w::double / sum(w) over (partition by lang, rate)::double))::bigint as w from l1),
o1 as (select lang, source, rate, b, sum(w)::bigint as w from (select lang, source, rate, b, 1000 * n as w from s1 union all
  select x.lang, x.source, l2.rate, l2.b, l2.w from (select distinct lang, source from s1) x join l2 on x.lang is not distinct from l2.lang) group by all),
c as (select *, sum(w) over u as cum, sum(w) over t as total, sum(case when b > 0 then w else 0 end) over u as cum_, sum(case when b > 0 then w else 0 end) over t as total_
  from o1 window t as (partition by lang, source, rate), u as (partition by lang, source, rate order by b)),
q as (select lang, source, rate, min(b) filter (cum * 100 >= total * 25) as q25, min(b) filter (cum * 100 >= total * 50) as q50,
  min(b) filter (b > 0 and cum_ * 100 >= total_ * 25) as p25, min(b) filter (b > 0 and cum_ * 100 >= total_ * 75) as p75 from c group by all),
x as (select lang, source, {", ".join(f"max(greatest({floor}, least({cap}, coalesce(case when q50 > 0 then q50 + {SPREAD} * (q50 - q25) + {SLACK} else {'p25 // 2' if rule == 'scarce' else f'p75 + {FENCE} * (p75 - p25)'} end, {cap})))) filter (rate = '{k}') as max_{k}" for k, (_, rule, floor, cap) in RATES.items())},
  max(q50 - {SPREAD} * (q50 - q25) - {SLACK}) filter (rate = 'word_length') as min_word_length from q group by all),
f as (select m.*, x.* exclude (lang, source), {BASE_FAILED} as base_failed
  from m left join x on m.lang is not distinct from x.lang and m.source is not distinct from x.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {" and ".join(f"coalesce(({e.replace('/', '//')})::bigint <= max_{k}, true)" for k, (e, *_) in RATES.items())} and coalesce(({RATES["word_length"][0].replace("/", "//")})::bigint >= min_word_length, true) as kept
from f
"""
