"""Refresh by freshness: which written datasources lag behind the others, and files that arrive taken in once.

`freshness` compares the greatest value of a datasource's watermark key with the greatest one that other datasources have;
a lag within the declared allowance is no reason to rebuild. `ingest` appends the files that came since its last call.
"""

from __future__ import annotations

import json
import subprocess
import sys
from dataclasses import replace
from functools import reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import spark_type
from ..lang.parser import LanguageError, Node
from ..plans.frame import column_name, full
from ..sources.readers import write_slices


def freshness(engine, key: str, within: str = "0 seconds") -> DataFrame:
    """datasource, high, newest, stale of each datasource that binds the key of dates or times.

    newest is the greatest value that any datasource has; stale where high is earlier than newest by more than `within`
    (an interval as in SQL), or where the datasource is empty and another one isn't. Null keys don't count.
    """
    model, address = engine.model, engine.model.address(key)
    names = [n for n, d in sorted(model.datasources.items()) if address in d.columns and not d.rowset]
    if not names:
        raise LanguageError(f"no datasource binds {key}")

    def high(name: str) -> DataFrame:
        frame = engine.planner.scan(name)
        return frame.df.agg(F.max(frame.col(address).cast("timestamp")).alias("high")).select(F.lit(name).alias("datasource"), "high")

    newest = F.max("high").over(Window.partitionBy(F.lit(1)))  # over one row a datasource
    late = F.when(F.col("high").isNull(), F.col("newest").isNotNull()).otherwise(F.col("high") < F.col("newest") - F.expr(f"interval {within}"))
    return reduce(DataFrame.union, map(high, names)).withColumn("newest", newest).select("datasource", "high", "newest", late.alias("stale"))


def checksum(columns: list[str]) -> Column:
    """An order-free checksum of the rows' values in columns."""
    return F.bit_xor(F.xxhash64(*(F.col(c).cast("string") for c in columns)))


def probe(path: str) -> bool:
    """Whether a program says that a datasource is up to date: it prints true, 1 or yes; any other end than success is an error."""
    done = subprocess.run([*([sys.executable] if path.endswith(".py") else []), path], capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"{path} ended with {done.returncode}: {done.stderr.strip()[-500:]}")
    return done.stdout.strip().lower() in ("true", "1", "yes")


def drift(engine, d) -> list[str]:
    """How a written table's columns depart from what is declared: missing ones, and ones of another type."""
    have = {f.name: f.dataType.simpleString() for f in d.load().schema}
    out = []
    for c, (e, _) in d.columns.items():
        if isinstance(e, Node) and e.kind == "ref":
            kind = engine.model.concepts[c].type
            want = spark_type(kind) if kind else None
            if e.name not in have:
                out.append(f"lacks {e.name}")
            elif want and have[e.name] != want and not {have[e.name], want} <= NUMBERS and not {have[e.name], want} <= TIMES:
                out.append(f"{e.name} is {have[e.name]}, not {want}")
    return out


#: Types of one family, between which a table may differ from the declaration.
NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}
TIMES = {"timestamp", "timestamp_ntz"}


def expected(engine, d) -> DataFrame:
    """The rows that a datasource should have, from the others; columns by its own names."""
    engine.model.datasources[d.name] = replace(d, published=False)
    try:
        items = [(e.name, engine.planner.expand(Node("ref", c)), False) for c, (e, _) in d.columns.items()]
        return engine.planner.result(items, [], None, [])
    finally:
        engine.model.datasources[d.name] = d


def slices(engine, name: str) -> DataFrame:
    """The slices of a partitioned datasource that a refresh would write: its partition columns, and why: missing, stale or gone.

    A slice is stale where the number of its rows or the checksum of their values isn't that of the rows it should have.
    Both sides are aggregated to a row a slice, then compared, null-safely.
    """
    d = engine.model.datasources[name]
    keys = [d.columns[engine.model.address(p)][0].name for p in d.partition]
    if not keys:
        raise LanguageError(f"{name} has no partitions")
    want = expected(engine, d)
    cols = sorted(want.columns)

    def marks(df: DataFrame, prefix: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(f"{prefix}n"), checksum(cols).alias(f"{prefix}h"))

    mine = marks(want, "w")
    table = engine.table(d.write_to)
    if not engine.spark.catalog.tableExists(table):
        return mine.select(*keys, F.lit("missing").alias("why"))
    casts = {f.name: f.dataType for f in want.schema}
    held = engine.spark.table(table)
    both = full(mine, marks(held.select(*(F.col(c).cast(casts[c]).alias(c) for c in cols)), "h"), keys)
    why = F.when(F.col("hn").isNull(), "missing").when(F.col("wn").isNull(), "gone").when(~(F.col("wn").eqNullSafe(F.col("hn")) & F.col("wh").eqNullSafe(F.col("hh"))), "stale")
    return both.select(*keys, why.alias("why")).where("why is not null")


def refresh_slices(engine, name: str) -> dict[tuple, str]:
    """Writes what slices() names and leaves the others; returns it by slice. The list of slices is the only thing the driver holds."""
    d = engine.model.datasources[name]
    todo = {tuple(r[:-1]): r[-1] for r in slices(engine, name).collect()}
    keys = [d.columns[engine.model.address(p)][0].name for p in d.partition]
    table = engine.table(d.write_to)
    wanted = [k for k, why in todo.items() if why != "gone"]
    if wanted:
        df = expected(engine, d)
        pick = engine.spark.createDataFrame(wanted, df.select(*keys).schema)
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
        write_slices(engine.spark, df.alias("r").join(F.broadcast(pick).alias("s"), reduce(lambda a, b: a & b, same), "left_semi"), table, keys)  # pick: a row a slice
    for k in (k for k, why in todo.items() if why == "gone"):
        if any(v is None for v in k):
            raise LanguageError(f"{name} has a slice without a key that its sources no longer have: rebuild it whole")
        spec = ", ".join(f"`{c}` = '{v}'" for c, v in zip(keys, k, strict=True))
        engine.spark.sql(f"alter table {table} drop if exists partition ({spec})")
    engine.written.add(d.write_to)
    return todo


def stale(engine) -> dict[str, str]:
    """The datasources that a refresh would rebuild, in order, each with why: missing, of another schema, empty, behind the
    roots, with other keys than the roots, out of date by a program's word, or with slices that differ.

    Managed are those that aren't root and declare `freshness by`, `incremental by` or `partition by`. Finer ones come
    first, so that coarser ones can be built from them.
    """
    model, out = engine.model, {}
    managed = [d for d in model.datasources.values() if not d.root and (d.freshness or d.incremental or d.partition) and d.write_to]
    for d in sorted(managed, key=lambda d: (-len(model.closure(d.grain)), d.name)):
        if "/" not in d.write_to and not engine.spark.catalog.tableExists(engine.table(d.write_to)):
            out[d.name] = "missing"
            continue
        if lost := drift(engine, d):
            out[d.name] = f"schema: {', '.join(lost)}"
            continue
        if d.freshness and d.freshness.endswith((".py", ".sh")):
            if not probe(str(Path(engine.root or ".") / d.freshness)):
                out[d.name] = f"by the word of {d.freshness}"
            continue
        if not (d.freshness or d.incremental):
            if slices(engine, d.name).take(1):
                out[d.name] = "slices differ"
            continue
        key = model.address(d.freshness or d.incremental)
        roots = [o.name for o in model.datasources.values() if key in o.columns and o.name != d.name and o.root]
        high = lambda n: engine.planner.scan(n).df.agg(F.max(column_name(key))).first()[0]  # noqa: B023, E731
        newest = max((v for v in map(high, roots) if v is not None), default=None)
        mine = high(d.name)
        if mine is None:
            if newest is not None:
                out[d.name] = "empty"
        elif newest is not None and mine < newest:
            one = engine.spark.createDataFrame([(mine, newest)], "a {0}, b {0}".format(engine.planner.scan(d.name).df.schema[column_name(key)].dataType.simpleString()))
            late = F.col("a") < (F.col("b") - F.expr(f"interval {d.within}") if not d.within.startswith("0 ") else F.col("b"))
            if one.select(late).first()[0]:
                out[d.name] = f"behind: {mine} of {newest}"
        elif roots and (other := differing(engine, d, roots)):
            out[d.name] = f"keys differ from {other}"
    return out


def differing(engine, d, roots: list[str]) -> str | None:
    """The first root of the same grain whose keys have another checksum, though neither side is behind."""
    for r in roots:
        root = engine.model.datasources[r]
        if root.grain == d.grain and d.grain and all(k in d.columns for k in d.grain):
            mark = lambda n: engine.planner.scan(n).df.agg(checksum([column_name(k) for k in sorted(d.grain)])).first()[0]
            if mark(d.name) != mark(r):
                return r
    return None


def refresh(engine) -> dict[str, str]:
    """Rebuilds what stale() names; returns it. A datasource that waits for its turn is hidden, so no stale table is read.

    With `partition by` the slices that differ are written, with `incremental by` the rows past the greatest key are
    appended, else the table is written anew; by a program where `refresh` names one.
    """
    todo = stale(engine)
    for name in todo:
        engine.model.datasources[name].published = False
    for name, why in todo.items():
        d = engine.model.datasources[name]
        if d.refresh:
            subprocess.run([*([sys.executable] if d.refresh.endswith(".py") else []), str(Path(engine.root or ".") / d.refresh)], check=True)
            engine.model.datasources[name] = replace(d, published=True)
        elif d.partition and not why.startswith("schema"):
            engine.model.datasources[name] = replace(d, published=True)
            refresh_slices(engine, name)
        elif d.incremental and why.startswith("behind"):
            key = engine.model.address(d.incremental)
            mark = engine.planner.scan(name).df.agg(F.max(column_name(key))).first()[0]
            engine.do_rebuild(name, Node("call", ">", (Node("ref", key), Node("lit", mark))), "append")
        else:
            engine.do_rebuild(name, None, "overwrite")
    return todo


def snapshot(engine) -> dict[str, dict]:
    """By the place of its data, each datasource's columns, and of its watermark key (if it has one) the greatest value and the keys' checksum: plain values that JSON holds."""
    out = {}
    for d in engine.model.datasources.values():
        place = d.write_to
        if not place or d.rowset:
            continue
        try:
            frame = engine.planner.scan(d.name)
        except AnalysisException:
            out[place] = {"missing": True}
            continue
        key = d.freshness or d.incremental
        row = {"columns": {f.name: f.dataType.simpleString() for f in d.load().schema}}
        if drift(engine, d):  # its values can't be read as declared
            out[place] = row
            continue
        marks = [checksum(sorted(column_name(k) for k in d.grain if k in frame.columns)).alias("keys")] if any(k in frame.columns for k in d.grain) else []
        marks += [F.max(frame.col(engine.model.address(key))).cast("string").alias("high")] if key and not key.endswith((".py", ".sh")) else []
        out[place] = row | (frame.df.agg(*marks).first().asDict() if marks else {})
    return out


def changed(before: dict[str, dict], now: dict[str, dict]) -> dict[str, str]:
    """What differs between two snapshots, by place: new, gone, or the parts that are other."""
    out = {p: "new" for p in now.keys() - before.keys()} | {p: "gone" for p in before.keys() - now.keys()}
    for p in now.keys() & before.keys():
        if parts := sorted(k for k in now[p].keys() | before[p].keys() if now[p].get(k) != before[p].get(k)):
            out[p] = ", ".join(parts)
    return out


def save_snapshot(spark: SparkSession, path: str, held: dict[str, dict]) -> None:
    """One JSON text in shared storage, replaced as a whole."""
    spark.createDataFrame([(json.dumps(held, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_snapshot(spark: SparkSession, path: str) -> dict[str, dict]:
    return json.loads(spark.read.text(path).first()[0])


def ingest(spark: SparkSession, folder: str, table: str, state: str, schema: str, format: str = "parquet") -> None:  # noqa: A002
    """Appends the files of `folder` that no earlier call with the same `state` folder took in to a table, exactly once.

    The state folder is a checkpoint in shared storage: a call that was cut short is finished by the next. An empty
    folder changes nothing.
    """
    stream = spark.readStream.schema(schema).format(format).load(folder)
    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).toTable(table).awaitTermination()


def windowed(stream: DataFrame, time: str, length: str, late: str, by: list[str] = (), slide: str | None = None, **aggregates) -> DataFrame:
    """Aggregates of a stream (or a table) by windows of time and further columns; rows later than `late` are dropped by a stream.

    aggregates: a Column each, by name. Columns: start, end, those of by, then the aggregates. State is one row a window
    and group and is let go once the watermark is past the window's end.
    """
    w = F.window(time, length, slide).alias("w") if slide else F.window(time, length).alias("w")
    out = stream.withWatermark(time, late).groupBy(w, *by).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *aggregates)
