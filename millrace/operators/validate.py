"""Checks of a model against its data, each a count that should be zero."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.frame import column_name


def outside(c: Column, domain: tuple) -> Column:
    """Whether a value is none of those that its type allows; null is no value."""
    fits = F.lit(False)
    for how, *x in domain:
        if how == "range":
            low, high = x
            fits = fits | ((c >= low if low is not None else F.lit(True)) & (c <= high if high is not None else F.lit(True)))
        else:
            fits = fits | (c.rlike(f"^(?:{x[0]})$") if how == "match" else c == x[0])
    return c.isNotNull() & ~fits


def datasource_checks(planner, names: list[str] = ()) -> DataFrame:
    """datasource, check, subject, failures: repeated grains, nulls where none are declared, complete bindings that lack values another source has."""
    model, out = planner.model, []
    for name, d in sorted(model.datasources.items()):
        if names and name not in names or d.rowset:
            continue
        frame = planner.scan(name)
        keys = sorted(k for k in d.grain if k in frame.columns)
        if keys and len(keys) == len(d.grain):
            out.append(frame.df.groupBy(*map(frame.col, keys)).count().where("count > 1").agg(F.count("*").alias("failures")).select(F.lit(name).alias("datasource"), F.lit("grain").alias("check"), F.lit(",".join(keys)).alias("subject"), "failures"))
        solid = [c for c in sorted(frame.columns) if "?" not in d.columns[c][1]]
        if solid:
            nulls = frame.df.agg(*(F.count_if(F.col(column_name(c)).isNull()).alias(column_name(c)) for c in solid))
            pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("subject"), F.col(column_name(c)).alias("failures")) for c in solid)))
            out.append(nulls.select(pairs.alias("p")).select(F.lit(name).alias("datasource"), F.lit("null").alias("check"), "p.subject", "p.failures"))
        bounded = [c for c in sorted(frame.columns) if model.concepts[c].domain]
        if bounded:
            lost = frame.df.agg(*(F.count_if(outside(frame.col(c), model.concepts[c].domain)).alias(column_name(c)) for c in bounded))
            pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("subject"), F.col(column_name(c)).alias("failures")) for c in bounded)))
            out.append(lost.select(pairs.alias("p")).select(F.lit(name).alias("datasource"), F.lit("values").alias("check"), "p.subject", "p.failures"))
        for k in keys:
            if d.is_partial(k):
                continue
            for other, o in sorted(model.datasources.items()):
                if other != name and k in o.columns and not o.rowset:
                    f = planner.scan(other)
                    lost = f.df.select(f.col(k).alias("k")).where("k is not null").distinct().join(frame.df.select(frame.col(k).alias("k")), "k", "left_anti")
                    out.append(lost.agg(F.count("*").alias("failures")).select(F.lit(name).alias("datasource"), F.lit(f"domain of {other}").alias("check"), F.lit(k).alias("subject"), "failures"))
    return reduce(DataFrame.union, out)


def declared_joins(planner) -> DataFrame:
    """subset, whole, failures: for each declared relation between keys of different names, the values of the one that the other lacks (both directions where they are declared equal)."""
    model, out = planner.model, []
    for name, of in sorted(model.same.items()):
        anchor = model.canonical(of)
        sides = [d for d in sorted(model.datasources.values(), key=lambda d: d.name) if anchor in d.columns and not d.rowset]
        for part in (d for d in sides if "~" in d.columns[anchor][1]):
            for whole in (d for d in sides if "~" not in d.columns[anchor][1]):
                out.append(missing_values(planner, part, whole, anchor, name))
        full = [d for d in sides if "~" not in d.columns[anchor][1]]
        out += [missing_values(planner, a, b, anchor, name) for a in full for b in full if a is not b]
    if not out:
        return planner.spark.createDataFrame([], "subset string, whole string, relation string, failures long")
    return reduce(DataFrame.union, out)


def missing_values(planner, part, whole, key: str, relation: str) -> DataFrame:
    a, b = planner.scan(part.name), planner.scan(whole.name)
    lost = a.df.select(a.col(key).alias("k")).where("k is not null").distinct().join(b.df.select(b.col(key).alias("k")), "k", "left_anti")
    return lost.agg(F.count("*").alias("failures")).select(F.lit(part.name).alias("subset"), F.lit(whole.name).alias("whole"), F.lit(f"{relation} in {key}").alias("relation"), "failures")


def differences(got: DataFrame, want: DataFrame, tolerance: float = 1e-9, ordered: bool = False) -> DataFrame:
    """Rows of either side that the other lacks, with their number there (n_got, n_want); empty if the results match.

    Columns go by position. Floats are compared after rounding to as many digits as a relative tolerance keeps; with
    ordered, the rows' places count, too.
    """
    if len(got.columns) != len(want.columns):
        raise ValueError(f"{len(got.columns)} columns against {len(want.columns)}")
    names = [f"c{i}" for i in range(len(got.columns))]
    digits = max(1, round(-math.log10(tolerance)))

    def plain(df: DataFrame) -> DataFrame:
        kinds = [f.dataType.typeName() for f in df.schema]
        df = df.toDF(*names)
        cols = [F.format_string(f"%.{digits}g", F.col(c).cast("double")) if k in ("double", "float", "decimal") else F.col(c).cast("string") for c, k in zip(names, kinds, strict=True)]
        at = [F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).alias("place")] if ordered else []
        return df.select(*(x.alias(c) for x, c in zip(cols, names, strict=True)), *at)

    keys = [*names, "place"] if ordered else names
    both = plain(got).withColumn("side", F.lit(1)).unionByName(plain(want).withColumn("side", F.lit(0)))
    counts = both.groupBy(*keys).agg(F.sum("side").alias("n_got"), F.sum(1 - F.col("side")).alias("n_want"))
    return counts.where("n_got != n_want")
