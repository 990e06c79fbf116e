"""What is known of a table before it is modelled: its columns, keys, a sample, a summary of a result, a model to start from."""

from __future__ import annotations

from itertools import combinations
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of the language for Spark's.
NAMES = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "string": "string", "boolean": "bool", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "datetime", "binary": "bytes"}
SEED = 42


def columns(df: DataFrame) -> list[tuple[str, str]]:
    """Each column and its type in the language (any for one that it lacks)."""
    return [(f.name, NAMES.get(f.dataType.simpleString(), f.dataType.simpleString() if f.dataType.simpleString().startswith(("decimal", "array", "map", "struct")) else "any")) for f in df.schema]


def sample(df: DataFrame, rows: int = 10_000, seed: int = SEED) -> DataFrame:
    """The rows with the least hashes: spread over the whole table, the same for the same seed however it is partitioned.

    Each task keeps its own least `rows` before they meet, so the table isn't sorted. Repeated rows have one hash and
    are taken together as far as there is room.
    """
    plain = [f"`{f.name}`" for f in df.schema if f.dataType.typeName() != "map"]
    return df.orderBy(F.xxhash64(F.lit(seed), *map(F.col, plain))).limit(rows)


def keys(df: DataFrame, width: int = 2) -> list[list[str]]:
    """The smallest sets of columns, of up to `width`, that tell all rows apart and are never null.

    Candidates come from one pass of approximate counts; what passes is counted exactly, all of one width at once.
    """
    plain = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "array", "struct", "double", "float")]
    if not plain:
        return []
    first = df.agg(F.count("*").alias("n"), *(F.approx_count_distinct(f"`{c}`", 0.02).alias(f"d{i}") for i, c in enumerate(plain)), *(F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(plain))).first()
    n = first["n"]
    solid = [c for i, c in enumerate(plain) if first[f"c{i}"] == n]
    about = {c: first[f"d{i}"] for i, c in enumerate(plain)}
    for k in range(1, width + 1):
        tries = [x for x in combinations(solid, k) if 1.1 * n <= 1.21 * prod(about[c] for c in x)]
        if not tries:
            continue
        got = df.agg(*(F.count_distinct(*(F.col(f"`{c}`") for c in x)).alias(f"u{i}") for i, x in enumerate(tries))).first()
        if found := [list(x) for i, x in enumerate(tries) if got[f"u{i}"] == n]:
            return found
    return []


def summary(df: DataFrame) -> DataFrame:
    """column, rows, non_null, nulls, distinct_approx, min and max (as text) of each column, in one pass."""
    plain = {f.name: f.dataType.typeName() not in ("map", "array", "struct", "binary") for f in df.schema}
    none = F.lit(None).cast("string")
    stats = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(F.col(f"`{c}`")).alias("non_null"), (F.count("*") - F.count(F.col(f"`{c}`"))).alias("nulls"), F.approx_count_distinct(F.col(f"`{c}`").cast("string") if not ok else F.col(f"`{c}`")).alias("distinct_approx") if ok else F.lit(None).cast("bigint").alias("distinct_approx"), (F.min(F.col(f"`{c}`")).cast("string") if ok else none).alias("min"), (F.max(F.col(f"`{c}`")).cast("string") if ok else none).alias("max")) for c, ok in plain.items()]
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def model_of(spark: SparkSession, tables: dict[str, DataFrame]) -> str:
    """A model to start from: for each table a key, properties and a datasource; a column that names another table's key and holds no other values binds it as partial."""
    found = {t: (keys(df) or [None])[0] for t, df in tables.items()}
    single = {k[0]: t for t, k in found.items() if k and len(k) == 1}
    lines, bindings = [], {}
    for t, df in tables.items():
        own, bindings[t] = found[t], []
        for c, kind in columns(df):
            owner = single.get(c)
            if owner and owner != t:
                lost = df.select(F.col(f"`{c}`").alias("v")).where("v is not null").distinct().join(tables[owner].select(F.col(f"`{c}`").alias("v")), "v", "left_anti")
                if not lost.take(1):
                    bindings[t].append(f"{c}: ~{owner}.{c}")
                    continue
            if own and c in own:
                lines.append(f"key {t}.{c} {kind};")
            elif own:
                lines.append(f"property <{','.join(f'{t}.{k}' for k in own)}>.{t}.{c} {kind};")
            else:
                lines.append(f"property {t}.{c} {kind};")
            bindings[t].append(f"{c}: {t}.{c}")
    lines.sort(key=lambda x: not x.startswith("key"))
    for t, b in bindings.items():
        grain = f" grain ({', '.join(f'{t}.{k}' for k in found[t])})" if found[t] else ""
        lines.append(f"datasource {t} ({', '.join(b)}){grain} address {t};")
    return "\n".join(lines) + "\n"
