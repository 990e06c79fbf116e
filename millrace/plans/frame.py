"""Frames: a lazy DataFrame whose columns are concepts, with the keys that are known to be unique in it."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang.parser import LanguageError


def column_name(address: str) -> str:
    return address.replace(".", "__")


@dataclass
class Frame:
    """columns: concept -> column name; unique: concepts that identify a row (empty: one row); partial: keys whose domain is not complete here;
    nulls: keys that may be null as a value; padded: columns that an outer join may have filled with null.
    """

    df: DataFrame
    columns: dict[str, str]
    unique: frozenset[str]
    partial: frozenset[str] = frozenset()
    nulls: frozenset[str] = frozenset()
    padded: frozenset[str] = frozenset()

    def col(self, concept: str) -> Column:
        return F.col(self.columns[concept])


def join(a: Frame, b: Frame, on: list[str], minimal, lookup: frozenset[str] = frozenset()) -> Frame:
    """Joins on shared keys; no row is lost but where both sides bind the whole domain of a key.

    A side's rows can lack a partner where the other side binds a part of the domain only, or where their own key is
    null; such a side is preserved (both: a full join with the keys coalesced). Nulls that are values on both sides
    meet; what an outer join filled in never does. lookup ("a", "b"): sides whose rows without a partner hold nothing
    that is asked for, which are not preserved.
    """
    every, on = on, [k for k in on if k in minimal(frozenset(on))]  # keys that others determine need no comparison
    keep_a = "a" not in lookup and any(k in b.partial or k in a.nulls | a.padded for k in on)
    keep_b = "b" not in lookup and any(k in a.partial or k in b.nulls | b.padded for k in on)
    how = "full" if keep_a and keep_b else "left" if keep_a else "right" if keep_b else "inner"
    # Expressions as text: each Column would be several calls to the JVM.
    right = b.df.selectExpr(*(f"`{c}` as `r__{c}`" for c in b.columns.values()))
    pair = lambda k: (f"`{a.columns[k]}`", f"`r__{b.columns[k]}`")
    values = (a.nulls & b.nulls) - a.padded - b.padded
    out = a.df.join(right, F.expr(" and ".join(f"{pair(k)[0]} {'<=>' if k in values else '='} {pair(k)[1]}" for k in on)), how)
    take = {}
    for c, name in {**b.columns, **a.columns}.items():
        if c in every:
            x, y = pair(c)
            take[c] = f"{f'coalesce({x}, {y})' if how == 'full' else y if how == 'right' else x} as `{name}`"
        else:
            take[c] = f"`{name}`" if c in a.columns else f"`r__{name}` as `{name}`"
    names = {c: a.columns.get(c) or b.columns[c] for c in take}
    keys = a.unique if b.unique <= frozenset(on) else b.unique if a.unique <= frozenset(on) else a.unique | b.unique
    shared = frozenset(every)
    narrow = lambda k: how != "full" if k in a.partial & b.partial else not keep_b if k in a.partial else not keep_a
    partial = frozenset(k for k in a.partial | b.partial if k not in shared or narrow(k))
    from_a, from_b = how != "right", how in ("right", "full")

    def carried(x: frozenset[str], y: frozenset[str]) -> frozenset[str]:
        return (x - shared) | (y - shared) | frozenset(k for k in shared if k in x and from_a or k in y and from_b)

    padded = carried(a.padded, b.padded)
    if how in ("left", "full"):
        padded |= frozenset(b.columns) - shared - frozenset(a.columns)
    if how in ("right", "full"):
        padded |= frozenset(a.columns) - shared
    return Frame(out.selectExpr(*take.values()), names, minimal(keys), partial, carried(a.nulls, b.nulls), padded)


def cross(a: Frame, b: Frame) -> Frame:
    """Adds the columns of a frame of one row."""
    if a.unique and b.unique:
        raise LanguageError(f"nothing connects {sorted(a.columns)} and {sorted(b.columns)}; a cross join is not made silently")
    many, one = (a, b) if a.unique else (b, a)
    return replace(many, df=many.df.crossJoin(F.broadcast(one.df)), columns={**one.columns, **many.columns})  # one row


def align(left: DataFrame, right: DataFrame, on: list[str], plain: frozenset[str] = frozenset()) -> DataFrame:
    """left with the columns of right, which has a row at most for each value of the columns on; null-safe but on plain ones, which are never null."""
    if not on:
        return left.crossJoin(F.broadcast(right))  # results without keys have one row
    other = right.selectExpr(*(f"`{c}` as `r__{c}`" if c in on else f"`{c}`" for c in right.columns))
    cond = " and ".join(f"`{c}` {'=' if c in plain else '<=>'} `r__{c}`" for c in on)
    return left.join(other, F.expr(cond), "left").drop(*(f"r__{c}" for c in on))


def merged(parts: list[DataFrame], on: list[str]) -> DataFrame:
    """Results that have a row for each value of the columns on, and columns of their own, as one: a row for each value that any has.

    They are stacked and grouped: null keys meet without a null-safe join, and what is hashed by the keys stays so.
    """
    if not on:
        return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each
    own = [c for p in parts for c in p.columns if c not in on]
    held = [p.selectExpr(*(f"`{c}`" for c in on), *(f"`{c}`" if c in p.columns else f"null as `{c}`" for c in own)) for p in parts]
    return reduce(DataFrame.unionAll, held).groupBy(*on).agg(*(F.expr(f"first(`{c}`, true) as `{c}`") for c in own))


def full(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Null-safe full join of results on columns of equal names, which are coalesced."""
    if not on:
        return left.crossJoin(F.broadcast(right))  # results without keys have one row
    other = right.select(*(F.col(c).alias(f"r__{c}" if c in on else c) for c in right.columns))
    cond = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"r__{c}")) for c in on))
    left = left.withColumn("__l", F.lit(True))  # a row that only one side has is told by a marker, not by its keys, which may be null
    out = left.join(other, cond, "full")
    return out.select(*(F.when(F.col("__l"), F.col(c)).otherwise(F.col(f"r__{c}")).alias(c) if c in on else F.col(c) for c in left.columns if c != "__l"), *(c for c in right.columns if c not in on))
