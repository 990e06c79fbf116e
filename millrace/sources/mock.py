"""Made-up rows for datasources: the same value for the same key in each of them, so that they join and agree."""

from __future__ import annotations

import string
from dataclasses import replace
from itertools import count
from re import _parser as re_parser

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import spark_type
from ..lang.parser import LanguageError, Node
from ..plans.frame import column_name
from ..plans.model import Concept, Datasource, Model


def mocked(spark: SparkSession, model: Model, d: Datasource, rows: int) -> Datasource:
    """d over `rows` made-up rows. Keys of its grain number the rows (as digits where there are several); other keys are
    drawn evenly from 1 to rows; a property is a function of its keys. Values keep to what their type allows.
    """
    row, keys = F.col("id"), sorted(k for k in d.grain if k in d.columns)
    side = next(n for n in range(1, rows + 2) if n ** max(len(keys), 1) >= rows)
    at: dict[str, Column] = {}
    for i, k in enumerate(keys):
        at[k] = F.floor(row / side**i) % side + 1 if len(keys) > 1 else row + 1
    for c in d.columns:
        if c not in at and model.concepts[c].purpose == "key":
            at[c] = F.pmod(F.xxhash64(F.lit(c), row), F.lit(rows)) + 1
    values = []
    for c in d.columns:
        concept = model.concepts[c]
        of = [at[k] for k in sorted(model.natural_keys(c)) if k in at] or [row]
        number = at[c] if c in at else F.xxhash64(F.lit(c), *of)
        values.append(value(concept, number, c in at).alias(column_name(c)))
    df = spark.range(rows).select(*values)
    return replace(d, columns={c: (Node("ref", column_name(c)), marks) for c, (_, marks) in d.columns.items()}, load=lambda: df, where=None)


def value(c: Concept, number: Column, key: bool) -> Column:
    """A value of the concept's type for a number; different ones for different numbers if it is a key of an open type."""
    kind, name = spark_type(c.type or "string"), c.address.rsplit(".", 1)[-1]
    listed = [x[1] for x in c.domain if x[0] == "value"]
    bounds = next((x[1:] for x in c.domain if x[0] == "range"), None)
    if listed:
        return F.element_at(F.array(*map(F.lit, listed)), (F.pmod(number, F.lit(len(listed))) + 1).cast("int")).cast(kind)
    if bounds and not isinstance(bounds[0] or bounds[1], str):
        low = bounds[0] if bounds[0] is not None else bounds[1] - 1000
        high = bounds[1] if bounds[1] is not None else low + 1000
        if kind == "bigint":
            return (F.pmod(number, F.lit(int(high) - int(low) + 1)) + int(low)).cast(kind)
        return (F.pmod(number, F.lit(1001)) / 1000 * (high - low) + low).cast(kind)
    match = next((x[1] for x in c.domain if x[0] == "match"), None)
    if match and kind == "string":
        return patterned(match, F.xxhash64(number))
    small = number if key else F.pmod(number, F.lit(1000))
    if kind.startswith("array"):
        return F.array(value(Concept(c.address, c.purpose, kind[6:-1]), number, key))
    if kind == "string":
        return F.concat_ws("_", F.lit(name), small.cast("string"))
    if kind == "boolean":
        return F.pmod(number, F.lit(2)) == 0
    if kind == "date":
        return F.date_add(F.lit("2020-01-01").cast("date"), small.cast("int"))
    if kind.startswith("timestamp"):
        return F.timestamp_add("MINUTE", small.cast("int"), F.lit("2020-01-01").cast(kind))
    if kind == "bigint" or kind == "int":
        return small.cast(kind)
    if kind == "double" or kind.startswith("decimal"):
        return (small / (1 if key else 4)).cast(kind)
    return F.lit(None).cast(kind)


#: Characters that stand for a class in made-up text.
CLASSES = {"CATEGORY_DIGIT": string.digits, "CATEGORY_WORD": string.ascii_lowercase + string.digits, "CATEGORY_SPACE": " "}
#: Repetitions made of an open repeat, beyond its least.
MORE = 4


def patterned(pattern: str, seed: Column) -> Column:
    """A text that a regular expression matches, a function of a number: literals, classes, groups, choices and repeats."""
    places = count()

    def pick(n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(next(places)), seed), F.lit(n))

    def letters(items) -> str:
        out = ""
        for op, x in items:
            if str(op) == "LITERAL":
                out += chr(x)
            elif str(op) == "RANGE":
                out += "".join(map(chr, range(x[0], x[1] + 1)))
            elif str(op) == "CATEGORY" and str(x) in CLASSES:
                out += CLASSES[str(x)]
            elif str(op) == "NEGATE":
                return "".join(ch for ch in string.ascii_letters + string.digits if ch not in letters(items[1:]))
            else:
                raise LanguageError(f"no text is made for {pattern}")
        return out

    def one(op, x) -> Column:
        match str(op):
            case "LITERAL":
                return F.lit(chr(x))
            case "IN":
                chars = letters(x)
                return F.substring(F.lit(chars), (pick(len(chars)) + 1).cast("int"), F.lit(1))
            case "ANY":
                return F.lit("x")
            case "AT":
                return F.lit("")
            case "SUBPATTERN":
                return every(x[-1])
            case "BRANCH":
                return F.element_at(F.array(*map(every, x[1])), (pick(len(x[1])) + 1).cast("int"))
            case "MAX_REPEAT" | "MIN_REPEAT":
                least, most = x[0], min(x[1], x[0] + MORE)
                times = pick(most - least + 1) + least
                return F.concat_ws("", *(every(x[2]) if i < least else F.when(F.lit(i) < times, every(x[2])) for i in range(most)))
        raise LanguageError(f"no text is made for {pattern}")

    def every(items) -> Column:
        return F.concat_ws("", *(one(op, x) for op, x in items))

    return every(re_parser.parse(pattern))
