"""Scalar functions of the language as Spark columns. Each takes the frame (for types) and compiled arguments."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.parser import LanguageError

#: Names of types in the language and in Spark.
TYPES = {"string": "string", "bytes": "binary", "bool": "boolean", "int": "bigint", "bigint": "bigint", "float": "double", "double": "double", "number": "double", "numeric": "decimal(20,5)", "decimal": "decimal(20,5)", "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp", "unix_seconds": "bigint", "any": "string", "geography": "struct<x:double,y:double,wkt:string>"}
#: strftime fields and their Java patterns.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%p": "a", "%I": "hh", "%f": "SSSSSS", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%R": "HH:mm", "%D": "MM/dd/yy", "%-d": "d", "%-m": "M", "%-H": "H", "%-I": "h", "%-M": "m", "%-S": "s", "%-j": "D", "%%": "%"}
PARTS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


def spark_type(name: str) -> str:
    name = name.strip()
    if m := re.fullmatch(r"(array|list)<(.*)>", name):
        return f"array<{spark_type(m[2])}>"
    if m := re.fullmatch(r"map<([^,]*),(.*)>", name):
        return f"map<{spark_type(m[1])},{spark_type(m[2])}>"
    if m := re.fullmatch(r"struct<(.*)>", name):
        return "struct<" + ",".join(f"{a}:{spark_type(b)}" for a, b in (x.split(":", 1) for x in m[1].split(","))) + ">"
    if m := re.fullmatch(r"(?:numeric|decimal)\((\d+),(\d+)\)", name):
        return f"decimal({m[1]},{m[2]})"
    return TYPES.get(name.lower(), name)


def type_of(df: DataFrame, c: Column) -> T.DataType:
    return df.select(c.alias("x")).schema["x"].dataType


def pattern(fmt: str) -> str:
    """A strftime format as a Java one; a field that has no counterpart is an error."""
    out = ""
    for piece in re.split(r"(%-?.)", fmt):
        if piece.startswith("%") and piece not in STRFTIME:
            raise LanguageError(f"{piece} isn't a known field of a time format")
        out += STRFTIME[piece] if piece in STRFTIME else "".join(f"'{c}'" if c.isalpha() else "''" if c == "'" else c for c in piece)
    return out


def cast(df: DataFrame, c: Column, to: str) -> Column:
    """Casts to whole numbers round: halves to even for floats, away from zero for decimals."""
    if spark_type(to) == "bigint":
        kind = type_of(df, c)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.rint(c)
        elif isinstance(kind, T.DecimalType):
            c = F.round(c)
    return c.cast(spark_type(to))


def months(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def date_diff(a: Column, b: Column, part: str) -> Column:
    """Boundaries of the part that lie between a and b; whole weeks."""
    days = F.datediff(b.cast("date"), a.cast("date"))
    if part == "day":
        return days.cast("bigint")
    if part == "week":
        return (F.signum(days) * F.floor(F.abs(days) / 7)).cast("bigint")
    if part == "month":
        return (months(b) - months(a)).cast("bigint")
    if part == "quarter":
        return (F.year(b) * 4 + F.quarter(b) - F.year(a) * 4 - F.quarter(a)).cast("bigint")
    if part == "year":
        return (F.year(b) - F.year(a)).cast("bigint")
    size = {"hour": 3600, "minute": 60, "second": 1}[part]
    at = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / size)
    return (at(b) - at(a)).cast("bigint")


def date_part(c: Column, part: str) -> Column:
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "week": F.weekofyear, "quarter": F.quarter, "hour": F.hour, "minute": F.minute, "second": F.second, "day_of_week": F.dayofweek}[part](c).cast("bigint")


def date_trunc(c: Column, part: str) -> Column:
    if part in ("hour", "minute", "second"):
        return F.date_trunc(part, c).cast("timestamp_ntz")
    return F.date_trunc(part, c).cast("date")


def date_add(df: DataFrame, c: Column, part: str, n: Column, sign: int) -> Column:
    amount = n * sign
    if isinstance(type_of(df, c), T.DateType):
        whole = {"day": lambda: F.date_add(c, amount.cast("int")), "week": lambda: F.date_add(c, (amount * 7).cast("int")), "month": lambda: F.add_months(c, amount.cast("int")), "quarter": lambda: F.add_months(c, (amount * 3).cast("int")), "year": lambda: F.add_months(c, (amount * 12).cast("int"))}
        if part in whole:
            return whole[part]()
    return F.timestamp_add(part.upper(), amount.cast("int"), c)


def contains(s: Column, t: Column) -> Column:
    return F.contains(F.lower(s), F.lower(t))


def substring(s: Column, start: Column, length: Column) -> Column:
    """1-based; a place before the text takes up part of the length."""
    end = start + length
    begin = F.greatest(start, F.lit(1))
    return F.when(start < 0, F.substr(s, start, length)).otherwise(F.substr(s, begin, F.greatest(end - begin, F.lit(0))))


def regexp_extract(s: Column, regex: str, group: int | None = None) -> Column:
    if group is None:
        group = 1 if re.compile(regex).groups else 0
    return F.regexp_extract(s, regex, group)


def regexp_replace_first(s: Column, regex: str, to: str) -> Column:
    groups = re.sub(r"\\(\d)", lambda m: f"${int(m[1]) + 1}", to)
    shifted = re.sub(r"\\(\d)", lambda m: f"\\{int(m[1]) + 1}", regex)
    return F.when(F.regexp_like(s, F.lit(regex)), F.regexp_replace(s, F.lit(f"(?s)\\A(.*?)(?:{shifted})"), F.lit("$1" + groups))).otherwise(s)


def length(df: DataFrame, c: Column) -> Column:
    return (F.size(c) if isinstance(type_of(df, c), (T.ArrayType, T.MapType)) else F.length(c)).cast("bigint")


def array_sort(c: Column, order: str = "asc") -> Column:
    return F.sort_array(c, asc=False) if order == "desc" else F.array_sort(c)


def array_sum(df: DataFrame, c: Column) -> Column:
    kind = type_of(df, c).elementType
    zero = F.lit(0).cast("bigint" if isinstance(kind, T.IntegralType) else "double")
    some = F.filter(c, lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, zero, lambda a, x: a + x.cast("bigint" if isinstance(kind, T.IntegralType) else "double")))


def digest(c: Column, how: str) -> Column:
    return {"md5": lambda: F.md5(c), "sha1": lambda: F.sha1(c), "sha256": lambda: F.sha2(c, 256), "sha512": lambda: F.sha2(c, 512)}[how]()


def index(df: DataFrame, c: Column, i: Column) -> Column:
    """A map's value for a key, or an array's element, from 1, from the end if negative; null where there is none."""
    return F.try_element_at(c, F.nullif(i, F.lit(0)) if isinstance(type_of(df, c), T.ArrayType) else i)


def grain(*parts: Column) -> Column:
    """A hash of values, nulls among them; each part's length stands before it, so no two rows of values are written alike."""
    text = lambda x: F.concat(F.length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string"))
    return F.md5(F.concat_ws("", *(F.coalesce(text(x), F.lit("-")) for x in parts)))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(None).cast("string").alias("wkt"))


def shape(wkt: Column) -> Column:
    """A geography from its text: a point, or another shape (multipoint, linestring, polygon without holes) by its centroid and text."""
    kind = F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))
    inner = F.regexp_extract(wkt, r"\(+([^()]*)\)", 1)
    at = lambda p, k: F.get(F.split(F.trim(p), r"\s+"), k).cast("double")
    ps = F.transform(F.split(inner, ","), lambda p: F.struct(at(p, 0).alias("x"), at(p, 1).alias("y")))
    add = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    pairs = F.zip_with(F.slice(ps, F.lit(1), F.greatest(F.size(ps) - 1, F.lit(0))), F.slice(ps, 2, 1 << 30), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    length = lambda s: F.sqrt(F.pow(s["b"]["x"] - s["a"]["x"], 2) + F.pow(s["b"]["y"] - s["a"]["y"], 2))

    def centre(k: str) -> Column:
        mean = add(ps, lambda p: p[k]) / F.size(ps)
        line = F.try_divide(add(pairs, lambda s: (s["a"][k] + s["b"][k]) / 2 * length(s)), add(pairs, length))
        area = F.try_divide(add(pairs, lambda s: (s["a"][k] + s["b"][k]) * cross(s)), 3 * add(pairs, cross))
        return F.when(kind == "LINESTRING", line).when(kind == "POLYGON", area).otherwise(mean)

    known = kind.isin("POINT", "MULTIPOINT", "LINESTRING", "POLYGON") & ~F.regexp_like(wkt, F.lit(r"\)\s*,\s*\(.*,"))
    made = F.struct(centre("x").alias("x"), centre("y").alias("y"), F.when(kind != "POINT", wkt).alias("wkt"))
    return F.when(wkt.isNotNull(), F.when(known, made).otherwise(F.raise_error(F.concat(F.lit("no such shape: "), wkt))))


def of_point(g: Column, value: Column) -> Column:
    return F.when(g.getField("wkt").isNull(), value)


#: Fixed value: the radius of the sphere of web mercator, in metres.
MERCATOR = 6378137.0


def reproject(g: Column, source: int, target: int) -> Column:
    """A point in another reference system, axes as the authority orders them: latitude, longitude in 4326; easting, northing in 3857."""
    x, y = g.getField("x"), g.getField("y")
    if source == target:
        return g
    if (source, target) == (4326, 3857):
        return F.when(g.isNotNull(), of_point(g, point(F.radians(y) * MERCATOR, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(x) / 2)) * MERCATOR)))
    if (source, target) == (3857, 4326):
        return F.when(g.isNotNull(), of_point(g, point(F.degrees(2 * F.atan(F.exp(y / MERCATOR)) - math.pi / 2), F.degrees(x / MERCATOR))))
    raise LanguageError(f"geo_transform knows EPSG 4326 and 3857, not {source} to {target}")


def null_safe_in(x: Column, values: list[Column]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | x.eqNullSafe(v)
    return out


#: Functions of columns alone.
PLAIN = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.try_divide(a, b),
    "mod": lambda a, b: F.try_mod(a, b),
    "power": F.pow,
    "negate": lambda a: -a,
    "abs": F.abs,
    "sqrt": F.sqrt,
    "floor": F.floor,
    "ceil": F.ceil,
    "random": lambda *a: F.rand(),
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "not": lambda a: ~a,
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "is_null": lambda a: a.isNull(),
    "is_not_distinct": lambda a, b: a.eqNullSafe(b),
    "between": lambda x, a, b: x.between(a, b),
    "like": lambda s, p: F.like(s, p, F.lit("\x01")),
    "ilike": lambda s, p: F.ilike(s, p, F.lit("\x01")),
    "coalesce": F.coalesce,
    "greatest": F.greatest,
    "least": F.least,
    "nullif": F.nullif,
    "bool": lambda a: F.coalesce(a.cast("boolean"), F.lit(False)),
    "current_date": F.current_date,
    "current_datetime": F.localtimestamp,
    "current_timestamp": F.current_timestamp,
    "concat": lambda *a: F.concat_ws("", *a),
    "concat_strict": F.concat,
    "upper": F.upper,
    "lower": F.lower,
    "trim": F.trim,
    "ltrim": F.ltrim,
    "rtrim": F.rtrim,
    "replace": F.replace,
    "strpos": lambda s, t: F.position(t, s).cast("bigint"),
    "contains": contains,
    "substring": substring,
    "hex": F.hex,
    "regexp_contains": lambda s, r: F.regexp_like(s, r),
    "date": lambda c: c.cast("date"),
    "datetime": lambda c: c.cast("timestamp_ntz"),
    "timestamp": lambda c: c.cast("timestamp"),
    **{p: (lambda c, p=p: date_part(c, p)) for p in (*PARTS, "day_of_week")},
    "month_name": lambda c: F.date_format(c, "MMMM"),
    "day_name": lambda c: F.date_format(c, "EEEE"),
    "unix_to_timestamp": lambda n: F.timestamp_seconds(n),
    "map_keys": F.map_keys,
    "map_values": F.map_values,
    "map": F.create_map,
    "generate_array": lambda a, b, s=None: F.sequence(a, b, s) if s is not None else F.sequence(a, b),
    "array_distinct": lambda a: F.array_compact(F.array_distinct(a)),
    "array_to_string": lambda a, sep: F.array_join(a, sep) if isinstance(sep, str) else F.call_function("array_join", a, sep),
    "tuple": lambda *a: F.struct(*a),
    "grain": grain,
    "geo_point": point,
    "geo_x": lambda p: of_point(p, p.getField("x")),
    "geo_y": lambda p: of_point(p, p.getField("y")),
    "geo_centroid": lambda p: F.when(p.isNotNull(), point(p.getField("x"), p.getField("y"))),
    "geo_distance": lambda a, b: of_point(a, of_point(b, F.sqrt(F.pow(a.getField("x") - b.getField("x"), 2) + F.pow(a.getField("y") - b.getField("y"), 2)))),
    "geo_from_text": shape,
}
#: Functions that need the frame or literal arguments: (frame, columns, literal values).
SPECIAL = {
    "index": lambda df, c, v: index(df, *c),
    "geo_transform": lambda df, c, v: reproject(c[0], int(v[1]), int(v[2])),
    "len": lambda df, c, v: length(df, c[0]),
    "length": lambda df, c, v: length(df, c[0]),
    "round": lambda df, c, v: F.round(c[0], v[1] if len(c) > 1 else 0),
    "log": lambda df, c, v: F.log10(c[0]) if len(c) == 1 else F.ln(c[0]) / F.ln(c[1]),
    "split": lambda df, c, v: F.split(c[0], re.escape(v[1]), -1),
    "concat_ws": lambda df, c, v: F.concat_ws(v[0], *c[1:]),
    "regexp_extract": lambda df, c, v: regexp_extract(c[0], v[1], v[2] if len(c) > 2 else None),
    "regexp_replace": lambda df, c, v: regexp_replace_first(c[0], v[1], v[2]),
    "hash": lambda df, c, v: digest(c[0], v[1]),
    "format_time": lambda df, c, v: F.date_format(c[0], pattern(v[1])),
    "parse_time": lambda df, c, v: F.try_to_timestamp(c[0], F.lit(pattern(v[1]))).cast("timestamp_ntz"),
    "date_trunc": lambda df, c, v: date_trunc(c[0], v[1]),
    "date_part": lambda df, c, v: date_part(c[0], v[1]),
    "date_add": lambda df, c, v: date_add(df, c[0], v[1], c[2], 1),
    "date_sub": lambda df, c, v: date_add(df, c[0], v[1], c[2], -1),
    "date_diff": lambda df, c, v: date_diff(c[0], c[1], v[2]),
    "array_sort": lambda df, c, v: array_sort(c[0], v[1] if len(c) > 1 else "asc"),
    "array_sum": lambda df, c, v: array_sum(df, c[0]),
    "getattr": lambda df, c, v: c[0].getField(v[1]),
}
#: Arguments of these are words, not concepts.
WORDS = {"hash": {1}, "date_trunc": {1}, "date_part": {1}, "date_add": {1}, "date_sub": {1}, "date_diff": {2}, "array_sort": {1}}
