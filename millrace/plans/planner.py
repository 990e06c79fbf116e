"""The planner: from a select over concepts to one lazy DataFrame.

Every aggregate gets rows of its own: the datasources that its argument and its grouping need, joined so that no row is
lost, reduced to the distinct grain of the argument, and grouped. Results are joined null-safely on their keys. So two
facts never meet before they are aggregated, and no measure is counted twice.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..lang.render import expr as render
from ..lang.parser import LanguageError, Node
from .frame import Frame, align, column_name, cross, full, join, merged
from .model import Concept, Datasource, Model
from .search import cheapest_tree

COUNTS = ("count", "count_distinct")
#: How the names of sources begin that hold all values of the keys of union joins.
UNITED = "united:"


def conjuncts(x: Node | None) -> list[Node]:
    if x is None:
        return []
    return conjuncts(x.args[0]) + conjuncts(x.args[1]) if x.kind == "call" and x.name == "and" else [x]


def both(xs: list[Node]) -> Node | None:
    return reduce(lambda a, b: Node("call", "and", (a, b)), xs) if xs else None


class Side:
    """The values that one side of a join binds, for a test of presence."""

    def __init__(self, frame):
        self.frame = frame


def implies(given: Node, wanted: Node) -> bool:
    """Whether a condition makes another one true: the same, or bounds and values of one concept that lie within the other's."""
    if given == wanted:
        return True
    a, b = allowed(given), allowed(wanted)
    if a is None or b is None or a[0] != b[0]:
        return False
    (_, mine, low, high), (_, theirs, least, most) = a, b
    try:
        if mine is not None:
            return all((theirs is None or v in theirs) and (least is None or v > least[0] or v == least[0] and least[1]) and (most is None or v < most[0] or v == most[0] and most[1]) for v in mine)
        above = least is None or low is not None and (low[0] > least[0] or low[0] == least[0] and (least[1] or not low[1]))
        below = most is None or high is not None and (high[0] < most[0] or high[0] == most[0] and (most[1] or not high[1]))
    except TypeError:  # values of different types
        return False
    return theirs is None and above and below


def disjuncts(x: Node) -> list[Node]:
    return disjuncts(x.args[0]) + disjuncts(x.args[1]) if x.kind == "call" and x.name == "or" else [x]


def implied(x: Node) -> list[Node]:
    """Of a disjunction, what it says of one concept alone: for each concept that every arm has a condition on, the arms' conditions on it."""
    arms = disjuncts(x)
    if len(arms) < 2 or any(n.kind in ("agg", "win", "scalar", "subselect", "in") and not (n.kind == "in" and n.name == "list") for n in x.walk()):
        return []
    of = [{} for _ in arms]
    for arm, mine in zip(arms, of, strict=True):
        for atom in conjuncts(arm):
            names = {n.name for n in atom.walk() if n.kind == "ref"}
            if len(names) == 1 and disjuncts(atom) == [atom]:
                mine.setdefault(names.pop(), []).append(atom)
    shared = set(of[0]).intersection(*of[1:])
    return [reduce(lambda a, b: Node("call", "or", (a, b)), (both(mine[c]) for mine in of)) for c in sorted(shared)]


#: Functions that are null where an argument is.
STRICT = {"add", "subtract", "multiply", "negate", "abs", "floor", "ceil", "upper", "lower", "trim", "length", "len", "year", "month", "day", "date", "datetime"}


def rejects_null(x: Node) -> set[str]:
    """Concepts without which a condition can't be true."""

    def within(y: Node) -> set[str]:
        if y.kind == "ref":
            return {y.name}
        return set().union(*map(within, y.args)) if y.kind == "cast" or y.kind == "call" and y.name in STRICT else set()

    if x.kind == "call" and x.name in ("=", "!=", "<", ">", "<=", ">=", "like", "ilike", "between"):
        return set().union(*map(within, x.args))
    if x.kind == "call" and x.name == "and":
        return rejects_null(x.args[0]) | rejects_null(x.args[1])
    if x.kind == "call" and x.name == "or":
        return rejects_null(x.args[0]) & rejects_null(x.args[1])
    if x.kind == "call" and x.name == "not" and x.args[0].kind == "call" and x.args[0].name in ("is_null", "like", "ilike", "between"):
        return set().union(*map(within, x.args[0].args))
    if x.kind == "in" and x.name == "list" and not any(y.kind != "lit" or y.name is None for y in x.args[1:]):
        return within(x.args[0])
    return set()


def allowed(x: Node) -> tuple | None:
    """(concept, its values or None, lower and upper bound as (value, inclusive) or None) of a simple condition."""
    plain = lambda y: y.name if y.kind == "lit" and y.name is not None else None
    if x.kind == "in" and x.name == "list" and x.args[0].kind == "ref" and all(plain(y) is not None for y in x.args[1:]):
        return x.args[0], tuple(y.name for y in x.args[1:]), None, None
    if x.kind != "call" or x.name not in ("=", "<", ">", "<=", ">=", "between") or x.args[0].kind != "ref" or any(plain(y) is None for y in x.args[1:]):
        return None
    v = x.args[1].name
    match x.name:
        case "=":
            return x.args[0], (v,), None, None
        case "between":
            return x.args[0], None, (v, True), (x.args[2].name, True)
        case ">" | ">=":
            return x.args[0], None, (v, x.name == ">="), None
    return x.args[0], None, None, (v, x.name == "<=")


class Planner:
    def __init__(self, spark: SparkSession, model: Model, hooks=None):
        self.spark, self.model, self.hooks = spark, model, hooks
        self.numbers = count()
        self.eligible: set[str] | None = None
        self.scoped: dict[str, str] = {}
        #: Keys of a scoped join by their own names, with the datasources that bound them: null tests ask for presence there.
        self.probes: dict[str, list[str]] = {}
        self.held: dict[str, Datasource] = {}
        #: Whether the select at hand may repeat rows, because only its set of rows matters.
        self.loose = False
        #: Whether rows at hand may lack values of united keys, because those are added to the result.
        self.narrow = False

    # Names and lineage

    def expand(self, x: Node, seen: tuple = ()) -> Node:
        """x with derived concepts and macros replaced by what they stand for; names made canonical."""
        if x.kind == "ref":
            name = self.scoped.get(x.name, x.name)
            a = self.model.address(name)
            a = self.scoped.get(a, a)
            c = self.model.concepts[a]
            if c.lineage is None:
                return Node("ref", a)
            if a in seen:
                raise LanguageError(f"{a} is defined by itself")
            return self.expand(c.lineage, (*seen, a))
        if x.kind == "cast" and x.name in self.model.types:
            return Node("cast", self.model.types[x.name], (self.expand(x.args[0], seen),))
        if x.kind == "macro":
            if x.name not in self.model.macros:
                raise LanguageError(f"unknown function @{x.name}")
            params, body = self.model.macros[x.name]
            if len(x.args) > len(params):
                raise LanguageError(f"@{x.name} takes {len(params)} arguments")
            given = dict(zip((p for p, _ in params), x.args, strict=False))
            values = {p: given.get(p, d) for p, d in params}
            if missing := [p for p, v in values.items() if v is None]:
                raise LanguageError(f"@{x.name} needs {missing}")
            put = lambda n: values[n.name] if n.kind == "ref" and n.name in values else n.map(put)
            return self.expand(put(body), seen)
        if x.kind == "agg" and x.name == "any" and x.extra and len(x.args) == 1 and x.args[0].kind == "ref":
            inner = self.expand(x.args[0], seen)
            if inner.kind == "agg" and not inner.extra:  # an aggregate grouped to keys is that aggregate at those keys
                return Node("agg", inner.name, inner.args, (tuple(self.expand(k, seen) for k in x.extra[0]),))
        if x.kind == "call" and x.name in ("array_transform", "array_filter"):
            params, body = self.model.macros[x.args[1].name]
            return Node("call", x.name, (self.expand(x.args[0], seen),), (params[0][0], body))
        if x.kind == "call" and x.name in scalar.WORDS:
            return Node("call", x.name, tuple(Node("lit", a.name) if i in scalar.WORDS[x.name] else self.expand(a, seen) for i, a in enumerate(x.args)))
        return x.map(lambda y: self.expand(y, seen))

    def roots(self, x: Node | None) -> set[str]:
        """The root concepts that rows need to have for x; what other scopes deliver is left out."""
        if x is None:
            return set()
        if x.kind == "ref":
            return set() if x.name.startswith("$") else {x.name}
        if x.kind in ("agg", "win", "scalar", "subselect"):
            return {r for k in x.extra[0] for r in self.roots(k)} if x.kind == "agg" and x.extra else set()
        if x.kind == "in" and x.name in ("set", "select", "present"):
            return self.roots(x.args[0])
        if x.kind == "call" and x.name in ("array_transform", "array_filter"):
            return self.roots(x.args[0])
        out: set[str] = set()
        x.map(lambda y: out.update(self.roots(y)) or y)
        return out

    def grain_of(self, x: Node) -> frozenset[str]:
        return frozenset(k for r in self.roots(x) for k in self.model.natural_keys(r))

    def grain_of_argument(self, x: Node) -> frozenset[str]:
        """A filtered value is one of what is filtered, however fine the condition is."""
        return self.grain_of(x.args[0] if x.kind == "filter" and self.roots(x.args[0]) else x)

    # Rows

    def rows(self, need: set[str], where: list[Node] = (), demanded: set[str] | None = None) -> Frame:
        """One frame with the needed root concepts: the cheapest connected set of datasources, joined.

        demanded: those of them that outputs are made of; the others only decide which rows stay.
        """
        if not need:
            return Frame(self.spark.range(1).select(F.lit(True).alias("one__row")), {}, frozenset())
        demanded = need if demanded is None else demanded
        kept = self.model.datasources, self.model.memo
        shown = {n: replace(d, columns={**d.columns, **{k: (Node("ref", c), "~") for k, c in d.echo.items() if k in need}}) for n, d in kept[0].items() if d.echo.keys() & need and d.columns.keys() & need}
        if shown:  # rowsets beside keys that they were made with
            self.model.datasources, self.model.memo = {**kept[0], **shown}, {}
        try:
            parts = self.components(need, list(where), demanded)
            if self.hooks:
                self.hooks.call("sources", [n for p in parts for n in p])
            return reduce(cross, (self.joined(p, demanded, list(where)) for p in parts))
        finally:
            self.model.datasources, self.model.memo = kept

    def components(self, need: set[str], where: list[Node], demanded: set[str]) -> list[list[str]]:
        chosen = self.cover(need, where, demanded)
        groups: list[set[str]] = []
        for name in chosen:
            mine = {name}
            rest = []
            for g in groups:
                if any(self.linked(name, o) for o in g):
                    mine |= g
                else:
                    rest.append(g)
            groups = [*rest, mine]
        return [sorted(g) for g in groups]

    def usable(self) -> dict:
        return {n: d for n, d in self.model.datasources.items() if d.published and not d.aggregates and (self.eligible is None or n in self.eligible or d.rowset) and not (self.narrow and n.startswith(UNITED))}

    def linked(self, a: str, b: str) -> list[str]:
        """The keys on which two datasources can be joined."""
        x, y = self.model.datasources[a], self.model.datasources[b]
        shared = set(x.columns) & set(y.columns)
        return sorted(k for k in shared if not self.model.concepts[k].is_row and (self.model.concepts[k].purpose == "key" or k in x.grain | y.grain))

    def whole(self, d: Datasource, where: list[Node]) -> bool:
        """Whether a datasource has all rows that conditions let through."""
        return not d.partial or d.complete is not None and all(any(implies(w, c) for w in where) for c in conjuncts(self.expand(d.complete)))

    def cover(self, need: set[str], where: list[Node], demanded: set[str]) -> list[str]:
        """The datasources to join: the connected set with the fewest of them, then the least keys by grain, that has all concepts.

        What outputs are made of comes from complete bindings where there are any. A partial datasource serves only
        where its slice holds all that the conditions let through.
        """
        have = self.usable()
        owners = {n: {k for k, d in have.items() if n in d.columns or n in d.grain} for n in need}
        if lost := sorted(n for n, k in owners.items() if not k):
            raise LanguageError(f"no datasource has {lost}")
        sliced = {k for k, d in have.items() if not self.whole(d, where)}
        if lost := sorted(n for n, k in owners.items() if k <= sliced):
            raise LanguageError(f"only partial datasources have {lost}, and the conditions don't keep to their slices")
        owners = {n: k - sliced for n, k in owners.items()}

        sure = set().union(*map(rejects_null, where)) if where else set()
        held = {k for k, d in have.items() if any(c in d.columns and owners.get(c, set()) <= {k} for c in sure)}

        def bound(n: str) -> set[str]:
            """Where all values of n that the rows can have are: in complete bindings, and in a partial one whose own rows a condition asks for."""
            return {k for k in owners[n] if n in have[k].columns and ("~" not in have[k].columns[n][1] or k in held)} if n in demanded else set()

        usable = {k: d for k, d in have.items() if k not in sliced}
        near = {k: [o for o in usable if o != k and self.linked(k, o)] for k in usable}
        price = {k: (1, 2 * len(d.grain) + (k.startswith("union:"))) for k, d in usable.items()}
        single = sorted({k for n in need for k in owners[n] if not usable[k].grain and not any(usable[o].grain for o in owners[n])})
        rest = [n for n in need if not owners[n] & set(single)]
        if not rest:
            return single
        for terms in ([bound(n) or owners[n] for n in rest], [owners[n] for n in rest]):
            if (found := cheapest_tree(terms, near, price)) is not None:
                return sorted({*found, *single})
        raise LanguageError(f"nothing connects {sorted(need)}; a cross join is not made silently")

    def asked(self, d: Datasource, where: list[Node]) -> tuple[list[str], list[tuple]]:
        """What a program is asked for: the columns that are bound, and the simple conditions on them."""
        columns = sorted({n.name for e, _ in d.columns.values() if isinstance(e, Node) for n in e.walk() if n.kind == "ref"})
        filters = []
        for a in where:
            if a.kind == "call" and a.name in ("=", "<", ">", "<=", ">=") and a.args[0].kind == "ref" and a.args[1].kind == "lit" and a.args[0].name in d.columns:
                bound = d.columns[a.args[0].name][0]
                if isinstance(bound, Node) and bound.kind == "ref":
                    filters.append((bound.name, a.name, a.args[1].name))
        return columns, filters

    def scan(self, name: str, where: list[Node] = ()) -> Frame:
        return self.scan_of(self.model.datasources[name], where)

    def scan_of(self, d: Datasource, where: list[Node] = ()) -> Frame:
        df = d.push(*self.asked(d, where)) if d.push else d.load()
        if d.where is not None:
            df = df.where(self.compile_physical(self.physical(d.where, d), df))
        cols = {}
        for c, (expr, _) in d.columns.items():
            kind = self.model.concepts[c].type
            to = scalar.spark_type(kind) if kind in ("int", "bigint", "float", "double", "number") and not isinstance(expr, tuple) else None
            if isinstance(expr, Node) and expr.kind == "ref":  # as text: a Column would be several calls to the JVM
                e = F.expr(f"cast(`{expr.name}` as {to}) as `{column_name(c)}`" if to else f"`{expr.name}` as `{column_name(c)}`")
            else:
                e = F.expr(expr[1]) if isinstance(expr, tuple) else self.compile_physical(expr, df)
                e = (e.cast(to) if to else e).alias(column_name(c))
            cols[c] = e
        partial = frozenset(c for c in d.columns if "~" in d.columns[c][1])
        out = df.select(*cols.values())
        may = frozenset(f.name for f in out.schema if f.nullable) if d.rowset else frozenset()
        nulls = frozenset(c for c in cols if "?" in d.columns[c][1] or column_name(c) in may)
        return Frame(out, {c: column_name(c) for c in cols}, d.grain, partial, nulls)

    def physical(self, x: Node, d) -> Node:
        """A condition over concepts as one over the columns of a datasource; names that are no concepts are columns."""
        if x.kind == "ref":
            try:
                a = self.model.address(x.name)
            except LanguageError:
                return x
            if a in d.columns and isinstance(d.columns[a][0], Node):
                return d.columns[a][0]
            c = self.model.concepts[a]
            return self.physical(c.lineage, d) if c.lineage is not None else x
        return x.map(lambda y: self.physical(y, d))

    def compile_physical(self, x: Node, df: DataFrame) -> Column:
        if x.kind == "ref":
            return F.col(x.name)
        return self.compile(x, df, {r.name: r.name for r in x.walk() if r.kind == "ref"})

    def joined(self, names: list[str], demanded: set[str], where: list[Node] = ()) -> Frame:
        """The datasources joined from the finest to the coarsest."""
        order = sorted(names, key=lambda n: (-len(self.model.closure(self.model.datasources[n].grain) & frozenset(k for o in names for k in self.model.datasources[o].grain)), n))
        out = self.scan(order[0], where)
        rest = order[1:]
        while rest:
            for n in rest:
                d = self.model.datasources[n]
                on = [k for k in out.columns if k in d.columns and not self.model.concepts[k].is_row and (self.model.concepts[k].purpose == "key" or k in d.grain)]
                if on:
                    frame = self.scan(n, where)
                    out = join(out, frame, on, self.model.minimal, self.lookups(out, frame, on, demanded))
                    rest.remove(n)
                    break
            else:
                raise LanguageError(f"nothing connects {order[0]} and {rest}")
        return out

    def lookups(self, a: Frame, b: Frame, on: list[str], demanded: set[str]) -> frozenset[str]:
        """The side, if any, that is a row for each value of the keys and determines nothing that is asked for: it is only looked up."""
        shared = frozenset(on)
        if self.model.closure(shared) & demanded:
            return frozenset()
        sides = {n for n, f in (("a", a), ("b", b)) if f.unique and f.unique <= shared}
        return frozenset(sides) if len(sides) == 1 else frozenset()

    # Conditions

    def filtered(self, need: set[str], where: list[list[Node]], grain: list[Node], beside: frozenset[str] = frozenset()) -> Frame:
        """Rows with the needed concepts that pass all stages; aggregates inside a stage see what passed the stages before."""
        atoms, demanded = [a for stage in where for a in stage], set(need) - beside
        for a in atoms:
            need = need | self.roots(a) | ({r for k in grain for r in self.roots(k)} if any(n.kind == "agg" and not n.extra for n in self.own(a)) else set())
        frame = self.rows(need, atoms, demanded or None)
        for a in [x for a in atoms for x in implied(a)]:  # narrower ones first: they reach the scans
            frame = self.keep(frame, a)
        plain = [a for a in atoms if not any(n.kind in ("agg", "win", "scalar", "subselect") for n in self.own(a))]
        for a in plain:
            frame = self.keep(frame, a)
        passed: list[list[Node]] = []
        for stage in where:
            for a in (a for a in stage if a not in plain):
                frame = self.keep(*self.with_values(frame, a, passed, grain))
            passed = [*passed, stage]
        return frame

    def own(self, x: Node):
        """The nodes of x that aren't inside another aggregate, window or select."""
        yield x
        if x.kind not in ("agg", "win", "scalar", "subselect"):
            kids: list[Node] = []
            x.map(lambda y: kids.append(y) or y)
            for y in kids if not (x.kind == "in" and x.name == "set") else kids[:1]:
                yield from self.own(y)

    def with_values(self, frame: Frame, x: Node, where: list[list[Node]], grain: list[Node]) -> tuple[Frame, Node]:
        """frame with columns for the aggregates and scalar selects of x, and x over these columns."""
        put: dict[Node, Node] = {}
        for n in self.own(x):
            if n in put or n.kind not in ("agg", "scalar", "win"):
                continue
            name = f"$v{next(self.numbers)}"
            if n.kind == "scalar":
                one = self.select(n.extra[0].select, nested=True)
                one = one.agg(F.first(one.columns[0]).alias("v"), F.count(F.lit(1)).alias("n"))  # one row, null for none
                one = one.select(F.when(F.col("n") > 1, F.raise_error(F.lit("a select that stands for a value has several rows"))).otherwise(F.col("v")).alias(column_name(name)))
                frame = replace(frame, df=frame.df.crossJoin(F.broadcast(one)), columns={**frame.columns, name: column_name(name)})
            elif n.kind == "agg":
                keys = list(n.extra[0]) if n.extra else grain
                got = self.aggregates([n], keys, where)
                names = [f"__k{i}" for i in range(len(keys))]
                df = frame.df.withColumns({k: self.compile(x, frame.df, frame.columns) for k, x in zip(names, keys, strict=True)}) if names else frame.df
                right = got.selectExpr(*(f"k{i} as __k{i}" for i in range(len(keys))), f"a0 as `{column_name(name)}`")
                solid = frozenset(c for c, k in zip(names, keys, strict=True) if self.solid(frame, k))
                df = align(df, right, names, solid).drop(*names)
                if n.name in COUNTS:
                    df = df.withColumn(column_name(name), F.coalesce(column_name(name), F.lit(0)))
                frame = replace(frame, df=df, columns={**frame.columns, name: column_name(name)})
            else:
                df = frame.df.withColumn(column_name(name), self.window(n, frame.df, frame.columns))
                frame = replace(frame, df=df, columns={**frame.columns, name: column_name(name)})
            put[n] = Node("ref", name)
        swap = lambda y: put[y] if y in put else y if y.kind in ("agg", "scalar", "win") else y.map(swap)
        return frame, swap(x)

    def solid(self, frame: Frame, x: Node) -> bool:
        """Whether a column is a key that is declared to have no nulls; what an outer join filled in is no value either."""
        return x.kind == "ref" and x.name in frame.columns and x.name not in frame.nulls and self.model.concepts[x.name].purpose == "key" and not any("?" in d.columns[x.name][1] or d.rowset for d in self.model.datasources.values() if x.name in d.columns)

    def keep(self, frame: Frame, atom: Node) -> Frame:
        """The rows for which an atom is true; memberships at the top become semi and anti joins."""
        no = atom.kind == "call" and atom.name == "not"
        inner = atom.args[0] if no else atom
        if inner.kind == "in" and inner.name in ("set", "select", "present") and not self.is_array(inner, frame):
            df, left, right = self.member_sides(frame.df, frame.columns, inner)
            members = inner.args[0].args if inner.args[0].kind == "call" and inner.args[0].name == "tuple" else (inner.args[0],)
            same = ("=" if self.solid(frame, m) else "<=>" for m in members)  # one side that is never null is enough
            df = df.join(right, F.expr(" and ".join(f"`{a}` {op} `{b}`" for a, op, b in zip(left, same, right.columns, strict=True))), "left_anti" if no else "left_semi").drop(*left)
            return replace(frame, df=df)
        frame, atom = self.flagged(frame, atom)
        return replace(frame, df=frame.df.where(self.compile(atom, frame.df, frame.columns)))

    def is_array(self, x: Node, frame: Frame) -> bool:
        right = x.args[1] if x.name == "set" else None
        if right is None:
            return False
        if right.kind == "array":
            return True
        return right.kind == "ref" and right.name in frame.columns and isinstance(frame.df.schema[frame.columns[right.name]].dataType, T.ArrayType)

    def member_sides(self, df: DataFrame, columns: dict, x: Node) -> tuple[DataFrame, list[str], DataFrame]:
        left = x.args[0].args if x.args[0].kind == "call" and x.args[0].name == "tuple" else (x.args[0],)
        names = []
        for i, e in enumerate(left):
            names.append(f"__m{next(self.numbers)}")
            df = df.withColumn(names[-1], self.compile(e, df, columns))
        if x.name == "present":
            right = x.extra[0].frame()
        elif x.name == "select":
            self.loose = x.extra[0].select.get("limit") is None
            right = self.select(x.extra[0].select, nested=True)
        else:
            members = x.args[1].args if x.args[1].kind == "call" and x.args[1].name == "tuple" else (x.args[1],)
            rule = [members[0].args[1]] if len(members) == 1 and members[0].kind == "filter" else []  # what a filter leaves out is no member
            narrow, self.narrow = self.narrow, False
            right = self.result([(f"m{i}", m.args[0] if rule else m, False) for i, m in enumerate(members)], [conjuncts(r) for r in rule], None, [])
            self.narrow = narrow
        k = next(self.numbers)
        return df, names, right.toDF(*(f"__s{k}_{i}" for i in range(len(right.columns))))

    def flagged(self, frame: Frame, atom: Node) -> tuple[Frame, Node]:
        """Memberships below the top as columns that are true or false."""
        put: dict[Node, Node] = {}
        for n in self.own(atom):
            if n.kind == "in" and n.name in ("set", "select", "present") and not self.is_array(n, frame):
                df, left, right = self.member_sides(frame.df, frame.columns, n)
                right = right.distinct()
                flag = f"$v{next(self.numbers)}"
                right = right.withColumn(column_name(flag), F.lit(True))
                cond = reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right.columns, strict=False)))
                df = df.join(right, cond, "left").drop(*left, *right.columns[:-1])
                df = df.withColumn(column_name(flag), F.coalesce(column_name(flag), F.lit(False)))
                frame = replace(frame, df=df, columns={**frame.columns, flag: column_name(flag)})
                put[n] = Node("ref", flag)
        swap = lambda y: put.get(y) or y.map(swap)
        return frame, swap(atom)

    def ready(self, frame: Frame, x: Node, where: list, grain: list[Node]) -> tuple[Frame, Node]:
        """x over columns of frame alone: with columns for its aggregates, scalar selects and memberships."""
        return self.flagged(*self.with_values(frame, x, where, grain))

    # Aggregates

    def aggregates(self, aggs: list[Node], keys: list[Node], where: list[list[Node]], by: tuple | None = None, beside: frozenset[str] = frozenset()) -> DataFrame:
        """One row for each value of keys (k0, k1, ...) with the aggregates a0, a1, ...; all from one stream of rows."""
        args = [a for n in aggs for a in n.args]
        inner = [x for a in args for x in self.own(a) if x.kind in ("agg", "scalar", "win")]
        need = {r for x in (*keys, *args) for r in self.roots(x)}
        for n in inner:
            need |= {r for k in (n.extra[0] if n.extra else ()) for r in self.roots(k)}
        summary = self.from_summary(aggs, keys, where)
        if summary is not None:
            return summary
        frame = self.filtered(need, where, keys, beside)
        grain = frozenset(k for x in keys for k in self.grain_of(x)) | frozenset(k for x in args for k in self.grain_of_argument(x))
        finest = frozenset(k for x in (*keys, *args) for k in self.grain_of(x))
        put = []
        columns = []
        for k in keys:
            frame, k = self.ready(frame, k, where, [])
            columns.append(k)
        for n in aggs:
            new = []
            for a in n.args:
                frame, a = self.ready(frame, a, where, keys)
                new.append(a)
            put.append(Node(n.kind, n.name, tuple(new), n.extra))
        more = frozenset(k for n in inner if n.extra for x in n.extra[0] for k in self.grain_of(x))
        grain, finest = self.model.minimal(grain | more), self.model.minimal(finest | more)
        known = self.model.closure(grain)
        fine = [n for n in aggs for a in n.args if a.kind == "filter" and self.roots(a.args[0]) and not self.roots(a.args[1]) <= known]
        counted = all(n.name in COUNTS and len(n.args) == 1 and n.args[0].args[0].kind == "ref" and self.model.natural_keys(n.args[0].args[0].name) == {n.args[0].args[0].name} for n in fine)
        if not all(self.repeats_dont_count(n, frame) for n in aggs):
            frame = self.to_grain(frame, finest if fine else grain)
        if fine and not counted and all(k in frame.columns for k in grain):
            frame, put, columns = self.collapsed(frame, grain, put, columns)
        df = frame.df.withColumns({f"k{i}": self.compile(k, frame.df, frame.columns) for i, k in enumerate(columns)}) if columns else frame.df
        names = [f"k{i}" for i in range(len(keys))]
        if by is None and put and frame.unique and not frame.unique & frame.padded and frame.unique <= {k.name for k in keys if k.kind == "ref"}:
            return df.select(*names, *(self.of_one(n, df, frame).alias(f"a{i}") for i, n in enumerate(put)))  # a row is a group
        if by is None:
            grouped = df.groupBy(*names)
        elif by[0] == "sets":
            grouped = df.groupingSets([[names[keys.index(x)] for x in s] for s in by[1]], *names)
        else:
            of = [names[keys.index(x)] for x in by[1]]
            grouped = (df.rollup if by[0] == "rollup" else df.cube)(*of)
        columns = [self.aggregate(n, df, frame, keys).alias(f"a{i}") for i, n in enumerate(put)]
        return grouped.agg(*columns) if columns else grouped.agg(F.count("*").alias("a")).drop("a")

    def repeats_dont_count(self, n: Node, frame: Frame) -> bool:
        """Whether an aggregate is the same over rows that occur several times: counts of keys are of different ones."""
        if n.name in ("count_distinct", "min", "max", "bool_or", "bool_and", "any", "grouping", "grouping_id"):
            return True
        root = n.args[0].args[0] if n.name == "count" and n.args[0].kind == "filter" else n.args[0]
        return n.name == "count" and root.kind == "ref" and root.name in self.model.concepts and not self.model.concepts[root.name].is_row and self.model.natural_keys(root.name) == {root.name} and frame.unique != {root.name}

    def collapsed(self, frame: Frame, grain: frozenset[str], aggs: list[Node], keys: list[Node]) -> tuple[Frame, list[Node], list[Node]]:
        """A row for each value of keys and grain, with the aggregates' arguments: a filtered one where any row passes."""
        made = {f"k{i}": self.compile(k, frame.df, frame.columns) for i, k in enumerate(keys)}
        values, put = {}, []
        for i, n in enumerate(aggs):
            if n.name in ("grouping", "grouping_id"):  # of keys, not of rows
                put.append(n)
                continue
            args = []
            for j, a in enumerate(n.args):
                values[f"__x{i}_{j}"] = self.compile(a, frame.df, frame.columns)
                args.append(Node("ref", f"$x{i}_{j}"))
            put.append(Node(n.kind, n.name, tuple(args), n.extra))
        by = [*made, *(frame.columns[k] for k in sorted(grain))]
        df = frame.df.withColumns({**made, **values}).groupBy(*by).agg(*(F.any_value(c, F.lit(True)).alias(c) for c in values))
        columns = {k: frame.columns[k] for k in grain} | {f"$x{c[3:]}": c for c in values} | {f"$k{i}": f"k{i}" for i in range(len(keys))}
        return Frame(df, columns, frozenset(["$collapsed"])), put, [Node("ref", f"$k{i}") for i in range(len(keys))]

    def to_grain(self, frame: Frame, grain: frozenset[str]) -> Frame:
        """Distinct rows of a grain, with no work where the frame is known to have it."""
        if frame.unique == grain or not frame.unique or frame.unique <= grain:
            return frame
        if any(self.model.concepts[k].is_row for k in grain):
            more = frame.unique - grain
            if all(k in self.model.closure(grain) for k in more):
                return frame
            raise LanguageError(f"rows of {sorted(grain)} can't be told apart after a join that repeats them")
        on = [frame.columns[k] for k in grain if k in frame.columns]
        if not grain:
            return frame
        if len(on) < len(grain):
            return replace(frame, df=frame.df.distinct(), unique=grain)
        return replace(frame, df=frame.df.dropDuplicates(on), unique=grain)

    def aggregate(self, n: Node, df: DataFrame, frame: Frame, keys: list[Node]) -> Column:
        is_row = lambda x: x.kind == "ref" and x.name in self.model.concepts and self.model.concepts[x.name].is_row
        if n.name == "count" and len(n.args) == 1 and n.args[0].kind == "filter" and is_row(n.args[0].args[0]):
            return F.count(self.compile(Node("filter", None, (Node("lit", 1), n.args[0].args[1])), df, frame.columns))
        row = len(n.args) == 1 and is_row(n.args[0])
        c = [F.lit(1) if row else self.compile(a, df, frame.columns) for a in n.args] if n.name not in ("grouping", "grouping_id") else []
        match n.name:
            case "count" if row:
                return F.count(c[0])
            case "count":
                x = n.args[0]
                root = x.args[0] if x.kind == "filter" else x
                is_key = root.kind == "ref" and root.name in self.model.concepts and self.model.natural_keys(root.name) == {root.name} and frame.unique != {root.name}
                return F.count_distinct(c[0]) if is_key else F.count(c[0])
            case "count_distinct":
                return F.count_distinct(c[0]) if len(c) == 1 else F.count_distinct(F.struct(*c))
            case "grouping":
                return F.grouping(f"k{keys.index(n.args[0])}").cast("bigint")
            case "grouping_id":
                bits = [F.grouping(f"k{keys.index(a)}").cast("bigint") for a in n.args]
                return reduce(lambda a, b: a * 2 + b, bits)
            case "array_agg":
                return F.transform(F.collect_list(F.struct(c[0].alias("v"))), lambda s: s["v"])
            case "any":
                return F.any_value(c[0], F.lit(True))
            case name:
                return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_samp, "variance": F.var_samp, "bool_or": F.bool_or, "bool_and": F.bool_and}[name](c[0])

    def of_one(self, n: Node, df: DataFrame, frame: Frame) -> Column:
        """An aggregate of a group of one row, of the type that it has for any group."""
        if n.name in ("grouping", "grouping_id"):
            return F.lit(0).cast("bigint")
        if n.name == "count_distinct" and len(n.args) > 1:
            return F.lit(1).cast("bigint")
        is_row = lambda x: x.kind == "ref" and x.name in self.model.concepts and self.model.concepts[x.name].is_row
        one = lambda x: Node("lit", 1) if is_row(x) else Node("filter", None, (one(x.args[0]), x.args[1])) if x.kind == "filter" else x
        c = self.compile(one(n.args[0]) if n.name in COUNTS else n.args[0], df, frame.columns)
        match n.name:
            case "count" | "count_distinct":
                return F.when(c.isNotNull(), 1).otherwise(0).cast("bigint")
            case "stddev" | "variance":
                return F.lit(None).cast("double")
            case "array_agg":
                return F.array(c)
            case "sum" | "avg":
                kind = scalar.type_of(df, c)
                if isinstance(kind, T.DecimalType):
                    more = (10, 0) if n.name == "sum" else (4, 4)
                    return c.cast(T.DecimalType(min(38, kind.precision + more[0]), min(37, kind.scale + more[1])))
                return c.cast("bigint" if n.name == "sum" and isinstance(kind, T.IntegralType) else "double")
        return c

    def from_summary(self, aggs: list[Node], keys: list[Node], where: list[list[Node]]) -> DataFrame | None:
        """The aggregates from the cheapest datasource that may answer with those it has: at its own grain, or summed up.

        It may not where it has a part of the rows only (unless the conditions keep to that part), where a condition or
        a key is neither in its grain nor a property of it, or where a key that is summed over splits what an aggregate
        counts: a sum or count may be added up over a key only if the aggregate's rows have one value of it each.
        """
        atoms = [a for s in where for a in s]
        if any(n.kind in ("agg", "win", "scalar", "in", "subselect") for a in atoms for n in self.own(a)) or any(k.kind != "ref" for k in keys):
            return None
        wanted = {k.name for k in keys} | {r for a in atoms for r in self.roots(a)}
        found = []
        for d in self.model.datasources.values():
            if not d.aggregates or not d.published or not self.whole(d, atoms):
                continue
            if self.eligible is not None and d.name not in self.eligible:
                continue
            have = {self.strip(self.expand(x)): c for c, x in d.aggregates.items()}
            more = wanted - set(d.columns)
            if any(self.strip(n) not in have for n in aggs) or not more <= self.model.closure(d.grain) or any(self.model.concepts[m].is_row for m in more):
                continue
            dropped = d.grain - {k.name for k in keys}
            if dropped and not all(self.adds_up(n, dropped) for n in aggs):
                continue
            found.append((bool(dropped), len(more), len(d.grain), d.name, have, more))
        if not found:
            return None
        dropped, _, _, name, have, more = min(found, key=lambda f: f[:4])
        frame = self.scan(name)
        for m in sorted(more):
            if m in frame.columns:
                continue
            grain = self.model.datasources[name].grain
            on = next(([g] for g in sorted(grain) if m in self.model.closure(frozenset([g]))), sorted(grain))
            frame = join(frame, self.to_grain(self.rows({m, *on}), frozenset(on)), on, self.model.minimal)
        for a in atoms:
            frame = self.keep(frame, a)
        picked = [F.col(column_name(have[self.strip(n)])) for n in aggs]
        head = [frame.col(k.name).alias(f"k{i}") for i, k in enumerate(keys)]
        zero = lambda n, c: F.coalesce(c, F.lit(0)) if n.name in COUNTS else c
        if not dropped and not (frame.unique - {k.name for k in keys}):
            return frame.df.select(*head, *(zero(n, p).alias(f"a{i}") for i, (n, p) in enumerate(zip(aggs, picked, strict=True))))
        add = {"min": F.min, "max": F.max, "bool_or": F.bool_or, "bool_and": F.bool_and}
        df = frame.df.select(*head, *(p.alias(f"x{i}") for i, p in enumerate(picked)))
        return df.groupBy(*(f"k{i}" for i in range(len(keys)))).agg(*(zero(n, add.get(n.name, F.sum)(f"x{i}")).alias(f"a{i}") for i, n in enumerate(aggs)))

    def adds_up(self, n: Node, dropped: frozenset[str]) -> bool:
        """Whether an aggregate's values at a finer grain give it after keys are dropped from the grain."""
        if n.name in ("min", "max", "bool_or", "bool_and"):
            return True
        if n.name not in ("sum", "count"):
            return False
        return dropped <= self.model.closure(frozenset(k for a in n.args for k in self.grain_of(a)))

    @staticmethod
    def strip(n: Node) -> Node:
        return Node(n.kind, n.name, n.args)

    # Selects

    def select(self, q: dict, nested: bool = False) -> DataFrame:
        if "arms" in q:
            return self.multiselect(q)
        if "items" not in q and "setop" in q:
            return self.setop(q["setop"])
        kept = self.eligible, self.scoped, dict(self.model.concepts), dict(self.model.datasources), dict(self.model.same)
        loose, self.loose = self.loose, False
        narrow, self.narrow = self.narrow, False
        outer, self.model.memo = (self.probes, self.held, self.model.memo), None
        try:
            self.scoped = dict(self.scoped)
            if q["from"]:
                self.eligible = set(q["from"])
            if q.get("setop"):
                self.register("", self.setop(q["setop"]), f"setop{next(self.numbers)}", q["setop"]["names"])
            self.unite([self.scoped_join(kind, chain) for kind, chain in q["joins"]])
            self.model.memo = {}
            own = {a: x for a, x, _ in q["items"]}
            where = [conjuncts(self.expand(self.presence(self.named(w, own)))) for w in q["where"]]
            items = [(a, self.expand(self.presence(self.named(x, {k: v for k, v in own.items() if k != a}))), h) for a, x, h in q["items"]]
            aliases = {a: x for a, x, _ in items}
            over = lambda x: aliases[x.name] if x.kind == "ref" and x.name in aliases else x.map(over) if x.kind != "ref" else self.expand(x)
            having = over(self.presence(q["having"])) if q["having"] is not None else None
            order = [(over(x), d, n) for x, d, n in q["order"]]
            by = q["by"]
            if by:
                by = (by[0], [[over(y) for y in s] for s in by[1]] if by[0] == "sets" else [over(x) for x in by[1]])
            return self.result(items, where, having, order, q["limit"], by, loose)
        finally:
            self.eligible, self.scoped = kept[:2]
            self.model.concepts, self.model.datasources, self.model.same = kept[2:]
            self.probes, self.held, self.model.memo = outer
            self.narrow = narrow

    def scopes(self, q: dict) -> list[tuple]:
        """For each output: its name, what it is, the keys that it has a value for, the conditions its rows have passed, and the datasources of its rows."""
        stages = [conjuncts(self.expand(w)) for w in q["where"]]
        atoms = [a for s in stages for a in s]
        items = [(a, self.expand(x)) for a, x, _ in q["items"]]
        shaped = lambda x: next((n for n in self.own(x) if n.kind in ("agg", "win", "scalar", "subselect")), None)
        dims = [x for _, x in items if shaped(x) is None]
        result = sorted(self.model.minimal(frozenset(k for d in dims for k in self.grain_of(d))))
        population = " and ".join(render(a) for a in atoms) or "all rows"
        out = []
        for name, x in items:
            n = shaped(x)
            if n is None:
                kind, grain, need = "dimension", sorted(self.model.minimal(self.grain_of(x))), self.roots(x)
            elif n.kind == "agg":
                kind = "aggregate"
                grain = sorted({k for y in n.extra[0] for k in self.grain_of(y)}) if n.extra else result
                need = {r for y in (*n.args, *(n.extra[0] if n.extra else dims)) for r in self.roots(y)}
            else:
                kind, grain, need = {"win": "window", "scalar": "value of a select", "subselect": "array"}[n.kind], result, {r for y in (*n.args, *dims) for r in self.roots(y)}
            every = need | {r for a in atoms for r in self.roots(a)}
            out.append((name, kind, grain, population, self.cover(every, atoms, need) if every else []))
        return out

    def scoped_join(self, kind: str, chain: list[Node]) -> tuple[str, set[str]]:
        """subset join: the first is contained in the last, which anchors; union join: neither contains the other.

        Gives the anchor and, of a union join, the datasources that together have all its values.
        """
        names = [self.join_key(x) for x in chain]
        anchor = names[-1]
        for x, n in zip(chain, names, strict=True):
            if x.kind == "ref" and (n != anchor or kind == "union"):
                own = [d.name for d in sorted(self.model.datasources.values(), key=lambda d: (n in d.grain, d.name)) if n in d.columns and d.published]
                self.probes = {**self.probes, n: own, x.name: own}
        self.held = {**self.held, **{k: self.model.datasources[v[0]] for k, v in self.probes.items() if v and k not in self.held}}
        united: set[str] = set()
        for n in names if kind == "union" else ():
            own = [d for d in self.usable().values() if n in d.columns]
            if sure := [d for d in own if not d.is_partial(n)]:
                own = [min(sure, key=lambda d: (len(d.grain | {n}), d.name))]
            united |= {d.name for d in own}
            if self.model.concepts[n].purpose != "key":  # values that aren't keys may be null
                for d in list(self.model.datasources.values()):
                    if n in d.columns:
                        self.mark(d, n, "?")
        for n in names[:-1]:
            self.relate(n, anchor, partial=True)
        if kind == "union":
            for d in list(self.model.datasources.values()):
                if anchor in d.columns:
                    self.mark(d, anchor, "~")
        return anchor, united

    def unite(self, joins: list[tuple[str, set[str]]]) -> None:
        """Sources of all values of the keys of union joins; keys that the same datasources bind have one, of their combinations."""
        own: dict[str, set[str]] = {}
        for key, names in joins:
            if names:
                own.setdefault(self.model.canonical(key), set()).update(names)
        for names in {frozenset(n) for n in own.values()}:
            keys = sorted(k for k, n in own.items() if n == names)
            held = [d for d in (self.model.datasources[n] for n in sorted(names)) if all(k in d.columns for k in keys)]
            marks = {k: "".join(m for m in "?" if any(m in d.columns[k][1] for d in held)) for k in keys}

            def load(held=held, keys=keys) -> DataFrame:
                frames = map(self.scan_of, held)
                return reduce(DataFrame.union, (f.df.select(*map(f.col, keys)) for f in frames)).distinct()

            name = UNITED + ",".join(keys)
            self.model.datasources = {**self.model.datasources, name: Datasource(name, {k: (Node("ref", column_name(k)), marks[k]) for k in keys}, frozenset(keys), load, rowset=True)}

    def join_key(self, x: Node) -> str:
        """The concept that a side of a join names; an expression becomes a key of its own, bound where its concepts are."""
        if x.kind == "ref" and self.model.concepts[self.model.address(x.name)].lineage is None:
            return self.model.address(x.name)
        e = self.expand(x)
        need = self.roots(e)
        if not need:
            raise LanguageError("a join key needs a concept")
        name = f"$join{next(self.numbers)}"
        self.model.concepts = {**self.model.concepts, name: Concept(name, "key", None)}
        own = [d for d in self.model.datasources.values() if d.published and not d.aggregates and all(r in d.columns and isinstance(d.columns[r][0], Node) for r in need)]
        marks = lambda d: "".join(m for m in "?" if any(m in d.columns[r][1] for r in need))
        for d in own:
            self.model.datasources[d.name] = replace(d, columns={**d.columns, name: (self.physical(e, d), marks(d))})
        if not own:  # over several datasources: their join is one more
            frame = self.rows(need)
            df = frame.df.withColumn(column_name(name), self.compile(e, frame.df, frame.columns))
            columns = {c: (Node("ref", k), "~" if c in frame.partial else "") for c, k in frame.columns.items()}
            self.model.datasources = {**self.model.datasources, f"rows{name}": Datasource(f"rows{name}", {**columns, name: (Node("ref", column_name(name)), "?")}, frame.unique, lambda: df, rowset=True)}
        return name

    def named(self, x: Node, own: dict[str, Node]) -> Node:
        """x with names of a select's outputs, where the model has no such concept, replaced by what they stand for."""
        if x.kind != "ref":
            return x.map(lambda y: self.named(y, own))
        try:
            self.model.address(x.name)
        except LanguageError:
            if x.name in own:
                return self.named(own[x.name], {k: v for k, v in own.items() if k != x.name})
        return x

    def presence(self, x: Node) -> Node:
        """Null tests of a joined key as tests of presence: whether the side that the key names has the row's value."""
        if x.kind == "call" and x.name == "is_null" and x.args[0].kind == "ref":
            name = x.args[0].name
            for n in (name, name.removeprefix("local.")):
                if self.probes.get(n):
                    d, anchor = self.held[n], self.model.address(n)
                    own = n if n in d.columns else next((a for a in d.columns if self.model.canonical(a) == anchor), None)

                    def values(d=d, own=own) -> DataFrame:
                        binding = d.columns[own][0]
                        c = F.expr(binding[1]) if isinstance(binding, tuple) else self.compile_physical(binding, d.load())
                        kind = self.model.concepts[own].type
                        c = c.cast(scalar.spark_type(kind)) if kind in ("int", "bigint", "float", "double", "number") else c
                        return d.load().select(c.alias("v")).where("v is not null")

                    return Node("call", "not", (Node("in", "present", (Node("ref", anchor),), (Side(values),)),))
        x = x.map(self.presence)
        twice = x.kind == "call" and x.name == "not" and x.args[0].kind == "call" and x.args[0].name == "not" and x.args[0].args[0].name == "present"
        return x.args[0].args[0] if twice else x

    def mark(self, d, concept: str, sign: str) -> None:
        e, marks = d.columns[concept]
        self.model.datasources[d.name] = replace(d, columns={**d.columns, concept: (e, marks if sign in marks else marks + sign)})

    def relate(self, a: str, b: str, partial: bool) -> None:
        """From now on a is b; where partial, what binds a has only part of b's values."""
        a, b = self.model.canonical(a), self.model.canonical(b)
        if a == b:
            return
        self.model.same = {**self.model.same, a: b}
        for d in list(self.model.datasources.values()):
            swap = lambda k: b if k == a else k
            if a in d.columns or a in d.grain:
                columns = {}
                for c, (e, marks) in d.columns.items():
                    if c == a:
                        columns[b] = (e, marks + "~" if partial and "~" not in marks else marks)
                    elif c not in columns:
                        columns[c] = (e, marks)
                self.model.datasources[d.name] = replace(d, columns=columns, grain=frozenset(map(swap, d.grain)))

    def result(self, items: list, where: list, having: Node | None, order: list, limit: int | None = None, by: tuple | None = None, loose: bool = False) -> DataFrame:
        items, where, having, order = self.narrowed(items, where, having, order)
        if by is not None and by[0] != "sets" and not by[1]:  # by rollup (): over all outputs that aren't aggregates
            by = (by[0], [x for _, x, _ in items if not any(n.kind in ("agg", "win") for n in self.own(x))])
        terms = [x for _, x, _ in items] + ([having] if having is not None else []) + [x for x, _, _ in order]
        shaped = lambda x: any(n.kind in ("agg", "win") for n in self.own(x))
        dims = [x for _, x, _ in items if not shaped(x) and x.kind not in ("scalar", "subselect")]
        if any(n.kind == "agg" and not n.extra for x in terms for n in self.own(x)):
            # beside a free aggregate, one pinned to keys that the result's keys don't determine is a dimension
            known = self.model.closure(frozenset(k for d in dims for k in self.grain_of(d)) | frozenset(d.name for d in dims if d.kind == "ref"))
            dims += [x for _, x, _ in items if x.kind == "agg" and x.extra and x.extra[0] and not self.grain_of(x) <= known]
        aggs: list[Node] = []

        def collect(x: Node) -> None:
            for n in self.own(x):
                if n in dims:
                    continue
                if n.kind == "agg":
                    if n not in aggs:
                        aggs.append(n)
                elif n.kind == "win":
                    for y in (*n.args, *n.extra[0], *(o[0] for o in n.extra[1])):
                        collect(y)
                elif n.kind == "subselect":
                    pass

        for x in terms:
            collect(x)
        # Row-level concepts that only stand beside aggregates, in windows or in having are hidden dimensions.
        hidden: list[Node] = []

        def bare(x: Node) -> None:
            if x in dims or x in hidden or x.kind in ("agg", "scalar", "subselect"):
                return
            if x.kind == "win":
                for y in (*x.args, *x.extra[0], *(o[0] for o in x.extra[1])):
                    bare(y)
            elif x.kind == "ref":
                if x not in dims:
                    hidden.append(x)
            elif x.kind == "in" and x.name in ("set", "select", "present"):
                bare(x.args[0])
            elif not shaped(x) and self.roots(x) and not any(n.kind in ("scalar", "subselect") for n in self.own(x)):
                kids: list[Node] = []
                x.map(lambda y: kids.append(y) or y)
                for y in kids:
                    bare(y)
            else:
                x.map(lambda y: bare(y) or y)

        wants = [x for _, x, _ in items if x not in dims]
        for x in wants:
            bare(x)
        late = [having] if having is not None else []
        late += [x for x, _, _ in order]
        for x in late:
            bare(x)
        pinned: list[Node] = []
        for n in aggs:
            for k in n.extra[0] if n.extra else ():
                if k not in dims and k not in hidden:
                    hidden.append(k)
                    pinned.append(k)
        # Keys of pinned aggregates that the result's keys determine are looked up: their other values add no rows.
        shown = frozenset(k for x in (*dims, *hidden) if x not in pinned for k in self.grain_of(x))
        known = self.model.closure(shown) if shown else frozenset()
        beside = frozenset(r for k in pinned if self.roots(k) <= known for r in self.roots(k)) - {r for x in (*dims, *hidden) if x not in pinned for r in self.roots(x)}
        alone = {k for n in aggs if n.extra for k in n.extra[0]}
        grain = [*dims, *[h for h in hidden if not (h in alone and not dims and not self.needed_outside(h, terms))]]
        df, columns = self.shape(grain, aggs, where, by, list(dims), loose, beside)
        # Everything below works on columns: grain expressions g0.. and aggregates.
        put = {x: Node("ref", c) for x, c in columns.items()}

        def swap(x: Node) -> Node:
            return put[x] if x in put else x if x.kind in ("scalar", "subselect") else x.map(swap)

        named = {v: v for v in columns.values()}
        frame = Frame(df, dict(named), frozenset(["$all"]))

        def values(frame: Frame, x: Node) -> tuple[Frame, Node]:
            """Windows (inner ones first), scalar and array selects, memberships as columns."""
            for n in list(self.own(x)):
                if n.kind == "win" and n not in put:
                    inner = Node("call", "tuple", (*n.args, *n.extra[0], *(o[0] for o in n.extra[1])))
                    if inner.args:
                        frame, _ = values(frame, inner)
                    name = f"$w{next(self.numbers)}"
                    frame = Frame(frame.df.withColumn(column_name(name), self.window(swap(Node("win", n.name, n.args, n.extra)), frame.df, frame.columns, [put[g].name for g in dims if g in put])), {**frame.columns, name: column_name(name)}, frame.unique)
                    put[n] = Node("ref", name)
                elif n.kind == "scalar" and n not in put:
                    frame, new = self.with_values(frame, n, where, grain)
                    put[n] = new
                elif n.kind == "subselect" and n not in put:
                    frame, new = self.subselect(frame, n, dims, put)
                    put[n] = new
            return self.flagged(frame, swap(x))

        compiled = []
        for _, x, _ in items:
            frame, y = values(frame, x)
            compiled.append(y)
        orders = []
        for x, desc, nulls in order:
            frame, y = values(frame, x)
            orders.append((y, desc, nulls))
        if having is not None:
            for atom in conjuncts(having):
                frame, y = values(frame, atom)
                frame = Frame(frame.df.where(self.compile(y, frame.df, frame.columns)), frame.columns, frame.unique)
        df = frame.df
        final = [(a, self.compile(y, df, frame.columns), h) for (a, _, h), y in zip(items, compiled, strict=True)]
        if orders:
            df = df.orderBy(*(self.direction(self.compile(y, df, frame.columns), d, n) for y, d, n in orders))
        unnested = any(n.kind == "call" and n.name in ("unnest", "date_spine") for x in compiled for n in x.walk())
        df = df.select(*(c.alias(column_name(a)) for a, c, h in final if not h))
        if unnested and not aggs:
            df = df.distinct()
        return df.limit(limit) if limit is not None else df

    def narrowed(self, items: list, where: list, having: Node | None, order: list) -> tuple:
        """Filtered concepts that are outputs as a condition on the rows: where they share one condition, there is no
        aggregate, and whatever else is an output is a key of what is filtered. Else other rows show null for them.
        """
        every = [x for _, x, _ in items]
        filters = [x for x in every if x.kind == "filter"]
        terms = [*every, *([having] if having is not None else []), *(x for x, _, _ in order)]
        if len({x.args[1] for x in filters}) != 1 or any(n.kind in ("agg", "win") for x in terms for n in self.own(x) if x.kind != "filter"):
            return items, where, having, order
        cond = filters[0].args[1]
        if any(n.kind in ("win", "scalar", "subselect") or n.kind == "in" and n.name in ("set", "select", "present") for n in self.own(cond)):
            return items, where, having, order
        content = {r for x in filters for r in self.roots(x.args[0])}
        keys = {k for r in content for k in self.model.natural_keys(r)} - {x.args[0].name for x in filters if x.args[0].kind == "ref"}
        if any(x.kind != "ref" or x.name not in keys for x in every if x.kind != "filter"):
            return items, where, having, order
        bare = lambda x: x.args[0] if x in filters else x.map(bare)
        last = [*(where[-1] if where else []), *conjuncts(cond)]
        return [(a, bare(x), h) for a, x, h in items], [*where[:-1], last], bare(having) if having is not None else None, [(bare(x), d, n) for x, d, n in order]

    def needed_outside(self, h: Node, terms: list[Node]) -> bool:
        def look(x: Node) -> bool:
            if x == h:
                return True
            if x.kind in ("agg", "scalar", "subselect"):
                return False
            kids: list[Node] = []
            x.map(lambda y: kids.append(y) or y)
            return any(map(look, kids))

        return any(map(look, terms))

    @staticmethod
    def direction(c: Column, desc: bool, nulls: str) -> Column:
        first = nulls == "first"
        return (c.desc_nulls_first() if first else c.desc_nulls_last()) if desc else (c.asc_nulls_first() if first else c.asc_nulls_last())

    def shape(self, grain: list[Node], aggs: list[Node], where: list, by: tuple | None, dims: list[Node], loose: bool = False, beside: frozenset[str] = frozenset()) -> tuple[DataFrame, dict[Node, str]]:
        """The grain's distinct rows (g0, g1, ...) with every aggregate's column. beside: concepts whose values add no rows."""
        columns: dict[Node, str] = {g: f"g{i}" for i, g in enumerate(grain)}
        if by is not None:
            keys = [*dict.fromkeys(x for s in by[1] for x in s)] if by[0] == "sets" else list(by[1])
            own = [n for n in aggs if not n.extra]
            marks = [Node("agg", "grouping", (k,)) for k in keys]
            df = self.aggregates([*own, *marks], keys, where, by)
            more = [g for g in grain if g not in keys]
            columns = {g: c for g, c in columns.items() if g not in keys} | {k: columns.get(k, f"h{i}") for i, k in enumerate(keys)} | {n: f"x{i}" for i, n in enumerate(own)}
            up = [f"__up{i}" for i in range(len(keys))]
            df = df.select(*(F.col(f"k{i}").alias(columns[k]) for i, k in enumerate(keys)), *(F.col(f"a{i}").alias(f"x{i}") for i in range(len(own))), *(F.col(f"a{len(own) + i}").alias(c) for i, c in enumerate(up)))

            def beside(df: DataFrame, got: DataFrame, of: list[Node]) -> DataFrame:
                """Columns at some of the keys, for the rows in which none of these is rolled up: a null key is no subtotal."""
                at = [up[keys.index(k)] for k in of if k in keys]
                return align(df, got.withColumns({c: F.lit(0).cast("bigint") for c in at}), [columns[k] for k in of] + at)

            if more:  # outputs outside the grouping come back by its keys
                rest = self.distinct([*keys, *more], where)
                df = beside(df, rest.select(*(F.col(f"g{i}").alias(columns[g]) for i, g in enumerate([*keys, *more]))), keys)
            for j, n in enumerate(n for n in aggs if n.extra):
                got = self.aggregates([n], list(n.extra[0]), where)
                got = got.select(*(F.col(f"k{i}").alias(columns[k]) for i, k in enumerate(n.extra[0])), F.col("a0").alias(f"p{j}"))
                df = beside(df, got, list(n.extra[0]))
                columns[n] = f"p{j}"
            return df.drop(*up), columns
        streams: dict[tuple, list[Node]] = {}
        for n in aggs:
            keys = tuple(n.extra[0]) if n.extra else tuple(grain)
            arg_grain = self.model.minimal(frozenset(k for x in keys for k in self.grain_of(x)) | frozenset(k for x in n.args for k in self.grain_of_argument(x)))
            if set(keys) == set(grain):
                keys = tuple(grain)
            inner = tuple(sorted(repr(x) for a in n.args for x in self.own(a) if x.kind in ("agg", "scalar", "win")))
            streams.setdefault((keys, arg_grain, inner), []).append(n)
        whole = [(k, v) for k, v in streams.items() if set(k[0]) == set(grain)]
        parts = [(k, v) for k, v in streams.items() if set(k[0]) != set(grain)]
        made = count()

        def stream(keys: tuple, own: list[Node]) -> DataFrame:
            for n in own:
                columns[n] = f"x{next(made)}"
            more = beside - {r for n in own for a in n.args for r in self.roots(a)} if set(keys) == set(grain) else frozenset()
            return self.aggregates(own, list(keys), where, beside=more).selectExpr(*(f"k{i} as `{columns[k]}`" for i, k in enumerate(keys)), *(f"a{i} as `{columns[n]}`" for i, n in enumerate(own)))

        united = {k for n, d in self.model.datasources.items() if n.startswith(UNITED) for k in d.columns}
        spread = bool(whole) and any(self.roots(g) & united for g in grain)
        results = []
        for (keys, _, _), own in whole:  # values that only the union of keys has come by a result of their own
            self.narrow = spread and not any(self.roots(a) & united for n in own for a in n.args)
            results.append(stream(keys, own))
        self.narrow = False
        if spread:
            results.append(self.distinct(grain, where, beside=beside))
        df = self.distinct(grain, where, loose, beside) if not results else results[0] if len(results) == 1 else merged(results, [columns[g] for g in grain])
        for (keys, _, _), own in parts:
            df = align(df, stream(keys, own), [columns[k] for k in keys])
        zero = [columns[n] for n in aggs if n.name in COUNTS]
        if (len(streams) > 1 or spread) and zero:
            df = df.fillna(0, subset=zero)
        return df, columns

    def distinct(self, grain: list[Node], where: list, loose: bool = False, beside: frozenset[str] = frozenset()) -> DataFrame:
        """The distinct rows of the grain's expressions (R1); no distinct where the rows' own key is among them."""
        if not grain:
            return self.spark.range(1).select(F.lit(1).alias("__one"))
        need = {r for g in grain for r in self.roots(g)}
        frame = self.filtered(need, where, grain, beside)
        refs = frozenset(g.name for g in grain if g.kind == "ref")
        generated = [g for g in grain if any(n.kind == "call" and n.name in ("unnest", "date_spine") for n in self.own(g))]
        made = []
        for g in grain:
            frame, g = self.ready(frame, g, where, [])
            made.append(g)
        df = frame.df.select(*(self.compile(g, frame.df, frame.columns).alias(f"g{i}") for i, g in enumerate(made)))
        return df if loose or frame.unique and frame.unique <= refs and not frame.unique & frame.padded and not generated else df.distinct()

    def subselect(self, frame: Frame, n: Node, dims: list[Node], put: dict) -> tuple[Frame, Node]:
        """The values of an expression as an ordered array, for each value of the outputs that it shares rows with."""
        cond, order = n.extra
        x = n.args[0]
        own = self.roots(x) | self.roots(cond) | {r for o in order for r in self.roots(o[0])}
        shared = [d for d in dims if self.roots(d)]
        inner = self.filtered(own | {r for d in shared for r in self.roots(d)}, [conjuncts(cond)] if cond is not None else [], [])
        inner = self.to_grain(inner, self.model.minimal(frozenset(k for r in own for k in self.model.natural_keys(r)) | frozenset(k for d in shared for k in self.grain_of(d))))
        keys = [f"__s{i}" for i in range(len(shared))]
        df = inner.df.select(*(self.compile(d, inner.df, inner.columns).alias(k) for d, k in zip(shared, keys, strict=True)), self.compile(x, inner.df, inner.columns).alias("v"), *(self.compile(o[0], inner.df, inner.columns).alias(f"o{i}") for i, o in enumerate(order)))
        by = [self.direction(F.col(f"o{i}"), o[1], o[2]) for i, o in enumerate(order)] or [F.col("v").asc_nulls_last()]
        df = df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
        if n.name is not None:
            df = df.where(F.col("n") <= n.name)
        name = f"$v{next(self.numbers)}"
        df = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda s: s["v"]).alias(column_name(name)))
        left = frame.df
        for d, k in zip(shared, keys, strict=True):
            left = left.withColumn(k, F.col(put[d].name))
        return Frame(align(left, df, keys).drop(*keys), {**frame.columns, name: column_name(name)}, frame.unique), Node("ref", name)

    def window(self, n: Node, df: DataFrame, columns: dict, grain: list[str] = ()) -> Column:
        part, order = n.extra
        w = Window.partitionBy(*(self.compile(p, df, columns) for p in part))
        if order:
            w = w.orderBy(*(self.direction(self.compile(o[0], df, columns), o[1], o[2]) for o in order))
        elif n.name in ("row_number", "rank", "dense_rank", "lag", "lead"):
            w = w.orderBy(*(self.compile(a, df, columns) for a in n.args[:1]) if n.args else (F.col(g) for g in grain))
        if n.name in ("row_number", "rank", "dense_rank"):
            return {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[n.name]().over(w).cast("bigint")
        x = self.compile(n.args[0], df, columns)
        if n.name in ("lag", "lead"):
            return (F.lag if n.name == "lag" else F.lead)(x, n.args[1].name if len(n.args) > 1 else 1).over(w)
        if n.name == "count_distinct":
            return F.size(F.collect_set(x).over(w)).cast("bigint")
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[n.name](x).over(w)

    # Set operations, aligned selects, rowsets

    def setop(self, s: dict) -> DataFrame:
        names = [n for n, _ in s["names"]]
        arms = [self.select(a, nested=True) for a in s["arms"]]
        if any(len(a.columns) != len(names) for a in arms):
            raise LanguageError("every arm of a set operation needs a column for each name")
        arms = [a.toDF(*map(column_name, names)) for a in arms]
        arms = [a.select(*(F.col(column_name(n)).cast(scalar.spark_type(k)).alias(column_name(n)) if k else F.col(column_name(n)) for n, k in s["names"])) for a in arms]
        op = {"union": DataFrame.union, "except": DataFrame.subtract, "intersect": DataFrame.intersect}[s["op"]]
        return reduce(op, arms)

    def multiselect(self, q: dict) -> DataFrame:
        """Selects that are joined in full on aligned columns, null-safely, each with all before it."""
        out, known, alone = None, [n for n, _ in q["align"]], True
        for arm in q["arms"]:
            df = self.select(arm, nested=True)
            put = {column_name(m): column_name(n) for n, ms in q["align"] for m in ms}
            df = df.select(*(F.col(c).alias(put.get(c, c)) for c in df.columns))
            on = [column_name(n) for n in known if column_name(n) in df.columns]
            dims = [put.get(column_name(a), column_name(a)) for a, x, _ in arm.get("items", []) if not any(n.kind in ("agg", "win") for n in self.own(self.expand(x)))]
            alone = alone and sorted(dims) == sorted(on) == sorted(map(column_name, known))  # a row for each value of the keys
            if out is None:
                out = df
                continue
            df = df.drop(*(c for c in df.columns if c in out.columns and c not in on))
            out = merged([out, df], on) if alone else full(out, df, on)
        columns = {c.replace("__", "."): c for c in out.columns} | {c: c for c in out.columns}
        for name, x in q["derive"]:
            out = out.withColumn(column_name(name), self.compile(x, out, columns))
            columns[name] = column_name(name)
        if q["having"] is not None:
            out = out.where(self.compile(q["having"], out, columns))
        if q["order"]:
            out = out.orderBy(*(self.direction(self.compile(x, out, columns), d, n) for x, d, n in q["order"]))
        return out.limit(q["limit"]) if q["limit"] is not None else out

    def register(self, prefix: str, df: DataFrame, name: str, names: list | None = None, grain: list[str] | None = None, echo: dict | None = None, owned: dict[str, list[str]] | None = None) -> None:
        """Makes the columns of a result concepts of their own (prefix.column), bound by one source.

        owned: for columns that fewer keys than the whole grain determine, those.
        """
        columns, of = {}, {}
        grain_addresses = []
        for i, c in enumerate(df.columns):
            a = of[c] = (f"{prefix}." if prefix else "") + (names[i][0] if names else c.replace("__", "."))
            key = grain is None or c in grain
            self.model.concepts = {**self.model.concepts, a: Concept(a, "key" if key else "property", None, None)}
            columns[a] = (Node("ref", c), "")
            if key:
                grain_addresses.append(a)
        row = f"{name}.$row"
        self.model.concepts[row] = Concept(row, "key", "rowid")
        bag = grain is None
        less = {of[c]: frozenset(of[k] for k in keys) for c, keys in (owned or {}).items()}
        for a in columns:
            if bag or a not in grain_addresses:
                self.model.concepts[a] = Concept(a, "property" if bag else self.model.concepts[a].purpose, None, frozenset([row]) if bag else less.get(a, frozenset(grain_addresses)))
        self.model.datasources = {**self.model.datasources, name: Datasource(name, columns, frozenset([row]) if bag else frozenset(grain_addresses), lambda: df, rowset=True, echo=echo or {})}

    # Expressions

    def compile(self, x: Node, df: DataFrame, columns: dict, local: dict | None = None) -> Column:
        """x as a column of df, in which columns tells where concepts are."""
        local = local or {}
        go = lambda y: self.compile(y, df, columns, local)
        if x.kind == "lit":
            return F.lit(x.name)
        if x.kind == "ref":
            if x.name in local:
                return local[x.name]
            if x.name in columns:
                return F.col(columns[x.name])
            raise LanguageError(f"{x.name} isn't available here")
        if x.kind == "cast":
            return scalar.cast(df, go(x.args[0]), self.model.types.get(x.name, x.name))
        if x.kind == "filter":
            return F.when(go(x.args[1]), go(x.args[0]))
        if x.kind == "case":
            out = F
            for cond, value in x.args:
                out = out.when(go(cond), go(value))
            return out.otherwise(go(x.extra[0])) if x.extra else out
        if x.kind == "array":
            return F.array(*map(go, x.args))
        if x.kind == "struct":
            return F.struct(*(go(a).alias(n) for a, n in zip(x.args, x.name, strict=True)))
        if x.kind == "in":
            if x.name == "list":
                return scalar.null_safe_in(go(x.args[0]), [go(a) for a in x.args[1:]])
            return F.coalesce(F.exists(go(x.args[1]), lambda y: y.eqNullSafe(go(x.args[0]))), F.lit(False))
        if x.kind == "call":
            if x.name in ("array_transform", "array_filter"):
                param, body = x.extra
                f = lambda y: self.compile(self.expand_local(body, param), df, columns, {**local, param: y})
                return (F.transform if x.name == "array_transform" else F.filter)(go(x.args[0]), f)
            if x.name == "unnest":
                return F.explode(go(x.args[0]))
            if x.name == "date_spine":
                return F.explode(F.sequence(go(x.args[0]).cast("date"), go(x.args[1]).cast("date"), F.expr("interval 1 day")))
            args = [go(a) for a in x.args]
            if x.name in scalar.SPECIAL:
                return scalar.SPECIAL[x.name](df, args, [a.name if a.kind in ("lit", "ref") else None for a in x.args])
            if x.name in scalar.PLAIN:
                if x.name == "array_to_string" and x.args[1].kind == "lit":
                    return F.array_join(args[0], x.args[1].name)
                return scalar.PLAIN[x.name](*args)
            raise LanguageError(f"unknown function {x.name}")
        raise LanguageError(f"{x.kind} {x.name} can't stand here")

    def expand_local(self, body: Node, param: str) -> Node:
        keep = lambda y: y if y.kind == "ref" and y.name == param else self.expand(y) if y.kind == "ref" else y.map(keep)
        return keep(body)
