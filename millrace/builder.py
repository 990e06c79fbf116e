"""Statements made by Python calls, over the same nodes that the parser makes.

    from millrace.builder import c, count, select, total
    e.execute(select(c("nation.name").as_("n"), count("customer.id").as_("customers"), where=c("region.name") == "ASIA", order=[c("customers").desc()], limit=5))
"""

from __future__ import annotations

from typing import Any

from .lang.parser import AGGREGATES, LanguageError, Node, Query, Statement, TypeName


class Expression:
    """An expression; operators, methods and keywords of the language by Python's."""

    def __init__(self, node: Node, alias: str | None = None, hidden: bool = False, descending: bool = False, nulls: str = "last"):
        self.node, self.alias, self.hidden, self.descending, self.nulls = node, alias, hidden, descending, nulls

    def as_(self, name: str) -> Expression:
        return Expression(self.node, name, self.hidden)

    def hide(self) -> Expression:
        return Expression(self.node, self.alias, True)

    def desc(self, nulls: str = "last") -> Expression:
        return Expression(self.node, self.alias, self.hidden, True, nulls)

    def asc(self, nulls: str = "last") -> Expression:
        return Expression(self.node, self.alias, self.hidden, False, nulls)

    def by(self, *keys: Any) -> Expression:
        """Pins an aggregate to keys; to none of them: over all rows."""
        if self.node.kind != "agg":
            raise LanguageError("only an aggregate has a grain of its own")
        return Expression(Node("agg", self.node.name, self.node.args, (tuple(node(k, name=True) for k in keys),)))

    def over(self, partition: tuple = (), order: tuple = ()) -> Expression:
        kind = "win" if order or self.node.kind == "win" else "agg"
        part = tuple(node(k, name=True) for k in partition)
        if kind == "agg":
            return Expression(Node("agg", self.node.name, self.node.args, (part,)))
        return Expression(Node("win", self.node.name, self.node.args, (part, tuple(ordered(o) for o in order))))

    def where(self, condition: Expression) -> Expression:
        return Expression(Node("filter", None, (self.node, condition.node)))

    def cast(self, kind: str) -> Expression:
        return Expression(Node("cast", TypeName(kind), (self.node,)))

    def isin(self, *values: Any) -> Expression:
        if len(values) == 1 and isinstance(values[0], Statement):
            return Expression(Node("in", "select", (self.node,), (Query(values[0].data["select"]),)))
        return Expression(Node("in", "list", (self.node, *map(node, values))))

    def isnull(self) -> Expression:
        return call("is_null", self)

    def between(self, low: Any, high: Any) -> Expression:
        return call("between", self, low, high)

    def like(self, pattern: str) -> Expression:
        return call("like", self, pattern)

    def __invert__(self):
        return call("not", self)

    def __neg__(self):
        return call("negate", self)

    __hash__ = None


def _operator(name: str, swapped: bool = False):
    return lambda self, other: call(name, *((other, self) if swapped else (self, other)))


for _method, _name in {"add": "add", "sub": "subtract", "mul": "multiply", "truediv": "divide", "mod": "mod", "pow": "power", "and": "and", "or": "or"}.items():
    setattr(Expression, f"__{_method}__", _operator(_name))
    setattr(Expression, f"__r{_method}__", _operator(_name, swapped=True))
for _method, _name in {"eq": "=", "ne": "!=", "lt": "<", "gt": ">", "le": "<=", "ge": ">="}.items():
    setattr(Expression, f"__{_method}__", _operator(_name))


def node(x: Any, name: bool = False) -> Node:
    """x as a node; a text is a value, or the name of a concept."""
    if isinstance(x, Expression):
        return x.node
    if isinstance(x, Node):
        return x
    if isinstance(x, list):
        return Node("array", None, tuple(map(node, x)))
    return Node("ref", x) if name else Node("lit", x)


def c(name: str) -> Expression:
    """A concept."""
    return Expression(Node("ref", name))


def lit(value: Any) -> Expression:
    return Expression(node(value))


def call(name: str, *args: Any) -> Expression:
    """A function of the language; its arguments are expressions or values."""
    return Expression(Node("call", name, tuple(map(node, args))))


def aggregate(name: str, *args: Any) -> Expression:
    if name not in AGGREGATES:
        raise LanguageError(f"{name} is no aggregate")
    return Expression(Node("agg", name, tuple(node(a, name=True) for a in args)))


def count(x: Any) -> Expression:
    return aggregate("count", x)


def total(x: Any) -> Expression:
    return aggregate("sum", x)


def rank(x: Any) -> Expression:
    return Expression(Node("win", "rank", (node(x, name=True),), ((), ())))


def case(*whens: tuple, otherwise: Any = None) -> Expression:
    return Expression(Node("case", None, tuple((node(a), node(b)) for a, b in whens), () if otherwise is None else (node(otherwise),)))


def ordered(x: Any) -> tuple:
    return (node(x, name=True), x.descending, x.nulls) if isinstance(x, Expression) else (node(x, name=True), False, "last")


def select(*items: Any, where: Any = None, having: Expression | None = None, order: list = (), limit: int | None = None, source: list | None = None, joins: list = (), by: tuple | None = None) -> Statement:
    """A select: items are expressions or names; where is a condition or a list of stages; joins are ("subset" or "union", key, ...); by is ("rollup" or "cube", keys)."""
    made = [x if isinstance(x, Expression) else c(x) for x in items]
    named = [(x.alias or (x.node.name if x.node.kind == "ref" else f"col{i + 1}"), x.node, x.hidden) for i, x in enumerate(made)]
    stages = [] if where is None else [w.node for w in where] if isinstance(where, list) else [where.node]
    q = {"from": source, "where": stages, "joins": [(kind, [node(k, name=True) for k in chain]) for kind, *chain in joins], "items": named, "by": (by[0], [node(k, name=True) for k in by[1]]) if by else None, "having": having.node if having is not None else None, "order": [ordered(o) for o in order], "limit": limit}
    return Statement("select", {"select": q})


def concept(purpose: str, name: str, kind: str | None = None, keys: list | None = None, value: Any = None) -> Statement:
    """A key, property, metric, auto or const."""
    own = [None] if purpose == "property" and keys is None and "." in name else keys
    return Statement("concept", {"purpose": purpose, "name": name, "keys": own, "type": TypeName(kind) if kind else None, "lineage": node(value) if value is not None else None})


def datasource(name: str, columns: dict[str, str], grain: list[str], table: str | None = None, query: str | None = None, files: list[str] | None = None, **more: Any) -> Statement:
    """columns: column -> concept, with ~ and ? before it as in the language."""
    source = ("table", table) if table else ("query", query) if query else ("file", files)
    bound = [(Node("ref", k), v.lstrip("~?"), v[: len(v) - len(v.lstrip("~?"))]) for k, v in columns.items()]
    return Statement("datasource", {"name": name, "columns": bound, "grain": grain, "source": source, **more})
