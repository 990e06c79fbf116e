"""Statements back to text, in one layout. parse(render(parse(text))) has the statements of text."""

from __future__ import annotations

import json

from .parser import Node, Parser, Statement, TypeName, parse

#: How tightly operators bind, the loosest first.
BINDS = {"or": 1, "and": 2, "not": 3, "=": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "like": 5, "ilike": 5, "between": 5, "is_null": 5, "is_not_distinct": 5, "add": 6, "subtract": 6, "concat_strict": 6, "multiply": 7, "divide": 7, "mod": 7, "power": 8}
SIGNS = {"add": "+", "subtract": "-", "concat_strict": "||", "multiply": "*", "divide": "/", "mod": "%", "power": "**"}


def text_of(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return json.dumps(value) if value is None or isinstance(value, bool) else repr(value)


def type_text(t: str) -> str:
    out = str(t)
    if isinstance(t, TypeName) and t.domain:
        one = lambda x: text_of(x) if x is not None else ""
        inner = ", ".join(f"{one(d[1])}..{one(d[2])}" if d[0] == "range" else text_of(d[1]) for d in t.domain)
        out = f"enum<{out}>[{inner}]" if out == "string" and t.domain[0][0] == "value" else f"{out}[{inner}]"
    return out + (f"::{t.trait}" if isinstance(t, TypeName) and t.trait else "")


def binding(x: Node) -> int:
    if x.kind == "filter":
        return 4
    if x.kind == "in":
        return 5
    return BINDS.get(x.name, 10) if x.kind == "call" else 10


def expr(x: Node, least: int = 0) -> str:
    """x as text, in parentheses if it binds less tightly than `least`."""
    out = bare(x)
    return f"({out})" if binding(x) < least else out


def listed(xs) -> str:
    return ", ".join(expr(x) for x in xs)


def bare(x: Node) -> str:
    k, a = x.kind, x.args
    if k == "lit":
        return text_of(x.name)
    if k == "ref":
        return x.name
    if k == "cast":
        return f"cast({expr(a[0])} as {type_text(x.name)})"
    if k == "array":
        return f"[{listed(a)}]"
    if k == "struct":
        return "struct(" + ", ".join(f"{expr(v)} -> {n}" for v, n in zip(a, x.name, strict=True)) + ")"
    if k == "macro":
        return f"@{x.name}({listed(a)})" if a else f"@{x.name}"
    if k == "filter":
        return f"{expr(a[0], 6)} ? {expr(a[1])}"
    if k == "case":
        other = f" else {expr(x.extra[0])}" if x.extra else ""
        return "case" + "".join(f" when {expr(c)} then {expr(v)}" for c, v in a) + other + " end"
    if k == "scalar":
        return f"({select_text(x.extra[0].select, ' ')})"
    if k == "in":
        if x.name == "select":
            return f"{expr(a[0], 6)} in ({select_text(x.extra[0].select, ' ')})"
        if x.name == "list":
            return f"{expr(a[0], 6)} in ({listed(a[1:])})"
        return f"{expr(a[0], 6)} in {expr(a[1]) if a[1].kind == 'call' and a[1].name == 'tuple' else '(' + expr(a[1]) + ')' if a[1].kind != 'array' else expr(a[1])}"
    if k == "agg":
        by = "" if not x.extra else " by *" if not x.extra[0] else f" by ({listed(x.extra[0])})"
        if x.name == "any" and len(a) == 1 and by and by != " by *":
            return f"group({expr(a[0])}){by}"
        return f"{x.name}({listed(a)}){by}"
    if k == "win":
        part, order = x.extra
        over = " ".join(p for p in (f"partition by {listed(part)}" if part else "", f"order by {order_text(order)}" if order else "") if p)
        return f"{x.name}({listed(a)})" + (f" over ({over})" if over else "")
    if k == "subselect":
        cond, order = x.extra
        return f"subselect({expr(a[0])}" + (f" where {expr(cond)}" if cond is not None else "") + (f" order by {order_text(order)}" if order else "") + (f" limit {x.name}" if x.name is not None else "") + ")"
    return call_text(x)


def call_text(x: Node) -> str:
    a, n = x.args, x.name
    if n in ("and", "or"):
        return f"{expr(a[0], BINDS[n])} {n} {expr(a[1], BINDS[n] + 1)}"
    if n == "not":
        return f"not {expr(a[0], 3)}"
    if n in SIGNS:
        left, right = (9, 8) if n == "power" else (BINDS[n], BINDS[n] + 1)
        return f"{expr(a[0], left)} {SIGNS[n]} {expr(a[1], right)}"
    if n == "between":
        return f"{expr(a[0], 5)} between {expr(a[1], 6)} and {expr(a[2], 6)}"
    if n == "is_null":
        return f"{expr(a[0], 5)} is null"
    if n == "is_not_distinct":
        return f"{expr(a[0], 5)} is {expr(a[1], 6)}"
    if n in BINDS:
        return f"{expr(a[0], 5)} {n} {expr(a[1], 6)}"
    if n == "negate":
        return f"-{expr(a[0], 10)}"
    if n == "index":
        return f"{expr(a[0], 10)}[{expr(a[1])}]"
    if n == "getattr" and a[0].kind != "ref":
        return f"{expr(a[0], 10)}.{a[1].name}"
    if n == "tuple":
        return f"({listed(a)})"
    if n == "map":
        return "{" + ", ".join(f"{expr(k)}: {expr(v)}" for k, v in zip(a[::2], a[1::2], strict=True)) + "}"
    return f"{n}({listed(a)})"


def order_text(order) -> str:
    return ", ".join(expr(x) + (" desc" if desc else " asc") + (f" nulls {nulls}" if nulls != "last" else "") for x, desc, nulls in order)


def setop_text(s: dict, gap: str) -> str:
    names = ", ".join(n + (f" {type_text(t)}" if t else "") for n, t in s["names"])
    return f"{s['op']}(" + ", ".join(f"({select_text(a, ' ')})" for a in s["arms"]) + f") -> ({names})"


def select_text(q: dict, gap: str = "\n") -> str:
    tab = "    " if gap == "\n" else ""
    if "arms" in q:
        parts = [f"{gap}merge{gap}".join(select_text(a, gap) for a in q["arms"]), "align " + " and ".join(f"{n}: {', '.join(of)}" for n, of in q["align"])]
        if q["derive"]:
            parts.append("derive " + ", ".join(f"{expr(x)} -> {n}" for n, x in q["derive"]))
    elif "items" not in q:
        return setop_text(q["setop"], gap)
    else:
        parts = []
        if q.get("setop"):
            parts.append("from " + setop_text(q["setop"], gap))
        if q["from"]:
            parts.append("from " + ", ".join(q["from"]))
        for kind, chain in q["joins"]:
            parts.append(f"{kind} join " + " = ".join(expr(x, 6) for x in chain))
        if q["where"]:
            parts.append("where " + f"{gap}then where ".join(expr(w) for w in q["where"]))
        item = lambda i, a, x, h: ("--" if h else "") + expr(x) + ("" if a == (x.name if x.kind == "ref" else f"col{i + 1}") else f" as {a}")
        parts.append(f"select{gap}{tab}" + f",{gap}{tab}".join(item(i, *it) for i, it in enumerate(q["items"])))
        if q["by"]:
            kind, keys = q["by"]
            parts.append("by grouping sets (" + ", ".join(f"({listed(s)})" for s in keys) + ")" if kind == "sets" else f"by {kind} ({listed(keys)})")
    if q["having"] is not None:
        parts.append(f"having {expr(q['having'])}")
    if q["order"]:
        parts.append(f"order by {order_text(q['order'])}")
    if q["limit"] is not None:
        parts.append(f"limit {q['limit']}")
    return gap.join(parts)


def concept_text(d: dict) -> str:
    name = d["name"] if d["keys"] in (None, [None]) else f"<{', '.join(d['keys']) or '*'}>.{d['name']}"
    out = ("unique property" if d["purpose"] == "unique" else d["purpose"]) + " " + name
    return out + (f" {type_text(d['type'])}" if d["type"] else "") + (f" <- {expr(d['lineage'])}" if d["lineage"] is not None else "")


def datasource_text(d: dict) -> str:
    column = lambda c: f"raw('''{c[1]}''')" if isinstance(c, tuple) else expr(c)
    bound = [column(c) + ": " + marks + concept for c, concept, marks in d["columns"]]
    parts = [("root " if d["root"] else "") + ("partial " if d["partial"] else "") + f"datasource {d['name']} (\n    " + ",\n    ".join(bound) + "\n)"]
    if d["grain"] is not None:
        parts.append(f"grain ({', '.join(d['grain'])})")
    if d["complete"] is not None:
        parts.append(f"complete where {expr(d['complete'])}")
    kind, value = d["source"] or (None, None)
    if kind == "table":
        parts.append(f"address `{value}`")
    elif kind == "query":
        parts.append(f"query '''{value}'''")
    elif kind == "file":
        parts.append("file " + (f"`{value[0]}`" + (f":`{d['write']}`" if d.get("write") else "") if len(value) == 1 else "[" + ", ".join(f"`{v}`" for v in value) + "]"))
    if d["where"] is not None:
        parts.append(f"where {expr(d['where'])}")
    for how in ("incremental", "freshness"):
        if d.get(how):
            parts.append(f"{how} by {d[how]}")
    if d.get("within"):
        parts.append(f"within {d['within']}")
    if d.get("refresh"):
        parts.append(f"refresh `{d['refresh']}`")
    if d["partition"]:
        parts.append("partition by " + ", ".join(d["partition"]))
    if "published" in d:
        parts.append("state " + ("published" if d["published"] else "unpublished"))
    return "\n".join(parts)


def chart_text(d: dict) -> str:
    out = ["chart"]
    for x in d["layers"]:
        bound = ", ".join(f"{r} <- {expr(e)}" + (f" as {a}" if a else "") for r, e, a in x["bindings"])
        out.append(f"layer {x['type']} ({bound})" + (f" from (\n{select_text(x['select'])})" if x["select"] else "") + (f" order by {order_text(x['order'])}" if x["order"] else "") + (f" limit {x['limit']}" if x["limit"] is not None else ""))
    out += [f"place {k} at {text_of(v)}" + (f" as {a}" if a else "") for k, v, a in d["places"]]
    out += [f"set {f}" for f in d["flags"]] + [f"set {k}: {v}" for k, v in d["scales"].items()]
    return "\n".join(out)


def statement_text(s: Statement) -> str:
    d = s.data
    match s.kind:
        case "concept":
            return concept_text(d)
        case "datasource":
            return datasource_text(d)
        case "select":
            return select_text(d["select"])
        case "rowset":
            return f"with {d['name']} as\n{select_text(d['select'])}"
        case "import":
            alias = f" as {d['alias']}" if d["alias"] else ""
            return f"from {d['path']}{alias} import {', '.join(d['names'])}" if d.get("names") else f"import {d['path']}{alias}"
        case "self_import":
            return f"self import as {d['alias']}"
        case "parameter":
            return f"parameter {d['name']} {type_text(d['type'])}" + (f" default {expr(d['default'])}" if d["default"] is not None else "")
        case "properties":
            return f"properties <{', '.join(d['keys'])}> (\n    " + ",\n    ".join(f"{n} {type_text(t)}" for n, t in d["items"]) + "\n)"
        case "type":
            return f"type {d['name']} " + " | ".join(type_text(t) for t in (d["base"], *d["others"])) + (f" drop {' | '.join(d['drop'])}" if d["drop"] else "")
        case "def":
            params = ", ".join(p + (f" = {expr(v)}" if v is not None else "") for p, v in d["params"])
            return f"def {d['name']}({params}) -> {expr(d['body'])}"
        case "merge":
            return f"merge {d['from']} into {'~' if d['partial'] else ''}{d['into']}"
        case "persist":
            return f"{d['mode']} {d['name']}" + (f" into {d['into']}" if d["into"] else "") + (f" by {', '.join(d['by'])}" if d["by"] else "") + f" from\n{select_text(d['select'])}"
        case "rebuild":
            return f"{d['mode']} {d['name']}" + (f" where {expr(d['where'])}" if d["where"] is not None else "")
        case "chart":
            return chart_text(d)
        case "copy" if "chart" in d["select"]:
            return f"copy into {d['format']} {text_of(d['path'])} from\n{chart_text(d['select']['chart'])}"
        case "copy":
            options = " (" + ", ".join(f"{k} = {text_of(v)}" for k, v in d["options"].items()) + ")" if d["options"] else ""
            return f"copy into {d['format']} {text_of(d['path'])}{options} from\n{select_text(d['select'])}"
        case "create":
            return "create " + {"ignore": "if not exists ", "overwrite": "or replace ", "error": ""}[d["mode"]] + f"datasource {d['name']}" + (" with data" if d["data"] else "")
        case "publish":
            return ("publish" if d["on"] else "unpublish") + f" datasources {d['name']}"
        case "raw_sql":
            return f"raw_sql('''{d['sql']}''')"
        case "show":
            return "show " + (d["what"] if d["what"] != "plan" else select_text(d["select"]))
        case "validate":
            return f"validate {d['what']}" + (" " + ", ".join(d["names"]) if d["names"] else "")
        case "mock":
            return "mock datasources " + ", ".join(d["names"]) if d["names"] else "mock all"
        case "call":
            return f"call `{d['program']}`" + (f" from\n{select_text(d['select'])}" if d["select"] else "")
    raise ValueError(f"no text for {s.kind}")


def render(statements: list[Statement]) -> str:
    return "".join(statement_text(s) + ";\n" for s in statements)


def formatted(text: str) -> str:
    """text in the one layout. A comment stands before the statement that it stood before or in; the last ones at the end."""
    parser = Parser(text)
    made = parser.statements()
    out, left = [], list(parser.comments)
    for s, after in zip(made, [*parser.begins[1:], None], strict=True):
        end = len(parser.tokens) - 1 if after is None else after
        # a comment right before the next statement comes after the semicolon, whose token is the one before
        here = [c for at, c in left if at < end]
        left = left[len(here) :]
        out += [c + "\n" for c in here] + [statement_text(s) + ";\n"]
    return "".join(out + [c + "\n" for _, c in left])
