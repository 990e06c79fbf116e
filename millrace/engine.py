"""The engine: statements in, lazy DataFrames out."""

from __future__ import annotations

import subprocess
import sys
from dataclasses import replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import spark_type
from .lang.parser import LanguageError, Node, Statement, parse
from .operators.recursion import terminal_ancestors
from .operators.validate import datasource_checks, declared_joins
from .plans.frame import column_name
from .plans.model import Concept, Datasource, Model
from .plans.planner import Planner, conjuncts
from .runtime import Environment, Hooks, Policy, collect
from .sources.mock import mocked
from . import charts
from .sources import introspect
from .sources.readers import read_files, read_parquet, read_script, request, write_files, write_slices, write_text

#: Where a model's imports are looked up; set by the engine's caller.
STD = Path(__file__).parent / "std"


class Engine:
    """One model bound to a session. run() executes statements in order and returns the selects' DataFrames."""

    def __init__(self, spark: SparkSession, root: str | None = None, tables: str | None = None, parameters: dict | None = None, hooks: Hooks | None = None, environment: str | None = None):
        """root: the folder of imports; tables: the folder of <table>.parquet that plain addresses are first looked for in;
        hooks: callbacks; environment: a prefix for the tables that are written, which are read in place of the others.
        """
        self.spark, self.root, self.tables, self.parameters = spark, root, tables, parameters or {}
        self.hooks = hooks or Hooks()
        self.environment = Environment(spark, environment) if environment else None
        self.model = Model()
        self.planner = Planner(spark, self.model, self.hooks)
        #: Keys made of several keys: those, and the properties made of theirs.
        self.stacks: dict[str, tuple] = {}
        self.frames: dict[str, DataFrame] = {}
        self.written: set[str] = set()

    def register_frame(self, address: str, df: DataFrame) -> None:
        """A DataFrame (or pandas frame) as a table by address."""
        self.frames[address] = df if isinstance(df, DataFrame) else self.spark.createDataFrame(df)

    def run(self, text: str) -> list[DataFrame]:
        return [x for s in parse(text) if (x := self.execute(s)) is not None]

    def execute(self, statement: Statement) -> DataFrame | None:
        """One statement, parsed or made by the builder."""
        self.hooks.call("statement", statement)
        got = getattr(self, f"do_{statement.kind}")(**statement.data)
        if got is not None:
            self.hooks.call("result", statement, got)
        return got

    def collect(self, text: str, policy: Policy | None = None) -> list:
        """The rows of a text's last select, under a time limit and with retries."""
        return collect(self.query(text), policy or Policy())

    def table(self, name: str) -> str:
        """The name under which a table is written."""
        return self.environment.write(name) if self.environment else name

    def sample(self, datasource: str, rows: int = 10_000) -> DataFrame:
        return introspect.sample(self.planner.scan(datasource).df, rows)

    def summary(self, text: str) -> DataFrame:
        """For each column of a select's result, without its limit: rows, nulls, distinct values, least and greatest."""
        statement = parse(text)[-1]
        whole = {k: None if k == "limit" else v for k, v in statement.data["select"].items()}
        for s in parse(text)[:-1]:
            self.execute(s)
        return introspect.summary(self.planner.select(whole))

    def scopes(self, text: str) -> DataFrame:
        """name, kind, grain, population and datasources of each output of a text's last select."""
        *before, last = parse(text)
        for s in before:
            self.execute(s)
        return self.spark.createDataFrame(self.planner.scopes(last.data["select"]), "name string, kind string, grain array<string>, population string, datasources array<string>")

    def query(self, text: str) -> DataFrame:
        return self.run(text)[-1]

    # Declarations

    def prefixed(self, prefix: str, x):
        """A statement's names moved into a namespace."""
        if isinstance(x, Node):
            if x.kind == "ref":
                return Node("ref", f"{prefix}.{x.name}")
            if x.kind == "macro":
                return Node("macro", f"{prefix}.{x.name}", tuple(self.prefixed(prefix, a) for a in x.args))
            return x.map(lambda y: self.prefixed(prefix, y))
        return x

    def do_import(self, path: str, alias: str | None, names: list | None = None) -> None:
        """A model from a file; names, where given, have to be in it. A leading dot is this folder, each further one a folder up."""
        up = len(path) - len(path.lstrip("."))
        file = "../" * max(up - 1, 0) + path.lstrip(".").replace(".", "/") + ".preql"
        places = [Path(self.root or ".") / file, STD.parent / file]
        where = next((p for p in places if p.exists()), None)
        if where is None:
            raise LanguageError(f"no model {path}")
        inner = Engine(self.spark, str(where.parent), self.tables, self.parameters, self.hooks)
        inner.environment = self.environment
        inner.frames, inner.written = self.frames, self.written
        inner.run(where.read_text())
        if lost := [n for n in names or () if n not in inner.model.concepts and n not in inner.model.macros and n not in inner.model.types]:
            raise LanguageError(f"{path} has no {lost}")
        self.absorb(inner.model, alias)

    def do_self_import(self, alias: str) -> None:
        """This model once more in a namespace of its own, for joins of a table with itself."""
        self.absorb(self.model, alias)

    def absorb(self, inner: Model, alias: str | None) -> None:
        p = f"{alias}." if alias else ""
        name = lambda a: p + a
        move = lambda x: self.prefixed(alias, x) if alias and x is not None else x
        for a, c in list(inner.concepts.items()):
            self.model.add(replace(c, address=name(a), keys=frozenset(map(name, c.keys)) if c.keys is not None else None, lineage=move(c.lineage)))
        for n, d in list(inner.datasources.items()):
            columns = {name(a): v for a, v in d.columns.items()}
            key = lambda a: name(a) if a else a
            self.model.datasources[name(n)] = replace(d, name=name(n), columns=columns, grain=frozenset(map(name, d.grain)), where=move(d.where), complete=move(d.complete), aggregates={name(a): move(x) for a, x in d.aggregates.items()}, incremental=key(d.incremental), freshness=key(d.freshness))
        for n, (params, body) in list(inner.macros.items()):
            self.model.macros[name(n)] = (params, self.prefixed_body(alias, params, body))
        self.model.types |= inner.types
        self.model.same |= {name(a): name(b) for a, b in list(inner.same.items())}

    def prefixed_body(self, alias: str | None, params: list, body: Node) -> Node:
        """A function's body moved into a namespace, but for its parameters."""
        own = {p for p, _ in params}
        if not alias:
            return body
        if body.kind == "ref" and body.name in own:
            return body
        if body.kind in ("ref", "macro"):
            return Node(body.kind, f"{alias}.{body.name}", tuple(self.prefixed_body(alias, params, a) for a in body.args), body.extra)
        return body.map(lambda y: self.prefixed_body(alias, params, y))

    def do_parameter(self, name: str, type: str, default: Node | None) -> None:  # noqa: A002
        value = self.parameters.get(name, default.name if default is not None else None)
        if value is None:
            raise LanguageError(f"parameter {name} has no value")
        self.model.add(Concept(name, "parameter", type, None, Node("cast", type, (Node("lit", value),))))

    def do_type(self, name: str, base: str, others: list = (), drop: list = ()) -> None:
        self.model.types[name] = base

    def do_properties(self, keys: list, items: list) -> None:
        for name, kind in items:
            if len(keys) == 1:
                self.do_concept("property", f"{keys[0]}.{name}", [None], kind, None)
            else:
                self.do_concept("property", name, keys, kind, None)

    def do_concept(self, purpose: str, name: str, keys: list | None, type: str | None, lineage: Node | None) -> None:  # noqa: A002
        if keys == [None]:
            head, _, last = name.rpartition(".")
            if head in self.model.concepts:
                keys, name = [head], ".".join([*head.split(".")[:-1], last])
            else:
                keys = None
        trait = self.model.types.get(getattr(type, "trait", None))
        type = self.model.types.get(type, type)  # noqa: A001
        domain = getattr(type, "domain", ()) or getattr(trait, "domain", ())
        if lineage is not None and lineage.kind == "call" and lineage.name == "recurse_edge":
            self.recursion(name, lineage)
            return
        if lineage is not None and lineage.kind == "call" and lineage.name == "union":
            self.stacked(name, lineage)
            return
        if lineage is not None and lineage.kind == "call" and lineage.name in ("unnest", "date_spine") and not self.planner.roots(made := self.planner.expand(lineage)):
            self.listed(name, type, made)
            return
        self.model.add(Concept(name, purpose, type, frozenset(keys) if keys is not None else None, lineage, domain))

    def recursion(self, name: str, lineage: Node) -> None:
        node, parent = (self.planner.expand(a) for a in lineage.args)
        found: list[DataFrame] = []

        def load() -> DataFrame:
            """The walk is made when rows are first asked for, once."""
            if not found:
                frame = self.planner.rows({node.name, parent.name})
                found.append(terminal_ancestors(frame.df, frame.columns[node.name], frame.columns[parent.name]))
            return found[0]

        self.model.add(Concept(name, "property", None, frozenset([node.name])))
        self.model.datasources[f"{name}.walk"] = Datasource(f"{name}.walk", {node.name: (Node("ref", "node"), "~"), name: (Node("ref", "root"), "?")}, frozenset([node.name]), load)

    def listed(self, name: str, type: str | None, made: Node) -> None:  # noqa: A002
        """A key whose values are the elements of an array that no table is needed for."""
        one = self.spark.range(1)
        df = one.select(self.planner.compile(made, one, {}).alias("v")).distinct()
        self.model.add(Concept(name, "key", type))
        self.model.datasources[f"{name}.values"] = Datasource(f"{name}.values", {name: (Node("ref", "v"), "?")}, frozenset([name]), lambda: df)

    def stacked(self, name: str, lineage: Node) -> None:
        """A key whose values are those of several keys, or a property of such a key: for each of its keys a property."""
        args = [self.planner.expand(a) for a in lineage.args]
        own = [self.model.natural_keys(a.name) if a.kind == "ref" else frozenset() for a in args]
        base = next((k for k, (keys, _) in self.stacks.items() if len(keys) == len(args) and all(x == {k.name} and a != k for x, a, k in zip(own, args, keys, strict=True))), None)
        if base is None:
            self.stacks[name] = (args, [])
            self.model.add(Concept(name, "key", None))
        else:
            self.stacks[base][1].append((name, args))
            self.model.add(Concept(name, "property", None, frozenset([base])))
        key = base or name
        keys, more = self.stacks[key]

        def load() -> DataFrame:
            arms = [self.planner.result([("v", k, False), *((f"p{j}", xs[i], False) for j, (_, xs) in enumerate(more))], [], None, []) for i, k in enumerate(keys)]
            return reduce(DataFrame.union, arms).distinct()

        self.model.datasources[f"{key}.stack"] = Datasource(f"{key}.stack", {key: (Node("ref", "v"), ""), **{n: (Node("ref", f"p{j}"), "") for j, (n, _) in enumerate(more)}}, frozenset([key]), load)

    def do_def(self, name: str, params: list, body: Node) -> None:
        self.model.macros[name] = (params, body)

    def do_datasource(self, name: str, columns: list, grain: list | None, source: tuple | None, **d) -> None:
        bound: dict = {}
        for column, concept, marks in columns:
            if concept not in self.model.concepts:
                raise LanguageError(f"{name} binds the unknown concept {concept}")
            bound[self.model.canonical(concept)] = (column, marks)
        aggregates = {c: self.model.concepts[c].lineage for c in bound if self.model.concepts[c].lineage is not None and self.model.concepts[c].purpose == "metric"}
        keys = frozenset(self.model.canonical(g) for g in grain) if grain is not None else frozenset(k for c in bound for k in self.model.natural_keys(c))
        push = None
        if source and source[0] == "file" and source[1][0].endswith(".py"):
            push = lambda columns, filters: read_script(self.spark, source[1][0].replace("{tables}", self.tables or "."), request(columns, filters))
        self.model.datasources[name] = Datasource(name, bound, keys, self.loader(name, source), d.get("partial", False), d.get("where"), d.get("complete"), aggregates, write_to=d.get("write") or (source[1] if source and source[0] == "table" else source[1][0] if source and source[0] == "file" else None), incremental=d.get("incremental"), partition=d.get("partition") or [], published=d.get("published", True), root=d.get("root", False), freshness=d.get("freshness"), within=d.get("within", "0 second"), refresh=d.get("refresh"), push=push)
        if d.get("partial") and d.get("complete") is not None:
            self.union_partitions(keys)

    def union_partitions(self, grain: frozenset) -> None:
        """Partial sources of one grain that are each complete for a slice, stacked; each arm keeps its slice's condition, which lets the optimizer drop arms."""
        arms = [d for d in self.model.datasources.values() if d.partial and d.complete is not None and d.grain == grain]
        if len(arms) < 2:
            return
        shared = [c for c in arms[0].columns if all(c in d.columns for d in arms)]

        def load() -> DataFrame:
            out = None
            for d in arms:
                frame = self.planner.scan(d.name)
                frame = self.planner.keep(frame, self.planner.expand(d.complete))
                df = frame.df.select(*map(frame.col, shared))
                out = df if out is None else out.unionByName(df)
            return out

        name = "union:" + ",".join(sorted(grain))
        self.model.datasources[name] = Datasource(name, {c: (Node("ref", column_name(c)), "") for c in shared}, grain, load)

    def loader(self, name: str, source: tuple | None):
        if source is None:
            raise LanguageError(f"{name} has no source")
        kind, value = source

        def load() -> DataFrame:
            if kind == "query":
                return self.spark.sql(value)
            if kind == "file":
                return read_files(self.spark, [v.replace("{tables}", self.tables or ".") for v in value], types=self.declared(name))
            if value in self.frames:
                return self.frames[value]
            if self.environment and (own := self.environment.read(value)) != value:
                return self.spark.table(own)
            if self.tables and value not in self.written:
                return read_parquet(self.spark, f"{self.tables}/{value}.parquet")
            return self.spark.table(value)

        return load

    def declared(self, name: str) -> dict[str, str | None]:
        """The types of a datasource's columns, None for a column whose concept has none or that is part of an expression."""
        out: dict[str, str | None] = {}
        for c, (e, _) in self.model.datasources[name].columns.items():
            if isinstance(e, Node) and e.kind == "ref":
                kind = self.model.concepts[c].type
                out[e.name] = spark_type(kind) if kind and kind not in ("rowid", "any") else None
            else:
                out["*"] = None
        return out

    def do_merge(self, into: str, partial: bool, **d) -> None:
        a = d["from"]
        if a.endswith(".*"):
            for c in list(self.model.concepts):
                if c.startswith(a[:-1]) and into[:-1] + c[len(a) - 1 :] in self.model.concepts:
                    self.planner.relate(c, into[:-1] + c[len(a) - 1 :], partial)
            return
        key = lambda n: self.planner.join_key(Node("ref", n))  # noqa: E731  a derived one is bound where its concepts are
        self.planner.relate(key(a), key(into), partial)

    def do_rowset(self, name: str, select: dict) -> None:
        df = self.planner.select(select, nested=True)
        grain, owned = None, {}
        if "items" in select:
            shown = {column_name(a): self.planner.expand(x) for a, x, h in select["items"] if not h}
            shown = {a: x for a, x in shown.items() if not any(n.kind in ("agg", "win") for n in self.planner.own(x))}
            owned = self.owned(shown)
            dims = [a for a in shown if a not in owned]
            grain = dims if dims else None
            if not dims and df.columns:
                grain = []
        if grain == []:
            self.single(name, df)
        else:
            kept = [(a, self.model.address(x.name)) for a, x, h in select.get("items", []) if not h and x.kind == "ref" and a == x.name]
            echo = {base: column_name(a) for a, base in kept if self.model.concepts[base].purpose == "key" and self.model.concepts[base].lineage is None}
            self.planner.register(name, df, f"rowset.{name}", None, grain, echo, owned)

    def owned(self, shown: dict[str, Node]) -> dict[str, list[str]]:
        """Of a select's columns, those that stay properties: the columns of the keys that determine them."""
        keys = {x.name: a for a, x in reversed(shown.items()) if x.kind == "ref" and not self.model.concepts[x.name].is_row and self.model.natural_keys(x.name) == {x.name}}
        known = self.model.closure(frozenset(keys)) if keys else frozenset()
        out = {}
        for a, x in shown.items():
            roots = self.planner.roots(x)
            if a in keys.values() or not roots or not roots <= known or any(n.kind == "call" and n.name in ("unnest", "date_spine") or n.kind in ("scalar", "subselect") for n in x.walk()):
                continue
            own = frozenset(k for r in roots for k in self.model.natural_keys(r))
            out[a] = [keys[k] for k in sorted(own if own <= keys.keys() else self.model.minimal(frozenset(keys)))]
        return out

    def single(self, name: str, df: DataFrame) -> None:
        columns = {}
        for c in df.columns:
            a = f"{name}.{c.replace('__', '.')}"
            self.model.add(Concept(a, "property", None, frozenset()))
            columns[a] = (Node("ref", c), "")
        self.model.datasources[f"rowset.{name}"] = Datasource(f"rowset.{name}", columns, frozenset(), lambda: df, rowset=True)

    # Queries and effects

    def do_select(self, select: dict) -> DataFrame:
        return self.planner.select(select)

    def do_raw_sql(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)

    def do_persist(self, name: str, into: str | None, by: list, mode: str, select: dict) -> None:
        df = self.planner.select(select)
        table = self.table(into or name)
        if by:
            write_slices(self.spark, df, table, [column_name(b) for b in by])
        else:
            df.write.mode(mode).format("parquet").saveAsTable(table)
        self.bind_result(name, table, select)

    def bind_result(self, name: str, table: str, select: dict) -> None:
        """The written table as a datasource of its concepts and aggregates."""
        if "items" not in select or name in self.model.datasources:
            return
        columns, dims, aggregates = {}, [], {}
        for a, x, h in select["items"]:
            e = self.planner.expand(x)
            shaped = any(n.kind in ("agg", "win") for n in self.planner.own(e))
            if h:
                continue
            if x.kind == "ref" and not shaped:
                columns[self.model.address(x.name)] = (Node("ref", column_name(a)), "")
                dims.append(self.model.address(x.name))
            elif e.kind == "agg" and not e.extra and x.kind == "ref":
                columns[x.name] = (Node("ref", column_name(a)), "")
                aggregates[x.name] = x
        if any(select[k] for k in ("where", "from", "joins", "by")) or select["having"] is not None or select["limit"] is not None or not columns:
            return
        self.model.datasources[name] = Datasource(name, columns, self.planner.model.minimal(frozenset(dims)) if not aggregates else frozenset(dims), lambda: self.spark.table(table), aggregates=aggregates, write_to=table)

    def layer(self, layer: dict) -> tuple[dict, DataFrame]:
        """A chart's layer: the column of each role, and its rows; without a select of its own, one of the bindings."""
        if layer["select"] is not None:
            return {r: x.name if x.kind == "ref" else a for r, x, a in layer["bindings"]}, self.planner.select({**layer["select"], "order": layer["order"] or layer["select"]["order"], "limit": layer["limit"] or layer["select"]["limit"]})
        items = [(a or (x.name if x.kind == "ref" else r), x, False) for r, x, a in layer["bindings"]]
        q = {"from": None, "where": [], "joins": [], "items": list(dict((i[0], i) for i in items).values()), "by": None, "having": None, "order": layer["order"], "limit": layer["limit"]}
        return {r: n for (r, _, _), (n, _, _) in zip(layer["bindings"], items, strict=True)}, self.planner.select(q)

    def do_chart(self, layers: list, places: list, flags: list, scales: dict) -> DataFrame:
        """The rows of a chart's first layer; draw() makes the picture."""
        return self.layer(layers[0])[1]

    def draw(self, chart: dict) -> str:
        """A chart as SVG."""
        made = []
        for x in chart["layers"]:
            roles, df = self.layer(x)
            names = {column_name(n): n for n in roles.values()}
            made.append({"type": x["type"], "roles": roles, "rows": [{names.get(k, k): v for k, v in r.asDict().items()} for r in df.limit(charts.MOST + 1).collect()]})
        title = ", ".join(dict.fromkeys(n for x in made for n in x["roles"].values())) if "show_title" in chart["flags"] else None
        return charts.draw(made, chart["places"], chart["scales"], "hide_legend" not in chart["flags"], title)

    def do_copy(self, format: str, path: str, options: dict, select: dict) -> None:  # noqa: A002
        if "chart" in select:
            picture = self.draw(select["chart"])
            if format not in ("svg", "html"):
                raise LanguageError(f"charts are written as svg or html, not {format}")
            write_text(self.spark, picture if format == "svg" else f"<!DOCTYPE html><html><body>{picture}</body></html>\n", path)
            return
        write_files(self.planner.select(select), format, path, options)

    def do_create(self, name: str, mode: str, data: bool) -> None:
        d = self.model.datasources[name]
        frame_columns = {c: e for c, (e, _) in d.columns.items()}
        if data:
            df = self.planner.result([(e.name, Node("ref", c), False) for c, e in frame_columns.items()], [], None, [])
        else:
            df = self.spark.createDataFrame([], ", ".join(f"`{e.name}` {spark_type(self.model.concepts[c].type or 'string')}" for c, e in frame_columns.items()))
        if mode == "ignore" and self.spark.catalog.tableExists(self.table(d.write_to)):
            return
        df.write.mode("overwrite" if mode == "overwrite" else "error").saveAsTable(self.table(d.write_to))

    def do_publish(self, name: str, on: bool) -> None:
        self.model.datasources[name].published = on

    def do_show(self, what: str, select: dict | None = None) -> DataFrame:
        if what == "concepts":
            return self.spark.createDataFrame([(c.address, c.purpose, c.type, sorted(c.keys or [])) for c in self.model.concepts.values()], "address string, purpose string, type string, keys array<string>")
        if what == "datasources":
            return self.spark.createDataFrame([(d.name, sorted(d.columns), sorted(d.grain)) for d in self.model.datasources.values()], "name string, concepts array<string>, grain array<string>")
        df = self.planner.select(select)
        return self.spark.createDataFrame([(df._jdf.queryExecution().toString(),)], "plan string")

    def do_validate(self, what: str, names: list) -> DataFrame:
        if what == "joins":
            return declared_joins(self.planner)
        return datasource_checks(self.planner, names if what == "datasources" else [])

    def do_call(self, program: str, select: dict | None) -> None:
        """Runs a program; each output of the select, which has one row, is an argument --name value."""
        arguments = []
        if select is not None:
            found = self.planner.select(select).limit(2).collect()
            if len(found) != 1:
                raise LanguageError(f"call needs one row, not {'none' if not found else 'several'}")
            arguments = [a for k, v in found[0].asDict().items() if v is not None for a in (f"--{k}", str(v))]
        path = Path(self.root or ".") / program
        subprocess.run([*([sys.executable] if path.suffix == ".py" else []), str(path), *arguments], check=True)

    def do_mock(self, names: list, rows: int = 100) -> None:
        """Datasources with made-up rows in place of their data; all of them where none is named."""
        for n in names or [n for n, d in self.model.datasources.items() if not d.rowset]:
            self.model.datasources[n] = mocked(self.spark, self.model, self.model.datasources[n], rows)

    # Rebuilding

    def do_rebuild(self, name: str, where: Node | None, mode: str) -> None:
        """A datasource's table written from the other datasources: whole, or for append the rows of a condition."""
        d = self.model.datasources[name]
        if not d.write_to:
            raise LanguageError(f"{name} has no place to be written to")
        self.model.datasources[name] = replace(d, published=False)
        try:
            items = [(e.name, self.planner.expand(Node("ref", c)), False) for c, (e, _) in d.columns.items()]
            df = self.planner.result(items, [conjuncts(self.planner.expand(where))] if where is not None else [], None, [])
        finally:
            self.model.datasources[name] = d
        if "/" in d.write_to:
            write_files(df, d.write_to.rsplit(".", 1)[-1], d.write_to, mode=mode)
        else:
            df.write.mode(mode).saveAsTable(self.table(d.write_to))
            self.written.add(d.write_to)
        if not d.published:
            self.model.datasources[name] = replace(d, published=True)

    # Incremental refresh

    def refresh(self, name: str, table: str) -> int:
        """Adds to `table` the rows of a select over name's concepts whose incremental key is past what the table has; returns how many."""
        d = self.model.datasources[name]
        if not d.incremental:
            raise LanguageError(f"{name} has no incremental key")
        key = self.model.address(d.incremental)
        items = [(c, Node("ref", c), False) for c in d.columns]
        df = self.planner.result(items, [], None, [])
        if self.spark.catalog.tableExists(table):
            mark = self.spark.table(table).agg(F.max(column_name(key))).first()[0]
            if mark is not None:
                df = df.where(F.col(column_name(key)) > F.lit(mark))
        before = self.spark.table(table).count() if self.spark.catalog.tableExists(table) else 0
        df.write.mode("append").saveAsTable(table)
        return self.spark.table(table).count() - before

    def watermark(self, name: str, key: str) -> DataFrame:
        """The greatest value of a key in a datasource, and an order-free checksum of its values."""
        frame = self.planner.scan(name)
        c = frame.col(self.model.address(key))
        return frame.df.agg(F.max(c).alias("high"), F.bit_xor(F.xxhash64(c)).alias("checksum"))


__all__ = ["Engine", "Statement", "conjuncts"]
