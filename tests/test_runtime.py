"""Hooks, limits, environments, statements made by calls, programs, slices, snapshots, introspection."""

import json
import uuid

import pytest

from millrace import builder as b
from millrace.engine import Engine
from millrace.operators.validate import differences
from millrace.runtime import Hooks, Policy, TimeLimit, collect
from millrace.sources import introspect
from millrace.streaming import refresh as r

MODEL = "key nation int; property nation.label string; key region int; property region.title string; datasource ns (n: nation, l: label, r: ~region) grain (nation) query '''select * from values (1, 'a', 1), (2, 'b', 1), (3, 'c', 2) as t(n, l, r)'''; datasource rs (r: region, t: title) grain (region) query '''select * from values (1, 'x'), (2, 'y'), (3, 'z') as t(r, t)''';"


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    e.run(MODEL)
    return e


def got(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def test_hooks(spark):
    seen = []
    e = Engine(spark, hooks=Hooks([lambda s: seen.append(s.kind)], [lambda names: seen.append(tuple(names))], [lambda s, df: seen.append(df.columns)]))
    e.run(MODEL + "select title, count(nation) as n;")
    assert seen.count("datasource") == 2 and "select" in seen and ("ns", "rs") in seen and seen[-1] == ["title", "n"]


def test_time_limit_and_retries(spark):
    slow = spark.range(0, 1_500_000_000, 1, 4).selectExpr("sum(sqrt(id) * sin(id)) as t")
    with pytest.raises(TimeLimit):
        collect(slow, Policy(seconds=0.5))
    calls = []

    class Flaky:
        sparkSession = spark

        def collect(self):
            calls.append(1)
            if len(calls) < 3:
                raise RuntimeError("Connection reset by peer")
            return ["row"]

    assert collect(Flaky(), Policy(retries=3, wait=0.01)) == ["row"] and len(calls) == 3
    calls.clear()
    with pytest.raises(RuntimeError):
        collect(Flaky(), Policy(retries=1, wait=0.01))


def test_environments(spark):
    table = f"made_{uuid.uuid4().hex}"
    text = f"datasource kept (n: nation, l: label) grain (nation) address {table} state unpublished;"
    live, dev = Engine(spark), Engine(spark, environment="dev")
    for e in (live, dev):
        e.run(MODEL + text)
    live.run("create datasource kept with data;")
    dev.run("create datasource kept with data;")
    assert dev.environment.tables() == [table] and spark.catalog.tableExists(f"dev__{table}")
    spark.sql(f"insert into dev__{table} values (9, 'new')")
    dev.run("publish datasource kept;")
    assert (9, "new") in got(dev.query("from kept select nation, label;"))
    assert spark.table(table).count() == 3
    assert dev.environment.promote() == [table] and spark.table(table).count() == 4 and dev.environment.tables() == []


def test_statements_by_calls(engine):
    made = b.select(b.c("title").as_("t"), b.count("nation").as_("n"), where=b.c("region") < 3, having=b.c("n") > 0, order=[b.c("n").desc(), b.c("t")], limit=5)
    assert [tuple(x) for x in engine.execute(made).collect()] == [("x", 2), ("y", 1)]
    engine.execute(b.concept("auto", "twice", value=b.c("nation") * 2))
    pinned = b.select("nation", b.total("twice").by("region").as_("s"), b.case((b.c("label") == "a", 1), otherwise=0).as_("f"), where=b.c("nation").isin(1, 2, 3))
    assert got(engine.execute(pinned)) == [(1, 6, 1), (2, 6, 0), (3, 6, 0)]
    inner = b.select("region", where=b.c("title") == "x")
    assert got(engine.execute(b.select("nation", where=b.c("region").isin(inner)))) == [(1,), (2,)]
    engine.execute(b.concept("key", "k2", "int"))
    engine.execute(b.datasource("more", {"a": "k2"}, ["k2"], query="select 5 as a"))
    assert got(engine.query("select k2;")) == [(5,)]


def test_scopes(engine):
    rows = {x.name: x for x in engine.scopes("where region < 3 select title as t, count(nation) as n, count(nation) by * as every;").collect()}
    assert rows["t"].kind == "dimension" and rows["t"].grain == ["region"] and rows["n"].kind == "aggregate" and rows["n"].grain == ["region"]
    assert rows["every"].grain == [] and rows["n"].datasources == ["ns", "rs"] and "region < 3" in rows["n"].population


def test_summary_sample_keys_and_model(spark, engine):
    s = {x.column: x for x in engine.summary("select nation, title limit 1;").collect()}
    assert s["nation"].rows == 4 and s["nation"].nulls == 1 and s["nation"].min == "1" and s["title"].max == "z"
    t = spark.range(1000).selectExpr("id as k", "id % 10 as a", "id div 10 as b", "cast(id as string) as name")
    few = introspect.sample(t, 50)
    assert sorted(few.collect()) == sorted(introspect.sample(t.repartition(7), 50).collect()) and few.count() == 50
    assert introspect.keys(t) == [["k"], ["name"]] and introspect.keys(t.select("a", "b")) == [["a", "b"]]
    tables = {"item": t.selectExpr("k", "a"), "sale": spark.range(50).selectExpr("id as s", "id % 20 as k")}
    text = introspect.model_of(spark, tables)
    e = Engine(spark)
    for n, df in tables.items():
        e.register_frame(n, df)
    e.run(text)
    assert "k: ~item.k" in text and e.query("select item.a, count(sale.s) as n;").agg({"n": "sum"}).first()[0] == 50


def test_programs_get_columns_and_conditions(spark, tmp_path):
    path, log = tmp_path / "source.py", tmp_path / "log"
    path.write_text(f"""
import json, sys, pyarrow as pa
open({str(log)!r}, "a").write(json.dumps(sys.argv[1:]) + "\\n")
t = pa.table({{"k": list(range(100)), "v": [i * 2 for i in range(100)], "rest": ["x"] * 100}})
w = pa.ipc.new_stream(sys.stdout.buffer, t.schema)
w.write_table(t)
w.close()
""")
    e = Engine(spark)
    e.run(f"key k int; property k.v int; datasource p (k: k, v: v) grain (k) file `{path}`;")
    assert got(e.query("where k >= 98 select k, v;")) == [(98, 196), (99, 198)]
    asked = [json.loads(x) for x in log.read_text().splitlines()]
    assert any(a[:2] == ["--columns", "k,v"] and "k >= 98" in a for a in asked)


def test_slices_that_differ_are_written(spark):
    table = f"slices_{uuid.uuid4().hex}"
    e = Engine(spark)
    rows = lambda extra: spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 30), *extra], "id long, g string, v long")
    e.register_frame("src", rows([(4, None, 40)]))
    e.run(f"key id int; property id.g string; property id.v int; root datasource src (id: id, g: g, v: v) grain (id) address src; datasource kept (id: id, g: g, v: v) grain (id) partition by g address {table};")
    assert r.refresh(e) == {"kept": "missing"}
    assert got(spark.table(table).select("id", "g", "v")) == [(1, "a", 10), (2, "a", 20), (3, "b", 30), (4, None, 40)]
    assert r.stale(e) == {}
    e.register_frame("src", spark.createDataFrame([(1, "a", 10), (2, "a", 20), (5, "c", 50), (4, None, 41)], "id long, g string, v long"))
    assert {(x.g, x.why) for x in r.slices(e, "kept").collect()} == {("b", "gone"), ("c", "missing"), (None, "stale")}
    r.refresh(e)
    assert got(spark.table(table).select("id", "g", "v")) == [(1, "a", 10), (2, "a", 20), (4, None, 41), (5, "c", 50)]


def test_probes_and_key_hashes(spark, tmp_path):
    (tmp_path / "probe.py").write_text("print(open(__file__.replace('probe.py', 'word')).read())")
    table = f"probed_{uuid.uuid4().hex}"
    e = Engine(spark, root=str(tmp_path))
    e.register_frame("src", spark.createDataFrame([(1, 10), (2, 20)], "id long, v long"))
    e.run(f"key id int; property id.v int; root datasource src (id: id, v: v) grain (id) address src; datasource kept (id: id, v: v) grain (id) freshness by `probe.py` address {table};")
    (tmp_path / "word").write_text("true")
    r.refresh(e)
    assert r.stale(e) == {}
    (tmp_path / "word").write_text("no")
    assert "probe.py" in r.stale(e)["kept"]
    other = f"hashed_{uuid.uuid4().hex}"
    e.run(f"datasource two (id: id, v: v) grain (id) freshness by v address {other};")
    r.refresh(e)
    (tmp_path / "word").write_text("true")
    assert r.stale(e) == {}
    e.register_frame("src", spark.createDataFrame([(1, 10), (3, 20)], "id long, v long"))
    assert r.stale(e) == {"two": "keys differ from src"}


def test_schema_drift_and_snapshots(spark, tmp_path):
    table = f"drift_{uuid.uuid4().hex}"
    e = Engine(spark)
    e.register_frame("src", spark.createDataFrame([(1, 10)], "id long, v long"))
    e.run(f"key id int; property id.v int; root datasource src (id: id, v: v) grain (id) address src; datasource kept (id: id, v: v) grain (id) freshness by v address {table};")
    spark.sql(f"create table {table} as select 1L as id, 'ten' as v")
    e.written.add(table)
    assert r.stale(e) == {"kept": "schema: v is string, not bigint"}
    before = r.snapshot(e)
    r.save_snapshot(spark, str(tmp_path / "state"), before)
    assert r.load_snapshot(spark, str(tmp_path / "state")) == before
    r.refresh(e)
    after = r.changed(before, r.snapshot(e))
    assert list(after) == [table] and "columns" in after[table]


def test_declared_joins_and_differences(spark):
    e = Engine(spark)
    e.run("key a int; key b int; datasource xs (a: a) grain (a) query '''select * from values (1), (2), (7) as t(a)'''; datasource ys (b: b) grain (b) query '''select * from values (1), (2), (3) as t(b)'''; merge a into ~b;")
    assert got(e.query("validate joins;")) == [("xs", "ys", "a in b", 1)]
    x = spark.createDataFrame([(1, 0.1 + 0.2), (2, None)], "k int, v double")
    y = spark.createDataFrame([(2, None), (1, 0.3)], "k int, v double")
    assert differences(x, y).count() == 0 and differences(x, y, ordered=True).count() == 4
    assert got(differences(x, y.where("k = 1")).select("c0", "n_got", "n_want")) == [("2", 1, 0)]
