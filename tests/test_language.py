"""The language around queries: layout, types, imports, made-up data, rebuilding, the command line."""

import pytest

from millrace import queries
from millrace.__main__ import main
from millrace.engine import Engine
from millrace.lang.parser import LanguageError, parse
from millrace.lang.render import formatted
from millrace.streaming.refresh import refresh, stale

EXTRA = """
from std.date import month; self import as other; properties <a, b> (x int[0..100], y enum<string>['p', 'q']); type t int | float drop sum | avg;
root datasource r (id: a, raw('''x + 1'''): x) grain (a) file `r.csv`:`w.csv` where x > 0 freshness by a within 2 days state unpublished;
overwrite r where a > 3; append into t1 from select a; mock datasources r; call `f.py` from select a limit 1; copy into csv 'o.csv' (header = true) from select a;
def f -> 1; create if not exists datasource r with data; publish datasources r; validate all; show concepts; raw_sql('''select 1'''); merge a.* into ~b.*;
"""


def tree(text):
    return [(s.kind, repr(s.data)) for s in parse(text)]


@pytest.mark.parametrize("name", [*queries.TEXTS, "model", "extra"])
def test_layout_keeps_the_statements(name):
    text = {"model": queries.MODEL, "extra": EXTRA}.get(name) or queries.TEXTS[name]
    once = formatted(text)
    assert formatted(once) == once
    for (k, d), (k2, d2) in zip(tree(once), tree(text), strict=True):
        assert k == k2
        if "Query" not in d:  # nested selects have no equality
            assert d == d2


@pytest.mark.parametrize("name", ["color", "currency", "date", "display", "geography", "metric", "money", "net", "ranking", "report", "semantic"])
def test_standard_models_load(spark, name):
    e = Engine(spark)
    e.run(f"import std.{name};")
    assert e.model.types or e.model.macros


def test_standard_functions(spark):
    e = Engine(spark)
    e.run("import std.report as report; import std.display as display; key k int; property k.v int; datasource d (id: k, v: v) grain (k) query '''select id, id * 2 as v from range(5)''';")
    rows = {tuple(r) for r in e.query("select k, @report.top_x_by_metric(k::string, v, 2) as top;").collect()}
    assert rows == {(4, "4"), (3, "3"), (2, "other"), (1, "other"), (0, "other")}
    assert [float(r.p) for r in e.query("select k, @display.calc_percent(1, v, 2) as p order by k asc;").collect()] == [0.0, 0.5, 0.25, 0.17, 0.13]


def test_values_that_a_type_forbids_are_counted(spark):
    e = Engine(spark)
    e.run("""import std.date; key k int; property k.m int::month; property k.s enum<string>['a', 'b']; property k.r string['[0-9]+'];
    datasource d (k: k, m: ?m, s: ?s, r: ?r) grain (k) query '''select * from values (1, 1, 'a', '12'), (2, 13, 'c', 'x1'), (3, null, null, null) as t(k, m, s, r)''';""")
    got = {r.subject: r.failures for r in e.query("validate all;").where("check = 'values'").collect()}
    assert got == {"m": 1, "s": 1, "r": 1}


def test_imports_by_name_and_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "base.preql").write_text("key id int; property id.name string; datasource b (id: id, name: name) grain (id) query '''select 1 as id, 'x' as name''';")
    (tmp_path / "in" / "top.preql").write_text("from ..base as b import id, name;")
    e = Engine(spark, str(tmp_path / "in"))
    e.run("import .top as t;")
    assert [tuple(r) for r in e.query("select t.b.id, t.b.name;").collect()] == [(1, "x")]
    with pytest.raises(LanguageError):
        e.run("from ..base import nothing;")


def test_self_import_joins_a_table_with_itself(spark):
    e = Engine(spark)
    e.run("key id int; property id.boss int; datasource p (id: id, boss: boss) grain (id) query '''select * from values (1, 1), (2, 1), (3, 2) as t(id, boss)'''; self import as up; merge boss into ~up.id;")
    got = sorted(tuple(r) for r in e.query("select id, up.boss as over where id is not null;").collect())
    assert got == [(1, 1), (2, 1), (3, 1)]


def test_made_up_rows_join(spark):
    e = Engine(spark)
    e.run("""key u int; properties u (name string, age int[18..65]); key p int; property p.score float;
    datasource users (id: u, n: name, a: age) grain (u) address nowhere; datasource posts (id: p, uid: ~u, s: score) grain (p) address nowhere2; mock datasources users, posts;""")
    rows = e.query("select u, name, age, count(p) as n;").collect()
    assert len(rows) == 100 and sum(r.n for r in rows) == 100 and all(18 <= r.age <= 65 for r in rows)
    assert rows != [] and {tuple(r) for r in rows} == {tuple(r) for r in e.query("select u, name, age, count(p) as n;").collect()}


def test_refresh_rebuilds_what_is_behind(spark):
    e = Engine(spark)
    facts = [(1, "2024-01-01", 5.0), (2, "2024-01-02", 7.0)]
    put = lambda: e.register_frame("facts", spark.createDataFrame(facts, "id long, d string, v double"))
    put()
    e.run("""key id int; key day date; property id.v float; metric total <- sum(v);
    root datasource facts (id: id, d::date: day, v: v) grain (id) address facts;
    datasource daily (day: day, total: total) grain (day) address daily_totals freshness by day within 1 day;""")
    assert refresh(e) == {"daily": "missing"}
    assert {str(r.day): r.total for r in spark.table("daily_totals").collect()} == {"2024-01-01": 5.0, "2024-01-02": 7.0}
    facts.append((3, "2024-01-03", 1.0))
    put()
    assert stale(e) == {}  # within the allowed lag
    facts.append((4, "2024-01-04", 2.0))
    put()
    assert list(refresh(e)) == ["daily"] and stale(e) == {}
    assert spark.table("daily_totals").count() == 4
    spark.sql("select day from daily_totals").write.mode("overwrite").saveAsTable("daily_days")
    e.run("datasource days (day: day, total: total) grain (day) address daily_days freshness by day; unpublish datasources daily;")
    e.written.add("daily_days")
    assert refresh(e)["days"] == "schema: lacks total" and "days" not in stale(e)
    assert {r.total for r in spark.table("daily_days").collect()} == {5.0, 7.0, 1.0, 2.0}


def test_call_passes_one_row(spark, tmp_path):
    (tmp_path / "p.py").write_text("import sys, pathlib; pathlib.Path(__file__).with_name('out').write_text(' '.join(sys.argv[1:]))")
    Engine(spark, str(tmp_path)).run("const x <- 5; call `p.py` from select x;")
    assert (tmp_path / "out").read_text() == "--x 5"
    with pytest.raises(LanguageError):
        Engine(spark, str(tmp_path)).run("key k int; datasource d (id: k) grain (k) query '''select id from range(2)'''; call `p.py` from select k;")


def test_command_line(spark, tmp_path, capsys):
    f = tmp_path / "m.preql"
    f.write_text("parameter n int default 1; SELECT n + 1 as  two;")
    main(["run", str(f), "--param", "n=4"], spark)
    assert "5" in capsys.readouterr().out
    main(["fmt", str(f)])
    assert f.read_text() == "parameter n int default 1;\nselect\n    n + 1 as two;\n"


def test_comments_stay():
    text = "# first\nkey a int; // of b\nselect a, # inner\n1 as one;\n/* end */"
    once = formatted(text)
    assert once == formatted(once) and all(c in once for c in ("# first", "// of b", "# inner", "/* end */"))
    assert once.index("# first") < once.index("key a") < once.index("// of b") < once.index("select") < once.index("/* end */")


def test_made_up_text_follows_patterns(spark):
    import re

    e = Engine(spark)
    e.run("key k int; property k.code string['[A-Z]{2}-\\\\d{3,5}(x|yz)?']; datasource t (k: k, c: code) grain (k) address t; mock datasources t;")
    rows = [r[0] for r in e.query("select k, code;").select("code").collect()]
    assert len(rows) == 100 and len(set(rows)) > 90 and all(re.fullmatch(r"[A-Z]{2}-\d{3,5}(x|yz)?", r) for r in rows)


def test_typed_text_files_are_read_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,d,x\n1,2024-01-02,0.5\n2,2024-01-03,1.5\n")
    e = Engine(spark)
    e.run(f"key k int; property k.d date; property k.x float; datasource t (k: k, d: d, x: x) grain (k) file `{tmp_path}/a.csv`;")
    df = e.query("select k, d, x;")
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "date", "double"] and df.count() == 2


def test_top_k_is_cut_before_rows_meet(spark):
    df = queries.QUERIES["top_x"](spark, "/root/testdata/sf0.001")
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "tables").mkdir()
    spark.range(5).selectExpr("id as k", "id * 2 as v").coalesce(1).write.parquet(str(tmp_path / "tables" / "t.parquet"))
    model = tmp_path / "m.preql"
    main(["ingest", str(model), "--tables", str(tmp_path / "tables")], spark)
    assert "key t.k int;" in model.read_text()
    model.write_text(model.read_text() + "select t.k, t.v;")
    for command, word in (("scopes", "dimension"), ("summary", "non_null"), ("state", "t: new")):
        main([command, str(model), "--tables", str(tmp_path / "tables")], spark)
        assert word in capsys.readouterr().out
