"""The semantic rules, each on a few rows with null keys, orphans and fan-out."""

import pytest

from millrace.engine import Engine
from millrace.lang.parser import LanguageError, parse

MODEL = """
key user.id int; property user.id.name string;
key post.id int; property post.id.score int; property post.id.tag string;
key vote.id int; property vote.id.weight int;
datasource users (id: user.id, name: user.name) grain (user.id) address users;
datasource posts (id: post.id, uid: ~?user.id, score: post.score, tag: ?post.tag) grain (post.id) address posts;
datasource votes (id: vote.id, pid: ~post.id, weight: vote.weight) grain (vote.id) address votes;
"""


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    e.register_frame("users", spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, name string"))
    e.register_frame("posts", spark.createDataFrame([(10, 1, 1, "x"), (11, 1, 2, None), (12, 2, 4, "y"), (13, None, 8, None)], "id long, uid long, score long, tag string"))
    e.register_frame("votes", spark.createDataFrame([(1, 10, 1), (2, 10, 1), (3, 11, 1), (4, 12, 5)], "id long, pid long, weight long"))
    e.run(MODEL)
    return e


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_r1_output_is_distinct_at_its_grain(engine):
    assert got(engine.query("select user.name;")) == [("a",), ("b",)]


def test_r2_pinned_and_global_aggregates(engine):
    assert got(engine.query("select post.id, sum(post.score) by * as s;")) == [(10, 15), (11, 15), (12, 15), (13, 15)]


def test_r3_no_measure_is_counted_twice(engine):
    rows = got(engine.query("select user.name as n, sum(post.score) as s, sum(vote.weight) as w;"))
    assert ("a", 3, 3) in rows and ("b", 4, 5) in rows


def test_r4_where_aggregate_sees_the_population(engine):
    assert got(engine.query("where post.score > 1 and count(post.id) by user.id = 2 select post.id;")) == [(11,)]


def test_r5_stages(engine):
    assert got(engine.query("where post.score > 1 then where count(post.id) by user.id = 1 and user.id is not null select post.id;")) == [(11,), (12,)]


def test_r6_having_on_hidden_aggregate(engine):
    assert got(engine.query("select user.name as n having sum(post.score) = 3;")) == [("a",)]


def test_r7_no_row_is_dropped(engine):
    rows = got(engine.query("select user.id as u, count(post.id) as n;"))
    assert (3, 0) in rows and (1, 2) in rows


def test_r8_in_is_identity_matching(engine):
    assert got(engine.query("where post.tag in ('x', null) select post.id;")) == [(10,), (11,), (13,)]
    assert got(engine.query("where post.tag not in ('x', null) select post.id;")) == [(12,)]


def test_r9_counts_are_zero_and_sums_null(engine):
    assert got(engine.query("where post.id = -1 select count(post.id) as n, sum(post.score) as s;")) == [(0, None)]


def test_r10_no_silent_cross_join(engine):
    engine.run("key lone.id int; datasource lone (id: lone.id) grain (lone.id) query '''select 1 as id''';")
    with pytest.raises(LanguageError):
        engine.query("select lone.id, user.id;")


def test_join_spellings_are_refused(engine):
    with pytest.raises(LanguageError, match="subset join"):
        engine.query("left join user.id = post.id select user.id;")


def test_persist_binds_and_append_adds(spark, engine):
    engine.run("metric total_score <- sum(post.score); persist tag_scores into tag_scores_t from select post.tag, total_score;")
    assert got(spark.table("tag_scores_t")) == [("x", 1), ("y", 4), (None, 10)] or len(got(spark.table("tag_scores_t"))) == 3
    assert "tag_scores_t" in spark.catalog.listTables()[0].name or spark.catalog.tableExists("tag_scores_t")
    assert got(engine.query("select post.tag as t, total_score as s having s > 5;")) == [(None, 10)]


def test_copy_and_file_source(spark, engine, tmp_path):
    engine.run(f"copy into csv '{tmp_path}/out.csv' from select user.id as id, user.name as name;")
    engine.run(f"key u2 int; property u2.nick string; datasource again (id: u2, name: nick) grain (u2) file `{tmp_path}/out.csv`;")
    assert len(got(engine.query("select u2, nick;"))) == 3


def test_incremental_refresh_adds_only_later_rows(spark, engine):
    engine.run("datasource feed (id: vote.id, weight: vote.weight) grain (vote.id) incremental by vote.id address votes;")
    assert engine.refresh("feed", "feed_t") == 4
    assert engine.refresh("feed", "feed_t") == 0


def test_validate_counts_repeated_grains(engine, spark):
    engine.register_frame("users", spark.createDataFrame([(1, "a"), (1, "b")], "id long, name string"))
    bad = {(r.datasource, r.check): r.failures for r in engine.query("validate datasources users;").collect()}
    assert bad[("users", "grain")] == 1


def test_show(engine):
    assert engine.query("show concepts;").count() >= 7
    assert "Project" in engine.query("show select user.name;").first()[0]


def test_imports_have_a_namespace(spark, tmp_path):
    (tmp_path / "shop.preql").write_text("key id int; property id.name string; datasource t (id: id, name: name) grain (id) query '''select 1 as id, 'n' as name'''; def twice(x) -> x * 2;")
    e = Engine(spark, root=str(tmp_path))
    e.run("import shop as s;")
    assert got(e.query("select s.id, s.name, @s.twice(s.id) as d;")) == [(1, "n", 2)]


def test_filter_reaches_the_scan(spark):
    from millrace.queries import engine as tpch

    plan = tpch(spark, "/root/testdata/sf0.001").query("show where line.quantity < 3 select line.flag as f, sum(line.price) as s;").first()[0]
    assert "LessThan(l_quantity,3" in plan and "l_comment" not in plan and plan.count("Exchange") <= 4


@pytest.mark.parametrize("text", ["select", "select a b c;", "key;", "where x select;", "select (1;"])
def test_bad_text_is_an_error(text):
    with pytest.raises(LanguageError):
        parse(text)


NULLABLE = """
key u int; property u.name string; key p int; property p.s int;
datasource us (id: u, name: name) grain (u) address us;
datasource ps (id: p, uid: {marks}u, s: s) grain (p) address ps;
"""


@pytest.fixture(params=["~?", "?"])
def nullable(spark, request):
    e = Engine(spark)
    e.register_frame("us", spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"))
    e.register_frame("ps", spark.createDataFrame([(10, 1, 1), (11, 1, 2), (12, 2, 4), (13, None, 9)], "id long, uid long, s long"))
    e.run(NULLABLE.format(marks=request.param))
    return e


def test_r7_null_keys_keep_their_rows(nullable):
    assert got(nullable.query("select p, name;")) == [(10, "a"), (11, "a"), (12, "b"), (13, None)]
    assert got(nullable.query("select name, sum(s) as t;")) == [("a", 3), ("b", 4), (None, 9)]
    assert got(nullable.query("select sum(s) as t;")) == [(16,)]


def test_r7_whole_results(engine):
    assert got(engine.query("select user.id as u, count(post.id) as n;")) == [(1, 2), (2, 1), (3, 0), (None, 1)]
    assert got(engine.query("select post.id, user.name;")) == [(10, "a"), (11, "a"), (12, "b"), (13, None), (None, "b")]


def test_r7_a_lookup_adds_no_rows(engine):
    assert got(engine.query("where user.name = 'b' select post.id;")) == [(12,)]


def test_padding_is_no_value(spark):
    """A fact without a key and a dimension row without a fact are both kept, and never meet at the next join."""
    e = Engine(spark)
    e.register_frame("a", spark.createDataFrame([(1, 5), (2, None)], "x long, y long"))
    e.register_frame("b", spark.createDataFrame([(5, 7), (6, None)], "y long, z long"))
    e.register_frame("c", spark.createDataFrame([(7, "seven"), (8, "eight")], "z long, n string"))
    e.run("key x int; key y int; key z int; property z.n string; datasource a (x: x, y: ~?y) grain (x) address a; datasource b (y: y, z: ~?z) grain (y) address b; datasource c (z: z, n: n) grain (z) address c;")
    assert got(e.query("select x, y, n;")) == [(1, 5, "seven"), (2, None, None), (None, 6, None), (None, None, "eight")]


def test_source_search_has_no_limit(spark):
    """A chain of 14 datasources, and a star of 12 around one fact."""
    e = Engine(spark)
    text = "key k0 int;"
    for i in range(1, 15):
        text += f"key k{i} int; datasource d{i} (a: k{i - 1}, b: k{i}) grain (k{i - 1}) query '''select 1 as a, 1 as b''';"
    e.run(text)
    assert got(e.query("select k0, k14;")) == [(1, 1)]
    star = "key f int;" + "".join(f"key s{i} int; property s{i}.n{i} int;" for i in range(12))
    star += "datasource fact (f: f," + ",".join(f"c{i}: s{i}" for i in range(12)) + ") grain (f) query '''select 1 as f, " + ",".join(f"{i} as c{i}" for i in range(12)) + "''';"
    star += "".join(f"datasource dim{i} (c: s{i}, n: n{i}) grain (s{i}) query '''select {i} as c, {i} as n''';" for i in range(12))
    e.run(star)
    assert got(e.query("select f, " + ", ".join(f"n{i}" for i in range(12)) + ";")) == [(1, *range(12))]


def test_a_scalar_select_with_several_rows_is_an_error(engine):
    with pytest.raises(Exception, match="several rows"):
        engine.query("where post.score > (select post.score) select post.id;").collect()
    assert got(engine.query("where post.score > (select post.score where post.score > 99) select post.id;")) == []


SALES = """
key day int; property day.region string; key sale int; property sale.amount int; key cust int;
metric total <- sum(amount); metric buyers <- count(cust); metric most <- max(amount);
datasource sales (s: sale, d: day, c: cust, a: amount) grain (sale) query '''select * from values (1, 1, 7, 1), (2, 1, 8, 2), (3, 2, 7, 3), (4, 3, 9, 10) as t(s, d, c, a)''';
datasource days (d: day, r: region) grain (day) query '''select * from values (1, 'eu'), (2, 'eu'), (3, 'us') as t(d, r)''';
"""


@pytest.fixture()
def sales(spark):
    e = Engine(spark)
    e.run(SALES)
    return e


def test_summary_with_part_of_the_rows(sales):
    sales.run("partial datasource eu (d: day, t: total) grain (day) complete where region = 'eu' query '''select * from values (1, 100), (2, 200) as t(d, t)''';")
    assert got(sales.query("select total as t;")) == [(16,)]
    assert got(sales.query("where region = 'eu' select total as t;")) == [(300,)]


def test_summary_with_a_condition(sales):
    sales.run("datasource by_day (d: day, t: total) grain (day) where d < 3 query '''select * from values (1, 100), (2, 200), (3, 900) as t(d, t)''';")
    assert got(sales.query("select day, total as t;")) == [(1, 100), (2, 200)]


def test_summary_counts_add_up_only_over_what_their_rows_have_once(sales):
    sales.run("datasource by_day (d: day, b: buyers, t: total, m: most) grain (day) query '''select * from values (1, 2, 300, 2), (2, 1, 300, 3), (3, 1, 1000, 10) as t(d, b, t, m)''';")
    assert got(sales.query("select buyers as b;")) == [(3,)]  # customer 7 came twice: not from the summary
    assert got(sales.query("select total as t, most as m;")) == [(1600, 10)]
    assert got(sales.query("select region, total as t;")) == [("eu", 600), ("us", 1000)]  # a property of the summary's grain
    assert got(sales.query("where region = 'us' select total as t;")) == [(1000,)]


def test_the_cheapest_summary_answers(sales):
    sales.run("datasource fine (d: day, c: cust, t: total) grain (day, cust) query '''select 1 as d, 7 as c, 5 as t'''; datasource coarse (d: day, t: total) grain (day) query '''select 1 as d, 6 as t''';")
    assert got(sales.query("select day, total as t;")) == [(1, 6)]


def test_conditions_of_datasources(spark):
    e = Engine(spark)
    e.run("key a int; property a.b int; datasource x (k: a, v: b) grain (a) where b > 1 and k < 9 query '''select id as k, id as v from range(12)''';")
    assert got(e.query("select a;")) == [(i,) for i in range(2, 9)]


def test_partial_sources_alone_are_an_error(spark):
    e = Engine(spark)
    e.run("key ch string; key s int; partial datasource web (c: ch, s: s) grain (s, ch) complete where ch = 'W' query '''select 'W' as c, id as s from range(2)''';")
    with pytest.raises(LanguageError, match="partial"):
        e.query("select s;")
    assert got(e.query("where ch = 'W' select s;")) == [(0,), (1,)]
    assert got(e.query("where ch in ('W') and s > 0 select s;")) == [(1,)]


JOINED = """
key ca int; property ca.va int; key cb int; property cb.vb string;
datasource ta (a: ca, v: va) grain (ca) query '''select * from values (1, 10), (2, 20), (4, 40) as t(a, v)''';
datasource tb (b: cb, v: vb) grain (cb) query '''select * from values (2, 'x'), (3, 'y') as t(b, v)''';
"""


def test_joins_by_expression(spark):
    e = Engine(spark)
    e.run(JOINED)
    assert got(e.query("subset join ca + 1 = cb select vb, va;")) == [("x", 10), ("y", 20), (None, 40)] or got(e.query("subset join ca + 1 = cb select vb, va;")) == [("x", 10), ("y", 20)]
    assert got(e.query("union join ca + 0 = cb + 0 select va, vb;")) == [(10, None), (20, "x"), (40, None), (None, "y")]


THREE = """
key l int; property l.lc int; key m int; property m.mc int; key c int; property c.cn string; key d int; property d.dn string;
datasource ls (i: l, c: lc) grain (l) query '''select * from values (1, 1), (2, 1), (3, 7), (4, null) as t(i, c)''';
datasource ms (i: m, c: ~c) grain (m) query '''select * from values (10, 2), (11, 2) as t(i, c)''';
datasource cs (c: c, n: cn) grain (c) query '''select * from values (1, 'a'), (2, 'b'), (5, 'e') as t(c, n)''';
datasource ds (d: d, n: dn) grain (d) query '''select * from values (5, 'five'), (9, 'nine') as t(d, n)''';
"""


def test_union_joins_have_the_values_of_every_side(spark):
    """A key of one side without rows in any fact that is counted was lost."""
    e = Engine(spark)
    e.run(THREE)
    assert got(e.query("union join lc = c select c as k, count(l) as a, count(m) as b;")) == sorted([(1, 2, 0), (2, 0, 2), (5, 0, 0), (7, 1, 0), (None, 1, 0)], key=repr)
    assert got(e.query("union join lc = c select c as k, count(m) as b;")) == sorted([(1, 0), (2, 2), (5, 0), (7, 0), (None, 0)], key=repr)
    assert got(e.query("union join lc = c select c as k, cn;")) == sorted([(1, "a"), (2, "b"), (5, "e"), (7, None), (None, None)], key=repr)
    assert got(e.query("union join lc = c select count(c) as n;")) == [(4,)]
    assert got(e.query("union join lc = c where c in (c ? c > 1) select c as k, count(l) as a;")) == [(2, 0), (5, 0), (7, 1)]


def test_chains_of_union_joins_have_the_values_of_every_side(spark):
    e = Engine(spark)
    e.run(THREE)
    want = sorted([(1, 2, 0, None), (2, 0, 2, None), (5, 0, 0, "five"), (7, 1, 0, None), (9, 0, 0, "nine"), (None, 1, 0, None)], key=repr)
    assert got(e.query("union join lc = c = d select c as k, count(l) as a, count(m) as b, any(dn) as s;")) == want
    assert got(e.query("union join lc = c union join c = d select c as k, count(l) as a, count(m) as b, any(dn) as s;")) == want
    assert got(e.query("union join lc = c = d select d as k, count(m) as b;")) == [(k, b) for k, _, b, _ in want]


def test_united_keys_of_several_columns(spark):
    # keys that the same sources bind come in the combinations that these have
    e = Engine(spark)
    e.run("key ax int; key ay int; key a.row rowid; property a.row.av int; key bx int; key by_ int; key b.row rowid; property b.row.bv int; datasource ta (x: ax, y: ay, v: a.av) grain (a.row) query '''select * from values (1, 1, 10), (1, 1, 11), (1, 2, 12) as t(x, y, v)'''; datasource tb (x: bx, y: by_, v: b.bv) grain (b.row) query '''select * from values (1, 1, 5), (2, 2, 6) as t(x, y, v)''';")
    assert got(e.query("union join ax = bx union join ay = by_ select bx as x, by_ as y;")) == [(1, 1), (1, 2), (2, 2)]


def test_presence(spark):
    e = Engine(spark)
    e.run("key cust int; property cust.cname string; key ord int; property ord.oc int; property ord.amt int; datasource cs (i: cust, n: cname) grain (cust) query '''select * from values (1, 'A'), (2, 'B'), (3, 'C') as t(i, n)'''; datasource os (o: ord, c: oc, a: amt) grain (ord) query '''select * from values (100, 1, 10), (101, 1, 15), (102, 2, 20) as t(o, c, a)''';")
    assert got(e.query("select cname subset join oc = cust;")) == [("A",), ("B",), ("C",)]
    assert got(e.query("where oc is not null select cname subset join oc = cust;")) == [("A",), ("B",)]
    assert got(e.query("where oc is null select cname subset join oc = cust;")) == [("C",)]
    assert got(e.query("subset join oc = cust select cname, oc is null as none;")) == [("A", False), ("B", False), ("C", True)]


def test_outputs_outside_a_rollup(spark):
    e = Engine(spark)
    e.run("key g int; property g.n string; key r int; property r.v int; datasource gs (g: g, n: ?n) grain (g) query '''select * from values (1, 'one'), (2, null) as t(g, n)'''; datasource rs (r: r, g: ?g, v: v) grain (r) query '''select * from values (1, 1, 1), (2, 2, 2), (3, null, 4) as t(r, g, v)''';")
    assert got(e.query("select g, n, sum(v) as s by rollup (g);")) == sorted([(1, "one", 1), (2, None, 2), (None, None, 4), (None, None, 7)], key=repr)
    assert got(e.query("select g, sum(v) as s, sum(v) by g as own by rollup (g);")) == sorted([(1, 1, 1), (2, 2, 2), (None, 4, 4), (None, 7, None)], key=repr)


def test_a_group_of_one_row_is_no_group(engine):
    df = engine.query("select post.id, sum(post.score) as s, count(post.tag) as t, count(post.id ? post.score > 1) as big, avg(post.score) as m, stddev(post.score) as d, array_agg(post.tag) as a, max(post.tag) as hi;")
    assert got(df) == [(10, 1, 1, 0, 1.0, None, ["x"], "x"), (11, 2, 0, 1, 2.0, None, [None], None), (12, 4, 1, 1, 4.0, None, ["y"], "y"), (13, 8, 0, 1, 8.0, None, [None], None)]
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [f.dataType.simpleString() for f in df.schema][:3] == ["bigint", "bigint", "bigint"]


def test_rowsets_are_islands(engine):
    """A rowset's base concepts are no path from it to anything."""
    engine.run("with few as where post.score < 5 select post.id as pid, user.id as uid;")
    assert got(engine.query("select few.pid;")) == [(10,), (11,), (12,)]
    with pytest.raises(LanguageError, match="connects"):
        engine.query("select few.pid, user.name;")
    assert got(engine.query("subset join few.uid = user.id select few.pid, user.name;")) == [(10, "a"), (11, "a"), (12, "b"), (None, "b")]


def test_keys_that_others_determine_are_not_compared(spark):
    e = Engine(spark)
    e.run("key a int; key b int; key c int; property c.v int; datasource ab (a: a, b: b) grain (a) query '''select id as a, id % 2 as b from range(4)'''; datasource cs (c: c, a: a, b: b, v: v) grain (c) query '''select id as c, id % 4 as a, id % 2 as b, id as v from range(8)'''; property a.n string; datasource names (a: a, b: b, n: n) grain (a) query '''select id as a, id % 2 as b, cast(id as string) as n from range(4)''';")
    df = e.query("select c, n;")
    assert df.count() == 8 and "b#" not in df._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("\n")[0]


def test_partitions_of_folders_are_pruned(spark, tmp_path):
    spark.range(20).selectExpr("id as k", "id % 4 as part").write.partitionBy("part").parquet(str(tmp_path / "t.parquet"))
    e = Engine(spark)
    e.run(f"key k int; property k.part int; datasource t (k: k, part: part) grain (k) partition by part file `{tmp_path}/t.parquet`;")
    df = e.query("where part = 2 select k;")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r[0] for r in df.collect()) == [2, 6, 10, 14, 18] and "(part#" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_filtered_concepts_as_outputs(engine):
    engine.run("auto good <- filter post.id where post.score > 1; auto liked <- post.id ? count(vote.id) by post.id > 1;")
    assert got(engine.query("select good;")) == [(11,), (12,), (13,)]
    assert got(engine.query("select post.id, (post.tag ? post.score > 1) as t;")) == [(11, None), (12, "y"), (13, None)]
    assert got(engine.query("select post.score as s, (post.tag ? post.score > 1) as t;")) == [(1, None), (2, None), (4, "y"), (8, None)]
    assert got(engine.query("select liked;")) == [(10,)]
    assert got(engine.query("where post.id not in good select post.id;")) == [(10,)]
    assert got(engine.query("select user.id as u, count(filter post.id where post.score > 1) as n;")) == [(1, 1), (2, 1), (3, 0), (None, 1)]


def test_keys_of_pinned_aggregates_add_no_rows(engine):
    """A user without posts came out as a row without a post."""
    assert got(engine.query("select post.id, group(user.name) by user.id as n;")) == [(10, "a"), (11, "a"), (12, "b"), (13, None)]
    assert got(engine.query("select post.id, count(vote.id) as v, count(post.id) by user.id as n;")) == [(10, 2, 2), (11, 1, 2), (12, 1, 1), (13, 0, 1)]
    assert got(engine.query("select post.id, max(post.score) by user.name as n;")) == [(10, 2), (11, 2), (12, 4), (13, 8)]
    assert got(engine.query("select user.id, count(post.id) by user.id as n;")) == [(1, 2), (2, 1), (3, 0), (None, 1)]


def test_rollup_over_all_outputs(engine):
    assert got(engine.query("select user.name as n, post.tag as t, sum(post.score) as s, by rollup ();")) == got(engine.query("select user.name as n, post.tag as t, sum(post.score) as s by rollup (user.name, post.tag);"))


def test_rowsets_beside_the_keys_they_were_made_with(engine):
    engine.run("rowset even <- select post.id, post.score where post.score % 2 = 0; with named as select post.id, post.tag as label;")
    assert got(engine.query("select post.id, even.post.score;")) == [(10, None), (11, 2), (12, 4), (13, 8)]
    assert got(engine.query("select post.id, even.post.score, named.label where post.score > 1;")) == [(11, 2, None), (12, 4, "y"), (13, 8, None)]
    with pytest.raises(LanguageError, match="connects"):  # two rowsets meet in nothing that isn't asked for
        engine.query("select even.post.score, named.label;")


BILLS = """
key bill int; key payer int; property payer.pn string; property bill.sum_ float;
datasource bills (b: bill, p: ~?payer, s: sum_) grain (bill) query '''select * from values (1, 1, 5.0), (2, 1, 5.0), (3, 2, 5.0), (4, 2, 7.0), (5, null, 5.0) as t(b, p, s)''';
datasource payers (p: payer, n: pn) grain (payer) query '''select * from values (1, 'a'), (2, 'a'), (3, 'c') as t(p, n)''';
"""


def test_measures_of_rowsets_count_once_a_row(spark):
    """Equal totals of one customer were summed once."""
    e = Engine(spark)
    e.run(BILLS + "with r as select bill as b, payer as p, sum_ as s, sum_ * 2 as d;")
    assert got(e.query("select r.p as p, count(r.b) as n, sum(r.s) as s, sum(r.d) as d, avg(r.s) as m;")) == sorted([(1, 2, 10.0, 20.0, 5.0), (2, 2, 12.0, 24.0, 6.0), (3, 0, None, None, None), (None, 1, 5.0, 10.0, 5.0)], key=repr)
    assert got(e.query("select r.p as p;")) == [(1,), (2,), (3,), (None,)]
    assert got(e.query("select count(r.p) as n;")) == [(3,)]
    assert got(e.query("select r.s as s;")) == [(5.0,), (7.0,), (None,)]
    assert got(e.query("select r.b as b, r.s as s;")) == sorted([(1, 5.0), (2, 5.0), (3, 5.0), (4, 7.0), (5, 5.0), (None, None)], key=repr)


def test_sums_over_rowsets_by_a_key_or_a_property(spark):
    e = Engine(spark)
    e.run(BILLS + "with dear as where sum_ < 6 select bill as b, payer as p, sum_ as s, pn as n; with top as select bill as b, sum_ as s order by sum_ desc, bill limit 3;")
    assert got(e.query("select dear.p as p, sum(dear.s) as s;")) == sorted([(1, 10.0), (2, 5.0), (None, 5.0)], key=repr)
    assert got(e.query("select dear.n as n, sum(dear.s) as s;")) == sorted([("a", 15.0), (None, 5.0)], key=repr)
    assert got(e.query("select sum(dear.s) as s, count(dear.b) as n;")) == [(20.0, 4)]
    assert got(e.query("select sum(top.s) as s;")) == [(17.0,)]


def test_keys_from_lists(spark):
    e = Engine(spark)
    e.run("const prime <- unnest([2, 3, 5, 7, 11, 13]); def cubed(x) -> x * x * x + 1; auto place <- row_number prime; const truth <- unnest([true, null, false]);")
    assert sorted(map(tuple, e.query("where cube % 7 = 0 select prime, @cubed(prime) as cube, cube * 2 as twice;").collect())) == [(3, 28, 56), (5, 126, 252), (13, 2198, 4396)]
    assert got(e.query("select place where place = 1;")) == [(1,)]
    assert got(e.query("select truth where not truth;")) == [(False,)]


def test_merges_of_derived_keys(spark):
    e = Engine(spark)
    e.run("key p int; property p.n string; property p.last <- split(n, ',')[1]; key full string; property full.worth float; property full.r_last <- split(full, ' ')[2]; datasource ps (p: p, n: n) grain (p) query '''select * from values (1, 'Smith, John'), (2, 'Jones, Mary'), (3, 'Brown, Sam') as t(p, n)'''; datasource rich (f: full, w: worth) grain (full) query '''select * from values ('Andrew Smith', 100.0D), ('Betty Jones', 200.0D) as t(f, w)'''; merge r_last into ~last;")
    assert got(e.query("where full is not null and n is not null select n, full;")) == [("Jones, Mary", "Betty Jones"), ("Smith, John", "Andrew Smith")]


def test_stacked_keys_with_properties(spark):
    e = Engine(spark)
    e.run("key a int; property a.an string; key b int; property b.bn string; auto every <- union(a, b); auto name <- union(an, bn); datasource xa (x: a, y: an) grain (a) query '''select * from values (2, 'test'), (1, 'fun') as t(x, y)'''; datasource xb (x: b, y: bn) grain (b) query '''select * from values (4, 'bravo'), (5, 'alpha') as t(x, y)''';")
    assert got(e.query("select every, name;")) == [(1, "fun"), (2, "test"), (4, "bravo"), (5, "alpha")]


def test_aggregates_grouped_to_keys(engine):
    engine.run("metric total <- sum(post.score); auto by_user <- group total by user.id;")
    assert got(engine.query("select user.id as u, by_user as t;")) == [(1, 3), (2, 4), (3, None), (None, 8)]
    assert got(engine.query("where post.score = max(post.score) by * and user.id is null select post.id, max(post.score) by * as m;")) == [(13, 8)]


GROUPS = """key r int; property r.thing int; property r.way string; property r.kind string; property r.sort string; property r.size int;
datasource rows_ (r: r, t: thing, w: way, k: ?kind, s: ?sort, z: size) grain (r) query '''select * from values (1, 100, 'S', 'A', 'x', 10), (2, 100, 'W', 'A', 'y', 20), (3, 200, 'W', 'B', 'x', 5), (4, 300, 'S', null, null, 3) as t(r, t, w, k, s, z)''';"""


@pytest.fixture()
def grouped(spark):
    e = Engine(spark)
    e.run(GROUPS)
    return e


@pytest.mark.parametrize("cond, want", [
    ("count(r ? way = 'S') > 0", [(100,), (300,)]),
    ("count(r ? way = 'S') by thing > 0", [(100,), (300,)]),
    ("count(r ? way = 'S') by * > 0", [(100,), (200,), (300,)]),
    ("way = 'S'", [(100,), (300,)]),
    ("some_bare", [(100,), (300,)]),
    ("some_global", [(100,), (200,), (300,)]),
])
def test_aggregates_in_conditions_take_the_selects_grain(grouped, cond, want):
    grouped.run("auto some_bare <- count(r ? way = 'S') > 0; auto some_global <- count(r ? way = 'S') by * > 0;")
    assert got(grouped.query(f"where {cond} select thing;")) == want


def test_aggregates_in_conditions_without_a_grain(grouped):
    assert got(grouped.query("where count(r) > 0 select thing, way;")) == [(100, "S"), (100, "W"), (200, "W"), (300, "S")]
    assert got(grouped.query("where count(r ? way = 'S') > 0 select count(r) as c;")) == [(4,)]


def test_filtered_aggregates_at_their_own_key(spark):
    e = Engine(spark)
    e.run("key o int; key i int; property <o, i>.flag bool; datasource ls (o: o, i: i, f: flag) grain (o, i) query '''select * from values (1, 1, false), (1, 2, true), (2, 1, false), (3, 1, true), (3, 2, true) as t(o, i, f)''';")
    assert got(e.query("select o, count(o ? flag) by o as v;")) == [(1, 1), (2, 0), (3, 1)]
    assert got(e.query("select o, sum(o ? flag) by o as v;")) == [(1, 1), (2, None), (3, 3)]
    assert got(e.query("select o, max(o ? flag) by o as v;")) == [(1, 1), (2, None), (3, 3)]
    assert got(e.query("select count(o ? flag) as v;")) == [(2,)]


def test_windows_over_groupings(grouped):
    grouped.run("auto total <- sum(size); auto lvl <- grouping(kind) + grouping(sort); auto parent <- case when grouping(sort) = 0 then kind else null end; auto rank_a <- rank(kind, sort) over (partition by lvl, parent order by total desc); auto rank_b <- rank(kind) over (partition by lvl order by total desc);")
    rows = [tuple(r) for r in grouped.query("select kind, sort, total, lvl, rank_a, rank_b by rollup (kind, sort) order by lvl asc, kind asc, sort asc;").collect()]
    assert rows == [("A", "x", 10, 0, 2, 2), ("A", "y", 20, 0, 1, 1), ("B", "x", 5, 0, 1, 3), (None, None, 3, 0, 1, 4), ("A", None, 30, 1, 1, 1), ("B", None, 5, 1, 2, 2), (None, None, 3, 1, 3, 3), (None, None, 38, 2, 1, 1)]


def test_filtered_measures_count_once(engine):
    """A post's score counts once, however many of its votes pass."""
    assert got(engine.query("select sum(post.score ? vote.weight = 1) as s, sum(post.score) as every;")) == [(3, 15)]
    assert got(engine.query("select user.name as n, sum(post.score ? vote.weight = 1) as s;")) == [("a", 3), ("b", None), (None, None)]
