"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import textwrap

import duckdb
import pandas
import pytest

from millrace.llm import bpe, chat_format, decontamination, html_extract, licence_scan, line_dedup, lm_score, quality, simhash_dedup, token_files
from millrace.llm.common import components, scratch, stored, sweep

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp long, component_id long, kept boolean, n_lines long, kept_text string, n_tokens long, bucket long, h string"
LONG = " ".join(f"w{i}" for i in range(30_000))
TEXTS = [(1, None), (2, ""), (3, "  \n\t"), (4, "same text here for all of us to read again and again today"), (5, "same text here for all of us to read again and again today"), (5, "same text here for all of us to read again and again today"), (None, "no id but words"), (6, LONG), (7, "é ß 日本 <|endoftext|> \\ <| x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i == 4 else "en", "s", 0, 0, 0, 0, False, 0, "k", 0, 0, "h") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "for all of us to read again and again"), (2, None), (3, ""), (4, "two words")], "item_id long, text string")


def test_simhash(docs, none):
    rows = simhash_dedup.near_groups(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == len(TEXTS) and len(by[5]) == 2
    assert {by[k][0].fp for k in (1, 2, 3)} == {0} and {by[k][0].component_id for k in (1, 2, 3)} == {1}
    assert by[5][0].component_id == 4 and by[None][0].component_id is None
    assert simhash_dedup.near_groups(none).count() == 0
    assert sorted((r.doc_id or 0) for r in simhash_dedup.dedup(docs).collect()) == [0, 1, 4, 6, 7]
    assert simhash_dedup.dedup(none).count() == 0


def test_token_files(spark, docs):
    token_files.write(docs, path := scratch(spark, "edge"))
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7]
    at = 0
    for r in rows:
        assert r.start == at and r.ids[-1] == 0
        at += len(r.ids)
    assert rows[1].ids == [0]
    t = bpe.transducer(bpe.default_tokenizer())
    assert token_files.lookup(spark, path, 6) == [*t.encode_text(LONG), 0]
    assert token_files.lookup(spark, path, 99) is None


def test_token_files_of_nothing(spark, none):
    token_files.write(none, path := scratch(spark, "edge-none"))
    assert token_files.read(spark, path).count() == 0


def test_bpe(docs, none):
    rows = bpe.encode_documents(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_documents(none).count() == 0


def test_quality(docs, none):
    m = quality.judge(quality.measure(docs)).collect()
    assert len(m) == len(TEXTS)
    assert all(r.base_failed and not r.kept for r in m if r.doc_id in (1, 2, 3))
    assert quality.filter_documents(docs).columns == docs.columns
    assert quality.filter_documents(none).count() == 0


def test_quality_limits_follow_the_group(spark):
    """A group is judged by its own texts; a small one leans on its language; a quarter of bad texts moves no limit."""
    good, bad = " ".join(["word"] * 3 + [f"w{i}" for i in range(60)]), " ".join(f"w{i} ###" for i in range(60))
    code = " ".join(f"w{i}{'$' if i % 2 else ''}" for i in range(60))
    rows = [("en", "web", good)] * 400 + [("en", "web", bad)] * 180 + [("en", "code", code)] * 600 + [("en", "small", good), ("en", "small", bad)]
    df = spark.createDataFrame([(i, t, a, b) for i, (a, b, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    m = quality.judge(quality.measure(df)).select("source", "n_symbols", "kept").distinct().collect()
    kept = {(r.source, r.n_symbols): r.kept for r in m}
    assert kept == {("web", 0): True, ("web", 180): False, ("code", 30): True, ("small", 0): True, ("small", 180): False}


def test_repeated_words(spark):
    from pyspark.sql import functions as F

    texts = ["a b c d e f g h " * 2, " ".join("abcdefghij") + " x " + " ".join("abcdefghij"), "a " * 20, "a b c", ""]

    def brute(t):
        w = t.split()
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        return len({p for i, x in enumerate(win) if win.count(x) > 1 for p in range(i, i + 8)})

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", quality.repeated_words(quality.words(F.col("text"))).alias("n")).collect()
    assert {r.text: r.n for r in got} == {t: brute(t) for t in texts}


def test_lm_score(docs, none):
    rows = lm_score.score(docs).collect()
    assert len(rows) == len(TEXTS) and all(r.score < 0 and r.n_tokens >= 1 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert lm_score.score(none).count() == 0


def test_line_dedup(spark, none):
    line = "this line is long enough to count"
    df = spark.createDataFrame([(1, f"a\n {line.upper()} \nb"), (2, f"{line}\n{line}"), (3, line), (3, line), (4, None), (None, line), (5, "short\nshort"), (6, "short"), (7, "short")], "doc_id long, text string")
    rows = {(r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.strip_lines(df).collect()}
    assert rows == {(1, "a\nb", 3, 1), (2, "", 2, 2), (3, line, 1, 0), (4, "", 1, 0), (None, "", 1, 1), (5, "short\nshort", 2, 0), (6, "short", 1, 0), (7, "short", 1, 0)}
    assert line_dedup.clean_documents(none).count() == 0
    assert line_dedup.clean_documents(none).columns == none.columns


def test_line_dedup_keeps_other_columns(spark):
    line = "this line is long enough to count"
    df = spark.createDataFrame([(i, f"{line}\nown {i}", 1, 2, 3, "k") for i in range(4)], "doc_id long, text string, __lost int, lost int, h1 int, kept_text string")
    assert {tuple(r) for r in line_dedup.clean_documents(df).collect()} == {(i, f"own {i}" if i < 3 else f"{line}\nown 3", 1, 2, 3, "k") for i in range(4)}
    assert {(r.doc_id, r["__lost"], r.kept_text) for r in line_dedup.strip_lines(df).collect()} == {(i, 1, f"own {i}" if i < 3 else f"{line}\nown 3") for i in range(4)}


@pytest.mark.parametrize("most", [200_000, 2])
def test_line_dedup_of_hot_and_long_documents(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", most)
    shared = [f"a line that several documents share, number {i}" for i in range(3000)]
    df = spark.createDataFrame([(i, "\n".join([*shared, f"and one of its own, {i}"])) for i in range(4)], "doc_id long, text string")
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.strip_lines(df).collect()} == {(i, 3001, 3000 if i < 3 else 0) for i in range(4)}


def lines_in_batches(spark, n=40):
    return spark.createDataFrame([(i, f"one shared line of text\nand one of its own {i:09d}") for i in range(n)], "doc_id long, text string")


def test_line_runs_are_levelled(spark):
    index, _, _ = line_dedup.index_lines(lines_in_batches(spark), batches=9)
    assert len(index.keys) < 9 and max(level for level, _ in index.keys) == 2 and len(index.more) < 8
    assert index.totals().count() == 41 and index.totals().agg({"n_docs": "max"}).first()[0] == 40
    stands = [spark.table(t).count() for _, t in index.keys]
    assert sum(stands) == 41 and sum(spark.table(t).count() for _, t in index.more) < 9  # increments of the one shared key
    index.close()


def test_the_anti_join_decides(spark, monkeypatch):
    """Without it the shared key stands in several key runs, and the totals are wrong."""
    kind = type(spark.range(1))
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, how=None: self if how == "left_anti" else join(self, other, on, how))
    index, _, _ = line_dedup.index_lines(lines_in_batches(spark), batches=2)
    assert index.totals().count() != 41 or index.totals().agg({"n_docs": "max"}).first()[0] != 40


def test_runs_are_joined_where_they_lie(spark):
    index, lines, _ = line_dedup.index_lines(lines_in_batches(spark), batches=2)
    a, b = (spark.table(t) for _, t in index.keys)
    plan = a.hint("merge").join(b.select("h1", "h2"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close()


def test_html(spark):
    page = "<html><body><div class='cookie-notice'>We use</div><div class='layout-sidebar'><nav>n</nav><main><h1>T &amp; t</h1><p>a\n  b<br>c<p>d<script>x</p></script><aside>no</aside></main></div><section id=comments><p>me</p></section><footer>f</footer>"
    rows = [(1, "http://a.b/c", page), (2, None, None), (3, "odd", ""), (3, "odd", ""), (4, "http://a.b/d", "plain <b>text</b> only"), (5, "http://a.b/e", "<p>" + "x " * 50_000)]
    df = spark.createDataFrame([(*r, "t", "h") for r in rows], "page_id long, url string, html string, text string, host string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[1] == "T & t\n\na b c\n\nd" and got[2] == "" and got[4] == "plain text only" and len(got[5]) == 99_999
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1 << 24, -1])
def test_html_wrapper(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", most)
    page = "<body><div class=x1><b>My Site</b></div><div><h2>Title {0}</h2><p>Body {0}</p></div><div>All rights reserved by us</div>"
    df = spark.createDataFrame([(i, f"https://w.org/{i}", page.format(i)) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(df).collect()} == {f"Title {i}\n\nBody {i}" for i in range(9)}


def test_chat(spark):
    hard = "a <|im_end|>\n<|im_start|>x \\<| \\\\ \\| <|im_next|>"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, "assistant", None), (1, 2, "assistant", ""), (2, 0, "a\nb\\n", "x"), (None, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chat(df)
    from pyspark.sql import functions as F

    got = {r.conv_id: r for r in chats.select("*", chat_format.parse_chat(F.col("formatted")).alias("turns")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", hard), ("assistant", hard), ("assistant", ""), ("assistant", "")]
    assert [tuple(t) for t in got[2].turns] == [("a\nb\\n", "x")] and [tuple(t) for t in got[None].turns] == [("", "")]
    r = got[1]
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == [hard.replace("\\", "\\\\").replace("<|", "<\\|"), "", ""]
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_a_long_chat(spark):
    from pyspark.sql import functions as F

    rows = [(7, i, ("user", "assistant", "assistant")[i % 3], f"turn {i}, ü") for i in range(20_000)]
    chat = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("*", chat_format.parse_chat(F.col("formatted")).alias("turns")).first()
    assert [tuple(t) for t in chat.turns] == [r[2:] for r in rows]
    assert [chat.formatted[s.start : s.start + s.length] for s in chat.loss_spans] == [r[3] for r in rows if r[2] == "assistant"]
    assert chat.formatted.count(chat_format.START) == sum(i % 3 != 2 for i in range(20_000))


def test_licences(docs, none, spark):
    mit, gpl3 = licence_scan.TEMPLATES["MIT"][-1], licence_scan.TEMPLATES["GPL-3.0"][-1]
    wrapped = "\n".join(" * " + line for line in textwrap.wrap(mit, 60))
    bsd3, bsd2 = licence_scan.TEMPLATES["BSD-3-Clause"][-1], licence_scan.TEMPLATES["BSD-2-Clause"][-1]
    rows = [
        (1, "x\nReleased under the MIT License.\ny"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, "the MIT of it"),
        (4, None),
        (5, f"/*\n * Some program, 2020\n{wrapped}\n */\n int main() {{ return 0; }}"),
        (6, " ".join(w for i, w in enumerate(mit.split()) if i % 25)),  # a few words lost
        (7, f"before {gpl3} after"),
        (8, "This work is licensed under the GNU General Public License, version 3."),
        (9, bsd3),
        (10, bsd2),
        (11, "Licensed under CC BY-NC 4.0."),
        (12, "Released under the MIT License. And again: Released under the MIT License."),
        (12, "Released under the MIT License. And again: Released under the MIT License."),
        (13, "a software license " * 500),
        (None, "Released under the MIT License."),
    ]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, t int, licence string")
    got = [(r.doc_id, r.licence) for r in licence_scan.scan(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, "MIT"), (2, "Apache-2.0"), (5, "MIT"), (6, "MIT"), (7, "GPL-3.0"), (8, "GPL-3.0"), (9, "BSD-3-Clause"), (10, "BSD-2-Clause"), (11, "CC-BY-NC-4.0"), (12, "MIT"), (None, "MIT")], key=repr)
    assert {(r.at_word, r.n_words, r.dice) for r in licence_scan.scan(df).where("doc_id = 12").collect()} == {(0, 5, 1.0)}
    assert licence_scan.scan(docs).count() == 0 and licence_scan.scan(none).count() == 0
    duck = duckdb.connect()
    documents = pandas.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    want = duck.sql(licence_scan.ORACLE).fetchall()
    mine = licence_scan.scan(df).selectExpr("doc_id", "licence", "at_word", "n_words", "cast(round(1000 * dice) as long) as d").collect()
    assert sorted(map(tuple, mine), key=repr) == sorted(want, key=repr)


def test_decontamination(docs, none, items):
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, items).collect()}
    assert got == {(4, 1), (5, 1)}
    assert decontamination.matches(none, items).count() == 0 and decontamination.matches(docs, items.limit(0)).count() == 0
    assert {r.doc_id for r in decontamination.filter_documents(docs, items).collect()} == {1, 2, 3, 6, 7, None}


def test_decontamination_of_rows_without_ids_and_of_shared_ids(spark):
    leak = "for all of us to read again and again"
    df = spark.createDataFrame([(None, f"so {leak} it goes", 1), (None, "clean words without an id", 1), (5, f"x {leak}", 1), (5, "another text of the same document", 1)], "doc_id long, text string, tid int")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(df, bench).collect()} == {(None, 1), (5, 1)}
    assert {(r.doc_id, r.text) for r in decontamination.filter_documents(df, bench).collect()} == {(None, "clean words without an id"), (5, "another text of the same document")}


def test_decontamination_of_a_long_item(spark):
    """More shingles than a 16-bit lane could count."""
    long = " ".join(f"w{i}" for i in range(70_000))
    df = spark.createDataFrame([(1, long), (2, "w1 w2 w3 w4 w5 w6")], "doc_id long, text string")
    got = decontamination.matches(df, spark.createDataFrame([(1, long)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.similarity) for r in got] == [(1, 1.0)]


def test_components(spark):
    import random

    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(n, find(n)) for n in root if any(n in e and e[0] != e[1] for e in edges)}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_old_files_are_swept(spark):
    held = stored(spark.range(3), "sweep")
    sweep(spark, hours=1)
    assert held.count() == 3
    assert sweep(spark, hours=-1) >= 1 and sweep(spark, hours=-1) == 0
