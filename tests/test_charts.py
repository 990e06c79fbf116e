"""Charts: every type is drawn, with a mark for each row; too many rows, roles that lack and odd scales are errors."""

import xml.etree.ElementTree as ET

import pytest

from millrace import charts
from millrace.engine import Engine
from millrace.lang.parser import LanguageError
from millrace.lang.render import formatted

MODEL = "key k int; property k.g string; property k.v float; datasource t (k: k, g: g, v: v) grain (k) query '''select id as k, concat('g', id % 4) as g, id * 1.5 + 1 as v from range(40)''';"


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    e.run(MODEL)
    return e


def marks(engine, path, text, kind="svg"):
    engine.run(f"copy into {kind} '{path}' from chart {text};")
    return ET.fromstring(path.read_text()) if kind == "svg" else path.read_text()


def tags(root, name):
    return [x for x in root.iter() if x.tag.endswith("}" + name)]


@pytest.mark.parametrize("text, tag, n", [
    ("layer bar (x_axis <- g, y_axis <- sum(v) as total)", "rect", 5),
    ("layer barh (y_axis <- g, x_axis <- count(k) as n) order by n desc limit 3", "rect", 4),
    ("layer point (x_axis <- k, y_axis <- v, size <- v) set hide_legend", "circle", 40),
    ("layer line (x_axis <- k, y_axis <- v, color <- g) set scale_y: log", "path", 4),
    ("layer area (x_axis <- k, y_axis <- v) set scale_x: sqrt", "path", 1),
    ("layer donut (color <- g, size <- sum(v) as s)", "path", 4),
    ("layer treemap (color <- g, size <- sum(v) as s)", "rect", 5),
    ("layer heatmap (x_axis <- g, y_axis <- k % 2 as odd, color <- count(k) as n)", "rect", 5),
    ("layer boxplot (x_axis <- g, y_axis <- v, color <- g)", "rect", 9),
    ("layer headline (x_axis <- sum(v) as total)", "text", 2),
    ("layer line (x_axis <- k, y_axis <- v) layer point (x_axis <- k, y_axis <- v) from (where k < 5 select k, v) place hline at 10 as limit_ set show_title", "circle", 5),
])
def test_every_row_has_a_mark(engine, tmp_path, text, tag, n):
    root = marks(engine, tmp_path / "c.svg", text)
    assert len(tags(root, tag)) >= n
    assert formatted(f"chart {text};") == formatted(formatted(f"chart {text};"))


def test_html_and_rows(engine, tmp_path):
    assert "<svg" in marks(engine, tmp_path / "c.html", "layer bar (x_axis <- g, y_axis <- sum(v) as total)", "html")
    assert sorted(map(tuple, engine.query("chart layer bar (x_axis <- g, y_axis <- count(k) as n);").collect())) == [(f"g{i}", 10) for i in range(4)]


def test_errors(engine, tmp_path, monkeypatch):
    for text, what in (("layer bar (x_axis <- g)", "needs y_axis"), ("layer point (x_axis <- k, y_axis <- v - 5 as w) set scale_y: log", "above zero")):
        with pytest.raises(LanguageError, match=what):
            marks(engine, tmp_path / "c.svg", text)
    with pytest.raises(LanguageError, match="svg or html"):
        engine.run(f"copy into png '{tmp_path}/c.png' from chart layer bar (x_axis <- g, y_axis <- sum(v) as t);")
    monkeypatch.setattr(charts, "MOST", 20)
    with pytest.raises(LanguageError, match="aggregate"):
        marks(engine, tmp_path / "c.svg", "layer point (x_axis <- k, y_axis <- v)")
