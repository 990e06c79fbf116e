"""Charts as SVG: layers of marks over common axes, from the rows of selects.

A chart is drawn by the driver, so its rows have to be few: more than MOST is an error that asks for an aggregate, nothing
is left out. Types: line, area, point, bar, barh, headline, donut, heatmap, boxplot, treemap.
"""

from __future__ import annotations

import datetime
import math
from html import escape
from statistics import quantiles

from .lang.parser import LanguageError

MOST = 5000
WIDTH, HEIGHT, LEFT, RIGHT, TOP, BOTTOM = 720, 420, 70, 130, 40, 60
COLOURS = ["#3366aa", "#dd7722", "#339966", "#bb4455", "#7755aa", "#886644", "#cc77aa", "#777777", "#99aa33", "#33aabb"]


def number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal"


def text(v) -> str:
    if v is None:
        return "none"
    return f"{float(v):,.6g}" if number(v) else str(v)


class Axis:
    """Values to places: numbers by a scale, anything else one after another in the order of their first row (dates in theirs)."""

    def __init__(self, values: list, low: float, high: float, scale: str = "linear", zero: bool = False, bands: bool = False):
        self.low, self.high, self.scale = low, high, scale
        known = [v for v in values if v is not None]
        self.numeric = bool(known) and all(map(number, known)) and not bands
        if self.numeric:
            xs = [float(v) for v in known]
            if scale == "log" and min(xs) <= 0:
                raise LanguageError("a log scale needs values above zero")
            self.least, self.most = min([*xs, *([0.0] if zero and scale != "log" else [])]), max([*xs, *([0.0] if zero and scale != "log" else [])])
            if self.least == self.most:
                self.least, self.most = (self.least - 1, self.most + 1) if scale != "log" else (self.least / 2, self.most * 2)
        else:
            self.order = list(dict.fromkeys(values))
            if known and all(isinstance(v, (datetime.date, datetime.datetime)) for v in known):
                self.order = sorted(dict.fromkeys(known)) + ([None] if None in values else [])

    def _at(self, v: float) -> float:
        return math.log10(v) if self.scale == "log" else math.copysign(math.sqrt(abs(v)), v) if self.scale == "sqrt" else v

    @property
    def band(self) -> float:
        return abs(self.high - self.low) / max(1, len(self.order))

    def place(self, v) -> float:
        if self.numeric:
            a, b = self._at(self.least), self._at(self.most)
            return self.low + (self.high - self.low) * (self._at(float(v)) - a) / (b - a)
        return self.low + (self.high - self.low) * (self.order.index(v) + 0.5) / len(self.order)

    def ticks(self) -> list:
        if not self.numeric:
            step = -(-len(self.order) // 16)
            return self.order[::step]
        if self.scale == "log":
            return [10.0**k for k in range(math.ceil(math.log10(self.least)), math.floor(math.log10(self.most)) + 1)] or [self.least, self.most]
        span = self.most - self.least
        step = 10 ** math.floor(math.log10(span / 5))
        step *= next(m for m in (1, 2, 5, 10) if span / (step * m) <= 6)
        return [round(k * step, 12) for k in range(math.ceil(self.least / step), math.floor(self.most / step) + 1)]


def draw(layers: list[dict], places: list[tuple] = (), scales: dict | None = None, legend: bool = True, title: str | None = None) -> str:
    """The SVG of layers: each with type, roles (role -> column) and rows (dicts)."""
    scales, out = scales or {}, []
    for x in layers:
        if len(x["rows"]) > MOST:
            raise LanguageError(f"a chart of over {MOST} rows: aggregate them first")
    kinds = {x["type"] for x in layers}
    if kinds & {"headline", "donut", "treemap"}:
        if len(layers) > 1:
            raise LanguageError("headline, donut and treemap stand alone")
        body, names = {"headline": headline, "donut": donut, "treemap": treemap}[layers[0]["type"]](layers[0])
        return svg([*body, *legend_of(names if legend else [])], title)
    values = lambda role: [r[x["roles"][role]] for x in layers for r in x["rows"] if role in x["roles"]]
    for x in layers:
        if missing := [r for r in ("x_axis", "y_axis") if r not in x["roles"]]:
            raise LanguageError(f"a {x['type']} layer needs {' and '.join(missing)}")
    across = bool(kinds & {"barh"})
    banded = kinds & {"bar", "barh", "heatmap", "boxplot"}
    xs = [*values("x_axis"), *(v for k, v, _ in places if k == "vline")]
    ys = [*values("y_axis"), *(v for k, v, _ in places if k == "hline")]
    x_axis = Axis(xs, LEFT, WIDTH - RIGHT, scales.get("scale_x", "linear"), zero=across, bands=bool(banded) and not across)
    y_axis = Axis(ys, HEIGHT - BOTTOM, TOP, scales.get("scale_y", "linear"), zero=bool(kinds & {"bar", "area"}), bands=across or "heatmap" in kinds)
    for v in x_axis.ticks():
        out.append(f'<line x1="{x_axis.place(v):.1f}" x2="{x_axis.place(v):.1f}" y1="{TOP}" y2="{HEIGHT - BOTTOM}" stroke="#eee"/><text x="{x_axis.place(v):.1f}" y="{HEIGHT - BOTTOM + 16}" text-anchor="middle">{escape(text(v))}</text>')
    for v in y_axis.ticks():
        out.append(f'<line x1="{LEFT}" x2="{WIDTH - RIGHT}" y1="{y_axis.place(v):.1f}" y2="{y_axis.place(v):.1f}" stroke="#eee"/><text x="{LEFT - 6}" y="{y_axis.place(v) + 4:.1f}" text-anchor="end">{escape(text(v))}</text>')
    first = layers[0]["roles"]
    out.append(f'<text x="{(LEFT + WIDTH - RIGHT) / 2}" y="{HEIGHT - 14}" text-anchor="middle">{escape(first["x_axis"])}</text><text transform="translate(16 {HEIGHT / 2}) rotate(-90)" text-anchor="middle">{escape(first["y_axis"])}</text>')
    names: list = []
    for i, x in enumerate(layers):
        series = series_of(x, f"{x['type']} {i + 1}" if len(layers) > 1 else None)
        for k, (name, rows) in enumerate(series.items()):
            names.append(name)
            out += marks(x, rows, x_axis, y_axis, COLOURS[(len(names) - 1) % len(COLOURS)], k, len(series))
    for kind, v, label in places:
        at = x_axis.place(v) if kind == "vline" else y_axis.place(v)
        where = f'x1="{at:.1f}" x2="{at:.1f}" y1="{TOP}" y2="{HEIGHT - BOTTOM}"' if kind == "vline" else f'y1="{at:.1f}" y2="{at:.1f}" x1="{LEFT}" x2="{WIDTH - RIGHT}"'
        out.append(f'<line {where} stroke="#444" stroke-dasharray="4 3"/>' + (f'<text x="{at + 4 if kind == "vline" else LEFT + 4:.1f}" y="{TOP + 12 if kind == "vline" else at - 4:.1f}">{escape(label)}</text>' if label else ""))
    return svg(out + legend_of(names if legend and names != [None] else []), title)


def series_of(x: dict, name: str | None) -> dict:
    """Rows by the value of the colour role."""
    role = x["roles"].get("color")
    out: dict = {}
    for r in x["rows"]:
        out.setdefault(text(r[role]) if role and x["type"] != "heatmap" else name, []).append(r)
    return out


def marks(x: dict, rows: list[dict], ax: Axis, ay: Axis, colour: str, k: int, of: int) -> list[str]:
    roles, kind = x["roles"], x["type"]
    ok = [r for r in rows if not (ax.numeric and r[roles["x_axis"]] is None or ay.numeric and r[roles["y_axis"]] is None)]
    at = [(ax.place(r[roles["x_axis"]]), ay.place(r[roles["y_axis"]])) for r in ok]
    tip = lambda r: f"<title>{escape(', '.join(f'{c}: {text(v)}' for c, v in r.items()))}</title>"
    if kind in ("line", "area"):
        line = sorted(at)
        path = " ".join(f"{'M' if i == 0 else 'L'}{a:.1f} {b:.1f}" for i, (a, b) in enumerate(line))
        floor = ay.place(max(ay.least, min(0.0, ay.most))) if ay.numeric else ay.low
        if kind == "area" and line:
            return [f'<path d="{path} L{line[-1][0]:.1f} {floor:.1f} L{line[0][0]:.1f} {floor:.1f} Z" fill="{colour}" fill-opacity="0.35" stroke="{colour}"/>']
        return [f'<path d="{path}" fill="none" stroke="{colour}" stroke-width="2"/>']
    if kind == "point":
        sizes = [float(r[roles["size"]] or 0) for r in ok] if "size" in roles else None
        radius = lambda i: 3 + 9 * math.sqrt(max(sizes[i], 0) / (max(sizes) or 1)) if sizes else 4
        return [f'<circle cx="{a:.1f}" cy="{b:.1f}" r="{radius(i):.1f}" fill="{colour}" fill-opacity="0.75">{tip(r)}</circle>' for i, ((a, b), r) in enumerate(zip(at, ok, strict=True))]
    if kind == "bar":
        w, zero = 0.8 * ax.band / of, ay.place(max(ay.least, min(0.0, ay.most)))
        return [f'<rect x="{a - 0.4 * ax.band + k * w:.1f}" y="{min(b, zero):.1f}" width="{w:.1f}" height="{abs(zero - b):.1f}" fill="{colour}">{tip(r)}</rect>' for (a, b), r in zip(at, ok, strict=True)]
    if kind == "barh":
        h, zero = 0.8 * ay.band / of, ax.place(max(ax.least, min(0.0, ax.most)))
        return [f'<rect x="{min(a, zero):.1f}" y="{b - 0.4 * ay.band + k * h:.1f}" width="{abs(a - zero):.1f}" height="{h:.1f}" fill="{colour}">{tip(r)}</rect>' for (a, b), r in zip(at, ok, strict=True)]
    if kind == "heatmap":
        shade = roles.get("color") or roles.get("size")
        if shade is None:
            raise LanguageError("a heatmap layer needs color")
        vs = [float(r[shade]) for r in ok if r[shade] is not None]
        depth = lambda v: 0.08 if v is None or not vs or max(vs) == min(vs) else 0.08 + 0.92 * (float(v) - min(vs)) / (max(vs) - min(vs))
        return [f'<rect x="{a - ax.band / 2:.1f}" y="{b - ay.band / 2:.1f}" width="{ax.band:.1f}" height="{ay.band:.1f}" fill="{COLOURS[0]}" fill-opacity="{depth(r[shade]):.2f}">{tip(r)}</rect>' for (a, b), r in zip(at, ok, strict=True)]
    out, groups = [], {}
    for r in ok:  # boxplot
        groups.setdefault(r[roles["x_axis"]], []).append(float(r[roles["y_axis"]]))
    for g, vs in groups.items():
        q1, q2, q3 = quantiles(vs, n=4, method="inclusive") if len(vs) > 1 else vs * 3
        low, high = min(v for v in vs if v >= q1 - 1.5 * (q3 - q1)), max(v for v in vs if v <= q3 + 1.5 * (q3 - q1))
        c, w, y = ax.place(g), 0.25 * ax.band, ay.place
        out.append(f'<line x1="{c:.1f}" x2="{c:.1f}" y1="{y(low):.1f}" y2="{y(high):.1f}" stroke="{colour}"/><rect x="{c - w:.1f}" y="{y(q3):.1f}" width="{2 * w:.1f}" height="{y(q1) - y(q3):.1f}" fill="#fff" stroke="{colour}"/><line x1="{c - w:.1f}" x2="{c + w:.1f}" y1="{y(q2):.1f}" y2="{y(q2):.1f}" stroke="{colour}" stroke-width="2"/>')
        out += [f'<circle cx="{c:.1f}" cy="{y(v):.1f}" r="2.5" fill="{colour}"/>' for v in vs if not low <= v <= high]
    return out


def headline(x: dict) -> tuple[list[str], list]:
    names = list(x["roles"].values())
    row = x["rows"][0] if x["rows"] else {}
    step = (WIDTH - 40) / max(1, len(names))
    return [f'<text x="{20 + step * (i + 0.5):.1f}" y="{HEIGHT / 2}" text-anchor="middle" font-size="48">{escape(text(row.get(n)))}</text><text x="{20 + step * (i + 0.5):.1f}" y="{HEIGHT / 2 + 30}" text-anchor="middle" font-size="16">{escape(n)}</text>' for i, n in enumerate(names)], []


def shares(x: dict) -> list[tuple[str, float]]:
    label, value = x["roles"].get("color") or x["roles"].get("x_axis"), x["roles"].get("size") or x["roles"].get("y_axis")
    if label is None or value is None:
        raise LanguageError(f"a {x['type']} layer needs a label (color or x_axis) and a value (size or y_axis)")
    return [(text(r[label]), float(r[value] or 0)) for r in x["rows"] if float(r[value] or 0) > 0]


def donut(x: dict) -> tuple[list[str], list]:
    parts, out, at = shares(x), [], -math.pi / 2
    total, cx, cy, r, hole = sum(v for _, v in parts) or 1, (WIDTH - RIGHT) / 2, HEIGHT / 2, 150, 85
    for i, (name, v) in enumerate(parts):
        end = at + 2 * math.pi * min(v / total, 0.99999)
        spot = lambda radius, angle: f"{cx + radius * math.cos(angle):.1f} {cy + radius * math.sin(angle):.1f}"
        wide = int(end - at > math.pi)
        out.append(f'<path d="M{spot(r, at)} A{r} {r} 0 {wide} 1 {spot(r, end)} L{spot(hole, end)} A{hole} {hole} 0 {wide} 0 {spot(hole, at)} Z" fill="{COLOURS[i % len(COLOURS)]}"><title>{escape(name)}: {text(v)}</title></path>')
        at = end
    return out, [n for n, _ in parts]


def treemap(x: dict) -> tuple[list[str], list]:
    """Slices halved by value, along the longer side."""
    out: list[str] = []
    parts = [(i, n, v) for i, (n, v) in enumerate(sorted(shares(x), key=lambda p: -p[1]))]
    todo = [(parts, 20.0, float(TOP), float(WIDTH - 40), float(HEIGHT - TOP - 20))]
    while todo:
        ps, a, b, w, h = todo.pop()
        if len(ps) == 1:
            i, n, v = ps[0]
            out.append(f'<rect x="{a:.1f}" y="{b:.1f}" width="{w:.1f}" height="{h:.1f}" fill="{COLOURS[i % len(COLOURS)]}" stroke="#fff"><title>{escape(n)}: {text(v)}</title></rect>' + (f'<text x="{a + 4:.1f}" y="{b + 14:.1f}" fill="#fff">{escape(n)}</text>' if w > 40 and h > 18 else ""))
        elif ps:
            total, run, cut = sum(v for *_, v in ps), 0.0, 1
            for cut in range(1, len(ps)):
                run += ps[cut - 1][2]
                if run >= total / 2:
                    break
            f = sum(v for *_, v in ps[:cut]) / total
            todo += [(ps[:cut], a, b, w * f, h), (ps[cut:], a + w * f, b, w * (1 - f), h)] if w >= h else [(ps[:cut], a, b, w, h * f), (ps[cut:], a, b + h * f, w, h * (1 - f))]
    return out, []


def legend_of(names: list) -> list[str]:
    return [f'<rect x="{WIDTH - RIGHT + 12}" y="{TOP + 18 * i}" width="10" height="10" fill="{COLOURS[i % len(COLOURS)]}"/><text x="{WIDTH - RIGHT + 27}" y="{TOP + 9 + 18 * i}">{escape(str(n))}</text>' for i, n in enumerate(names[:20]) if n is not None]


def svg(body: list[str], title: str | None) -> str:
    head = f'<text x="{WIDTH / 2}" y="22" text-anchor="middle" font-size="16">{escape(title)}</text>' if title else ""
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif" font-size="11"><rect width="100%" height="100%" fill="#fff"/>{head}{"".join(body)}</svg>\n'
