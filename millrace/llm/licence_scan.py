"""Licence scan: stretches of a document against licence texts and notices, by Dice coefficient of word bigrams.

Text is normalised (A-Z lower-cased, everything but letters and digits a separator, so line ends don't matter) and cut
into word bigrams. The Dice coefficient of a stretch with l bigrams and a template with m is 2 c / (l + m), c being the
bigrams they share, repeats included. It can reach `at_least` only where l lies between at_least / (2 - at_least) and
(2 - at_least) / at_least times m; templates outside these bounds are never compared with a stretch.

1. A stretch that reaches it holds two thirds of the template's bigrams (at 0.8), so at least one of any set of more
   than a third of them. The ones with the longest words are the template's anchors: documents that hold none of them
   are done. Anchors are a table of a few thousand hashes at most, checked before it is broadcast.
2. In the others, a stretch begins and ends at a bigram of the template. For each begin the end within the size bounds
   is taken that has the greatest coefficient if every bigram of the template that is met counts (the nearest of equals).
3. The exact coefficient decides. Where templates of two licences are that much alike themselves (versions of one
   licence), a stretch counts for one only if it has at least half of the words that this one has beyond the other, and
   at most half of the words that the other has beyond this one.

Spark expressions only. Defined cases: a null text, and one with fewer than two words, matches nothing; the best stretch
of a document and licence is returned (the highest coefficient, the first of equals); rows with equal doc_id and text
are one document, rows that share a doc_id only are scanned each; a null doc_id is kept; texts of any length are scanned
whole; further columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bag_common, broadcast_if, let, lower_ascii, pin

#: Licence texts, notices and wordings by which works name their licence, by SPDX identifier.
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.
This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."""
_GNU_SHORT = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."""
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        _GNU_SHORT.format("program", "General Public License", "3"),
        _GNU.format("program", "General Public License", "3"),
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        _GNU_SHORT.format("program", "General Public License", "2"),
        _GNU.format("program", "General Public License", "2"),
    ],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", _GNU.format("library", "Lesser General Public License", "3")],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", _GNU.format("library", "Lesser General Public License", "2.1")],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", _GNU.format("program", "Affero General Public License", "3")],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "\n".join([_BSD_HEAD, _BSD_THIRD, _BSD_TAIL])],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "\n".join([_BSD_HEAD, _BSD_TAIL])],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    ],
}
AT_LEAST = 0.8
#: Documents (16 bytes each) and template bigrams (24 bytes each) that may be broadcast; beyond, both sides are shuffled.
BROADCAST_IDS, BROADCAST_BIGRAMS = 1_000_000, 500_000
SLIP = 1e-9


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(ws: Column) -> Column:
    """A hash for each two words that follow one another."""
    at = F.sequence(F.lit(1), F.greatest(F.size(ws) - 1, F.lit(1)))
    return let(ws, lambda w: F.when(F.size(w) > 1, F.transform(at, lambda i: F.xxhash64(F.slice(w, i, 2)))).otherwise(F.array().cast("array<bigint>")))


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]


def bounds(m: int, at_least: float) -> tuple[int, int, int]:
    """The least and greatest size of a stretch, and how many bigrams it shares at least, for a template of m bigrams."""
    low, high = at_least / (2 - at_least) * m, (2 - at_least) / at_least * m
    least = -int(-(low - SLIP) // 1)
    return least, int(high + SLIP), -int(-(at_least * (least + m) / 2 - SLIP) // 1)


def dice(a: list[str], b: list[str]) -> float:
    x, y = Counter(zip(a, a[1:], strict=False)), Counter(zip(b, b[1:], strict=False))
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def compiled(templates: dict[str, list[str]], at_least: float) -> list[tuple]:
    """For each template its licence, words, bounds, places of its anchors, and the words that tell it from each template like it."""
    every = [(name, plain_words(t)) for name, texts in templates.items() for t in texts]
    if any(len(ws) < 2 for _, ws in every):
        raise ValueError("templates need two words at least")
    out = []
    for name, ws in every:
        m = len(ws) - 1
        least, most, share = bounds(m, at_least)
        anchors = sorted(range(m), key=lambda i: (-len(ws[i]) - len(ws[i + 1]), i))[: m - share + 1]
        rivals = [(sorted(set(ws) - set(vs)), sorted(set(vs) - set(ws))) for other, vs in every if other != name and dice(ws, vs) >= at_least]
        out.append((len(out), name, ws, m, least, most, share, sorted(anchors), rivals))
    return out


SCHEMA = "t int, licence string, tw array<string>, m int, least int, most int, share int, anchors array<int>, rivals array<struct<plus: array<string>, minus: array<string>>>"


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, at_least: float = AT_LEAST) -> DataFrame:
    """doc_id, licence, at_word (from 0), n_words, dice of the best stretch of each document and licence."""
    known = docs.sparkSession.createDataFrame(compiled(templates, at_least), SCHEMA)  # its size is the templates'
    known = pin(known.withColumn("tb", bigrams(F.col("tw"))).drop("tw"))
    anchors = pin(known.select("t", F.explode(F.transform("anchors", lambda i: F.get("tb", i))).alias("h")).distinct())
    anchors = broadcast_if(anchors, anchors.count(), BROADCAST_BIGRAMS)
    docs = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    met = docs.select("doc_id", "tid", F.explode(bigrams(words(F.col("text")))).alias("h")).join(anchors, "h").select("doc_id", "tid", "t").distinct()
    near = pin(met.groupBy("doc_id", "tid").agg(F.collect_set("t").alias("ts")))  # templates of one document
    near = broadcast_if(near.select(F.col("doc_id").alias("i"), F.col("tid").alias("k"), "ts"), near.count(), BROADCAST_IDS)
    held = docs.join(near, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tid") == F.col("k"))).dropDuplicates(["doc_id", "tid"])
    held = held.select("doc_id", "tid", "ts", words(F.col("text")).alias("ws")).withColumn("b", bigrams(F.col("ws")))
    rows = held.withColumn("t", F.explode("ts")).join(broadcast_if(known, known.count(), 10_000), "t")
    # tb is a template's few bigrams
    rows = rows.withColumn("ps", F.filter(F.transform("b", lambda h, i: F.when(F.array_contains("tb", h), i)), lambda i: i.isNotNull())).where("size(ps) >= share")

    def best(k: Column) -> Column:
        """For the begin at the k-th shared bigram (from 1): the end with the greatest coefficient, if any is within the bounds."""
        begin = F.element_at("ps", k)
        ends = F.filter(F.sequence(k + F.col("share") - 1, F.least(k + F.col("most") - 1, F.size("ps"))), lambda j: (F.element_at("ps", j) - begin + 1).between(F.col("least"), F.col("most")))
        rated = F.transform(ends, lambda j: F.struct((2.0 * (j - k + 1) / (F.element_at("ps", j) - begin + 1 + F.col("m"))).alias("d"), (-F.element_at("ps", j)).alias("end")))
        top = F.array_max(rated)
        return F.when(F.element_at("ps", k + F.col("share") - 1) - begin < F.col("most"), F.when(top["d"] >= at_least - SLIP, F.struct(begin.alias("begin"), (-top["end"]).alias("end"))))

    laid = F.filter(F.transform(F.sequence(F.lit(1), F.size("ps") - F.col("share") + 1), best), lambda s: s.isNotNull())
    rows = rows.select("doc_id", "tid", "licence", "m", "rivals", "tb", "ws", "b", F.explode(laid).alias("s"))
    size = F.col("s.end") - F.col("s.begin") + 1
    rows = rows.withColumn("dice", 2.0 * bag_common(F.slice("b", F.col("s.begin") + 1, size), F.col("tb")) / (size + F.col("m"))).where(F.col("dice") >= at_least - SLIP)

    def apart(own: Column) -> Column:
        has = lambda ws: F.size(F.array_intersect(ws, own))
        return F.forall("rivals", lambda r: (2 * has(r["plus"]) >= F.size(r["plus"])) & (2 * has(r["minus"]) <= F.size(r["minus"])))

    rows = rows.where(let(F.slice("ws", F.col("s.begin") + 1, size + 1), apart))
    top = F.min(F.struct((-F.col("dice")).alias("d"), F.col("s.begin").alias("at"), size.alias("n")))
    found = rows.groupBy("doc_id", "tid", "licence").agg(top.alias("b"))
    return found.select("doc_id", "licence", F.col("b.at").cast("long").alias("at_word"), (F.col("b.n") + 1).cast("long").alias("n_words"), (-F.col("b.d")).alias("dice"))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "licence", "at_word", "n_words", F.round(1000 * F.col("dice")).cast("long").alias("dice_thousandths"))


def _values() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quoted(name)}, {quoted(t)})" for i, (name, t) in enumerate((name, t) for name, texts in TEMPLATES.items() for t in texts))


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DICE = "2.0 * (select coalesce(sum(least(x.n, y.n)), 0) from (select g, count(*) as n from (select unnest({0}) as g) group by g) x join (select g, count(*) as n from (select unnest({1}) as g) group by g) y using (g)) / (len({0}) + len({1}))"
#: The words and bigrams of templates and documents, every begin and end, and the exact coefficients, without anchors.
ORACLE = rf"""
with t0(t, licence, x) as (values {_values()}),
t1 as (select t, licence, regexp_extract_all({_LOWER.format("x")}, '[\p{{L}}\p{{N}}]+') as tw from t0),
t2 as (select *, list_transform(range(1, len(tw)), lambda i: tw[i] || ' ' || tw[i + 1]) as tb, len(tw) - 1 as m from t1),
t3 as (select *, ceil({AT_LEAST / (2 - AT_LEAST)} * m - 1e-9)::int as least_, floor({(2 - AT_LEAST) / AT_LEAST} * m + 1e-9)::int as most from t2),
tt as (select *, ceil({AT_LEAST} * (least_ + m) / 2 - 1e-9)::int as share from t3),
like_ as (select a.t, list_filter(list_distinct(a.tw), lambda w: not list_contains(b.tw, w)) as plus, list_filter(list_distinct(b.tw), lambda w: not list_contains(a.tw, w)) as minus
  from tt a join tt b on a.licence <> b.licence where {_DICE.format("a.tb", "b.tb")} >= {AT_LEAST}),
tg as (select distinct t, unnest(tb) as g from tt),
d as (select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[\p{{L}}\p{{N}}]+') as ws from (select distinct doc_id, text from documents)),
d2 as (select *, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) as b from d where len(ws) > 1),
b as (select rid, unnest(b) as g, unnest(range(0, len(b))) as p from d2),
h as (select rid, t, p, row_number() over (partition by rid, t order by p) as k from b join tg using (g)),
w as (select x.rid, x.t, x.p as s, y.p as e, 2.0 * (y.k - x.k + 1) / (y.p - x.p + 1 + m) as est from h x join h y on x.rid = y.rid and x.t = y.t and y.k >= x.k join tt on tt.t = x.t
  where y.p - x.p + 1 between least_ and most and y.k - x.k + 1 >= share),
v as (select rid, t, s, e from w qualify row_number() over (partition by rid, t, s order by est desc, e) = 1 and est >= {AT_LEAST} - 1e-9),
z as (select rid, t, s, e, list_slice(b, s + 1, e + 1) as wb, list_slice(ws, s + 1, e + 2) as ww, doc_id, licence, tb from v join d2 using (rid) join tt using (t)),
r as (select *, {_DICE.format("wb", "tb")} as dice from z),
f as (select *, row_number() over (partition by rid, licence order by dice desc, s, e) as k from r where dice >= {AT_LEAST} - 1e-9
  and not exists (select 1 from like_ l where l.t = r.t and (2 * len(list_intersect(l.plus, ww)) < len(l.plus) or 2 * len(list_intersect(l.minus, ww)) > len(l.minus))))
select doc_id, licence, s::bigint as at_word, (e - s + 2)::bigint as n_words, round(1000 * dice)::bigint as dice_thousandths from f where k = 1
"""
