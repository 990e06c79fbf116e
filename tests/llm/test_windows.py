"""Decontamination against every window of every document, without a prefilter."""

import random
from collections import Counter

from millrace.llm import decontamination

WORDS = [f"w{i}" for i in range(400)]


def grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def brute(docs, items):
    out = {}
    for d, t in docs.items():
        w = t.lower().split()
        for i, x in items.items():
            y = x.lower().split()
            for s in range(max(len(w) - len(y), 0) + 1):
                g, want = grams(w[s : s + len(y)]), grams(y)
                got = sum((g & want).values()) / sum((g | want).values()) if g and want else 0
                if got >= 0.8 and got > out.get((d, i), (0, 0))[0]:
                    out[d, i] = got, s
    return out


def matches(spark, docs, items):
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    return {(r.doc_id, r.item_id): (r.similarity, r.at_word) for r in decontamination.matches(d, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}


def test_parts_in_another_order(spark):
    r = random.Random(3)
    docs, items = {}, {}
    for k, n in enumerate([45, 59, 100, 100, 30, 12]):
        x = r.choices(WORDS, k=n)
        items[k] = " ".join(x)
        for c in range(3):  # two parts swapped, at different places, inside a longer document
            cut = n * (c + 1) // 4
            docs[10 * k + c] = " ".join([*r.choices(WORDS, k=60), *x[cut:], *x[:cut], *r.choices(WORDS, k=60)])
        y = list(x)
        y[n // 2] = "changed"
        docs[10 * k + 5] = " ".join([*r.choices(WORDS, k=20), *y])
        docs[10 * k + 6] = " ".join(x[: n - 1])
    want = brute(docs, items)
    assert sum(d % 10 < 3 for d, _ in want) >= 6
    assert matches(spark, docs, items) == want


def test_items_under_five_words_inside_longer_documents(spark):
    items = {1: "one", 2: "two words", 3: "three words here", 4: "just four words here", 5: "a line of five words"}
    docs = {10 * i: f"a document with Some text before {x} and after that more" for i, x in items.items()} | {10 * i + 1: x for i, x in items.items()} | {7: "nothing of it", 8: "", 9: "words"}
    want = brute(docs, items)
    assert {(10 * i, i) for i in items} <= set(want) and matches(spark, docs, items) == want


def test_blocks_meet_every_pair_within_the_radius_once(spark):
    from pyspark.sql import functions as F

    r = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [(i, r.getrandbits(64)) for i in range(60)]
    windows = []
    for i in range(600):
        x = items[i % 60][1]
        for b in r.sample(range(64), r.randrange(0, 30)):
            x ^= 1 << b
        windows.append((i, x))
    w = spark.createDataFrame([(7, i, signed(x)) for i, x in windows], "len int, w int, wfp long")
    it = spark.createDataFrame([(7, i, signed(x)) for i, x in items], "len int, item_id int, ifp long")
    got = [(x.w, x.item_id) for x in decontamination.near_pairs(w, it, 20).collect()]
    want = {(a, b) for a, x in windows for b, y in items if (x ^ y).bit_count() <= 20}
    assert len(got) == len(set(got)) and set(got) == want
    some = spark.range(1).select(F.array(*map(F.lit, [1, 1, 1, 2, 3, 3])).alias("a"), F.array(*map(F.lit, [1, 1, 3, 3, 3, 4])).alias("b"))
    assert some.select(decontamination.bag_common(F.col("a").cast("array<long>"), F.col("b").cast("array<long>"))).first()[0] == 4
