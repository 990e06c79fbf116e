"""Operators that SQL can't express, against plain versions over the smallest documents table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import bpe, decontamination, lm_score, queries, simhash_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def groups(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if j > i and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_copies_of(texts):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in texts.items()}
    g = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else {()} for i, w in words.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(g):
        for j in sorted(g):
            if j > i and len(g[i] & g[j]) >= 0.8 * len(g[i] | g[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(len(w) - 2, 1))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("hot", [64, 1])
def test_simhash_groups(spark, docs, hot):
    fps = {i: fingerprint(t) for i, t in docs.items()}
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash_dedup.near_groups(spark.read.parquet(f"{SF}/documents.parquet"), hot=hot).collect()}
    assert got == {i: (fps[i], c) for i, c in groups(fps).items()}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2))
def test_golay_keys_meet(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    pair = np.array([x, y], np.uint64).view(np.int64)
    rows, keys = simhash_dedup.fuzzy_keys(pair)
    assert set(keys[rows == 0]) & set(keys[rows == 1])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "\n", " ", "'s", "'re", "é", "日", "<|endoftext|>", "<|endof", "1", "!", "ing", "---"]), max_size=60), st.integers(1, 40))
def test_bpe_streams_as_the_library(parts, window):
    text, t = "".join(parts), bpe.transducer(bpe.default_tokenizer())
    library = Tokenizer.from_file(bpe.default_tokenizer())
    want = library.encode(text, add_special_tokens=False).ids
    assert [i for ids in t.encode((text[k : k + 5] for k in range(0, len(text), 5)), window) for i in ids] == want
    assert "".join(t.decode([want])) == "".join(t.decode([i] for i in want)) == library.decode(want, skip_special_tokens=False)


def test_bpe_inside_one_long_word():
    random.seed(5)
    t, library = bpe.transducer(bpe.default_tokenizer()), Tokenizer.from_file(bpe.default_tokenizer())
    for text in ("".join(random.choice(["a", "th", "é", "日", "ing"]) for _ in range(4000)), "a" * 5000, "=" * 4000):
        assert [i for ids in t.encode([text], 1000) for i in ids] == library.encode(text, add_special_tokens=False).ids


def test_own_merges_equal_the_kernel(docs):
    t = bpe.transducer(bpe.default_tokenizer())
    for text in list(docs.values())[:20]:
        assert [t.ids[x] for p in t.pattern.findall(text) for x in t.merge(p.encode())] == t.kernel.encode_ordinary(text)


def test_token_and_bpe_queries(spark, docs):
    library = Tokenizer.from_file(bpe.default_tokenizer())
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in docs.items()}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    digests = {i: (len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for i, x in ids.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op3_bpe"](spark, SF).collect()} == digests
    at, want = 0, {}
    for i in sorted(ids):
        x = np.array([*ids[i], 0], "<u4")
        want[i] = (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op2_token_files"](spark, SF).collect()} == want


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores(spark, docs, order):
    toks = {i: [*(t or "").encode().lower().split(), b" "] for i, t in docs.items()}
    learnt = [i for i in toks if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter()  # of n-grams of all lengths, the start of a text being a word
    for i in learnt:
        ws = [b"\n", *toks[i]]
        for k in range(1, order + 1):
            c.update(tuple(ws[j : j + k]) for j in range(len(ws) - k + 1))
    n, v = sum(len(toks[i]) for i in learnt), sum(len(g) == 1 and g != (b"\n",) for g in c)

    def p(w, context):
        if not context:
            return (c[w,] + 0.5) / (n + 0.5 * (v + 1))
        k = lm_score.PRIOR * max(c[context], 1) ** lm_score.HEAPS
        return (c[*context, w] + k * p(w, context[1:])) / (c[context] + k)

    got = lm_score.score(spark.read.parquet(f"{SF}/documents.parquet"), order=order) if order != lm_score.ORDER else queries.QUERIES["op5_lm_score"](spark, SF)
    for r in got.collect():
        ws = [b"\n", *toks[r.doc_id]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in learnt, len(ws) - 1, sum(c[w,] > 0 for w in ws[1:]), n)
        assert math.isclose(r.base_score, sum(math.log10(p(w, ())) for w in ws[1:]), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(ws[j], tuple(ws[max(0, j - order + 1) : j]))) for j in range(1, len(ws))), rel_tol=1e-9)


def test_lm_traversal_takes_failure_arcs():
    """Weights of a state sum to one over all words, and a word without an arc is reached by failure arcs."""
    from array import array as numbers

    known = {w: i for i, w in enumerate([lm_score.START, lm_score.END, b"a", b"b", b"c"])}
    batch = lm_score._pack([1, 2], [4, 3], [True, True], known, numbers("I", [2, 3, 2, 1, 2, 4, 1]), 0).to_pylist()[0]
    part = lm_score.Part(batch["n"], batch["train"], batch["words"], batch["tokens"], 3)
    machine = lm_score.Automaton(part, part.totals(part.counts), 7, 4, 2)
    ends = {1 + 1} | {1 + len(known) + i for i, w in enumerate(part.last[2]) if w == 1}  # nothing follows the end of a text
    for state in sorted(set(range(len(machine.failure))) - ends):
        total = 0.0
        for w in range(5):  # 0 stands for all words never seen
            s, x = state, 0.0
            while (arc := machine.arcs.get(s * machine.words + w)) is None and s:
                x += machine.weight[s]
                s = machine.failure[s]
            total += 10 ** (x + (arc[0] if arc else machine.root[w]))
        assert math.isclose(total, 1), state
    assert machine.score([2, 3, 2, 1]) > machine.score([3, 4, 4, 1])


def leaks(docs, items):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()
    out = set()
    for d, t in docs.items():
        w = words(t)
        have = set(grams(w))
        for i, x in items.items():
            y = words(x)
            want = grams(y)
            if have & set(want) and any(sum((g & want).values()) / sum((g | want).values()) >= 0.8 for s in range(max(len(w) - len(y), 0) + 1) for g in [grams(w[s : s + len(y)])]):
                out.add((d, i))
    return out


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    near = {9000 + i: f"before it {' '.join(t.split()[1:])} and after" for i, t in items.items()}
    more = spark.createDataFrame(list(near.items()), "doc_id long, text string")
    got = decontamination.matches(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(more), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == leaks({**docs, **near}, items)


def test_pipeline(spark):
    """Each stage on its own input, against the operators' plain versions."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, table, SF)
    assert good.columns == table.columns
    kept = {r.doc_id for r in queries.QUERIES["op4_quality"](spark, SF).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    cleaned = corpus_pipeline.drop_lines(spark, good, SF)
    texts = {r.doc_id: r.text for r in good.collect()}
    holders = {}
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x).strip(" \t\n\x0b\f\r")
    for i, t in texts.items():
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, set()).add(i)
    wide = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    want = {i: "\n".join(x for x in t.split("\n") if wide.get(key(x), i) == i) for i, t in texts.items()}
    assert {r.doc_id: r.text for r in cleaned.collect()} == want and cleaned.columns == table.columns
    apart = corpus_pipeline.drop_copies(spark, cleaned, SF)
    first = {i for i, c in near_copies_of(want).items() if i == c}  # 5 words, similarity 0.8
    assert {r.doc_id for r in apart.collect()} == first and apart.columns == table.columns
    clean = corpus_pipeline.drop_leaks(spark, apart, SF)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    lost = {d for d, _ in leaks({i: want[i] for i in first}, items)}
    assert {r.doc_id for r in clean.collect()} == first - lost
    library = Tokenizer.from_file(bpe.default_tokenizer())
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()} == {i: len(library.encode(want[i], add_special_tokens=False).ids) for i in first - lost}
