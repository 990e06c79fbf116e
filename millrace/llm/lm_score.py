"""Language-model scores from a weighted backoff automaton over word n-grams.

States are contexts: the empty one, the start of a text, and every n-gram of fewer than `order` words that training
texts have. A state has an arc for each word seen after it, to the longest context that the word leaves behind, and a
failure arc to the context without its first word. With c the training counts, k(h) = PRIOR * c(h) ** HEAPS (a context
fails as often as it has different successors, which grow as a power of its count) and h' the shorter context:

    arc      log10 p(w | h)              p(w | h) = (c(h, w) + k(h) p(w | h')) / (c(h) + k(h))
    failure  log10 k(h) / (c(h) + k(h))
    empty    log10 p(w)                  p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), for every word

so the weights of a state sum to one. A text is read once from left to right: the state is carried from word to word,
where it has no arc its failure arcs are taken until a state has one, and the weights are added up. The end of the text
is a word, too.

The automaton grows with the corpus, so no process holds it. Documents are packed into blocks of up to BLOCK_BYTES of
text. A block sends each distinct n-gram once (a hash, its count in training texts) to the bucket of its hash, so a
frequent word costs one entry a block; buckets add the counts up and send back the totals in the order of the request;
then each block builds the part of the automaton that its texts can reach and runs them through it. What moves is in
proportion to the distinct n-grams of the blocks: a frame of few n-grams is a few bytes a piece. The number of buckets
and of tasks grows with the tokens, so that their size stays the same. Within a bucket n-grams are told apart by 47 bits
of hash: under one in 10^7 look-ups meets another n-gram's count, at every corpus size.

Defined cases: a null or word-less text is the end token alone; a text of any length is scored whole, in a block of its
own if need be; a null doc_id counts as the empty text for the split and is kept; rows that share a doc_id are read and
scored each; further columns are ignored, whatever their names; an empty table gives an empty table; with no training
text every count is zero (V = N = 0).
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ORDER, PRIOR, HEAPS = 2, 5.0, 0.8
BLOCK_BYTES, BUCKET_TOKENS = 4 << 20, 4 << 20
#: Byte strings that are no words stand for the end of a text and for the state before its first word.
END, START = b" ", b"\n"
BLOCK = "block long, doc_id array<long>, n array<int>, train array<boolean>, words binary, tokens binary"
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _close(*xs: np.ndarray) -> bytes:
    """Arrays of unsigned numbers as planes of bytes, compressed unless they are short: upper planes of small numbers cost nothing."""
    planes = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() for x in xs)
    return b"\0" + planes if len(planes) < 64 else b"\1" + zstandard.compress(planes, 1)


def _open(data: bytes, *kinds: type) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data[1:]) if data[0] else data[1:], np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(planes) // sum(sizes), [], 0
    for k, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(planes[at : at + n * size].reshape(size, n).T).view(k).ravel())
        at += n * size
    return out


def _pack(ids: list, lengths: list[int], train: list[bool], known: dict[bytes, int], tokens: array, block: int) -> pa.RecordBatch:
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
    row = [[block], [ids], [lengths], [train], [hashes.tobytes()], [_close(np.frombuffer(tokens, np.uint32))]]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["block", "doc_id", "n", "train", "words", "tokens"])


def blocks(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) as blocks of token numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32

        def fresh() -> tuple:
            return [], [], [], {START: 0, END: 1}, array("I"), 0

        ids, lengths, train, known, tokens, size = fresh()
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and size + len(text or b"") > BLOCK_BYTES:
                    yield _pack(ids, lengths, train, known, tokens, block)
                    block += 1
                    ids, lengths, train, known, tokens, size = fresh()
                ws = (text or b"").lower().split()
                tokens.extend([known.setdefault(w, len(known)) for w in ws])
                tokens.append(1)
                ids.append(i)
                lengths.append(len(ws) + 1)
                train.append(zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1)
                size += len(text or b"")
        if ids:
            yield _pack(ids, lengths, train, known, tokens, block)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, BLOCK)


class Part:
    """The n-grams of one block. For each length k from 1: at[k], the number of the k-gram that ends at each token (-1: the
    text has too few words before it, the start being one); last[k] and head[k], the word that ends each k-gram and the
    (k-1)-gram before it; tail[k], the (k-1)-gram that it ends with. All n-grams in the order of their hashes.
    """

    def __init__(self, n, train, words: bytes, tokens: bytes, order: int):
        hashes = np.frombuffer(words, np.uint64)
        now = _open(tokens, np.uint32)[0].astype(np.int64)
        self.order, self.words, self.lengths = order, len(hashes), np.asarray(n, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        place = np.arange(len(now)) - np.repeat(self.first, self.lengths)
        learnt = np.repeat(np.asarray(train, bool), self.lengths)
        with np.errstate(over="ignore"):
            code = _mix(hashes ^ np.uint64(0x9E3779B97F4A7C15))
            self.at, self.last, self.head, self.tail = {1: now}, {1: np.arange(self.words)}, {}, {}
            every, counts = [code], [np.bincount(now[learnt], minlength=self.words)]
            for k in range(2, order + 1):
                before = np.concatenate([[-1], self.at[k - 1][:-1]])
                before[place == 0] = 0 if k == 2 else -1  # the start of the text, a word of no text
                has = before >= 0
                grams, number = np.unique(before[has] * self.words + now[has], return_inverse=True)
                self.at[k] = np.full(len(now), -1)
                self.at[k][has] = number
                self.head[k], self.last[k] = grams // self.words, grams % self.words
                self.tail[k] = np.zeros(len(grams), np.int64)
                self.tail[k][number] = self.at[k - 1][has]
                code = _mix(code[self.head[k]] * np.uint64(0xC2B2AE3D27D4EB4F) + _mix(hashes[self.last[k]]))
                every.append(code)
                counts.append(np.bincount(self.at[k][has & learnt], minlength=len(grams)))
        self.sizes = [len(x) for x in every]
        every = np.concatenate(every) & ~np.uint64(1)
        every[: self.words] |= np.uint64(1)  # the last bit tells words from longer n-grams
        self.order_ = np.argsort(every, kind="stable")
        self.hashes, self.counts = every[self.order_], np.concatenate(counts)[self.order_]

    def totals(self, in_order: np.ndarray) -> dict[int, np.ndarray]:
        """Counts of k-grams, for each k, from counts in the order of the hashes."""
        out = np.empty(len(in_order), np.int64)
        out[self.order_] = in_order
        ends = np.cumsum([0, *self.sizes])
        return {k + 1: out[ends[k] : ends[k + 1]] for k in range(self.order)}


class Automaton:
    """The states and arcs that a block's texts can reach. State 0 is the empty context; state of[k] + i the i-th k-gram."""

    def __init__(self, part: Part, totals: dict[int, np.ndarray], n: int, v: int, texts: int):
        word = totals[1]
        p = (word + 0.5) / (n + 0.5 * (v + 1))
        self.words, self.root = part.words, np.log10(p)
        context = dict(totals)
        context[1] = word.copy()
        context[1][0] = texts  # the start has as many next words as there are texts
        of, states = {}, 1
        for k in range(1, part.order):
            of[k] = states
            states += len(context[k])
        self.start = of.get(1, 0)
        failure, weight = np.zeros(states, np.int64), np.zeros(states)
        keys, arcs, to = [], [], []
        for k in range(1, part.order):
            c = context[k]
            prior = PRIOR * np.maximum(c, 1) ** HEAPS
            here = slice(of[k], of[k] + len(c))
            weight[here] = np.log10(prior / (c + prior))
            if k > 1:
                failure[here] = of[k - 1] + part.tail[k]
            head, last = part.head[k + 1], part.last[k + 1]
            p = (totals[k + 1] + prior[head] * p[part.tail[k + 1]]) / (c[head] + prior[head])
            seen = np.flatnonzero(totals[k + 1] > 0)
            keys.append((of[k] + head[seen]) * part.words + last[seen])
            arcs.append(np.log10(p[seen]))
            to.append(of[k + 1] + seen if k + 1 < part.order else of[k] + part.tail[k + 1][seen])
        self.next_word = of.get(1, 0) if part.order > 1 else 0  # the state of a word's own context
        self.failure, self.weight = failure.tolist(), weight.tolist()
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.arcs = dict(zip(keys.tolist(), zip(np.concatenate(arcs).tolist(), np.concatenate(to).tolist(), strict=True), strict=True)) if len(keys) else {}

    def score(self, tokens: list[int]) -> float:
        """The log10 probability of a text, read once from left to right."""
        arcs, failure, weight, root, words = self.arcs, self.failure, self.weight, self.root, self.words
        state, total, own = self.start, 0.0, self.next_word
        for w in tokens:
            arc = arcs.get(state * words + w)
            while arc is None and state:
                total += weight[state]
                state = failure[state]
                arc = arcs.get(state * words + w) if state else None
            if arc is None:  # the empty context has an arc for every word
                total += root[w]
                state = own + w if own else 0
            else:
                total += arc[0]
                state = arc[1]
        return total


def _requests(table: DataFrame, bits: int, order: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                part = Part(r["n"], r["train"], r["words"], r["tokens"], order)
                bucket = (part.hashes >> np.uint64(64 - bits)).astype(np.int64)
                ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
                low = ((part.hashes << np.uint64(bits)) >> np.uint64(17) << np.uint64(1)) | (part.hashes & np.uint64(1))
                rows = list(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)) if len(bucket) else []
                data = [_close(np.diff(low[i:j], prepend=np.uint64(0)), part.counts[i:j].astype(np.uint32)) for i, j in rows]
                columns = [pa.array([bucket[i] for i, _ in rows], pa.int32()), pa.array([r["block"]] * len(rows), pa.int64()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "data"])

    return table.select("block", "n", "train", "words", "tokens").mapInArrow(run, "bucket int, block long, data binary")


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """For one bucket: total counts in the order of each request, and how many words have any."""
    got = [_open(x, np.uint64, np.uint32) for x in group["data"]]
    raw = [np.cumsum(x, dtype=np.uint64) for x, _ in got]
    every, where = np.unique(np.concatenate(raw), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate([c for _, c in got])).astype(np.int64)
    words = np.count_nonzero((every & np.uint64(1) > 0) & (total > 0))
    out, ends = total[where].astype(np.uint64), np.cumsum([len(x) for x in raw])
    return pd.DataFrame(
        {
            "block": group["block"].to_numpy(),
            "bucket": group["bucket"].to_numpy(),
            "totals": [_close(out[e - len(x) : e]) for x, e in zip(raw, ends, strict=True)],
            "distinct_words": np.concatenate([[words], np.zeros(len(raw) - 1, np.int64)]).astype(np.int64),
        }
    )


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """For each of docs (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score."""
    table = stored(blocks(docs), "lm-blocks")
    tokens = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    learnt = F.aggregate(F.arrays_zip("n", "train"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["train"], x["n"]).otherwise(0))
    every, n, texts, many = table.agg(F.sum(tokens), F.sum(learnt), F.sum(F.size(F.filter("train", lambda x: x))), F.count("*")).first()
    bits = max(4, math.ceil(math.log2(max(1, order * (every or 0) / BUCKET_TOKENS))))
    n, texts, many = n or 0, texts or 0, max(many, 1)
    requests = _requests(table, bits, order).repartition(1 << bits, "bucket")
    answers = stored(requests.groupBy("bucket").applyInPandas(_answer, "block long, bucket int, totals binary, distinct_words long"), "lm-counts")
    v = answers.agg(F.sum("distinct_words")).first()[0] or 0

    def run(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        rows = []
        got = got.sort_values("bucket")
        totals = np.concatenate([_open(x, np.uint64)[0] for x in got["totals"]]).astype(np.int64) if len(got) else np.zeros(0, np.int64)
        for r in own.itertuples():
            part = Part(r.n, r.train, r.words, r.tokens, order)
            counts = part.totals(totals)
            machine = Automaton(part, counts, n, v, texts)
            add = lambda x: np.add.reduceat(x, part.first)  # noqa: B023, E731
            now = part.at[1]
            scores = [machine.score(now[i : i + k].tolist()) for i, k in zip(part.first, part.lengths, strict=True)]
            rows.append(pd.DataFrame({"doc_id": pd.array([None if x is None or x != x else int(x) for x in r.doc_id], "Int64"), "held_out": ~np.asarray(r.train, bool), "n_tokens": part.lengths, "n_known": add((counts[1][now] > 0).astype(np.int64)), "train_tokens": n, "base_score": add(machine.root[now]), "score": scores}))
        return pd.concat(rows) if rows else pd.DataFrame({c.split()[0]: [] for c in SCORE.split(", ")}, dtype=object)

    parts = lambda df: df.repartition(many, "block").groupBy("block")
    return parts(table).cogroup(parts(answers)).applyInPandas(run, SCORE)


def op5(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
