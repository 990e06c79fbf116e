"""The transducer in constant memory, and short-document access that reads only what it needs."""

import hashlib
import tracemalloc

from millrace.llm import bpe, token_files
from millrace.llm.common import scratch


def test_a_text_of_100_mb_in_constant_memory():
    t, piece = bpe.transducer(bpe.default_tokenizer()), "The quick brown fox, 3 times; naïve or not? It's \n\n  over " * 180
    assert t.lookahead and t.kernel
    n, sha = 0, hashlib.sha256()

    def runs():
        nonlocal n
        for ids in t.encode(piece for _ in range(100_000_000 // len(piece))):
            n += len(ids)
            yield ids

    tracemalloc.start()
    for text in t.decode(runs()):
        sha.update(text.encode())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = hashlib.sha256()
    for _ in range(100_000_000 // len(piece)):
        want.update(piece.encode())
    assert sha.digest() == want.digest() and n > 10_000_000 and peak < 2_000_000


def test_no_text_goes_whole_to_the_kernel(monkeypatch):
    """A text of a few windows is encoded in that many runs at least."""
    t = bpe.Transducer(bpe.default_tokenizer())
    text, seen, final = "some words and more " * 500, [], t.final
    monkeypatch.setattr(t, "final", lambda run: (seen.append(len(run)), final(run))[1])
    assert t.encode_text(text) == bpe.transducer(bpe.default_tokenizer()).encode_text(text)
    assert len(seen) >= 5 and max(seen) <= 2 * bpe.WINDOW


def test_lookup_reads_only_blocks_that_can_hold_the_document(spark):
    docs = spark.createDataFrame([(i, f"document {i} " * 50) for i in range(3000)], "doc_id long, text string")
    token_files.write(docs, path := scratch(spark, "lookup"))
    held = token_files.holding(spark, path, 1234)
    plan = held._jdf.queryExecution().explainString(held.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "LessThanOrEqual(first,1234)" in plan and "GreaterThanOrEqual(last,1234)" in plan
    assert token_files.lookup(spark, path, 1234) == [*bpe.transducer(bpe.default_tokenizer()).encode_text("document 1234 " * 50), 0]
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.where("first <= 1234 and last >= 1234").count() == 1 < blocks.count()
