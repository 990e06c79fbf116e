"""Byte-level BPE as a bounded-lookahead streaming transducer, and decoding by an incremental byte-to-text state machine.

Encoding reads text in pieces of any size. Two kinds of boundary become final before the text ends:

* between pre-tokens: white space after other characters always starts a new pre-token, whatever follows, so all text
  before the last such place can be encoded and given out at once;
* inside one pre-token longer than the window: by the merge list's sufficient lookahead. What follows position p can
  change the merges before p only along a chain of rules of rising rank in which each one's right part is what an
  earlier one takes away or makes; the longest such chain, in bytes, is found in one pass over the merge list. Token
  ends further than that from the end of the read bytes are final. As no merge crosses a token's end, encoding goes on
  from there with nothing kept but the bytes after it.

Every text takes this path, whatever its length: it is fed in pieces of WINDOW characters, ids are given out as they
become final, digested and decoded right away, and neither all ids nor the decoded text of a document are ever held.
Memory so is bounded by the window. Final runs are handed to the tiktoken kernel with ranks built from the tokenizer
file's own vocabulary where its merges are in the order of their ids (else to the merge loop below); its ids equal those
of the tokenizers library, which tests compare, at over four times the speed.

Defined cases: a null text is empty; an empty text has no ids; strings of special tokens become their ids, as in the
library; ids that the vocabulary lacks raise KeyError in decode.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern by which byte-level BPE of this family splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that a pre-token's end can depend on beyond it (a contraction's two letters and the one after white space).
BEYOND = 3
WINDOW = 1 << 10


def default_tokenizer() -> str:
    """The file named in MILLRACE_TOKENIZER, or the one that the public_tokenizers package has."""
    if path := os.environ.get("MILLRACE_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Transducer:
    """The tables of one tokenizer file, shared by any number of streams."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE without a normalizer is covered")
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.ids = {raw(s): i for s, i in model["vocab"].items() if s not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(raw(a), raw(b)) for a, b in pairs]
        self.rank = {ab: r for r, ab in reversed(list(enumerate(self.merges)))}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.pattern = regex.compile(PATTERN)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.keep = max([1, *map(len, self.special)]) - 1

    @cached_property
    def lookahead(self) -> int:
        """Bytes after a position that can change the tokens before it, at most."""
        chain: dict[bytes, int] = {}
        most = 1
        for a, b in self.merges:
            n = len(a) + len(b) + chain.get(b, 0)
            most = max(most, n)
            for x in (a, a + b):
                chain[x] = max(chain.get(x, 0), n)
        return most

    @cached_property
    def kernel(self) -> tiktoken.Encoding | None:
        made = [self.ids.get(a + b, -1) for a, b in self.merges]
        if made != sorted(set(made)) or made and made[0] < 256 or len(self.ids) != 256 + len(made):
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ids, special_tokens={})

    def merge(self, piece: bytes) -> list[bytes]:
        """The tokens of one pre-token: the best-ranked pair is merged first, the leftmost of equals; O(n log n)."""
        n = len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) >= n or self.rank.get((part[i], part[j])) != r:
                continue
            part[i], part[j], after[i] = part[i] + part[j], None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self.rank.get((part[k], part[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k))
        return [p for p in part if p is not None]

    def final(self, text: str) -> list[int]:
        """Ids of a run whose ends are final."""
        if self.kernel:
            return self.kernel.encode_ordinary(text)
        return [self.ids[t] for p in self.pattern.findall(text) for t in self.merge(p.encode())]

    def encode(self, chunks: Iterable[str], window: int = WINDOW) -> Iterator[list[int]]:
        """Lists of ids, given out as they become final, of the text that the chunks make up."""
        held, window = "", max(window, self.keep + BEYOND + 1)
        for chunk in chunks:
            held += chunk
            while len(held) > window:
                ids, held = self._step(held)
                if ids:
                    yield ids
                else:
                    break
        if held:
            yield self._all(held)

    def stream(self, text: str | None, window: int = WINDOW) -> Iterator[list[int]]:
        """encode() of a text that is at hand."""
        return self.encode((text[k : k + window] for k in range(0, len(text), window)), window) if text else iter(())

    def encode_text(self, text: str | None, window: int = WINDOW) -> list[int]:
        return [i for ids in self.stream(text, window) for i in ids]

    def _all(self, text: str) -> list[int]:
        if not self.cut.search(text):
            return self.final(text)
        ids, at = [], 0
        for m in self.cut.finditer(text):
            ids += [*self.final(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return ids + self.final(text[at:])

    def _step(self, held: str) -> tuple[list[int], str]:
        """The ids that are final, and the text after them; no ids if more text is needed."""
        if m := self.cut.search(held):
            if m.start() == 0:
                return [self.special[m[0]]], held[m.end() :]
            return self.final(held[: m.start()]), held[m.start() :]
        upto = len(held) - self.keep  # a special token's string may have begun after it
        places = regex.search(r"(?r)\S(?=\s)", held, endpos=upto)  # its end starts a pre-token
        if places and places.end() < upto:
            return self.final(held[: places.end()]), held[places.end() :]
        stable = [m for m in self.pattern.finditer(held) if m.end() + BEYOND <= upto]
        if stable:  # piece by piece: white space at the end of a run would be split otherwise
            return [self.ids[t] for m in stable for t in self.merge(m[0].encode())], held[stable[-1].end() :]
        # One pre-token fills the window: its tokens up to the lookahead before the end of what is read are final.
        piece, out, done, last = held[: upto - BEYOND].encode(), [], 0, (0, 0)
        for t in self.merge(piece):
            done += len(t)
            if done > len(piece) - self.lookahead:
                break
            out.append(self.ids[t])
            if piece[done] & 0xC0 != 0x80:  # between characters
                last = len(out), done
        return out[: last[0]], piece[last[1] :].decode() + held[upto - BEYOND :]

    def decode(self, runs: Iterable[list[int]]) -> Iterator[str]:
        """Text as its bytes come, from ids in runs of any length; a sequence of bytes that is no character becomes U+FFFD, as in the library."""
        state, table = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of
        for ids in runs:
            if s := state.decode(b"".join([table[i] for i in ids])):
                yield s
        if s := state.decode(b"", True):
            yield s

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """How many ids a text has, and the SHA-256 of the ids (little-endian unsigned 32-bit) and of the text decoded from them, in one pass."""
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

        def seen() -> Iterator[list[int]]:
            nonlocal n
            for ids in self.stream(text):
                n += len(ids)
                of_ids.update(np.array(ids, "<u4").tobytes())
                yield ids

        for piece in self.decode(seen()):
            of_text.update(piece.encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()


@lru_cache(4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 (of ids as little-endian unsigned 32-bit integers) and decoded_sha256 of each whole text.

    Columns of docs with these names are replaced. The tokenizer file must be at its path on every executor.
    """
    path = tokenizer or default_tokenizer()
    keep = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    at = keep.index("text") if "text" in keep else None
    if at is None:
        raise ValueError("docs has no column text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            n, sha, back = zip(*(t.digests(text.as_py()) for text in b.column(at)), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], [*b.schema.names, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*keep).mapInArrow(run, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs).select("doc_id", "n_tokens", F.col("ids_sha256"), F.col("decoded_sha256"))
