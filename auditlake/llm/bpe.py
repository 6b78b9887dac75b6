"""Operator 2: BPE encoding and decoding by a contiguous rank array.

A word's symbols and the merge ranks of adjacent symbols lie in two short arrays. The smallest rank is found by a
scan, the boundary between its two symbols goes, and the ranks on either side are looked up again, until no
neighbours can merge. Words are short, so scanning beats any queue; the rare long run takes a heap instead.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import read_table

LONG_WORD = 400  # symbols; a longer run is merged with a heap
CACHED_CHUNKS = 700_000  # per Python worker
NEVER = 1 << 30
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary with word ends, read from a tokenizer file; merges words and keeps a bounded cache."""

    def __init__(self, path: str, cached: int = CACHED_CHUNKS):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.vocab: dict[str, int] = model["vocab"] | {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = [""] * (max(self.vocab.values()) + 1)
        for token, i in self.vocab.items():
            self.tokens[i] = token
        special = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.special_mark = [s.encode() for s in special]
        end = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + end] for s in symbols]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (left, right) in enumerate(model["merges"]):
            self.ranks.setdefault(self.vocab[left] << 20 | self.vocab[right], rank)
            self.merged.append(self.vocab[left + right])
        self.cached = cached
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token's bytes."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(ids) > LONG_WORD:
            return self.merge_long(ids)
        find, merged = self.ranks.get, self.merged
        ranks = [find(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            ids[i] = merged[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = find(ids[i - 1] << 20 | ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = find(ids[i] << 20 | ids[i + 1], NEVER)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in n log n steps: least rank first, leftmost among equals."""
        n, find = len(ids), self.ranks.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := find(ids[i] << 20 | ids[i + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or find(ids[i] << 20 | ids[j], NEVER) != rank:
                continue
            ids[i], alive[j], after[i] = self.merged[rank], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := find(ids[a] << 20 | ids[b], NEVER)) != NEVER:
                    heapq.heappush(heap, (r, a))
        return [x for x, on in zip(ids, alive) if on]

    def chunk(self, raw: bytes) -> bytes:
        """Ids, as 4-byte little-endian integers, of a run without ASCII white space."""
        text, ids = raw.decode("utf-8", "surrogatepass"), []
        marked = self.special is not None and any(m in raw for m in self.special_mark)
        for part in self.special.split(text) if marked else [text]:
            if marked and self.special.fullmatch(part):
                ids.append(self.vocab[part])
                continue
            if not part.isascii():
                part = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
            for piece in PIECES.findall(part.lower() if part.isascii() else part):
                ids += self.merge(piece.encode("utf-8", "surrogatepass"))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        raw = text.encode("utf-8", "surrogatepass")
        # Special strings are matched before case is folded, so such a text keeps its case
        chunks = (raw if b"<|" in raw else raw.translate(LOWER)).split()
        young, old, out = self.young, self.old, []
        for c in chunks:
            ids = young.get(c)
            if ids is None:
                ids = old.get(c)
                if ids is None:
                    ids = self.chunk(c)
                if len(c) < 100:
                    if len(young) >= self.cached // 2:
                        self.old = old = young
                        self.young = young = {}
                    young[c] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Token strings joined by spaces: what a byte-level vocabulary without a decoder gives."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One tokenizer and cache for each Python worker and file."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_values: bool = False) -> DataFrame:
    """Encode every whole text and decode it again: n_tokens and digests, with ``with_values`` also ids and text.

    Null and empty texts have no ids and decode to the empty string. One row comes out for each row in, so repeated
    keys and null keys stay; other columns are not read. A map over the rows: no shuffle, memory bounded by one
    Arrow batch and the worker's cache.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for b in batches:
            n, sha, back, ids_out, text_out = [], [], [], [], []
            for t in b.column("text").to_pylist():
                ids = bpe.encode(t)
                decoded = bpe.decode(ids)
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_values:
                    ids_out.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    text_out.append(decoded)
            cols = [b.column("key"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            if with_values:
                cols += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(text_out, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_values else ""
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ``documents``, one row each."""
    import public_tokenizers

    return encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
