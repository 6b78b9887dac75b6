"""Operator 1: n-gram Jaccard join by a MinHash LSH forest, verified exactly.

A text's shingles are its runs of five words. TREES sorted tries hold DEPTH MinHash values of every text each. Texts
that share a trie prefix are candidates; the prefix starts at its full depth and is shortened for all tries, until the
links seen at that depth, weighted by how likely each was to be seen, say that the target recall is met. Candidates
whose signatures agree enough form candidate groups, and inside these every pair is verified on its shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.buckets import RESULT, Union, cells, dealt, groups, result
from auditlake.llm.common import connected_components, mix64, read_table, stored, words_of

SHINGLE = 5
SIMILARITY = 0.8
TREES = 16
DEPTH = 5
LEAST_DEPTH = 3
TARGET_RECALL = 0.9999
#: Signatures of a candidate pair agree in at least this share; at similarity 0.8 and 80 values fewer is 5 sigma off.
AGREE = 0.58
HASHES = TREES * DEPTH
CACHED_WORDS = 500_000
#: Candidates up to which their keys are broadcast (some 60 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 200_000

_rng = np.random.default_rng(5)
XORS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
ODDS = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
PLACES = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a text of fewer words, but not none, is one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(n, SHINGLE)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total += mix64(h[i : n - k + 1 + i] + PLACES[i]) * PLACES[i]
    return np.unique(mix64(total))


def signature(shingle_hashes: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 32 bits, tree by tree."""
    low = (shingle_hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(least, ((low[i : i + 1024, None] ^ XORS) * ODDS).min(axis=0), out=least)
    return least


def digest(text: str, words: list[bytes]) -> bytes:
    """Equal for texts of equal words; a text without words goes by its bytes."""
    raw = b" ".join(words) if words else b"\0" + text.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(raw, digest_size=16).digest()


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        digests, signatures = [], []
        for t in b.column("text").to_pylist():
            words = words_of(t)
            digests.append(digest(t, words) if t else None)
            signatures.append(signature(shingles(words, hashes)).tobytes() if words else None)
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("text_h"), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], ["key", "text_h", "digest", "sig"])


def prefix_entries(depth: int):
    """(bucket, member): a bucket for each tree and prefix of the given depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(977))
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)
            key = np.tile(salt, (len(sig), 1))
            for d in range(depth):
                key = mix64(key * np.uint64(31) + sig[:, :, d])
            members = np.repeat(b.column("member").to_numpy(zero_copy_only=False), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(members)], ["bucket", "member"])

    return run


def seen_by(s: np.ndarray, depth: int) -> np.ndarray:
    """Chance that two texts of similarity s share a prefix of this depth in a tree or more."""
    return 1 - (1 - s**depth) ** TREES


def agreeing(depth: int):
    """In each cell: spanning edges of the pairs whose signatures agree enough (kind 1), and two sums for the recall
    (kind 0): over likely links, weighted by the times each is met, of the chance to be seen, and of 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        seen = every = 0.0
        for (_, i, j), g in groups(batches):
            sig = np.frombuffer(b"".join(g["sig"]), np.uint32).reshape(-1, HASHES)
            own, members = np.array(g["own"]), g["member"]
            union = Union(len(members))
            for x in range(len(members) - 1):
                share = (sig[x + 1 :] == sig[x]).mean(axis=1)
                fits = (share >= AGREE) & ((own[x + 1 :] != own[x]) | (i == j))
                link = share[fits & (share >= SIMILARITY)]
                weight = 1 / (TREES * link**depth)
                seen += float((weight * seen_by(link, depth)).sum())
                every += float(weight.sum())
                out += [(1, members[x], members[x + 1 + y], 0) for y in np.flatnonzero(fits).tolist() if union.join(x, x + 1 + y)]
            if len(out) > 5000:
                yield result(out)
                out = []
        yield result([*out, (0, int(seen * 1e6), int(every * 1e6), 0)])

    return run


def common_counts(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the sizes of its intersections with all sets, from an inverted index."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(ids, kind="stable")
    posting, start = owner[order], np.concatenate([[0], np.cumsum(df)])
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for x in range(len(sets)):
        own = ids[at[x] : at[x + 1]]
        own = own[df[own] > 1]
        n = df[own]
        if not len(own):
            yield x, np.zeros(len(sets), np.int64)
            continue
        flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[own], n)
        yield x, np.bincount(posting[flat], minlength=len(sets))


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each cell of a candidate group: links of every member by exact Jaccard, and spanning edges."""
    out: list[tuple[int, int, int, int]] = []
    for (_, i, j), g in groups(batches):
        sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
        size, n, own = np.array([len(s) for s in sets]), np.array(g["n"]), np.array(g["own"])
        members, union = g["member"], Union(len(sets))
        for x, common in common_counts(sets):
            other = size + size[x] - common
            link = common >= SIMILARITY * other - 1e-9
            link[x] = False
            if i != j:
                link &= own != own[x]
            y = np.flatnonzero(link)
            if len(y):
                out.append((0, members[x], 0, int(n[y].sum())))
                out += [(1, members[x], members[z], 0) for z in y.tolist() if union.join(x, z)]
        if len(out) > 5000:
            yield result(out)
            out = []
    yield result(out)


def with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text, digest, member, n) those whose text has the digest, with their shingles."""
    hashes = WordHashes()
    for b in batches:
        rows = []
        for t, d, m, n in zip(*(b.column(c).to_pylist() for c in ("text", "digest", "member", "n"))):
            words = words_of(t)
            if words and digest(t, words) == d:
                rows.append((m, n, shingles(words, hashes).tobytes()))
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["member", "n", "shingles"])


def near_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key, text_h (the text's hash), class_id, n_links, component_id, kept.

    Words: A-Z lower-cased, class [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]; shingles: SHINGLE words, all words of a shorter
    text. Texts of equal words are a class, named by its smallest key; ``n_links`` counts the other rows whose class is
    the same or has a Jaccard similarity of SIMILARITY or more; ``component_id`` is the smallest key reachable by
    links, and ``kept`` marks the row that has it; where a key repeats with different texts of a group, the one with
    the smallest text hash. Texts that differ, but have no word, link with nothing; null and empty texts link with
    nothing at all, and each is kept. Rows repeating key and text are one document: all are returned, each marked
    alike. A null key comes after all others, and names a group only where no member has a key. Other columns aren't
    read. Pairs are compared inside bounded cells and never written out.
    """
    kind = dict(docs.dtypes)[key]
    d = docs.select(docs[key].alias("key"), docs[text].alias("text")).withColumn("text_h", F.xxhash64("text"))
    rows = stored(d.mapInArrow(signed, f"key {kind}, text_h long, digest binary, sig binary"))
    place = F.struct(F.col("key").isNull().alias("unnamed"), "key", "text_h")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min(place).alias("least"), F.count("*").alias("n"), F.first("sig").alias("sig"))
    classes = stored(classes.withColumn("member", F.monotonically_increasing_id()))
    hashed = classes.where("sig is not null").select("member", "sig")
    edges = None
    for depth in range(DEPTH, LEAST_DEPTH - 1, -1):
        entries = hashed.mapInArrow(prefix_entries(depth), "bucket long, member long")
        met = stored(dealt(cells(entries).join(hashed, "member")).mapInArrow(agreeing(depth), RESULT))
        edges = met.where("kind = 1").select("a", "b")
        sums = met.where("kind = 0").agg(F.sum("a").alias("seen"), F.sum("b").alias("all")).first()
        if not sums["all"] or sums["seen"] >= TARGET_RECALL * sums["all"]:
            break
    candidates = connected_components(None, edges).select(F.col("component").alias("bucket"), F.col("node").alias("member"))
    wanted = stored(candidates.join(classes.select("member", "least", "digest", "n"), "member"))
    few = wanted.count() <= BROADCAST_ROWS
    same = d["key"].eqNullSafe(wanted["least"]["key"]) & (d["text_h"] == wanted["least"]["text_h"])
    named = d.join(F.broadcast(wanted) if few else wanted, same).select("text", "digest", "member", "n")
    sets = named.mapInArrow(with_shingles, "member long, n long, shingles binary").dropDuplicates(["member"])
    found = stored(dealt(cells(wanted.select("bucket", "member")).join(sets, "member")).mapInArrow(verified, RESULT))
    links = found.where("kind = 0").groupBy("a").agg(F.sum("n").alias("links"))
    linked = found.where("kind = 1").select("a", "b")
    parts = connected_components(None, linked)
    least = parts.join(classes, parts["node"] == classes["member"]).groupBy("component").agg(F.min("least").alias("stays"))
    grouped = parts.join(least, "component").join(links, F.col("node") == F.col("a"), "left").select("node", "stays", F.coalesce("links", F.lit(0)).alias("links"))
    grouped = stored(grouped)
    info = classes.select("digest", "least", "n", "member").join(grouped, F.col("member") == F.col("node"), "left")
    info = info.select("digest", F.col("least.key").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("stays", "least").alias("stays"))
    out = rows.select("key", "text_h", "digest").join(info, "digest", "left")
    lone = F.col("digest").isNull()
    return out.select(
        F.col("key").alias(key), "text_h", F.when(lone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(lone, F.col("key")).otherwise(F.col("stays.key")).alias("component_id"),
        (lone | (F.col("key").eqNullSafe(F.col("stays.key")) & (F.col("text_h") == F.col("stays.text_h")))).alias("kept"),
    )


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, links and groups of near copies of ``documents``, one row each (see ``near_texts`` for nulls, empty texts, ties and repeats)."""
    return near_texts(read_table(spark, sf_dir, "documents")).drop("text_h")
