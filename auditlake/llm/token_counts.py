"""Operator 13: token counts of a byte-level BPE vocabulary by merging many pre-tokens at once in ragged arrays.

The pre-tokens of a batch lie one after the other in a flat array of symbols, with the rank of every adjacent pair beside
it. In each step every sequence that can still merge applies its lowest rank at all its places, leftmost first where
they overlap; only ranks next to a merge are looked up again. A sequence without a pair that merges leaves with the
number of its symbols. Applying a rank at all places at once equals merging one place after the other where each
token is made by one merge, later than the tokens it is made of; other vocabularies merge one place a step.
"""

from __future__ import annotations

import gc
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.bpe import byte_symbols
from auditlake.llm.common import read_table

LIMIT = 1024
SLICE_BYTES = 2 << 20  # text whose new segments are merged together
CACHED_SEGMENTS = 1_000_000  # per Python worker
CACHED_BYTES = 100  # longer segments are counted again each time
LONG_PIECE = 4096  # bytes; a longer pre-token takes a heap in place of a step for each of its ranks
NEVER = np.int64(1 << 40)
SLOTS = 18  # bits of the pair table's slots
SPREAD = np.uint64(0x9E3779B97F4A7C15)
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class PairRanks:
    """Merge ranks of symbol pairs in an open-addressed table of numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, symbols: int):
        self.symbols = np.uint64(symbols)
        bits = max(SLOTS, int(4 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(1 << bits, NEVER, np.int64)
        keys, first = np.unique(left.astype(np.uint64) * self.symbols + right.astype(np.uint64), return_index=True)
        slots = self.home(keys)
        while len(keys):  # each round places one key in every free slot that is asked for
            free = self.keys[slots] == np.iinfo(np.uint64).max
            _, one = np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)
            one = one[free[one]]
            self.keys[slots[one]], self.ranks[slots[one]] = keys[one], first[one]
            left_over = np.ones(len(keys), bool)
            left_over[one] = False
            keys, first, slots = keys[left_over], first[left_over], (slots[left_over] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * SPREAD) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NEVER where they don't merge."""
        keys = left.astype(np.uint64) * self.symbols + right.astype(np.uint64)
        slots = self.home(keys)
        there, out = self.keys[slots], self.ranks[slots]
        wrong = np.flatnonzero(there != keys)
        out[wrong] = NEVER
        wrong = wrong[self.ranks[slots[wrong]] != NEVER]  # an empty slot ends the search
        while len(wrong):
            slots[wrong] = (slots[wrong] + 1) & self.mask
            at = slots[wrong]
            right_one = self.keys[at] == keys[wrong]
            out[wrong[right_one]] = self.ranks[at[right_one]]
            wrong = wrong[~right_one & (self.ranks[at] != NEVER)]
        return out


class RaggedBpe:
    """Counts the tokens of pre-tokens and texts for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, cached: int = CACHED_SEGMENTS):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        self.byte_ids = np.array([vocab[s] for s in byte_symbols()], np.int64)
        left, right, made = (np.array([vocab[x] for x in part], np.int64) for part in zip(*((a, b, a + b) for a, b in merges)))
        self.pairs, self.made = PairRanks(left, right, max(vocab.values()) + 1), made
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        born[made] = np.arange(len(made))
        order = np.arange(len(made))
        self.at_once = len(np.unique(made)) == len(made) and bool(((born[left] < order) & (born[right] < order)).all())
        special = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = [s.encode() for s in special]
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.assigned: set[str] = set()
        self.cached, self.young, self.old = cached, {}, {}

    def merge_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = lengths.copy()
        for i in np.flatnonzero(lengths > LONG_PIECE).tolist():
            out[i] = self.heap_count(pieces[i])
        several = np.flatnonzero((lengths > 1) & (lengths <= LONG_PIECE))
        if not len(several):
            return out
        flat = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in several.tolist()]), np.uint8)]
        lengths = lengths[several]
        ends = np.cumsum(lengths)
        ranks = np.full(len(flat), NEVER, np.int64)
        inner = np.ones(len(flat), bool)  # of a pair within one sequence: all symbols but the last
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        ranks[at] = self.pairs.of(flat[at], flat[at + 1])
        while True:
            least = np.minimum.reduceat(ranks, ends - lengths)
            goes_on = least != NEVER
            out[several[~goes_on]] = lengths[~goes_on]
            if not goes_on.any():
                return out
            if not goes_on.all():
                stay = np.repeat(goes_on, lengths)
                flat, ranks, inner = flat[stay], ranks[stay], inner[stay]
                several, lengths, least = several[goes_on], lengths[goes_on], least[goes_on]
            of = np.repeat(np.arange(len(several)), lengths)
            at = np.flatnonzero(ranks == least[of])
            if self.at_once:
                begins = np.concatenate([[True], np.diff(at) != 1])  # of runs of places that overlap; every other one merges
                at = at[(at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0]
            else:
                at = at[np.concatenate([[True], np.diff(of[at]) != 0])]
            flat[at] = self.made[ranks[at]]
            inner[at] = inner[at + 1]
            stay = np.ones(len(flat), bool)
            stay[at + 1] = False
            lengths = lengths - np.bincount(of[at], minlength=len(several))
            ends = np.cumsum(lengths)
            at = at - np.arange(len(at))  # each merge before it took one symbol away
            flat, ranks, inner = flat[stay], ranks[stay], inner[stay]
            ranks[at] = NEVER
            again = np.unique(np.concatenate([at, at[at > 0] - 1]))
            again = again[inner[again]]
            ranks[again] = self.pairs.of(flat[again], flat[again + 1])

    def heap_count(self, piece: bytes) -> int:
        """Tokens of one long pre-token: least rank first, leftmost among equals, in n log n steps."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        n, never = len(ids), int(NEVER)
        firsts = self.pairs.of(ids[:-1], ids[1:]).tolist()
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = [*firsts, never]
        heap = [(r, i) for i, r in enumerate(firsts) if r != never]
        heapq.heapify(heap)
        left = n
        known: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.pairs.of(np.array([a]), np.array([b]))[0])
            return known[a, b]

        while heap:
            r, i = heapq.heappop(heap)
            if ranks[i] != r:
                continue
            j = after[i]
            ids[i], after[i], ranks[j] = int(self.made[r]), after[j], never
            left -= 1
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0:
                    ranks[a] = rank(ids[a], ids[b]) if b < n else never
                    if ranks[a] != never:
                        heapq.heappush(heap, (ranks[a], a))
        return left

    def pieces(self, raw: bytes) -> tuple[list[bytes], int]:
        """Pre-tokens of a segment, and how many special tokens stand between them."""
        text = raw.decode("utf-8", "surrogatepass")
        split = PIECES.findall
        if not raw.isascii() and not self.assigned.issuperset(text):
            newer = {c for c in text if unicodedata.category(c) == "Cn"}
            self.assigned |= set(text) - newer
            if newer:  # than Python's tables: the library's own tables decide
                split = self.newer
        if self.special is None or not any(m in raw for m in self.marks):
            return [p.encode("utf-8", "surrogatepass") for p in split(text)], 0
        parts = self.special.split(text)
        return [p.encode("utf-8", "surrogatepass") for part in parts for p in split(part)], len(parts) - 1

    def newer(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def counts(self, texts: list[bytes | None]) -> list[int]:
        """Tokens of each text (UTF-8); null counts as empty.

        A text is cut at single spaces between characters that are no white space: no pre-token crosses them, so a
        segment's count, kept in a bounded cache, doesn't depend on what is around it.
        """
        if len(self.young) >= self.cached // 2:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, {}
        found = []
        for raw in texts:
            # A segment goes by its bytes after the space, one that holds spaces or begins the text by a space and all its bytes
            keys = raw.split(b" ") if raw else []
            got = list(map(young.get, keys))
            holes = []
            if keys:
                got[0] = None
                unsafe = [i for i, g in enumerate(got) if g is None and not self.cuts(keys[i], i, old)]
                if unsafe:
                    keys = glued(keys, unsafe)
                    got = list(map(young.get, keys))
                else:
                    keys[0] = b" " + keys[0]
                    got[0] = young.get(keys[0])
                for i in [i for i, g in enumerate(got) if g is None] if None in got else []:
                    if (g := old.get(keys[i])) is not None:
                        got[i] = young[keys[i]] = g
                    else:
                        new[keys[i]] = 0
                        holes.append(i)
            found.append((keys, got, holes))
        if new:
            new = self.learn(list(new))
            for keys, got, holes in found:
                for i in holes:
                    got[i] = new[keys[i]]
            young.update((k, n) for k, n in new.items() if len(k) < CACHED_BYTES)
        return [sum(got) for _, got, _ in found]

    @staticmethod
    def cuts(key: bytes, i: int, old: dict[bytes, int]) -> bool:
        """Whether the spaces on both sides of a segment are cuts: it begins and ends without white space."""
        if i and key in old:
            return True
        text = key.decode("utf-8", "surrogatepass")
        return bool(text) and not text[0].isspace() and not text[-1].isspace()

    def learn(self, keys: list[bytes]) -> dict[bytes, int]:
        own: dict[bytes, int] = {}
        special, of, which = np.zeros(len(keys), np.int64), [], []
        for k, key in enumerate(keys):
            pieces, special[k] = self.pieces(key[1:] if key[:1] == b" " else b" " + key)
            for p in pieces:
                of.append(k)
                which.append(own.setdefault(p, len(own)))
        counts = self.merge_counts(list(own))
        total = special + np.bincount(np.array(of, np.int64), weights=counts[np.array(which, np.int64)], minlength=len(keys)).astype(np.int64)
        return dict(zip(keys, total.tolist()))


def glued(keys: list[bytes], unsafe: list[int]) -> list[bytes]:
    """A text's segments joined up again where a space beside one of ``unsafe`` is no cut; those, and the first, get their mark."""
    out: list[bytes] = []
    done = i = 0
    while i < len(unsafe):
        first, last = max(unsafe[i] - 1, 0), unsafe[i] + 1
        while i + 1 < len(unsafe) and unsafe[i + 1] - 1 <= last:
            i += 1
            last = unsafe[i] + 1
        out += keys[done:first]
        out.append((b"  " if first else b" ") + b" ".join(keys[first : last + 1]))
        done, i = last + 1, i + 1
    out += keys[done:]
    if unsafe[0] > 1:
        out[0] = b" " + out[0]
    return out


@lru_cache(maxsize=2)
def ragged_bpe(path: str) -> RaggedBpe:
    """One vocabulary and cache for each Python worker and file."""
    return RaggedBpe(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text.

    Null and empty texts have no bytes and no tokens. One row comes out for each row in, in any order; repeated and null
    keys stay; other columns are not read. A map over the rows without a shuffle; a task holds one Arrow batch, the
    merges of SLICE_BYTES of text (or of one longer text) and the worker's bounded cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ragged_bpe(path)
        gc.disable()  # the cache is large and holds no cycles
        try:
            for b in batches:
                sizes, counts, held, bytes_held = [], [], [], 0
                for raw in b.column("text").cast(pa.binary()):
                    held.append(raw.as_py())
                    sizes.append(len(held[-1] or b""))
                    bytes_held += sizes[-1]
                    if bytes_held >= SLICE_BYTES:
                        counts += bpe.counts(held)
                        held, bytes_held = [], 0
                counts += bpe.counts(held)
                n = pa.array(counts, pa.int64())
                cols = [b.column("key"), pa.array(sizes, pa.int64()), n, pa.array(np.array(counts, np.int64) > limit, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "n_bytes", "n_tokens", "over_limit"])
        finally:
            gc.enable()

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"key {dict(docs.dtypes)[key]}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of ``documents``, one row each (see ``count_tokens`` for nulls, empty texts and repeats)."""
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
