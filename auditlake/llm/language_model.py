"""Operator 8: document log-likelihood under a gated recurrent language model.

A token's probability is its class's under the network times its own within the class, both by a softmax over the same
state. Frequent words are classes of their own, others share classes by their last letters. Within a shared class the
LEARNT most frequent words have output weights each; all others of the class share one slot, in which they follow their
training counts, with a Good-Turing share for words not seen. The network (GRU, numpy) is trained by truncated
backpropagation on all training documents, each in one of some rounds: every part of a round trains from the same
weights, and the parts' weights are averaged. Scoring carries the state across windows over whole documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import durable, read_table

CLASSES = 128
OWN = 64  # classes of one token: the end, then the most frequent words
HIDDEN = 20
LEARNT = 4096  # words of shared classes with output weights
HEAD = 100_000  # most frequent words, whose counts every task holds; the rest are joined
ROUNDS = 3
PART_TOKENS = 1_000_000  # of a part on average, whatever the number of shuffle partitions
STREAMS, WINDOW = 256, 16
RATE = 0.02
BATCH_DOCS, SCORE_WINDOW = 1024, 32
CACHED_ROWS = 256  # whose logits lie in a core's cache
SAFE_LOGIT = 60  # e to its power and to its negative are floats
FLUSH_WORDS = 3_000_000  # of texts whose words are counted together
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
END = b""  # no token of a text is empty


def tokens(text: str | None) -> list[bytes]:
    """White-space tokens with A-Z lower-cased, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").translate(LOWER).split(), END]


def shared_class(word: bytes) -> int:
    """Of a word without a class of its own: by its last letters."""
    return OWN + zlib.crc32(word[-3:]) % (CLASSES - OWN)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def words_of_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``tokens`` of all texts but for the ends, one after the other, and where each text's begin, then their number."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten().cast(pa.binary())
    full = pc.binary_length(words).to_numpy() > 0  # white space at a text's start or end leaves an empty word there
    return words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[split.offsets.to_numpy()]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Array] = []
    ends = 0

    def flushed() -> pa.RecordBatch:
        counts = pc.value_counts(pa.chunked_array(held, pa.binary()))
        words, c = counts.field("values"), counts.field("counts")
        if ends:
            words, c = pa.concat_arrays([words, pa.array([END], pa.binary())]), pa.concat_arrays([c, pa.array([ends], pa.int64())])
        return pa.RecordBatch.from_arrays([words, c], ["word", "c"])

    for b in batches:
        held.append(words_of_texts(b.column("text"))[0])
        ends += b.num_rows
        if sum(map(len, held)) > FLUSH_WORDS:
            yield flushed()
            held, ends = [], 0
    yield flushed()


# ---- the network ----------------------------------------------------------------------------------------------


def fresh(class_log: np.ndarray, slot_log: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """First weights, which give the shares by counts: of classes, and of the slots inside shared classes."""
    rng, slots = np.random.default_rng(8), np.zeros(0) if slot_log is None else slot_log
    return {
        "x": (rng.standard_normal((CLASSES, 3 * HIDDEN)) * 0.1).astype(np.float32),
        "u": (rng.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32),
        "v": (rng.standard_normal((HIDDEN, CLASSES)) * 0.05).astype(np.float32),
        "b": class_log.astype(np.float32),
        "w": np.zeros((len(slots), HIDDEN), np.float32),
        "c": slots.astype(np.float32),
    }


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in p.values()])


def parts_of(w: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Views of a flat array of weights."""
    out, at = {}, 0
    for k, a in like.items():
        out[k], at = w[at : at + a.size].reshape(a.shape), at + a.size
    return out


def unflat(w: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: a.astype(np.float32) for k, a in parts_of(w, like).items()}


def sigmoid(a: np.ndarray) -> np.ndarray:
    out = np.exp(-a)
    out += 1
    return np.reciprocal(out, out=out)


def cell(u: np.ndarray, x: np.ndarray, keeps: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One GRU step from the inputs' part ``x``; where ``keeps`` is 0 the state is cleared before."""
    h = h * keeps
    g = h @ u
    zr = sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    n = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
    return n + z * (h - n), h, g, z, r, n


def step(p: dict[str, np.ndarray], previous: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One GRU step; a document's first token follows an end, which clears the state."""
    return cell(p["u"], p["x"][previous], (previous != 0)[:, None], h)


def joined(weights: np.ndarray, constants: np.ndarray) -> tuple[np.ndarray, bool]:
    """Output weights (one row each) with their constants as last column, for states that end in a 1; whether exponentials of
    all logits are far from a float's limits, as states lie between -1 and 1."""
    out = np.concatenate([weights, constants[:, None]], axis=1)
    return out, not len(out) or float(np.abs(out).sum(axis=1).max()) < SAFE_LOGIT


def exponentials(hs: np.ndarray, out: np.ndarray, safe: bool, place: np.ndarray | None = None) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """Of the logits of ``hs``: those at ``place`` (of the flat array), the exponentials of all, and their sums by row."""
    e = np.dot(hs, out.T)
    if not safe:
        e -= e.max(axis=1, keepdims=True)
    picked = None if place is None else e.reshape(-1)[place]
    np.exp(e, out=e)
    return picked, e, np.dot(e, np.ones(len(out), e.dtype))


class Inside:
    """Logits of states inside the shared classes that their slots are in, class after class in one flat array.

    ``first`` has each shared class's first slot and, at last, the number of slots; a slot of -1 is none. ``rows`` are the
    states with one, by slot; ``place`` is where each one's own logit lies.
    """

    def __init__(self, hs: np.ndarray, slots: np.ndarray, first: np.ndarray, out: np.ndarray, safe: bool):
        rows = np.flatnonzero(slots >= 0)
        kind = np.int16 if first[-1] < 1 << 15 else np.int64  # short numbers sort faster
        self.rows = rows = rows[np.argsort(slots[rows].astype(kind), kind="stable")]  # slots of a class lie together
        slots, self.x, self.out = slots[rows], hs[rows], out
        cuts, sizes = np.searchsorted(slots, first), np.diff(first)
        of = np.repeat(np.arange(len(sizes)), np.diff(cuts))
        ends = np.cumsum(sizes[of])
        self.starts = ends - sizes[of]
        self.place = self.starts + slots - first[of]
        self.e, self.met = np.empty(ends[-1] if len(ends) else 0, hs.dtype), []
        at = 0
        for a, b, low, high in zip(cuts.tolist(), cuts[1:].tolist(), first.tolist(), first[1:].tolist()):
            if a < b:
                e = self.e[at : at + (b - a) * (high - low)].reshape(b - a, high - low)
                at += e.size
                np.dot(self.x[a:b], out[low:high].T, out=e)
                if not safe:
                    e -= e.max(axis=1, keepdims=True)
                self.met.append((e, slice(a, b), slice(low, high)))

    def exponentials(self) -> np.ndarray:
        """Makes all logits their exponentials; the sum of each row."""
        np.exp(self.e, out=self.e)
        return np.add.reduceat(self.e, self.starts) if len(self.starts) else self.e


def gradients(
    p: dict[str, np.ndarray], previous: np.ndarray, target: np.ndarray, h: np.ndarray, slots: np.ndarray | None = None, first: np.ndarray | None = None
) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Backpropagation through one window (streams x steps), truncated at its start; the state it ends with.

    A target of -1 is filling and teaches nothing. ``slots`` are the targets' slots inside their classes, -1: none.
    """
    streams, steps = previous.shape
    before, after = (np.empty((steps, streams, HIDDEN), h.dtype) for _ in "ba")
    zs, rs, ns, gs = (np.empty_like(after) for _ in "zrng")
    xs, keeps = p["x"][previous.T], (previous.T != 0).astype(h.dtype)[:, :, None]
    for t in range(steps):
        h, before[t], g, zs[t], rs[t], ns[t] = cell(p["u"], xs[t], keeps[t], h)
        after[t], gs[t] = h, g[:, 2 * HIDDEN :]
    hs = np.ones((steps * streams, HIDDEN + 1), h.dtype)
    hs[:, :HIDDEN] = after.reshape(-1, HIDDEN)
    wanted = target.T.ravel()
    n_wanted = max(1, int((wanted >= 0).sum()))
    taught = (wanted >= 0).astype(h.dtype) / n_wanted
    dhs, grad = np.empty_like(hs), {}
    out, safe = joined(p["v"].T, p["b"])
    d_out = np.zeros_like(out)
    for at in range(0, len(hs), CACHED_ROWS):
        here = slice(at, at + CACHED_ROWS)
        own = np.maximum(wanted[here], 0)
        place = np.arange(len(own)) * len(out) + own
        _, e, total = exponentials(hs[here], out, safe)
        e.reshape(-1)[place] -= total
        scale = (taught[here] / total)[:, None]
        d_out += e.T @ (hs[here] * scale)
        dhs[here] = (e @ out) * scale
    grad["v"], grad["b"] = d_out[:, :HIDDEN].T, d_out[:, HIDDEN]
    out, safe = joined(p["w"], p["c"])
    d_out = np.zeros_like(out)
    if slots is not None:
        own = Inside(hs, slots.T.ravel(), first, out, safe)
        total = own.exponentials()
        own.e[own.place] -= total
        scale = (1 / (total * n_wanted))[:, None]
        x, dx = own.x * scale, np.empty_like(own.x)
        for e, here, at in own.met:
            np.dot(e.T, x[here], out=d_out[at])
            np.dot(e, out[at], out=dx[here])
        dx *= scale
        dhs[own.rows] += dx
    grad["w"], grad["c"] = d_out[:, :HIDDEN], d_out[:, HIDDEN]
    dhs = np.ascontiguousarray(dhs[:, :HIDDEN]).reshape(steps, streams, HIDDEN)
    to_n, to_z, to_r = (1 - zs) * (1 - ns * ns), (before - ns) * zs * (1 - zs), gs * rs * (1 - rs)
    inputs, inner = (np.empty((steps, streams, 3 * HIDDEN), hs.dtype) for _ in "ix")
    back, dh = np.ascontiguousarray(p["u"].T), np.zeros_like(h)
    zs *= keeps
    for t in range(steps - 1, -1, -1):
        dh += dhs[t]
        dn, dx = inputs[t, :, 2 * HIDDEN :], inner[t]
        np.multiply(dh, to_n[t], out=dn)
        np.multiply(dh, to_z[t], out=dx[:, :HIDDEN])
        np.multiply(dn, to_r[t], out=dx[:, HIDDEN : 2 * HIDDEN])
        np.multiply(dn, rs[t], out=dx[:, 2 * HIDDEN :])
        dh *= zs[t]
        dh += (dx @ back) * keeps[t]
    inputs[:, :, : 2 * HIDDEN] = inner[:, :, : 2 * HIDDEN]
    grad["u"] = before.reshape(-1, HIDDEN).T @ inner.reshape(-1, 3 * HIDDEN)
    seen = previous.T.ravel()
    order = np.argsort(seen, kind="stable")
    starts = np.flatnonzero(np.diff(seen[order], prepend=-1))
    grad["x"] = np.zeros_like(p["x"])
    grad["x"][seen[order][starts]] = np.add.reduceat(inputs.reshape(-1, 3 * HIDDEN)[order], starts)
    return {k: grad[k] for k in p}, h


def train(p: dict[str, np.ndarray], classes: np.ndarray, slots: np.ndarray | None = None, first: np.ndarray | None = None, rate: float = RATE) -> dict[str, np.ndarray]:
    """One pass over a sequence of classes (documents with their ends), as parallel streams, the last filled up, by Adam."""
    n = -(-(len(classes) - 1) // STREAMS)
    filling = np.full(STREAMS * n + 1 - len(classes), -1, np.int16)
    classes = classes.astype(np.int16)
    w = flat(p)
    m, v, g, new, p = *(np.zeros_like(w) for _ in range(4)), parts_of(w, p)
    h, at = np.zeros((STREAMS, HIDDEN), np.float32), 0
    target = np.concatenate([classes[1:], filling]).reshape(STREAMS, n)
    previous = np.concatenate([classes[:-1], filling * 0]).reshape(STREAMS, n)
    inner = None if slots is None else np.concatenate([slots[1:], filling]).reshape(STREAMS, n)
    for t in range(0, n, WINDOW):
        here = slice(t, t + WINDOW)
        grad, h = gradients(p, previous[:, here], target[:, here], h, None if inner is None else inner[:, here], first)
        at += 1
        g = np.concatenate([x.ravel() for x in grad.values()], out=g)
        np.divide(g, np.float32(max(1.0, float(np.sqrt(g @ g)))), out=g)
        m *= np.float32(0.9)
        m += np.multiply(g, np.float32(0.1), out=new)
        v *= np.float32(0.999)
        np.multiply(g, np.float32(0.001), out=new)
        v += np.multiply(new, g, out=new)
        np.divide(v, np.float32(1 - 0.999**at), out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-8)
        np.divide(m, np.float32(1 - 0.9**at), out=new)
        new *= np.float32(rate)
        new /= g
        w -= new
    return p


def class_scores(p: dict[str, np.ndarray], docs: list[np.ndarray], slots: list[np.ndarray] | None = None, first: np.ndarray | None = None) -> np.ndarray:
    """Natural log-probability of each document's classes and slots, its state carried from window to window."""
    scores = np.zeros(len(docs))
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    (out, safe), (inner_out, inner_safe) = joined(p["v"].T, p["b"]), joined(p["w"], p["c"])
    for at in range(0, len(order), BATCH_DOCS):
        part = order[at : at + BATCH_DOCS]
        lengths = np.array([len(docs[i]) for i in part])
        h, total, last = np.zeros((len(part), HIDDEN), np.float32), np.zeros(len(part)), np.zeros(len(part), np.int64)
        for start in range(0, int(lengths[0]), SCORE_WINDOW):
            live = int((lengths > start).sum())
            width = min(SCORE_WINDOW, int(lengths[0]) - start)
            target, inner = np.zeros((live, width), np.int16), np.full((live, width), -1, np.int32)
            for r in range(live):
                piece = docs[part[r]][start : start + width]
                target[r, : len(piece)] = piece
                if slots is not None:
                    inner[r, : len(piece)] = slots[part[r]][start : start + width]
            target, inner = np.ascontiguousarray(target.T), np.ascontiguousarray(inner.T)
            previous = np.concatenate([last[None, :live], target[:-1]])
            keeps = (previous != 0).astype(np.float32)[:, :, None]
            states = np.ones((width, live, HIDDEN + 1), np.float32)
            on = (lengths[:live] > start + np.arange(width)[:, None]).sum(axis=1).tolist()
            for t, k in enumerate(on):
                h[:k] = cell(p["u"], p["x"][previous[t, :k]], keeps[t, :k], h[:k])[0]
                states[t, :k, :HIDDEN] = h[:k]
            there = np.flatnonzero(np.arange(live) < np.array(on)[:, None])
            hs = states.reshape(-1, HIDDEN + 1)
            hs, wanted, rows = hs if len(there) == len(hs) else hs[there], target.ravel()[there].astype(np.int64), there % live
            picked, sums = np.empty(len(hs), hs.dtype), np.empty(len(hs), hs.dtype)
            for i in range(0, len(hs), CACHED_ROWS):
                here = slice(i, i + CACHED_ROWS)
                own = wanted[here]
                picked[here], _, sums[here] = exponentials(hs[here], out, safe, np.arange(len(own)) * len(out) + own)
            picked -= np.log(sums)
            if slots is not None:
                met = Inside(hs, inner.ravel()[there], first, inner_out, inner_safe)
                own = met.e[met.place]
                picked[met.rows] += own - np.log(met.exponentials())
            total += np.bincount(rows, picked.astype(np.float64), minlength=len(part))
            last[:live] = target[-1]
        scores[part] = total
    return scores


# ---- Spark ----------------------------------------------------------------------------------------------------


class Head:
    """The most frequent words: counts and classes by index, to be sent to every task."""

    def __init__(self, words: list[bytes], counts: list[int]):
        own = {w: i + 1 for i, w in enumerate([w for w in words if w != END][: OWN - 1])}
        self.own = own
        self.index = {w: i for i, w in enumerate(words)}
        self.words = pa.array(words, pa.binary())
        self.counts = np.array(counts, np.float64)
        self.classes = np.array([self.class_of(w) for w in words], np.int64)
        shared = np.flatnonzero(self.classes >= OWN)
        learnt = shared[:LEARNT]
        sizes = 1 + np.bincount(self.classes[learnt] - OWN, minlength=CLASSES - OWN)
        #: First slot of each shared class (that of its other words), then the number of slots.
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.slots = np.where(self.classes >= OWN, self.first[np.maximum(self.classes - OWN, 0)], -1)
        order = learnt[np.argsort(self.classes[learnt], kind="stable")]
        self.slots[order] = np.setdiff1d(np.arange(self.first[-1]), self.first[:-1])
        self.learnt = np.zeros(len(words), bool)
        self.learnt[learnt] = True

    def slot_log(self, others: np.ndarray) -> np.ndarray:
        """Logarithms of the slots' training counts, given those of each shared class's words without a slot of their own."""
        mass = np.zeros(self.first[-1])
        mass[self.first[:-1]] = others
        mass[self.slots[self.learnt]] = self.counts[self.learnt]
        return np.log(mass + 0.5)

    def other_of(self, word: bytes) -> int:
        """The shared class in whose common slot a word lies; -1: none, as it has a class or a slot of its own."""
        k, at = self.class_of(word), self.index.get(word)
        return -1 if k < OWN or (at is not None and self.learnt[at]) else k

    def class_of(self, word: bytes) -> int:
        return 0 if word == END else self.own.get(word) or shared_class(word)


class Sequences:
    """A batch's texts as tokens with their ends: ``classes``; ``slots`` in them (-1: none); indices ``found`` into the head (-1:
    none). ``offsets`` has each text's first token and, at last, their number; ``rare`` are the places of the ``rare_tokens``,
    which are not in the head."""

    def __init__(self, texts: pa.Array, head: Head):
        words, starts = words_of_texts(texts)
        self.offsets = starts + np.arange(len(starts))
        ends = self.offsets[1:] - 1
        inner = np.ones(self.offsets[-1], bool)
        inner[ends] = False
        looked_up = pc.index_in(words, value_set=head.words)
        self.found = np.empty(len(inner), np.int64)
        self.found[inner] = pc.fill_null(looked_up, -1).to_numpy()
        self.found[ends] = head.index.get(END, -1)
        self.rare_tokens = words.filter(looked_up.is_null())
        ending = pc.binary_slice(self.rare_tokens, -3).dictionary_encode()  # words with classes of their own are in the head
        kinds = np.array([shared_class(x) for x in ending.dictionary.to_pylist()], np.int64)[ending.indices.to_numpy()]
        if len(head.classes):
            self.classes, self.slots = head.classes[self.found], head.slots[self.found]
        else:
            self.classes, self.slots = np.zeros(len(inner), np.int64), np.full(len(inner), -1)
        self.rare = np.flatnonzero(inner)[self.found[inner] < 0]
        self.classes[self.rare] = kinds
        self.slots[self.rare] = np.where(kinds >= OWN, head.first[np.maximum(kinds - OWN, 0)], -1)
        self.classes[ends], self.slots[ends] = 0, -1

    def sums(self, of_head: np.ndarray) -> np.ndarray:
        """Of each text the sum of its tokens' values, those not in the head having none."""
        values = np.append(of_head, 0)[self.found]
        return np.add.reduceat(values, self.offsets[:-1]) if len(self.offsets) > 1 else values

    def rare_words(self) -> pa.ListArray:
        """Of each text its distinct rare words (word, times, class k)."""
        words = self.rare_tokens.dictionary_encode()
        n, which = max(1, len(words.dictionary)), words.indices.to_numpy()
        kinds = np.zeros(n, np.int32)
        kinds[which] = self.classes[self.rare]
        text = np.searchsorted(self.offsets, self.rare, "right") - 1
        pairs, times = np.unique(text * n + which, return_counts=True)
        which = pairs % n
        cols = [words.dictionary.take(pa.array(which)), pa.array(times, pa.int32()), pa.array(kinds[which])]
        at = np.searchsorted(pairs // n, np.arange(len(self.offsets)))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(cols, ["word", "times", "k"]))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Up to ``most`` words with their counts, the most frequent first; a step of counts that doesn't fit whole stays out.

    Steps are eighths of a doubling, so that a few hundred rows say how far down ``most`` words reach, and no more than
    these words come to the driver.
    """
    step = F.floor(F.log2("c") * 8).cast("int")
    fits, floor = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        fits += r["n"]
        if fits > most:
            break
        floor = r["step"]
    if floor is None:
        return []
    rows = counts.where(step >= floor).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on rows whose crc32(key as text) mod 5 is not 1 (a null key counts as the empty text). Null texts are
    empty: their one token is the end. Repeated rows count and are scored each; other columns aren't read. Without a
    training row every token is unknown, and base and model give what is left. Counts cover all training rows;
    HEAD words and the classes' sums are the only counts held by a task, rarer words are joined by word.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    d = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    training = d.where(~held_out(F.col("key")))
    counts = training.select("text").mapInArrow(count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = durable(counts)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, HEAD)
    head = Head([w for w, _ in top], [c for _, c in top])
    sent = spark.sparkContext.broadcast(head)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = sent.value
        for b in batches:
            words, c = b.column("word").to_pylist(), b.column("c").to_numpy(zero_copy_only=False)
            k, other = (np.fromiter(map(f, words), np.int64, b.num_rows) for f in (h.class_of, h.other_of))
            at = other[other >= 0]
            sums = [np.bincount(k, c, CLASSES), np.bincount(at, c[other >= 0], CLASSES), np.bincount(at, c[other >= 0] == 1, CLASSES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), *(pa.array(x.astype(np.int64)) for x in sums)], ["k", "c", "others", "ones"])

    added = [F.sum(x).alias(x) for x in ("c", "others", "ones")]
    sums = counts.mapInArrow(by_class, "k long, c long, others long, ones long").groupBy("k").agg(*added).collect()  # CLASSES rows
    mass, others, ones = np.zeros(CLASSES), np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        mass[r["k"]], others[r["k"]], ones[r["k"]] = r["c"], r["others"], r["ones"]
    #: Of a class's common slot: the share of words not seen.
    unseen = np.where(others > 0, (ones + 0.5) / (others + 1), 1.0)
    start = fresh(np.log((mass + 0.5) / (mass.sum() + 0.5 * CLASSES)), head.slot_log(others[OWN:]))
    weights = fit_network(training, n, sent, start)
    denominator = n + 0.5 * (v + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        head_base = np.log10((head.counts + 0.5) / denominator)
        common = (head.classes >= OWN) & ~head.learnt
        head_word = np.where(common, np.log10((1 - unseen[head.classes]) * head.counts / others[head.classes]), 0.0) if len(top) else head.counts

    ones_of_head = np.ones(len(head_base), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, p = sent.value, unflat(weights, start)
        for b in batches:
            if not b.num_rows:
                continue
            met = Sequences(b.column("text"), h)
            cuts = met.offsets[1:-1]
            logs = class_scores(p, np.split(met.classes.astype(np.int16), cuts), np.split(met.slots.astype(np.int32), cuts), h.first) / np.log(10)
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(np.diff(met.offsets)), pa.array(met.sums(ones_of_head)), pa.array(met.sums(head_base)),
                 pa.array(met.sums(head_word) + logs), met.rare_words()],
                ["key", "n_tokens", "known", "base", "score", "rare"],
            )

    schema = f"key {kind}, n_tokens long, known long, base double, score double, rare array<struct<word:binary,times:int,k:int>>"
    rows = durable(d.mapInArrow(run, schema)).withColumn("row", F.monotonically_increasing_id())
    table = [(k, float(others[k]), float(unseen[k])) for k in range(CLASSES)]
    classes = F.broadcast(spark.createDataFrame(table, "k int, others double, unseen double"))  # CLASSES rows
    rare = rows.select("row", F.explode("rare").alias("x")).select("row", "x.*").join(counts, "word", "left").join(classes, "k")
    c = F.coalesce("c", F.lit(0))
    word = F.when(c > 0, F.log10((1 - F.col("unseen")) * c / F.col("others"))).otherwise(F.log10("unseen"))
    rare = rare.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(float(denominator)))).alias("more_base"),
        F.sum(F.col("times") * word).alias("more_score"),
    )
    return rows.drop("rare").join(rare, "row", "left").select(
        F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def fit_network(training: DataFrame, n: int, sent, weights: dict[str, np.ndarray]) -> np.ndarray:
    """ROUNDS of parallel training and averaging over the n tokens; each document is in one round."""
    current = flat(weights)
    rounds = training.withColumn("round", F.pmod(F.xxhash64("key", "text", F.lit(8)), F.lit(ROUNDS)))
    parts = max(1, -(-n // (ROUNDS * PART_TOKENS)))
    for number in range(ROUNDS):
        start = current

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            head = sent.value
            texts = [Sequences(b.column("text"), head) for b in batches if b.num_rows]
            if not texts:
                return
            classes = np.concatenate([np.zeros(1, np.int64), *(x.classes for x in texts)])
            slots = np.concatenate([np.full(1, -1), *(x.slots for x in texts)])
            w = flat(train(unflat(start, weights), classes, slots, head.first, RATE / 2**number))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w))), pa.array(w), pa.array(np.full(len(w), float(len(classes))))], ["at", "w", "n"])

        trained = rounds.where(F.col("round") == number).select("text").repartition(parts).mapInArrow(run, "at long, w float, n double")
        mean = trained.groupBy("at").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).toArrow()  # one row a weight, fixed by the model's size
        if mean.num_rows:
            current = mean.sort_by("at").column("w").to_numpy()
    return current


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihoods of ``documents`` by the base and the model, one row each (see ``score_documents`` for nulls, empty texts and repeats)."""
    return score_documents(read_table(spark, sf_dir, "documents"))
