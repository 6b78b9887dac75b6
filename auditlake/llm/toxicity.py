"""Operator 7: toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon (well-known insults, and words and stems that labelled rows mark as toxic) is a trie. A Levenshtein
automaton of each text word walks the trie, so misspelt terms (a letter too many, lacking, changed, or two changed
about) are found without trying every term. Words that clean rows repeat are no misspellings, and a term among many
such words is met as it stands alone. Around each hit a window of words decides whether it is quoted or reported, or
aimed at someone. A logistic model over these features gives the score. It is fitted on a bounded sample of labelled rows and their misspelt copies, each row
described by terms that other rows taught, as terms look better on their own rows than on new ones.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import durable, read_table, stored, words_of

#: Common insults.
INSULTS = """asshole bastard bitch clown coward creep crap cretin cunt damn despicable dickhead disgusting dumbass filth fool freak fuck
garbage idiot imbecile jackass jerk liar loser lunatic moron motherfucker pathetic pig prick psycho retard scum shit slut stupid sucker
trash ugly vermin whore worthless""".split()
#: Words that make a hit a quotation or a report; words that aim it at someone.
REPORTED = frozenset(b"said says quote quoted quotes called wrote reported word term phrase according claims sagte schrieb zitat dit citation dijo cita".split())
AIMED = frozenset(b"you your yours youre he she they them are is du ihr dein sie tu vous ton votre eres usted tus".split())
TRAIN_ROWS = 20_000  # bound on the labelled rows that a model is fitted on
STEM_LENGTHS = (4, 5, 6)
MIN_ROWS = 4  # toxic rows that a learnt term needs
MIN_ODDS = 4.0  # log odds that a learnt term needs
FOLDS = 4  # parts of the labelled rows; weights are fitted on each part by the terms of the others
MAX_TERMS = 3000
MIN_CLEAN = 2  # clean rows that make a word beside a term one of its own
CROWDED = 4  # such words about a term that keep it out of the automaton
MAX_HARMLESS = 250_000  # of these words, the most frequent, over all folds
FUZZY_TERM, FUZZY_STEM = 5, 6  # letters from which terms and stems are met with one edit; most short words are near a shorter one
CONTEXT = 5
THRESHOLD = 0.3
CACHED_WORDS = 300_000


class Hit(NamedTuple):
    weight: float
    distance: int
    term: str = ""


class Trie:
    """Terms with weights; a term that ends in ``*`` is a stem, which any longer word may carry on."""

    def __init__(self, terms: dict[str, float]):
        self.root: dict = {}
        for term, weight in terms.items():
            node = self.root
            for c in term.rstrip("*"):
                node = node.setdefault(c, {})
            kind = "*" if term.endswith("*") else "$"
            node[kind] = max((weight, term), node.get(kind, (-math.inf, "")))

    def exact(self, word: str) -> Hit | None:
        node, best = self.root, None
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            if "*" in node and (best is None or node["*"][0] > best.weight):
                best = Hit(node["*"][0], 0, node["*"][1])
        if "$" in node and (best is None or node["$"][0] > best.weight):
            best = Hit(node["$"][0], 0, node["$"][1])
        return best

    def fuzzy(self, word: str, most: int) -> Hit | None:
        """The best term within ``most`` edits of the word, or stem within ``most`` edits of a beginning of it that the
        word carries on: states of the word's automaton, a row each, walked down the trie.

        A state is the row of edit distances between the trie path and every beginning of the word, with the row before
        it, from which two letters changed about are one edit; a branch ends where neither row can lead within the limit.
        Of equal distances the heaviest term is taken, of equal weights the last by name.
        """
        best: tuple | None = None
        stack = [(self.root, tuple(range(len(word) + 1)), None, "")]
        while stack:
            node, row, before, last = stack.pop()
            for kind, d in (("$", row[-1]), ("*", min(row[:-1], default=most + 1))):
                if kind in node and d <= most:
                    best = max(best, (-d, *node[kind])) if best else (-d, *node[kind])
            for c, below in node.items():
                if not isinstance(below, dict):
                    continue
                nxt = [row[0] + 1]
                for i, w in enumerate(word):
                    d = min(nxt[i] + 1, row[i + 1] + 1, row[i] + (w != c))
                    if before and i and w == last and word[i - 1] == c:
                        d = min(d, before[i - 1] + 1)
                    nxt.append(d)
                if min(nxt) <= most or min(row) < most:
                    stack.append((below, tuple(nxt), row, c))
        return best and Hit(best[1], -best[0], best[2])


FOLD = str.maketrans("013457@$", "oieastas")
#: Runs of word characters and the two signs that FOLD reads as letters, with one of these at least.
DISGUISED = re.compile(r"[\w@$]*[@$][\w@$]*")
#: Quoted passages of a line; each alternative stops at the next opening mark, so that a scan is linear.
QUOTES = re.compile("\"[^\"\n]*\"|“[^“”„\n]*”|„[^“”„\n]*[“”]|«[^«»\n]*»|»[^«»\n]*«|‘[^‘’\n]*’(?!\\w)")
#: Signs outside ASCII that part words as its own do: spaces, dashes, quotes, dots, inverted marks.
SIGNS = re.compile("[\u00a0-\u00bf\u2010-\u205e]")
#: What is left of a hit's weight inside quotes, and near a word of reporting.
QUOTED_SHARE, REPORTED_SHARE = 0.2, 0.5
FEATURES = 9


class Matcher:
    """Words to hits, with a bounded cache; one edit for terms of FUZZY_TERM letters and stems of FUZZY_STEM or more, but
    for those in ``crowded``. Words in ``harmless`` are no misspellings."""

    def __init__(self, terms: dict[str, float], harmless: frozenset[str] = frozenset(), crowded: frozenset[str] = frozenset()):
        self.trie, self.seen, self.harmless = Trie(terms), {}, harmless
        whole = {t for t in terms if not t.endswith("*") and len(t) >= FUZZY_TERM} - crowded
        stems = {t for t in terms if t.endswith("*") and len(t) > FUZZY_STEM} - crowded
        self.spelled = Trie({t: terms[t] for t in whole | stems})
        # Within one edit, a word and a term are equal once each lacks one letter or none
        self.whole, self.stems = ({v for t in ts for v in lacking(t.rstrip("*"))} for ts in (whole, stems))
        self.whole_ends, self.stem_ends = ends_of(whole), ends_of({t.rstrip("*") for t in stems})

    def near_a_term(self, word: str) -> bool:
        """False only where no spelled term is within one edit, and no spelled stem of a beginning."""
        n = len(word)
        for size, (first, last) in self.whole_ends.items():
            h = (size - 1) // 2
            if abs(size - n) <= 1 and (word[:h] in first or word[n - h :] in last) and not self.whole.isdisjoint(lacking(word)):
                return True
        for size, (first, last) in self.stem_ends.items():
            h = (size - 1) // 2
            starts = word[:h] in first
            for k in range(size - 1, min(size + 1, n) + 1):
                if (starts or word[k - h : k] in last) and not self.stems.isdisjoint(lacking(word[:k])):
                    return True
        return False

    def hits(self, words: list[bytes]) -> dict[bytes, Hit]:
        """The distinct words that hit, with their hits."""
        distinct = set(words)
        if len(self.seen) + len(distinct) > CACHED_WORDS:
            self.seen.clear()
        for w in distinct.difference(self.seen):
            self.seen[w] = self.find(w.decode("utf-8", "replace"))
        return {w: h for w in distinct if (h := self.seen[w]) is not None}

    def find(self, word: str) -> Hit | None:
        hit = self.trie.exact(word)
        if hit is None and len(word) >= FUZZY_TERM - 1:
            folded = word.translate(FOLD)
            if folded != word:
                hit = self.trie.exact(folded)
            if hit is None and folded not in self.harmless and self.near_a_term(folded):
                hit = self.spelled.fuzzy(folded, 1)
                hit = hit and hit._replace(weight=hit.weight * 0.5)
        return hit

    def unmasked(self, text: str) -> str:
        """The text with letters for '@' and '$' in words that are terms then; other words as they are."""
        def plain(found: re.Match) -> str:
            word = found[0].translate(FOLD)
            return word if any(self.trie.exact(w.decode("utf-8", "replace")) for w in words_of(word)) else found[0]

        return DISGUISED.sub(plain, text) if "@" in text or "$" in text else text


def lacking(word: str) -> list[str]:
    """The word, and it without each one of its letters."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


def ends_of(terms: set[str]) -> dict[int, tuple[set[str], set[str]]]:
    """By length, the first and the last (length - 1) // 2 letters of terms: one edit, two letters changed about
    included, leaves one of the two as it is, as a letter or more lies between them."""
    out: dict[int, tuple[set[str], set[str]]] = {}
    for t in terms:
        h, (first, last) = (len(t) - 1) // 2, out.setdefault(len(t), (set(), set()))
        first.add(t[:h])
        last.add(t[len(t) - h :])
    return out


def misspelt(word: str, rng: random.Random) -> str:
    """The word with one edit inside: a letter dropped, doubled, or changed about with the next."""
    i = rng.randrange(1, len(word) - 1)
    return [word[:i] + word[i + 1 :], word[: i + 1] + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :]][rng.randrange(3)]


def with_misspellings(text: str, m: Matcher) -> str:
    """The text with each whole term of FUZZY_TERM letters or more misspelt, by an edit that follows from the text."""
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))

    def changed(found: re.Match) -> str:
        hit = m.trie.exact(found[0].lower())
        return misspelt(found[0], rng) if hit and len(found[0]) >= FUZZY_TERM else found[0]

    return re.sub(r"\w+", changed, text)


def quoted_places(text: str) -> list[tuple[int, int]]:
    """Ranges of word places inside quotes; ``text`` is cut at the quotes, which part words."""
    out, at, n = [], 0, 0
    for q in QUOTES.finditer(text):
        n += len(words_of(SIGNS.sub(" ", text[at : q.start()])))
        inside = len(words_of(SIGNS.sub(" ", q[0])))
        out.append((n, n + inside))
        at, n = q.end(), n + inside
    return out


def features(text: str | None, m: Matcher) -> list[float]:
    """Counts and sums over a whole text's hits, each by its context; all 0 where none is.

    A hit counts whole, but QUOTED_SHARE of it inside quotes, REPORTED_SHARE where a word of reporting is within CONTEXT
    words, and both of these for both.
    """
    text = text and m.unmasked(text)
    words = words_of(text if not text or text.isascii() else SIGNS.sub(" ", text))
    found = m.hits(words)
    if not found:
        return [0.0] * FEATURES
    hits = [(i, found[w]) for i, w in enumerate(words) if w in found]
    quotes = quoted_places(text)
    starts = [a for a, _ in quotes]
    plain = near = said = aimed = inside = 0
    most = best = total = whole = 0.0
    for i, h in hits:
        around = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
        at = bisect_right(starts, i) - 1
        is_said, is_in = any(w in REPORTED for w in around), at >= 0 and i < quotes[at][1]
        share = (REPORTED_SHARE if is_said else 1.0) * (QUOTED_SHARE if is_in else 1.0)
        said += is_said
        inside += is_in
        aimed += any(w in AIMED for w in around) and not is_in
        near += share * (h.distance > 0)
        plain += share * (h.distance == 0)
        most = max(most, share)
        best = max(best, h.weight * share)
        total += h.weight * share
        whole += share
    n = len(hits)
    return [most, math.log1p(plain), math.log1p(near), said / n, inside / n, aimed / n, best / 10, math.log1p(total) / 3, min(1.0, 20 * whole / len(words))]


def held_out(keys: list) -> list[bool]:
    """crc32 of the key as text, modulo 4, is 2; a null key counts as the empty text."""
    return [zlib.crc32(b"" if k is None else str(k).encode()) % 4 == 2 for k in keys]


class Model(NamedTuple):
    terms: dict[str, float]
    weights: list[float]  # of the features, then the bias
    harmless: frozenset[str] = frozenset()
    crowded: frozenset[str] = frozenset()

    def matcher(self) -> Matcher:
        return Matcher(self.terms, self.harmless, self.crowded)


#: Which way each feature may move a score: hits up, reports and quotes down.
DIRECTIONS = np.array([1, 1, 1, -1, -1, 1, 1, 1, 1])


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights by projected descent, each of the sign in DIRECTIONS or 0, and the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + decay * np.r_[w[:-1], 0]
        w -= rate * g * 4
        w[:-1] = DIRECTIONS * np.maximum(DIRECTIONS * w[:-1], 0)
    return w


def term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch: rows of each fold that hold a word or a stem, and the toxic ones among them."""
    for b in batches:
        counts: dict[tuple[int, int], Counter] = {}
        for text, fold, toxic in zip(b["text"], b["fold"], b["toxic"]):
            words = {w.decode("utf-8", "replace") for w in words_of(text)}
            stems = {w[:k] + "*" for w in words for k in STEM_LENGTHS if len(w) > k}
            counts.setdefault((int(fold), int(toxic)), Counter()).update(words | stems)
        rows = [(t, fold, n, n * toxic) for (fold, toxic), c in counts.items() for t, n in c.items()]
        yield pd.DataFrame(rows, columns=["term", "fold", "n", "toxic"])


def telling(learnt: list[tuple[str, float, int]]) -> dict[str, float]:
    """Of (term, odds, toxic rows) those that tell something: a stem whose toxic rows exceed those of one longer
    term or stem by fewer than MIN_ROWS only repeats it."""
    counts = {t: n for t, _, n in learnt}
    most: dict[str, int] = {}  # by beginning, the toxic rows of the commonest longer term
    for t, n in counts.items():
        body = t.rstrip("*")
        for k in STEM_LENGTHS:
            if len(body) > k:
                most[body[:k] + "*"] = max(n, most.get(body[:k] + "*", 0))
    return {t: min(10.0, odds) for t, odds, n in learnt if not t.endswith("*") or n - most.get(t, 0) >= MIN_ROWS}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn terms and weights from at most TRAIN_ROWS labelled rows, none of them held out.

    The rows are those with the smallest seeded hash of key and text; rows equal in both count once. Neither language,
    source nor key is a feature. With no labelled row of one kind, the insults alone decide. At most MAX_TERMS terms are
    learnt, each by MIN_ROWS toxic rows and MIN_ODDS.
    """
    base = {t: 6.0 for t in INSULTS}
    known = labels.where(labels[label].isin(0, 1)).select(labels[key].alias("k"), labels[label].cast("int").alias("toxic"))
    known = known.where("k is not null and crc32(cast(cast(k as string) as binary)) % 4 <> 2")
    sample = known.dropDuplicates(["k"]).orderBy(F.xxhash64("k", F.lit(17)), "k").limit(TRAIN_ROWS)
    rows = docs.select(docs[key].alias("k"), docs[text].alias("text")).join(F.broadcast(sample), "k")  # TRAIN_ROWS at most
    rows = durable(rows.withColumn("h", F.xxhash64("text")).repartition(12, "k", "h").dropDuplicates(["k", "h"]))
    chosen = rows.select("k", "h").orderBy(F.xxhash64("k", "h", F.lit(17)), "k", "h").limit(TRAIN_ROWS)  # a key may have many texts
    rows = rows.join(F.broadcast(chosen), rows["k"].eqNullSafe(chosen["k"]) & rows["h"].eqNullSafe(chosen["h"]), "left_semi")
    rows = rows.select("text", "toxic", F.pmod(F.xxhash64("k", "h", F.lit(23)), F.lit(FOLDS)).cast("int").alias("fold"))
    kinds = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    size = [[sum(n for (f, x), n in kinds.items() if x == toxic and f != fold) for toxic in (0, 1)] for fold in range(FOLDS + 1)]
    good, bad = size[FOLDS]  # the last is of all folds
    if not bad or not good:
        return Model(base, [3.0] + [0.0] * (FEATURES - 1) + [-2.0])
    counted = rows.mapInPandas(term_counts, "term string, fold int, n long, toxic long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("t"),
        *(F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c[0]}{f}") for f in range(FOLDS) for c in ("n", "toxic")),
    )
    counted = stored(counted.where(F.col("n") >= min(MIN_ROWS, MIN_CLEAN)))

    def seen_without(fold: int) -> tuple[Column, Column, Column]:
        """Clean rows, toxic rows and log odds of a term where a fold is left out."""
        n, t = (F.col(c) - F.col(f"{c}{fold}") if fold < FOLDS else F.col(c) for c in "nt")
        return n - t, t, F.log(((t + 0.5) / (size[fold][1] + 1)) / ((n - t + 0.1) / (size[fold][0] + 1)))

    lexicons = []
    for fold in range(FOLDS + 1):
        _, t, odds = seen_without(fold)
        learnt = counted.select("term", t.alias("t"), odds.alias("odds")).where((F.col("t") >= MIN_ROWS) & (F.col("odds") >= MIN_ODDS))
        learnt = learnt.orderBy(F.desc(F.col("odds") * F.col("t")), "term").limit(MAX_TERMS).collect()  # MAX_TERMS at most
        lexicons.append(base | telling([(r["term"], float(r["odds"]), r["t"]) for r in learnt]))

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(fold, term, word, n) of words near a term of the lexicon without the fold."""
        matchers = [Matcher(terms) for terms in lexicons]
        for b in batches:
            hits = [(f, h.term, w, n) for w, n, own in zip(b["term"], b["n"], b["own"]) for f in own if (h := matchers[f].find(w)) and h.distance]
            yield pd.DataFrame(hits, columns=["fold", "term", "word", "n"])

    # Words of clean rows, not commoner by far among toxic ones
    own = [F.when((clean >= MIN_CLEAN) & (odds < MIN_ODDS), F.lit(f)) for f in range(FOLDS + 1) for clean, _, odds in [seen_without(f)]]
    own = counted.where(~F.col("term").endswith("*")).select("term", "n", F.array_compact(F.array(*own)).alias("own")).where(F.size("own") > 0)
    own = own.mapInPandas(beside, "fold int, term string, word string, n long").orderBy(F.desc("n"), "word", "fold").limit(MAX_HARMLESS).collect()
    models = []
    for fold, terms in enumerate(lexicons):
        about = Counter(r["term"] for r in own if r["fold"] == fold)
        models.append(Model(terms, [], frozenset(r["word"] for r in own if r["fold"] == fold), frozenset(t for t, n in about.items() if n >= CROWDED)))

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Features of each row and of its misspelt copy."""
        matchers = [m.matcher() for m in models[:FOLDS]]
        for b in batches:
            x, y = [], []
            for t, fold, toxic in zip(b["text"], b["fold"], b["toxic"]):
                one = features(t, matchers[fold])
                x += [one, features(with_misspellings(t, matchers[fold]), matchers[fold]) if any(one) else one]
                y += [float(toxic)] * 2
            yield pd.DataFrame({"x": x, "y": y})

    table = rows.mapInPandas(described, "x array<double>, y double").toPandas()  # 2 * TRAIN_ROWS of FEATURES numbers at most
    return models[FOLDS]._replace(weights=fit_logistic(np.array(table["x"].tolist()), table["y"].to_numpy()).tolist())


def score_toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, text_h (the text's hash), held_out, score, predicted (score >= THRESHOLD). Null and empty texts have no hit and score low.

    A map over the rows; repeated and null keys stay; other columns aren't read.
    """
    kind, w = dict(docs.dtypes)[key], np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.matcher()
        for b in batches:
            x = np.array([features(t, m) + [1.0] for t in b.column("text").to_pylist()]).reshape(b.num_rows, FEATURES + 1)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            cols = [b.column("key"), b.column("text_h"), pa.array(held_out(b.column("key").to_pylist()), pa.bool_()), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "text_h", "held_out", "score", "predicted"])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("text_h"))
    return rows.mapInArrow(run, f"key {kind}, text_h long, held_out boolean, score double, predicted int").withColumnRenamed("key", key)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of ``documents`` by a model of the labelled ones that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, read_table(spark, sf_dir, "labels"))).drop("text_h")
