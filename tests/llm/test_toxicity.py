"""The toxicity operator through its automaton: distances, misspellings in scores, harmless neighbours, bounds."""

import random

import numpy as np

from auditlake.llm import toxicity
from auditlake.llm.toxicity import FEATURES, INSULTS, Matcher, Trie, features, fit, misspelt, score_toxicity, telling

VOCABULARY = [c + v + e for c in "bdfgklmnprt" for v in "aeiou" for e in ("lan", "mer", "sto", "nik", "dos")]


def plain_distance(a, b):
    """Edits of one letter, or two neighbours changed about once, by the whole table."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def edited(rng, word, edits):
    for _ in range(edits):
        i = rng.randrange(len(word) + 1)
        c = rng.choice("aeiost")
        word = rng.choice([word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + word[i : i + 2][::-1] + word[i + 2 :]])
    return word


def test_automaton_equals_plain_distances_to_the_whole_lexicon():
    rng = random.Random(1)
    terms = {t: 6.0 for t in INSULTS} | {"grobna*": 5.0, "dummko*": 4.0, "crétine": 5.0}
    trie = Trie(terms)
    words = [edited(rng, rng.choice([t.rstrip("*") + rng.choice(["", "xy"]) for t in terms]), k) for k in (0, 1, 2, 3) for _ in range(60)]
    for w in words:
        for most in (1, 2):
            want = []
            for t in terms:
                body = t.rstrip("*")
                d = plain_distance(w, body) if body == t else min((plain_distance(w[:n], body) for n in range(len(w))), default=most + 1)
                if d <= most:
                    want.append((-d, terms[t], t))
            got = trie.fuzzy(w, most)
            assert (got and (-got.distance, got.weight, got.term)) == (max(want) if want else None), w


def test_the_test_before_the_automaton_passes_over_nothing():
    rng = random.Random(2)
    terms = dict.fromkeys(INSULTS, 6.0) | {"grobna*": 5.0}
    m = Matcher(terms)
    for _ in range(6000):
        w = edited(rng, rng.choice([*INSULTS, "grobnaxyz"]), rng.randrange(1, 3))
        assert m.near_a_term(w) or m.spelled.fuzzy(w, 1) is None, w


def labelled(n=600):
    rng = random.Random(4)
    bad = ["idiot", "moron", "stupid", "loser"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(VOCABULARY, k=40)
        if i % 5 == 0:
            for w in rng.choices(bad, k=3):
                words.insert(rng.randrange(len(words)), w)
        elif i % 2 == 0:
            words[3] = "oron"  # a word of its own beside a term
        if i % 7 == 0:
            words[5] = rng.choice(["whor", "whre", "whorn", "whorm", "whorp"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    return rows, labels


def test_misspelt_insults_raise_scores_and_harmless_neighbours_do_not(spark):
    rows, labels = labelled()
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit(d, lab)
    w = np.array(model.weights)
    assert len(w) == FEATURES + 1 and (w[:-1] * toxicity.DIRECTIONS >= 0).all() and w[2] > 0
    assert "oron" in model.harmless and "whore" in model.crowded and not {"idiot", "moron"} & model.crowded
    clean = " ".join(VOCABULARY[:40])
    forms = [clean + x for x in ("", " oron", " whre", " you idiot", " you idot", " you idoit", " you mroon", " a stupdi losr", " whore")]
    got = [r.score for r in sorted(score_toxicity(spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string"), model).collect(), key=lambda r: r.doc_id)]
    assert got[0] == got[1] == got[2] < 0.1 and all(s >= 0.3 for s in got[3:]), got
    assert max(got[4:7]) < got[3]
    # Held-out toxic documents with every insult misspelt, against exact hits alone, which meet none of them
    rng, trie = random.Random(8), Trie(model.terms)
    known = dict(labels)
    hurt = [(i, " ".join(misspelt(x, rng) if trie.exact(x) else x for x in t.split()) if known[i] else t) for i, t in rows]
    out = score_toxicity(spark.createDataFrame(hurt, "doc_id long, text string"), model).where("held_out").collect()
    bad, good = [r.predicted for r in out if known[r.doc_id]], [r.predicted for r in out if not known[r.doc_id]]
    assert len(bad) > 20 and sum(bad) >= 0.95 * len(bad) and sum(good) <= 0.02 * len(good)


def test_stems_that_repeat_one_term_go():
    assert telling([("pathetic", 9.0, 97), ("pathet*", 9.0, 97), ("path*", 8.0, 99), ("grobna*", 12.0, 60), ("grobn*", 7.0, 60), ("grobnak", 7.0, 20)]) == {
        "pathetic": 9.0, "grobna*": 10.0, "grobnak": 7.0}


def test_the_bound_on_rows_holds_where_one_key_has_many_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 40)
    seen = []
    real = toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, y: seen.append(len(x)) or real(x, y))
    rows, labels = labelled(60)
    rows += [(5, f"you idiot number {i}") for i in range(300)] + [(5, None), (5, None), (5, "")]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, 1), (None, 1)], "doc_id long, toxic int")
    model = fit(d, lab)
    assert len(seen) == 1 and seen[0] == 2 * 40
    assert all(0 <= r.score <= 1 for r in score_toxicity(d, model).collect())


def test_empty_tables_extra_columns_and_texts_of_any_length(spark):
    d = spark.createDataFrame([(1, None, 9, "x"), (1, "", 9, "x"), (2, "you idot " * 50_000, 9, "x"), (None, "moron", 9, "x")], "doc_id long, text string, toxic long, score string")
    lab = spark.createDataFrame([(1, None), (2, 7), (None, 1)], "doc_id long, toxic int")
    model = fit(d, lab)  # no labelled row: the insults alone
    got = score_toxicity(d, model).collect()
    assert len(got) == 4 and [r.predicted for r in sorted(got, key=lambda r: r.score)] == [0, 0, 1, 1]
    assert features(None, model.matcher()) == features("", model.matcher()) == [0.0] * FEATURES
    assert fit(d.limit(0), lab.limit(0)) == model and score_toxicity(d.limit(0), model).count() == 0
