"""The language model's softmaxes where exponentials of plain logits would not be floats, and inner ones class by class."""

import numpy as np
import pyarrow as pa
import pytest

from auditlake.llm import language_model as lm


@pytest.mark.parametrize("scale", [1, 40])
def test_inner_softmaxes_class_by_class(scale):
    rng = np.random.default_rng(2)
    first = np.array([0, 3, 3, 4, 9])
    hs = np.ones((50, lm.HIDDEN + 1), np.float32)
    hs[:, :-1] = rng.uniform(-1, 1, (50, lm.HIDDEN))
    out, safe = lm.joined(rng.standard_normal((9, lm.HIDDEN)).astype(np.float32) * scale, np.zeros(9, np.float32))
    slots = rng.integers(-1, 9, 50)
    got = lm.Inside(hs, slots, first, out, safe)
    assert safe == (scale == 1) and sorted(got.rows.tolist()) == np.flatnonzero(slots >= 0).tolist()
    own = got.e[got.place].astype(float)
    logs = own - np.log(got.exponentials())
    for row, value in zip(got.rows.tolist(), logs):
        at = np.searchsorted(first, slots[row], "right") - 1
        z = out[first[at] : first[at + 1]].astype(float) @ hs[row]
        assert abs(value - (z[slots[row] - first[at]] - z.max() - np.log(np.exp(z - z.max()).sum()))) < 1e-3
    assert not len(lm.Inside(hs, np.full(50, -1), first, out, safe).exponentials())


def test_large_logits_give_finite_scores_and_gradients():
    p = {k: a.astype(np.float32) for k, a in lm.fresh(np.zeros(lm.CLASSES)).items()}
    p["b"][:2] = 200, -200
    assert np.allclose(lm.class_scores(p, [np.array([0, 1, 0])]), [-400], rtol=0.01)
    grad, _ = lm.gradients(p, np.zeros((2, 3), int), np.ones((2, 3), int), np.zeros((2, lm.HIDDEN), np.float32))
    assert all(np.isfinite(g).all() for g in grad.values()) and np.allclose(grad["b"][:2], [1, -1])


def test_words_of_a_batch_are_those_of_each_text():
    texts = [None, "", " ", "\x1c a\x1fb\x85c d \n", "A\tb\x0bC\x0cÀé  \r\n", "x", "😀 Zz x b zz rare rare"]
    want = [lm.tokens(t) for t in texts]
    head = lm.Head([lm.END, b"x", b"b", b"zz"], [7, 2, 2, 2])
    met = lm.Sequences(pa.array(texts), head)
    assert np.diff(met.offsets).tolist() == [len(w) for w in want]
    assert met.classes.tolist() == [head.class_of(t) for w in want for t in w]
    assert met.found.tolist() == [head.index.get(t, -1) for w in want for t in w]
    rare = [{t: w.count(t) for t in w if t not in head.index} for w in want]
    assert [{x["word"]: x["times"] for x in row} for row in met.rare_words().to_pylist()] == rare
    assert all(x["k"] == head.class_of(x["word"]) for row in met.rare_words().to_pylist() for x in row)
    assert met.sums(np.ones(4)).tolist() == [sum(t in head.index for t in w) for w in want]
    counts = {}
    for b in lm.count_words(iter([pa.record_batch([pa.array(texts)], ["text"])])):
        counts |= dict(zip(b.column("word").to_pylist(), b.column("c").to_pylist()))
    assert counts == {t: sum(w.count(t) for w in want) for w in want for t in w}
