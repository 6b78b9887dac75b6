"""Edit distances side by side, and the comparisons that spanning forests save."""

import random

import numpy as np
import pytest

from auditlake.llm import lines


def edited(rng, line, n):
    out = list(line)
    for _ in range(n):
        kind, i = rng.random(), rng.randrange(len(out) + 1)
        if kind < 0.6:
            out[i : i + (kind < 0.3)] = rng.choice("abc")
        else:
            del out[i : i + 1]
    return "".join(out)


@pytest.mark.parametrize("words", [1, 2, 3])
def test_band_distances(words):
    """Sharp within the bound, no less than the distance beyond it."""
    rng, pairs, bounds = random.Random(words), [], []
    for _ in range(400):
        a = "".join(rng.choices("abc", k=rng.randint(1, 40) if words == 1 else rng.randint(100, 400)))
        a, b = sorted((a, edited(rng, a, rng.randint(0, len(a) // 3)) or "a"), key=len)
        bound = min(max(len(b) - len(a), 64 * (words - 1)) + rng.randint(0, 20), 64 * words - 1)
        if bound >= len(b) - len(a):
            pairs.append((a, b))
            bounds.append(bound)
    got = lines.band_distances([tuple(np.frombuffer(x.encode(), np.uint8) for x in p) for p in pairs], np.array(bounds), words)
    for (a, b), n, bound in zip(pairs, got.tolist(), bounds):
        want = lines.edit_distance(a, b)
        one = lines.band_distance(a, b, bound)
        assert n == one == want if want <= bound else min(n, one) >= want > bound


def test_similar_pairs_of_any_length_and_alphabet():
    rng, names = random.Random(4), []
    for n in range(300):
        size = rng.choice([1, 5, 60, 639, 650, 1400]) if n else 6000
        a = "".join(rng.choices("abé€" if n % 2 else "ab😀\udc80", k=size))
        b = edited(rng, a, int(size * rng.choice([0, 0.03, 0.09, 0.1, 0.11, 0.2])))
        names += [a, rng.choice([b, b, b[: int(size * 0.9)], a[size // 10 :]])]
    a, b = np.arange(0, len(names), 2), np.arange(1, len(names), 2)
    want = [lines.edit_distance(names[x], names[y]) <= 0.1 * max(len(names[x]), len(names[y])) + 1e-9 for x, y in zip(a, b)]
    assert lines.similar_pairs(names, a, b).tolist() == want and 50 < sum(want) < 250


def test_near_copies_need_few_comparisons(monkeypatch):
    """A cell of near copies and one of strangers: all links, and of the copies' pairs hardly more than a forest compared."""
    rng, compared = random.Random(6), []
    stem = "".join(rng.choices("abcdefgh", k=200))
    names = [edited(rng, stem, 4) for _ in range(60)] + ["".join(rng.choices("abcdefgh", k=200)) for _ in range(10)]
    a, b = np.triu_indices(len(names), 1)
    inner = lines.similar_pairs
    monkeypatch.setattr(lines, "similar_pairs", lambda n, x, y: compared.append(int((y < 60).sum())) or inner(n, x, y))
    edges = lines.links(names, a, b, np.zeros(len(a), np.int64))
    assert len(edges) == 59 and {x for e in edges for x in e} == set(range(60))
    assert sum(compared) < 200
