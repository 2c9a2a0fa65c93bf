"""The fuzzy score against a slow, literal form of its definition."""

import random

import numpy as np
import pytest

from tablevitals.functions.fuzzy import CandidateScorer, lcs_length, partial_ratio, wratio


def table_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def indel(a, b):
    return 200.0 * table_lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def windows(a, b):
    short, long = sorted((a, b), key=len)
    size = len(short)
    pairs = [(short, long), (long, short)] if len(a) == len(b) else [(short, long)]
    return max(indel(s, t[max(i, 0) : i + size]) for s, t in pairs for i in range(1 - size, len(t)))


def test_known_values():
    assert wratio("Orissa", "Odisha") == pytest.approx(200 * 4 / 12)
    assert wratio("Eastsidee", "Eastside") == pytest.approx(200 * 8 / 17)
    assert wratio("", "abc") == 0.0
    assert wratio("new york mets", "new york mets") == 100.0
    assert wratio("york new", "new york") == pytest.approx(95.0)
    assert wratio("new york", "the new york city ball club") == pytest.approx(90.0)


def test_lcs_and_windows_against_tables():
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90)))
        b = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 90)))
        assert lcs_length(a, b) == table_lcs(a, b)
    for _ in range(150):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        assert partial_ratio(a, b) == pytest.approx(windows(a, b))


def test_all_candidates_at_once():
    """The batch form equals the pair form, also where it may leave low scores out."""
    rng = random.Random(9)
    text = lambda sizes: "".join(rng.choice("abcde ") for _ in range(rng.choice(sizes))).strip()
    for _ in range(120):
        candidates = [text([0, 1, 2, 5, 9, 20, 70]) for _ in range(15)]
        scorer = CandidateScorer(candidates)
        value = text([1, 3, 7, 15, 40, 90])
        exact = np.array([wratio(value, c) for c in candidates], dtype=np.float32)
        assert np.allclose(scorer.scores(value), exact, atol=1e-3)
        floored = scorer.scores(value, 60.0)
        if exact.max() >= 60:
            assert floored.max() == pytest.approx(exact.max(), abs=1e-3)
            assert scorer.scores(value).argmax() == floored.argmax()
