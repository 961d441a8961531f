"""The parts of the classifiers against plain restatements."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from syncsift.llm import quality, toxicity


def restated(text):
    """The statistics by counting characters, words and lines one at a time."""
    raw = text.encode()
    n = max(len(raw), 1)
    classes = [
        lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b > 127, lambda b: b in b" \t\r\x0b\x0c\n", lambda b: b > 127, lambda b: b == 10,
        lambda b: b in b".,;:?'\"-()", lambda b: b == 33, lambda b: b == 124, lambda b: b in b"#$%&*+/<=>@[\\]^_`{}~",
    ]
    out = [sum(map(c, raw)) / n for c in classes]
    out.append(-sum(k / n * math.log2(k / n) for k in Counter(raw).values()))
    words, lines = raw.split(), raw.split(b"\n")
    w, pairs = len(words), list(zip(words, words[1:], strict=False))
    sizes = [len(x) for x in words]
    mean = sum(sizes) / w if w else 0.0
    out += [math.log1p(len(raw)), math.log1p(w), mean, math.sqrt(sum((s - mean) ** 2 for s in sizes) / w) if w else 0.0, math.sqrt(max(sizes, default=0))]
    out += [len(set(words)) / max(w, 1), math.log1p(len(set(words))), sum(a == b for a, b in pairs) / max(w - 1, 1), len(set(pairs)) / max(w - 1, 1)]
    full = [x.strip() for x in lines if x.strip()]
    out += [math.log1p(len(lines)), len(set(full)) / max(len(full), 1), math.log1p(len(raw) / len(lines))]
    return [*out, sum(x[-1:] in (b".", b"!", b"?") for x in words) / max(w, 1), sum(x[:1].isupper() for x in words) / max(w, 1), sum(x.isalpha() for x in words) / max(w, 1)]


@given(st.text(alphabet="aB9é .!|#\n\t-", max_size=80))
@settings(max_examples=150, deadline=None)
def test_statistics(text):
    assert quality.statistics(text.encode()) == pytest.approx(restated(text), abs=1e-9)


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 1)), min_size=1, max_size=25))
@settings(max_examples=150, deadline=None)
def test_isotonic_calibration(points):
    """Each row's value is the greatest of the least means of the rows that begin at it or before, in order of scores."""
    x, y = (np.array(v, float) for v in zip(*points, strict=True))
    centres, values = quality.pooled(x, y)
    order = np.argsort(x, kind="stable")
    ys = y[order]
    want = [max(min(ys[a : b + 1].mean() for b in range(i, len(ys))) for a in range(i + 1)) for i in range(len(ys))]
    assert (np.diff(values) > 0).all() and (np.diff(centres) >= 0).all()
    assert sorted(set(np.round(want, 9))) == sorted(np.round(values, 9))


def test_random_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    model = quality.Model(np.zeros(26), np.ones(26), rng.normal(size=(26, 20_000)) / 6.0, rng.uniform(0, 2 * np.pi, 20_000), np.zeros(20_001), np.zeros(1), np.zeros(1))
    x = rng.normal(size=(12, 26))
    f = model.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 72)
    assert np.abs(f @ f.T - want).max() < 0.04


def test_label_model_weighs_voters_by_what_they_are_worth():
    rng = np.random.default_rng(2)
    truth = rng.random(6000) < 0.15
    speak = lambda right, wrong: np.where(truth, rng.random(6000) < right, rng.random(6000) < wrong).astype(np.int8)
    good, weak = [speak(0.7, 0.01) for _ in range(4)], speak(0.5, 0.06)
    v = np.column_stack([*good, weak, weak, weak, np.where(np.sum(good, axis=0) == 0, -1, 0)])
    q = toxicity.label_model(v)
    told = lambda x, right, wrong: np.where(x == 1, math.log(right / wrong), math.log((1 - right) / (1 - wrong)))
    best = math.log(0.15 / 0.85) + sum(told(x, 0.7, 0.01) for x in good) + told(weak, 0.5, 0.06)  # by the true rates, the same voter once
    assert ((q > 0.5) == (best > 0)).mean() > 0.95 and ((q > 0.5) == truth).mean() > 0.95
    alone = (weak == 1) & (np.sum(good, axis=0) == 0)
    assert alone.sum() > 100 and q[alone].max() < 0.5  # three voters that say the same are no three voices


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(400, 5)), rng.random(400)
    w = toxicity.logistic(x, q)
    f = np.hstack([x, np.ones((400, 1))])
    slope = f.T @ (q - 1 / (1 + np.exp(-(f @ w)))) - np.array([0.02] * 5 + [1e-4]) * w
    assert np.abs(slope).max() < 1e-4


def test_hits_of_words_and_beginnings():
    counter = toxicity.Counter(["vile", "grim*", "foul", "nast*"], 4)
    assert counter.items == {"vile": 0, "foul": 1, "grim*": 2, "nast*": 3}
    by_voter, hit, n = toxicity.hits("Vile GRIMLY foul, grim; nastier vileness", counter.items, 4)
    assert (by_voter.tolist(), hit, n) == ([1, 1, 1, 1], 4, 6)  # the word grim is no longer than its beginning
    x = counter.of("vile grimly")
    assert (x[:4] > 0).tolist() == [True, False, True, False] and x[4:].tolist()[0] == 1 and not counter.of("clean words").any()
    v = toxicity.votes(np.array([x, counter.of("clean")]), 4)
    assert v[0, :4].tolist() == [1, 0, 1, 0] and v[0, 4] == 1 and v[1].tolist()[:5] == [0, 0, 0, 0, -1]
