"""Surrogates of labels and what is measured on them, against plain Python."""

import math
import random
import statistics
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest

from pulsegrid.operators import surrogates as su


def sequences():
    r = random.Random(7)
    out = {"one": ["a"], "same": ["b"] * 30, "two": ["a", "b"]}
    for t, stay in (("sticky", 0.9), ("loose", 0.4)):
        s = ["a"]
        for _ in range(899):
            s.append(s[-1] if r.random() < stay else r.choice("abc"))
        out[t] = s
    return out


@pytest.fixture(scope="module")
def made(spark):
    rows = [(t, 3 * i, s) for t, xs in sequences().items() for i, s in enumerate(xs)] + [("sticky", 10_000, None), ("sticky", 10_001, "")]
    states = spark.createDataFrame(rows, "train string, idx int, state string").repartition(5)
    got = defaultdict(dict)
    for x in su.surrogates(states, 12).collect():
        assert x.idx not in got[x.kind, x.train, x.surrogate]
        got[x.kind, x.train, x.surrogate][x.idx] = x.state
    return states, {k: [v[i] for i in range(1, len(v) + 1)] for k, v in got.items()}


def shape(xs):
    return [(k, len(list(v))) for k, v in groupby(xs)]


def test_shuffles_keep_what_they_shuffle(made):
    _, got = made
    for t, xs in sequences().items():
        for g in range(1, 13):
            assert Counter(got["label_permutation", t, g]) == Counter(xs)
            blocks = Counter(tuple(xs[i : i + 10]) for i in range(0, len(xs), 10))
            ys, k = got["block_shuffle", t, g], len(xs) % 10
            if not k:
                assert Counter(tuple(ys[i : i + 10]) for i in range(0, len(ys), 10)) == blocks
            assert Counter(ys) == Counter(xs)
            joined = Counter()
            for s, n in shape(got["run_shuffle", t, g]):
                joined[s] += n
            assert joined == Counter(xs) and len(shape(got["run_shuffle", t, g])) <= len(shape(xs))
    assert len({tuple(got["run_shuffle", "sticky", g]) for g in range(1, 13)}) == 12


def test_made_sequences_have_the_rates_of_their_train(made):
    _, got = made
    for t, xs in sequences().items():
        names = sorted(set(xs))
        for kind in su.MADE:
            assert all(len(got[kind, t, g]) == len(xs) for g in range(1, 13)) and {s for g in range(1, 13) for s in got[kind, t, g]} <= set(names)
    for t in ("sticky", "loose"):
        xs = sequences()[t]
        moves, seen = Counter(zip(xs, xs[1:], strict=False)), Counter()
        for g in range(1, 13):
            ys = got["markov", t, g]
            seen += Counter(zip(ys, ys[1:], strict=False))
        for a in "abc":
            n, m = sum(moves[a, b] + 1 for b in "abc"), sum(seen[a, b] for b in "abc")
            for b in "abc":
                p = (moves[a, b] + 1) / n
                assert abs(seen[a, b] / m - p) < 5 * math.sqrt(p * (1 - p) / m)
        lengths, again = defaultdict(Counter), defaultdict(Counter)
        for s, n in shape(xs):
            lengths[s][n] += 1
        for g in range(1, 13):
            ys = shape(got["renewal", t, g])
            for s, n in ys[:-1]:  # the last one is cut
                again[s][n] += 1
        for s in "abc":
            assert set(again[s]) <= set(lengths[s])
            mean = lambda c: sum(k * v for k, v in c.items()) / sum(c.values())
            sd = math.sqrt(sum(v * (k - mean(lengths[s])) ** 2 for k, v in lengths[s].items()) / sum(lengths[s].values()))
            assert abs(mean(again[s]) - mean(lengths[s])) < 5 * sd / math.sqrt(sum(again[s].values())) + 1e-9


def measures(xs):
    if len(xs) < 2:
        return {"state_n": float(len(set(xs)))}
    moves = Counter(zip(xs, xs[1:], strict=False))
    out = Counter()
    for (a, _), n in moves.items():
        out[a] += n
    h = -sum(n * math.log2(n / out[a]) for (a, _), n in moves.items()) / sum(out.values())
    d = [n for _, n in shape(xs)]
    m = Counter(tuple(xs[i : i + 3]) for i in range(len(xs) - 2))
    full = {"transition_entropy": h, "max_transition_prob": max(n / out[a] for (a, _), n in moves.items()), "mean_dwell_isi": sum(d) / len(d), "state_n": float(len(set(xs)))}
    return full | ({"top_motif_rate": max(m.values()) / sum(m.values())} if m else {}) | ({"dwell_cv": statistics.stdev(d) / statistics.mean(d)} if len(d) > 1 else {})


def test_controls(spark, made):
    states, got = made
    table = {(x.train, x.kind, x.metric): x for x in su.controls(states, 12).collect()}
    assert len(table) == 5 * 5 * 6
    for t, xs in sequences().items():
        seen = measures(xs)
        for kind in su.KINDS:
            values = [measures(got[kind, t, g]) for g in range(1, 13)]
            for name in su.METRICS:
                x, v = table[t, kind, name], [round(m[name], 12) for m in values if name in m]
                if name not in seen:
                    assert x.observed is None and x.p_high is None
                    continue
                assert x.observed == pytest.approx(seen[name], abs=1e-11)
                if not v:
                    assert x.p_high is None
                    continue
                high, low = ((1 + sum(f(a) for a in v)) / (len(v) + 1) for f in (lambda a: a >= round(seen[name], 12) - 5e-13, lambda a: a <= round(seen[name], 12) + 5e-13))
                assert (x.p_high, x.p_low) == pytest.approx((high, low)) and x.p_two_sided == pytest.approx(min(1, 2 * min(high, low)))
                assert x.mean == pytest.approx(sum(v) / len(v), abs=1e-11)
    assert table["sticky", "label_permutation", "mean_dwell_isi"].p_high == pytest.approx(1 / 13)


def test_controls_store_no_surrogates(spark, made, monkeypatch):
    """What is stored doesn't grow with the number of surrogates."""
    sizes, keep = [], su.stored

    def counted(df, what):
        out = keep(df, what)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(su, "stored", counted)
    states, _ = made
    su.controls(states, 9).collect()
    assert max(sizes) <= states.count()


def test_sequences_side_by_side():
    r = random.Random(8)
    xs = [[r.randrange(r.choice([1, 2, 5])) for _ in range(n)] for n in (1, 2, 3, 40, 1, 7)]
    for shift in (0, 1 << 15):  # large numbers of states: three of them in a row don't fit 62 bits with the sequence
        codes = [[v + (shift << 8) * (v > 0) for v in x] for x in xs]
        got = np.array(su.measured(np.concatenate(codes), np.array([len(x) for x in xs]))).T
        for x, values in zip(codes, got, strict=True):
            want = measures(x)
            assert [None if np.isnan(v) else v for v in values] == [pytest.approx(want[n]) if n in want else None for n in su.METRICS]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "train string, idx int, state string")
    assert su.surrogates(empty, 3).count() == 0 and su.controls(empty, 3).count() == 0
