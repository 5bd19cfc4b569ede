"""The learnt operators against plain versions: optimisation by gradient descent, scores and decoding worked out one document at a time."""

import math
import random

import numpy as np
import pytest

from pulsegrid.llm import langid, quality

WORDS = "the of and thing with éaux über straße là ñor".split()


def test_bradley_terry_weights_are_those_of_plain_descent():
    rng = np.random.default_rng(3)
    better, worse = rng.normal(0.6, 1, (40, 4)), rng.normal(-0.4, 1, (30, 4))
    w = quality.fit_pairs(better, worse, n=500, decay=1e-2, steps=2000, seed=11)
    draw = np.random.default_rng(11)
    d = better[draw.integers(40, size=500)] - worse[draw.integers(30, size=500)]
    plain = np.zeros(4)
    for _ in range(20_000):
        gradient = 1e-2 * plain
        gradient -= (d * (1 / (1 + np.exp(d @ plain)))[:, None]).mean(0)
        plain -= 0.2 * gradient
    assert np.allclose(w, plain, atol=1e-4)


def test_quality_scores_one_by_one(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(1, 40))) + ("." if i % 3 else " ### $$"), int(i % 3 > 0), 1.0) for i in range(120)]
    rows += [(None, "a text without an id", 1, 1.0), rows[5], rows[5], (500, "word " * 60_000, 1, 1.0), (501, None, 0, 1.0), (502, "", 0, 1.0), (503, " \n ", 0, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, PREDICTED double")
    model = quality.fit(docs, docs.where("doc_id % 5 <> 0").select("doc_id", "label"))
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and [c.lower() for c in quality.score(docs, model).columns].count("predicted") == 1
    for x in got:
        z = sum(w * max(-5, min(5, (f - m) / s)) for w, f, m, s in zip(model["w"], quality.features(None if x.text is None else x.text.encode()), model["mean"], model["std"], strict=True))
        p = 1 / (1 + math.exp(-((z - model["cut"]) / model["unit"] + math.log(0.3 / 0.7))))
        assert x.score == pytest.approx(p) and x.predicted == int(p >= 0.3)
    assert len({x.score for x in got if x.doc_id == 5}) == 1 and len({x.score for x in got if x.doc_id in (501, 502, 503)}) == 1


def test_quality_learns_from_every_label(spark, monkeypatch):
    """All labelled documents are in the scaling and in pairs, also where there are more than a group holds and one label is rare."""
    monkeypatch.setattr(quality, "GROUP", 10)
    r = random.Random(9)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(1, 30))) + ("." if i % 40 else " ### $$"), int(i % 40 > 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(7)
    seen, plain = [], quality.pairs
    monkeypatch.setattr(quality, "pairs", lambda rows, *more: seen.append((rows, more)) or plain(rows, *more))
    model = quality.fit(docs, docs.select("doc_id", "label"))
    x = np.array([quality.features(t.encode()) for _, t, _ in rows])
    y = np.array([k for *_, k in rows])
    groups, n = quality.grouped(docs, {0: 5, 1: 195}, "label")
    dealt = groups.collect()
    assert n == 20 and {g.doc_id for g in dealt} == set(range(200)) and all({g.label for g in dealt if g.group == k} == {0, 1} for k in range(n))
    assert sum(not g.again for g in dealt) == 200 and np.allclose(model["mean"], x.mean(0))
    (kept, (mean, std, _)), z = seen[0], np.clip((x - model["mean"]) / model["std"], -5, 5)
    d = np.array([p.x for p in plain(kept, mean, std, 1).collect()])
    rare = {g.group: g.doc_id for g in dealt if g.label == 0}
    want = np.array([z[g.doc_id] - z[rare[g.group]] for g in dealt if g.label == 1])
    assert np.allclose(np.sort(d @ model["w"]), np.sort(want @ model["w"])) and len(d) == 195
    again = quality.fit(docs.repartition(3), docs.select("doc_id", "label"))
    assert np.allclose(again["w"], model["w"], atol=1e-6) and again["cut"] == pytest.approx(model["cut"], abs=1e-6)


def test_bit_classifiers_are_those_of_plain_descent():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 90)
    x = np.concatenate([rng.normal(size=(90, 3)) * 0.5 + np.eye(3)[y], np.ones((90, 1))], 1).astype(np.float32)
    code = langid.codewords(3)
    w = langid.fit_bits(x, y, code, steps=3000, decay=1e-2)
    share = np.array([1 / (y == k).sum() for k in y]) / 3
    for bit in range(code.shape[1]):
        plain, want = np.zeros(4), code[y, bit]
        for _ in range(20_000):
            m = want * (x @ plain)
            plain -= 0.5 * (1e-2 * plain - (x * (share * want / (1 + np.exp(m)))[:, None]).sum(0))
        assert np.allclose(w[:, bit], plain, atol=2e-3)


def test_languages_one_by_one(spark):
    r = random.Random(4)
    kinds = {"en": "the of and thing with".split(), "fr": "le de éaux être çon".split(), "de": "der und über straß zu".split()}
    rows = [(i, " ".join(r.choices(kinds[k], k=r.randint(1, 20))), k, 0.5) for i, k in enumerate(r.choices(list(kinds), k=150))]
    rows += [rows[3], rows[3], (None, "le de", None, 0.5), (900, "\U00032010", "en", 0.5), (901, "12", "fr", 0.5), (902, None, None, 0.5), (903, "the le der " * 20_000, "en", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score double")
    known, code, w = model = langid.trained(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows) and [c.lower() for c in langid.identify(docs, model).columns].count("score") == 1
    for x in got:
        f = langid.features(x.text)
        if f is None:
            assert (x.lang_pred, x.score, x.ambiguous) == ("und", 0.0, True) and not any(c.isalpha() for c in x.text or "")
            continue
        margins = [float(f @ w[:-1, b] + w[-1, b]) for b in range(code.shape[1])]
        loss = [sum(math.log1p(math.exp(-m * c)) for m, c in zip(margins, word, strict=True)) for word in code]
        first, second = sorted(loss)[:2]
        assert x.lang_pred == known[loss.index(first)]
        assert x.score == pytest.approx(math.exp(-first) / sum(math.exp(-v) for v in loss), abs=1e-4)
        lead = (second - first) / (first + second)
        assert x.ambiguous == (lead < langid.MARGIN) or abs(lead - langid.MARGIN) < 1e-3
    assert {x.lang_pred for x in got if x.doc_id == 900} <= {"en", "fr", "de"}  # a letter of a far plane


def test_counts_of_letters_and_gaps():
    """n-grams of a text are those of its lower-cased letters with one gap for all else."""
    a, b = langid.counts("Ab,  c!"), langid.counts("ab c ")
    assert np.array_equal(a, b) and a.sum() == len("_ab_c_") - 1 + len("_ab_c_") - 2
    assert langid.counts("1 2") is None and langid.counts("") is None and langid.counts(None) is None
