"""Fill-in-middle, exact dedup and centroid clustering against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import centroids, exact_dedup, fill_in_middle
from pulsegrid.llm.common import LOWER, UPPER

DOCS = "doc_id long, text string, source string, n long, form string, _units string, keep_id long"
FOLD = str.maketrans(UPPER, LOWER)
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PLAIN = {"words": TOKEN, "runs": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "lines": r"[^\n]*\n|[^\n]+", "characters": r"(?s)."}


def values():
    r = random.Random(5)
    out = [None, "", " ", "\n\n", "a", " a", "a ", "\ta \n b\x0b\x0cc\r", "é x y z", "a\x1cb c", "😀 😀😀 b", "x <P> y", "<M>", "a <S", "< <P < S>", "  a\x85b", "A", "ａ"]
    out += [" ".join(r.choices(["the", "of\n", "Été", "😀", "<", "P>", "\t\t"], k=r.randint(1, 30))) + r.choice(["", " "]) for _ in range(120)]
    return [*out, "long " * 200_000, "x" * 300_000]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, f"s{i}", -1, "clash", "kept", 7) for i, t in rows], DOCS)


@pytest.mark.parametrize("grammar", sorted(PLAIN))
def test_fill_in_middle(spark, grammar):
    rows = [*enumerate(values()), (None, "a b c d e"), (3, "again and again"), (3, "again and again")]
    done = fill_in_middle.fill_in_middle(frame(spark, rows), fill_in_middle.GRAMMARS[grammar])
    assert sorted(done.columns) == sorted([*"doc_id text source n form _units keep_id prefix_chars middle_chars output".split()])
    got = done.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter()
    for i, t in rows:
        t = t or ""
        u = re.findall(PLAIN[grammar], t)
        sha = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h = [int(sha[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(u) + 1) for x in h[:2])
        plain = not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50
        form = "plain" if plain else "spm" if h[3] % 100 < 80 else "psm"
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        want[i, len(u), form, None if plain else len(p), None if plain else len(m), out, t] += 1
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == want
    assert len({k[2] for k in want}) == 3
    assert all(r._units == "kept" and r.keep_id == 7 and r.source == f"s{r.doc_id}" for r in got)


def test_fill_in_middle_of_nothing_and_of_other_markers(spark):
    docs = frame(spark, [(1, "a b")])
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0
    every = fill_in_middle.fill_in_middle(docs, percent=100, spm_percent=0, markers=("<a.>", "<b*>", "<c>")).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"), ("<a.>", "<b*>", "<c>"))).first()
    assert every.form == "psm" and every.output.startswith("<a.>") and every.back == "a b"
    for bad in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P>>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(docs, markers=bad)


def groups_of(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda i: (i is not None, i), reverse=True):
            out[i, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()] += 1
            first = False
    return out


def copies():
    r = random.Random(9)
    texts = [*values(), *(f"text {i}" for i in range(400)), "É", "é", "K", "K", "İ", "i"]
    rows = [(i, t) for i, t in enumerate(r.choices(texts, k=900) + ["HOT Copy"] * 300 + ["hot copy"] * 300)]
    r.shuffle(rows)
    return [*rows, (None, "hot copy"), (None, "only null ids"), (None, "ONLY null ids"), rows[0], rows[0], (1 << 60, "Text 1"), (-5, "text 2")]


@pytest.mark.parametrize(("capacity", "remembered", "hashes"), [(256, 64 << 20, None), (2, 300, None), (8, 64 << 20, 3), (1, 1000, 1)])
def test_exact_groups(spark, monkeypatch, capacity, remembered, hashes):
    """In small buckets, with little memory, and with hashes that collide."""
    rows = copies()
    monkeypatch.setattr(exact_dedup, "REMEMBERED", remembered)
    if hashes:
        whole = F.xxhash64
        monkeypatch.setattr(F, "xxhash64", lambda c: F.pmod(whole(c), F.lit(hashes)).cast("long") * (1 << 61))
    got = exact_dedup.exact_groups(frame(spark, rows).repartition(7), capacity)
    assert Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got.collect()) == groups_of(rows)


def test_directory_splits_what_is_overfull(spark):
    r = random.Random(2)
    keys = [r.getrandbits(64) - (1 << 63) for _ in range(3000)] + [(1 << 62) + k for k in range(200)]  # 200 of one slot
    slots, bits = exact_dedup.directory(spark.createDataFrame([(k,) for k in keys], "key long"), len(keys), capacity=32)
    got = {x.slot: x for x in slots.collect()}
    held = Counter((k % (1 << 64)) >> (64 - bits) for k in keys)
    assert set(got) == set(held)
    size = lambda s, d: sum(n for o, n in held.items() if o >> (bits - d) == s >> (bits - d))
    for s, x in got.items():
        assert x.bucket == s >> (bits - x.depth) << (bits - x.depth)
        assert size(s, x.depth) <= 32 or x.depth == bits
        assert x.depth == 0 or size(s, x.depth - 1) > 32
    assert max(x.depth for x in got.values()) == bits


def test_deduplicated(spark):
    rows = copies()
    docs = frame(spark, rows).withColumnRenamed("source", "_row")
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    want = {k[4]: k[1] for k in groups_of(rows)}
    assert Counter((hashlib.sha256((r.text or "").translate(FOLD).encode()).hexdigest(), r.doc_id) for r in got.collect()) == Counter(want.items())
    assert exact_dedup.deduplicated(docs.limit(0)).count() == exact_dedup.exact_groups(docs.limit(0)).count() == 0


def plain_clusters(rows, k, rounds, dim):
    rows = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    for r in range(rounds + 1):
        which = []
        for _, v in rows:
            d = [sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c]
            which.append((min(d), d.index(min(d))))
        if r == rounds:
            return Counter((i, j, d) for (i, _), (d, j) in zip(rows, which, strict=True)), c
        for j in range(len(c)):
            some = [v for (_, v), (_, w) in zip(rows, which, strict=True) if w == j]
            if some:
                c[j] = [sum(x) // len(some) for x in zip(*some, strict=True)]


def vectors(n=400, dim=64):
    g = np.random.default_rng(3)
    rows = [(i, (g.normal(size=dim) + 3 * g.normal(size=dim) * (i % 3 == 0)).tolist()) for i in range(n)]
    rows += [(n + i, [0.5] * dim) for i in range(150)] + [rows[3], rows[3], (None, rows[4][1]), (7, rows[8][1])]
    rows += [(900, None), (901, []), (902, [1.0] * (dim - 1)), (903, [float("nan")] * dim), (904, [None] * dim), (905, [float("inf")] + [0.0] * (dim - 1)), (906, [1.0] * (dim + 1))]
    return rows


@pytest.mark.parametrize(("k", "rounds"), [(16, 3), (1, 2), (700, 1)])
def test_centroids(spark, k, rounds):
    rows = vectors(120 if k == 700 else 400)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int").repartition(5)
    done, final = centroids.clustered(df, k, rounds)
    want, c = plain_clusters(rows, k, rounds, 64)
    assert final.tolist() == c
    got = centroids.with_inertia(done, final).collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == want
    total = sum(d * m for (_, _, d), m in want.items())
    for r in got:
        assert r.inertia == total and r.cluster_inertia == sum(d * m for (_, j, d), m in want.items() if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_centroids_of_nothing_and_of_huge_components(spark):
    schema = "vec_id long, embedding array<double>"
    assert centroids.with_inertia(*centroids.clustered(spark.createDataFrame([(1, None)], schema))).count() == 0
    df = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], schema)
    got = {r.vec_id: r for r in centroids.with_inertia(*centroids.clustered(df)).collect()}
    assert len(got) == 3 and all(r.distance == 0 for r in got.values())


def test_centroids_far_away_are_abandoned():
    g = np.random.default_rng(1)
    c = (g.normal(size=(16, 64)) * np.linspace(40, 1, 64)).astype(np.int64)
    x = c[g.integers(0, 16, 2000)] + g.integers(-3, 4, (2000, 64))
    order = np.argsort(-x.var(0))
    which, distance, added = centroids.nearest(x, c, order)
    every = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert (which == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert added < 0.25 * every.size * 64
    _, _, backwards = centroids.nearest(x, c, order[::-1])
    assert added < backwards
