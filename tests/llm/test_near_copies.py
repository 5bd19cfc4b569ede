"""The pipeline's near-dedup stage on planted near copies, against all pairs."""

import random

import numpy as np

import corpus_pipeline
from pulsegrid.llm import near_copies as nc


def plain(texts):
    """The smallest place of each text's group, over all pairs."""
    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [cut(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if (len(a & sets[j]) / len(a | sets[j]) if a or sets[j] else 1.0) >= 0.8:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [root(i) for i in range(len(texts))]


def planted(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (60, 150, 400, 900):
        for _ in range(12):
            base = r.choices(words, k=n)
            texts.append(" ".join(base))
            for share in (0.01, 0.02, 0.022, 0.03, 0.05):  # the last two are mostly too far away
                copy = [f"new{r.random()}" if r.random() < share else w for w in base]
                texts.append(" ".join(copy))
    hot = r.choices(words, k=300)
    for _ in range(120):  # one large group, whose members are 0 to 6 words apart from its base
        copy = list(hot)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(300)] = f"other{r.random()}"
        texts.append(" ".join(copy))
    r.shuffle(texts)
    return [*texts, "a b c d", "A  b c d", "a b c e", "one two three four five", None, "", " \n", texts[0]]


def test_stage_finds_planted_near_copies(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en", i % 3) for i, t in enumerate(texts)], "doc_id long, text string, lang string, _hash int")
    want = plain(texts)
    kept = sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted({*want})
    assert len(kept) < len(texts) - 200


def test_pivots_lose_no_pair(spark, monkeypatch):
    texts = planted(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(nc, "BIG", 30)
    monkeypatch.setattr(nc, "FEW", 2)
    monkeypatch.setattr(nc, "BLOCK_ROWS", 16)
    monkeypatch.setattr(nc, "PIVOTS", 2)
    assert sorted(x.doc_id for x in nc.deduplicated(docs).collect()) == sorted({*plain(texts)})
    assert nc.deduplicated(docs.limit(0)).count() == 0


def test_shuffled_joins_find_the_same(spark, monkeypatch):
    """Large tables aren't broadcast; then the same joins are shuffled."""
    from pulsegrid.llm import common, decontamination, mixing, simhash

    texts = planted(5)[:160] + [None, "", texts_again := "a b c d e f g h i j k l"] + [texts_again]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, "c d e f g h i j k l"), (2, "zz")], "item_id long, text string")

    def results():
        return [
            sorted(x.doc_id for x in nc.deduplicated(docs).collect()),
            sorted((x.doc_id, x.reps) for x in mixing.mix(docs).collect()),
            sorted((x.doc_id, x.n_hit) for x in decontamination.contamination(docs, items).collect()),
            sorted(x.doc_id for x in decontamination.decontaminated(docs, items).collect()),
            sorted((x.doc_id, x.component_id) for x in simhash.near_duplicates(docs).collect()),
        ]

    sent = results()
    for module in (nc, mixing, decontamination, simhash):
        monkeypatch.setattr(module, "small", lambda df, rows=0: common.small(df, -1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert results() == sent
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_blocks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(nc, "FEW", 1)
    texts = planted(6)[-90:]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[5]), (None, None), (None, None)], "doc_id long, text string")
    kept = nc.deduplicated(docs).collect()
    assert sorted(x.doc_id for x in kept) == sorted({*plain(texts)})


def test_shared_counts():
    sets = [{1, 2, 3}, {2, 3, 4}, {9}, {1, 2, 3}]
    both = nc.shared(np.arange(4), np.array([len(s) for s in sets]), np.array([x for s in sets for x in sorted(s)]))
    assert [[int(v) if i != j else len(sets[i]) for j, v in enumerate(row)] for i, row in enumerate(both)] == [[len(a & b) for b in sets] for a in sets]
