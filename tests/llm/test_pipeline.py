"""The whole pipeline on small tables, against plain Python for each stage."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import corpus_pipeline
from pulsegrid.llm import token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, _hash int, size int, reps string, kept boolean"


def near(a, b):
    cut = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))} if (t or "").split() else set()
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) >= 0.8 if x or y else True


def deduplicated(rows):
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near(rows[i][1], rows[j][1]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    best = {}
    for i, r in enumerate(rows):
        k = root(i)
        if k not in best or (r[0] is None, r[0]) < (best[k][0] is None, best[k][0]):
            best[k] = r
    return list(best.values())


def words_of(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def clean(rows, items):
    windows = set()
    for t in items:
        w = words_of(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    return [r for r in rows if not hit(words_of(r[1]))]


def mixed(rows):
    """Each row as often as the mix takes it."""
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    words = Counter()
    for r in rows:
        words[r[3]] += size(r)
    target, open_, left = {}, set(sources), 1.5 * sum(words.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / total > 2 * words[s]} if total else set()
        if not over:
            break
        for s in over:
            target[s] = 2.0 * words[s]
            left -= target[s]
        open_ -= over
    target |= {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
    out = []
    for s in sources:
        if not words[s]:
            continue
        whole = int(target[s] // words[s])
        rest, before = target[s] - whole * words[s], 0
        key = lambda r: hashlib.md5(f"17|{'null' if r[0] is None else r[0]}".encode()).hexdigest()
        for r in sorted((r for r in rows if r[3] == s), key=key):
            out += [r] * min(2, whole + (before + size(r) / 2 <= rest))
            before += size(r)
    return out


def documents():
    r = random.Random(12)
    words = [f"{a}{b}" for a in "the of thing wörd blue red".split() for b in "abcdefghijk"]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(r.choices(words, k=r.randint(3, 120))), "en" if i % 3 else "de", None if i % 5 == 0 else f"s{i % 4}"))
    for i in range(12):  # near copies and copies
        w = rows[i * 3][1].split()
        if len(w) > 40:
            w[len(w) // 2] = "changed"
        rows.append((100 + i, " ".join(w), "en", "s1"))
    rows += [(200, None, "en", "s0"), (201, "", None, "s1"), (202, "12 !! --", "en", "s2"), (203, "one two three four five six seven eight nine ten eleven", "en", "s2"), (204, "x " * 3000, "de", "s3")]
    rows += [rows[7], (None, "a text of its own without an id", "en", None)]
    return [(*x, len(x[1] or ""), 0.25, 7, 8, "nine", True) for x in rows]


def test_pipeline(spark, tmp_path):
    rows, items = documents(), ["Two, three four five six seven eight nine ten; eleven", None, "", "gone gone"]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [x for x in rows if any(c.isalpha() for c in x[1] or "")]
    docs, plain = spark.read.parquet(f"{tmp_path}/documents.parquet"), [lambda x: want, deduplicated, lambda x: clean(x, items), mixed]
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs, want = spark.read.parquet(path), brute(want)
        assert Counter(map(tuple, docs.collect())) == Counter(want), name
    assert 203 not in {x[0] for x in want} and {1, None} <= {x[0] for x in want} | {1}
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(token_files.tokenizer_path()).encode
    ids = lambda t: [*encode(t or "", add_special_tokens=False).ids, 2]
    last = Counter((x[0], len(y := ids(x[1])), zlib.crc32(struct.pack(f"<{len(y)}I", *y))) for x in want)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == last
    at = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at
        at += x.n_tokens


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
