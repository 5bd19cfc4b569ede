"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import decontamination, html_extraction, langid, line_dedup, mixing, quality, simhash, token_counts, token_files, topk
from pulsegrid.llm.common import UPPER, LOWER, ascii_lower, ranked

DOCS = "doc_id long, text string, source string, lang string, _row string, kept string, size long"
FOLD = str.maketrans(UPPER, LOWER)
WORDS = "the of Thand inER éaux Über zu la de Ñor 4x straße".split()


def texts(n=60, seed=1):
    r = random.Random(seed)
    lines = [" ".join(r.choices(WORDS, k=r.randint(1, 9))) for _ in range(12)]
    out = [None, "", " ", "\n", "A", "a\n", "\t the\n the \nThe\r"]
    out += ["\n".join(r.choices(lines, k=r.randint(1, 8))) + r.choice(["", "\n", "\nÉ" + str(r.random())]) for _ in range(n)]
    out += [out[-1], out[-2], " ".join(r.choices(WORDS, k=30_000))]
    return out


def frame(spark, values, extra=()):
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", "en" if i % 2 else None, "clash", "clash", 1) for i, t in enumerate(values)]
    return spark.createDataFrame(rows + list(extra), DOCS)


def test_ascii_lower_and_ranked(spark):
    values = ["ABC", "ÉA", "éA", "ΑΣ Q", "İI", "K k", "straẞe Z", "", "Ⓐ A"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", ascii_lower(F.col("v")).alias("l")).collect()
    assert all(r.l == r.v.translate(FOLD) for r in got)
    rows = ranked(spark.createDataFrame([(x, i) for i, x in enumerate([5, 1, 1, None, 9, 1] * 20)], "x int, i int"), F.col("x"), F.col("i")).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(120))
    assert [(r.x is not None, r.x, r.i) for r in rows] == sorted((r.x is not None, r.x, r.i) for r in rows)


def test_lines(spark):
    values = texts()
    docs = frame(spark, values, [(None, "the", None, None, "", "", 0), (None, "the", None, None, "", "", 0)])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    seen = defaultdict(set)
    for row in rows:
        for x in (row[1] or "").split("\n"):
            seen[key(x)].add(row)
    for least in (1, 3):
        common = {k for k, v in seen.items() if len(k) >= least and len(v) >= 10}
        want = Counter()
        for i, t in rows:
            lines = (t or "").split("\n")
            left = [x for x in lines if key(x) not in common]
            want[i, len(lines), len(lines) - len(left), "\n".join(left)] += 1
        got = line_dedup.drop_common_lines(docs, 10, least)
        assert got.columns.count("kept") == 1 and "_row" not in got.columns
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == want
        assert common
    assert line_dedup.drop_common_lines(docs.limit(0)).count() == 0


def fill(caps, weights, total):
    open_, left, out = set(caps), total, {}
    while True:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * left / w > caps[s]} if w else set()
        if not over:
            return out | {s: weights[s] * left / w for s in open_}
        for s in over:
            out[s] = caps[s]
            left -= caps[s]
        open_ -= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    r = random.Random(seed)
    sizes = {"a": 30, "b": 400, "ä": 5, None: 100, "empty": 3, "Z": 60}
    rows = []
    for s, n in sizes.items():
        rows += [(len(rows) + i, None if s == "empty" else "w " * r.randint(0, 40), s, "en", "", "", 9) for i in range(n)]
    rows += rows[:2]  # repeated rows
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    words = Counter()
    for x in rows:
        words[x[2]] += len((x[1] or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = fill({s: 2.0 * words[s] for s in order}, weights, 1.5 * sum(words.values()))
    taken, most = Counter(), Counter()
    assert len(got) == len(rows)
    for x in got:
        assert x.size == len((x.text or "").split()) and x.source_size == words[x.source]
        assert x.target == pytest.approx(want[x.source]) and x.taken == x.reps * x.size <= 2 * x.size
        taken[x.source] += x.taken
        most[x.source] = max(most[x.source], x.size)
    for s in order:
        assert abs(taken[s] - want[s]) <= 2 * most[s]
    key = lambda rows: Counter((x.doc_id, x.reps) for x in rows)
    again = mixing.mix(docs.repartition(5)).collect()
    assert key(again) == key(got)
    assert mixing.repeated(mixing.mix(docs), ["doc_id"]).count() == sum(x.reps for x in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_token_files(spark, tmp_path):
    values = [*texts(20), "<|endoftext|> It's we'll 'S don't x y\x1cz é ́ 日本語 12345 !!?", "x" * 5000]
    docs = frame(spark, values, [(None, "null id", None, None, "", "", 0), (3, "again", None, None, "", "", 0)])
    path = token_files.tokenizer_path()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/t")
    got = sorted(token_files.read_token_files(manifest, with_ids=True).collect(), key=lambda r: r.start)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()  # rows that repeat an id stand in the order of a hash
    rows = [(r.doc_id, r.text) for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))]
    start = 0
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows, strict=True):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids)
        start += len(ids)
    file = manifest.orderBy("part", "seq").first().uri
    reader = token_files.SeekableTokens(file)
    assert reader.ids(len(reader) - 1)[-1] == 2
    import zstandard

    raw = open(file.removeprefix("file://"), "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole == b"".join(reader.raw(i) for i in range(len(reader)))  # any zstandard reader sees one stream
    broken = bytearray(raw)
    broken[reader.starts[-1] + reader.entries[-1][0] - 1] ^= 1
    (tmp_path / "broken").write_bytes(broken)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        bad = token_files.SeekableTokens(f"file://{tmp_path}/broken")
        bad.ids(len(bad) - 1)
    assert token_files.encoded(docs.limit(0)).count() == 0
    special = ["<|ENDOFTEXT|> A<|endoftext|>b", "Word. <|StartOfText|>", "a" * 100 + " <|"]
    for text, raw in zip(special, token_files.Encoder(path)(pa.array(special)), strict=True):
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    small = token_files.Encoder(path, keep=3)
    raw = pa.array(values, pa.string())
    assert small(raw) == small(raw) == token_files.Encoder(path)(raw)
    assert token_files.Encoder(path)(pa.array([], pa.string())) == []


def test_token_counts(spark):
    docs = frame(spark, texts(40))
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_files.tokenizer_path())
    n = [len(plain.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    hist = token_counts.histogram(docs)
    got = {r.length: r for r in hist.collect()}
    assert set(got) == set(n)
    for x, r in got.items():
        assert (r.docs, r.tokens) == (n.count(x), x * n.count(x))
        assert (r.docs_at_least, r.tokens_at_least) == (sum(k >= x for k in n), sum(k for k in n if k >= x))
        assert (r.truncated_tokens, r.total_tokens) == (sum(min(k, x) for k in n), sum(n))
        assert r.quantile == pytest.approx(sum(k <= x for k in n) / len(n))
    limits = [0, 1, 7, 100, 10**6]
    assert {r.context_limit: (r.docs_over, r.truncated_tokens) for r in token_counts.at_limits(hist, limits).collect()} == {x: (sum(k > x for k in n), sum(min(k, x) for k in n)) for x in limits}
    assert token_counts.quantile(hist, 0.5) == sorted(n)[math.ceil(len(n) * 0.5) - 1]
    assert token_counts.histogram(docs.limit(0)).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def test_decontamination(spark):
    r = random.Random(3)
    vocabulary = [*"abcdefghij", "Éa", "éa", "x1"]
    items = [(i, " ".join(r.choices(vocabulary, k=k))) for i, k in enumerate([1, 2, 3, 4, 9, 10, 11, 25, 40, 10])]
    items += [(10, None), (11, ""), (12, "--"), (2, items[2][1]), (13, "zz zz"), (14, items[8][1])]
    docs = [None, "", "..", *[" ".join(r.choices(vocabulary, k=r.randint(1, 60))) for _ in range(60)]]
    for i in range(40):
        _, t = items[r.randrange(10)]
        docs.append(" ".join(r.choices(vocabulary, k=5)) + ". " + t.upper() + "! " + t + " " + " ".join(r.choices(vocabulary, k=5)))
    docs += [docs[-1]] * 3
    want = []
    for i, t in enumerate(docs):
        w, hit, found = words_of(t), set(), set()
        for k, x in items:
            v = words_of(x)
            n = min(len(v), 10)
            for a in range(max(1, len(v) - 9) if v else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add(str(k))
        want.append((i, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    frame_ = frame(spark, docs)
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    got = decontamination.contamination(frame_, bench).collect()
    assert sorted((x.doc_id, x.n_words, x.n_hit, x.n_items, ",".join(x["items"]), x.contaminated) for x in got) == want
    assert any(x[2] and x[2] != x[1] for x in want)
    left = decontamination.decontaminated(frame_, bench)
    assert sorted(x.doc_id for x in left.collect()) == [x[0] for x in want if not x[5]] and left.columns == frame_.columns
    assert decontamination.contamination(frame_, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(frame_.limit(0), bench).count() == 0


def test_proximity(spark):
    docs = frame(spark, ["red fox x x blue", "blue red fox", "red x x x x x x fox blue", "fox", None])
    windows, _ = decontamination.item_windows(spark.createDataFrame([(1, "red fox blue"), (2, "fox")], "item_id long, text string"))
    terms = windows.select(F.explode("terms").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("term_id"))
    from pulsegrid.llm.common import stored

    terms = stored(terms, "terms")
    index = decontamination.build_index(docs, terms)
    found = decontamination.proximity_matches(index, decontamination.window_terms(windows, terms, index), 4)
    rows = index.where("term_id = -1").select("row", "doc_id")
    got = found.join(windows, "window").join(rows, "row").select("doc_id", F.size("terms").alias("n")).distinct().collect()
    assert {tuple(x) for x in got} == {(0, 3), (1, 3), (0, 1), (1, 1), (2, 1), (3, 1)}


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps, radius):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            up[root(i)] = root(j)
    least = defaultdict(lambda: 10**9)
    for i, x in enumerate(ids):
        least[root(i)] = min(least[root(i)], x)
    return [least[root(i)] for i in range(len(ids))]


def test_simhash(spark):
    r = random.Random(5)
    base = [" ".join(r.choices(WORDS, k=400)) for _ in range(12)]
    values = [*texts(20)[:-1]]
    for t in base:
        for _ in range(6):
            w = t.split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "Changed" + str(r.random())
            values.append(" ".join(w))
    values += base + [None, ""]
    docs = frame(spark, values)
    got = sorted(simhash.near_duplicates(docs).collect(), key=lambda x: x.doc_id)
    fps = [plain_fingerprint(t) for t in values]
    assert [x.fp % (1 << 64) for x in got] == fps
    want = groups(list(range(len(values))), fps, 2)
    assert [x.component_id for x in got] == want
    assert len({*want}) < len({*fps})  # some links join different fingerprints
    assert sorted(x.doc_id for x in simhash.deduplicated(docs).collect()) == sorted({*want})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_bit_slices_and_links(spark, radius):
    rng = np.random.default_rng(radius)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 40)}
    for x in list(fps)[:20]:
        y = x
        for _ in range(30):
            y ^= sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 4)))
            fps.add(y % (1 << 64))
    fps = sorted(fps)
    a = np.array(fps, np.uint64)
    near = simhash.BitSlices(a, list(range(64))).within(a, radius)
    bits = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, : len(a)].astype(bool)
    assert (bits == np.array([[(x ^ y).bit_count() <= radius for y in fps] for x in fps])).all()
    wanted = np.packbits(np.arange(-(-len(a) // 64) * 64) % 3 == 0, bitorder="little").view(np.uint64)
    some = simhash.BitSlices(a, list(range(64)))
    near = np.unpackbits(some.within(a, radius, wanted).view(np.uint8), axis=1, bitorder="little")[:, : len(a)].astype(bool)
    assert (near == bits * (np.arange(len(a)) % 3 == 0)).all()
    reps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = {x.node % (1 << 64): x.root for x in simhash.components(simhash.links(reps, radius)).collect()}
    want = groups(list(range(len(fps))), fps, radius)
    by_root, by_want = defaultdict(set), defaultdict(set)
    for i, x in enumerate(fps):
        by_root[found.get(x, x)].add(i)
        by_want[want[i]].add(i)
    assert {frozenset(v) for v in by_root.values()} == {frozenset(v) for v in by_want.values()}


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vec = [[float(x) for x in v] for v in rng.normal(size=(700, 8)) * rng.exponential(1, (700, 1))]
    vec[10:40] = [vec[0]] * 30  # ties
    vec += [[], [None] * 8, [math.nan] * 8, [math.inf] * 8, [0.0] * 8, [1.0, 2.0], [3.0, 1.0], None, []]
    rows = [(i, v, 1, 0.5) for i, v in enumerate(vec)]
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<double>, rank int, score double")
    monkeypatch.setattr(topk, "BLOCK_VALUES", 64 * 8)
    monkeypatch.setattr(topk, "HEAD_ROWS", 100)
    df = df.unionByName(spark.createDataFrame([(None, [1.0] * 8, 1, 0.5)], df.schema))  # a null id takes no part
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows + rows[:3] if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in dict(fine).items():
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in fine if c != q and len(w) == len(v))
            want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(scored[:5])}
    assert {tuple(x) for x in got} == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_blocks_prune_and_lose_nothing(spread):
    """Vectors of spread lengths are pruned by length, clustered ones of nearly one length by coordinates."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16)) * (rng.random((30, 16)) < 0.2) * 5
    v = centres[rng.integers(30, size=4000)] + rng.normal(size=(4000, 16)) * 0.2
    v *= np.exp(spread * rng.normal(size=(4000, 1))) / np.linalg.norm(v, axis=1, keepdims=True)
    v = np.floor(256 * v).astype(np.int64)
    length = np.sqrt((v.astype(float) ** 2).sum(1))
    order = np.argsort(-length)
    v, length, ids = v[order], length[order], np.arange(4000)
    asked = np.arange(0, 4000, 50)
    scores = v[asked] @ v.T
    scores[np.arange(len(asked)), asked] = np.iinfo(np.int64).min
    kth = np.sort(scores, 1)[:, -5]
    theta = kth.astype(float)
    theta[0] = -np.inf
    got, pruned, pairs = set(), 0, 0
    for a in range(0, 4000, 200):
        found, out = topk.Candidates(ids[a : a + 200], v[a : a + 200], length[a : a + 200]).best(ids[asked], v[asked], length[asked], theta, 5)
        got |= {tuple(x) for x in found.T.tolist()}
        pruned, pairs = pruned + out, pairs + 200 * len(asked)
    want = {(int(asked[i]), int(j), int(scores[i, j])) for i in range(len(asked)) for j in np.flatnonzero(scores[i] >= kth[i])}
    assert want <= got
    assert pruned / pairs > 0.4
    print(f"spread {spread}: {pruned / pairs:.3f} of the pairs pruned")


def test_products_stay_exact():
    a = np.array([[2**40, -(2**40), 3]])
    assert topk.products(a, a, float(2**81))[0, 0] == (1 << 63) - 1
    b = np.array([[2**28, 1, 1]])
    assert topk.products(b, b, float(2**56))[0, 0] == 2**56 + 2


def test_min_cut_is_least():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 8)
        s = [r.choice([-1, 1]) * r.random() * 3 for _ in range(n)]
        e = [(i, j, r.random() * 2) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        cost = lambda x: sum(abs(s[i]) for i in range(n) if x[i] != (s[i] > 0)) + sum(w for i, j, w in e if x[i] != x[j])  # noqa: B023, E731
        assert cost(html_extraction.min_cut(s, e)) == pytest.approx(min(cost(x) for x in itertools.product((False, True), repeat=n)))


PAGE = """<!DOCTYPE html><html class="has-sidebar"><head><title>T</title><style>p{}</style><script>if (a<b) x="</p>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies on this site. Please accept all of them now.</div><div class=sidebar><p>Latest stories that everyone has read today.</p></div>
<article><h1>Title &amp; more</h1><p>A   first\n<b>paragraph</b> &copy; that is long enough to count, with <a href=y>a link</a>.<p>Short.<div class="ad">Buy this now!</div>
<ul><li>One<li>Two</ul><p>The last paragraph of the text.</p><form><label>Name</label><input><button>Send</button></form></article>
<section id="comments"><p>I think that this is a great article, and I have much to say about it.</p></section><footer>&copy; us &middot; legal</footer></body></html>"""


def test_html(spark):
    want = "Title & more\nA first paragraph © that is long enough to count, with a link.\nShort.\nOne\nTwo\nThe last paragraph of the text."
    cases = [(PAGE, want), (None, ""), ("", ""), ("<nav>a</nav>", ""), ("<article><p>A text that was cut off in the mid", "A text that was cut off in the mid"), ("<article><p>A text that is cut <a hre", "A text that is cut")]
    cases.append(("<article>" + "<p>Paragraph number one.</p>" * 5000, "\n".join(["Paragraph number one."] * 5000)))
    df = spark.createDataFrame([(i, "u", h, "x") for i, (h, _) in enumerate(cases)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extraction.extract(df).collect()}
    for i, (_, text) in enumerate(cases):
        assert (got[i].text, got[i].n_chars) == (text, len(text))
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_language(spark):
    r = random.Random(4)
    kinds = {"en": "the of and thing with".split(), "fr": "le de éaux être çon".split(), "de": "der und über straß zu".split()}
    rows = [(i, " ".join(r.choices(kinds[lang], k=20)), "s", lang, "", "", 0) for i, lang in enumerate(r.choices(list(kinds), k=300))]
    odd = [(1000, None, None, None, "", "", 0), (1001, "", None, "en", "", "", 0), (1002, "12 !?", None, "fr", "", "", 0), (None, "the of and", None, None, "", "", 0)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    got = langid.identify(docs, langid.trained(docs)).collect()
    assert len(got) == len(rows) + 4
    known = [x for x in got if x.doc_id is not None and x.doc_id < 1000]
    assert sum(x.lang_pred == x.lang for x in known) >= 0.98 * len(known)
    assert all((x.lang_pred, x.score, x.ambiguous) == ("und", 0.0, True) for x in got if x.doc_id and x.doc_id >= 1000)
    assert all(0 <= x.score <= 1 for x in got)
    assert {x.lang_pred for x in langid.identify(docs, langid.trained(docs.limit(0))).collect()} == {"und"}
    long = " ".join(r.choices(WORDS, k=120_000))  # the same counts however it is cut
    whole, langid.CHUNK = langid.counts(long), 1 << 30
    try:
        assert np.abs(langid.counts(long) - whole).max() <= 1e-9
    finally:
        langid.CHUNK = 1 << 18
    for n in (1, 2, 4, 5, 9):
        code = langid.codewords(n)
        assert len({tuple(x) for x in code}) == n


def test_quality(spark):
    r = random.Random(6)
    good = [" ".join(r.choices(WORDS, k=40)) + "." for _ in range(150)]
    bad = [" ".join(w + "###" for w in r.choices(WORDS, k=40)) for _ in range(40)]
    rows = [(i, t, int(t in set(good)), "x") for i, t in enumerate(good + bad)] + [(900, None, None, "x"), (901, "", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, score string")
    labels = docs.where("doc_id % 5 <> 0").select("doc_id", "label")
    model = quality.fit(docs, labels)
    got = {x.doc_id: x for x in quality.score(docs, model).collect()}
    assert all(got[i].predicted == label for i, _, label, _ in rows[:-2])
    assert all(0 <= x.score <= 1 for x in got.values()) and got[900].score == got[901].score
    assert quality.fit(docs, labels.limit(0)) is None and quality.fit(docs.limit(0), labels) is None and {x.score for x in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0
    assert hashlib.sha256(model["w"].tobytes()).digest() == hashlib.sha256(quality.fit(docs.repartition(3), labels)["w"].tobytes()).digest()


def test_blocks_of_fingerprints_are_abandoned():
    """Of a large bucket, a search reads on only in the blocks that still hold a fingerprint within the radius."""
    rng = np.random.default_rng(4)
    bits = list(range(16))
    fps = np.sort(rng.choice(1 << 16, 4000, replace=False)).astype(np.uint64)
    s = simhash.BitSlices(fps, bits)
    found = s.within(fps[:1], 2)
    want = np.array([(int(x) ^ int(fps[0])).bit_count() <= 2 for x in fps])
    assert (np.unpackbits(found.view(np.uint8), bitorder="little")[: len(fps)].astype(bool) == want).all()
    assert s.scanned == 63 and s.abandoned > 20
    before = s.abandoned
    s.within(fps[:1], 2, np.zeros_like(s.valid))
    assert s.abandoned == before + 63  # nothing is wanted


def test_simhash_of_null_ids_and_repeated_rows(spark):
    t = "some words that make a text of their own here"
    rows = [(None, t, 1), (None, t, 1), (5, t, 2), (5, t, 2), (7, "another text of quite other words than that one", 3), (None, None, 4), (9, "", 5)]
    got = sorted(((x.doc_id, x.component_id) for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()), key=repr)
    assert got == sorted([(None, 5), (None, 5), (5, 5), (5, 5), (7, 7), (None, 9), (9, 9)], key=repr)
    assert sorted(x.doc_id for x in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, _hash int")).collect()) == [5, 7, 9]


def test_token_files_of_rows_without_an_id(spark, tmp_path):
    rows = [(None, f"text {i % 50}") for i in range(400)] + [(i, "again") for i in (1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/t")
    assert manifest.where("docs > 0").count() > 2  # they don't all meet in one task
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    assert [x.doc_id for x in got] == [None] * 400 + [1] * 3 and len({x.start for x in got}) == 403


def test_components_of_links_that_change_when_computed_again(spark):
    """A link's direction is drawn anew each time its plan runs, as rows that come in another order may draw another tree."""
    flip = F.udf(lambda: random.SystemRandom().random() < 0.5, "boolean").asNondeterministic()
    chain = spark.range(120).withColumn("flip", flip()).select(F.when(F.col("flip"), F.col("id")).otherwise(F.col("id") + 1).alias("a"), F.when(F.col("flip"), F.col("id") + 1).otherwise(F.col("id")).alias("b"))
    assert {(x.node, x.root) for x in simhash.components(chain).collect()} == {(i, 0) for i in range(121)}


def test_links_do_not_depend_on_the_order_of_rows(spark):
    r = random.Random(8)
    fps = [r.getrandbits(63) for _ in range(10)]
    fps = sorted({x ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for x in fps for _ in range(40)})
    runs = [{tuple(x) for x in simhash.links(spark.createDataFrame([(x,) for x in some], "fp long").repartition(n), 2).collect()} for some, n in ((fps, 1), (fps[::-1], 7))]
    assert runs[0] == runs[1]
