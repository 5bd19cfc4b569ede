"""Benchmark decontamination by a distributed positional inverted index of the training texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, small, stored, table, without_clashes

#: A word, before A-Z are lower-cased; the same runs as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after that.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The entry that each document has in the index besides its words; its position is the number of words.
END = -1


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows, owners) of benchmark items: (window, terms) for each different run of n words, or the whole of an item that has fewer
    but not none, and (window, item_id). Null and wordless items have none; repeated items share their windows."""
    words = items.select(F.col(id_col).alias("item_id"), F.transform(_words(F.col(text_col)), ascii_lower).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    each = stored(words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, n))).alias("terms")).distinct(), "item-windows")
    windows = stored(each.select("terms").distinct().select(F.monotonically_increasing_id().alias("window"), "terms"), "windows")
    return windows, stored(each.join(windows, "terms").select("window", "item_id"), "owners")


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index: (row, term_id, pos) for every word of docs that stands in terms (term, term_id), and for every document
    an entry with term_id END, its number of words as pos, and its doc_id and text_hash.

    row numbers the documents; it is fixed once the index is stored, so null and repeated ids and repeated rows do no harm.
    Postings of words that no query has can never be read, so they aren't stored. One pass over the texts, without a shuffle
    unless terms is too large to be broadcast.
    """
    spark = docs.sparkSession
    end = spark.createDataFrame([("", END)], "term string, term_id long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.concat(_words(F.col(text_col)), F.array(F.lit(""))).alias("w"))
    posted = rows.select("row", "_id", "_hash", F.posexplode("w").alias("pos", "word")).withColumn("term", ascii_lower(F.col("word")))
    posted = posted.join(small(stored(terms.unionByName(end), "terms")), "term")
    at_end = F.col("term_id") == END
    return stored(posted.select("row", "term_id", "pos", F.when(at_end, F.col("_id")).alias("doc_id"), F.when(at_end, F.col("_hash")).alias("text_hash")), "index")


def window_terms(windows: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """(window, off, len, term_id, rarity): the words of each window, numbered from its rarest in the index (1), and the postings of each as freq."""
    freq = index.where(F.col("term_id") != END).groupBy("term_id").agg(F.count(F.lit(1)).alias("freq"))
    each = windows.select("window", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "term")).join(small(terms), "term").join(small(stored(freq, "frequencies")), "term_id")
    rarity = F.row_number().over(Window.partitionBy("window").orderBy("freq", "off"))
    return stored(each.withColumn("rarity", rarity).select("window", "off", "len", "term_id", "rarity", "freq"), "window-terms")


def phrase_matches(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, window, start, len) of every place where all words of a window stand in its order, without gaps.

    The postings of a window's rarest word give the places where it may start. Those lists, offset-adjusted, are intersected with those
    of its second rarest word, and what is left with those of all its other words. Every step is a semi-join on (term, row, position),
    which no frequent word, passage or document makes uneven.
    """
    postings = index.where(F.col("term_id") != END).select("row", "term_id", "pos")
    whole = wanted.groupBy("window").agg(F.count(F.lit(1)).alias("found"), F.first("len").alias("len")).where("found = len").select("window")
    wanted = stored(wanted.join(whole, "window", "left_semi"), "wanted")
    first = wanted.where("rarity = 1").select("window", "len", "term_id", "off")
    second = wanted.where("rarity = 2").select("window", F.col("term_id").alias("_t2"), F.col("off").alias("_o2"))
    pairs = stored(first.join(second, "window", "left"), "rarest")
    starts = postings.join(small(pairs), "term_id").withColumn("start", F.col("pos") - F.col("off")).where("start >= 0").drop("pos", "term_id", "off")
    alone = starts.where("_t2 is null").select("row", "window", "start", "len")
    rare = postings.join(small(stored(pairs.select(F.col("_t2").alias("term_id")).distinct(), "second")), "term_id", "left_semi")
    two = starts.where("_t2 is not null").withColumn("_at", F.col("start") + F.col("_o2"))
    two = two.join(rare, (two["_t2"] == rare["term_id"]) & (two["row"] == rare["row"]) & (two["_at"] == rare["pos"]), "left_semi")
    left = stored(two.select("row", "window", "start", "len").unionByName(alone), "candidates")
    rest = wanted.where("rarity > 2").select("window", "term_id", "off")
    need = left.join(small(rest), "window").withColumn("_at", F.col("start") + F.col("off")).withColumnRenamed("term_id", "_t")
    lists = postings.join(small(stored(left.select("row").distinct(), "rows")), "row", "left_semi")
    have = need.join(lists, (need["_t"] == lists["term_id"]) & (need["row"] == lists["row"]) & (need["_at"] == lists["pos"]), "left_semi")
    full = have.groupBy("row", "window", "start", "len").agg(F.count(F.lit(1)).alias("n")).where("n = len - 2").drop("n")
    return stored(full.unionByName(left.where("len <= 2")), "matches")


def proximity_matches(index: DataFrame, wanted: DataFrame, distance: int) -> DataFrame:
    """(row, window, pos) of every posting of a window's rarest word that has each of the window's other words, in any order, at most distance words away.

    A posting is looked up in the position block of its own and in the two beside it, so nothing but near postings meets. Words that a
    window repeats must be there once.
    """
    postings = index.where(F.col("term_id") != END).select("row", "term_id", "pos")
    size = distance + 1
    found = wanted.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.first("len").alias("len")).where("n = len").select("window")
    wanted = stored(wanted.join(found, "window", "left_semi"), "wanted")
    first = wanted.where("rarity = 1").select("window", "term_id")
    start = stored(postings.join(small(first), "term_id").select("row", "window", "pos", F.col("term_id").alias("_own")), "anchors")
    others = stored(wanted.join(first.withColumnRenamed("term_id", "_own"), "window").where("term_id <> _own").select("window", "term_id").distinct(), "others")
    count = others.groupBy("window").agg(F.count(F.lit(1)).alias("_need"))
    need = start.join(small(others), "window").withColumn("_block", F.explode(F.array(*[F.floor(F.col("pos") / size) + i for i in (-1, 0, 1)])))
    near = postings.withColumn("_block", F.floor(F.col("pos") / size)).withColumnRenamed("pos", "_pos")
    near = need.join(near, ["row", "term_id", "_block"]).where(F.abs(F.col("pos") - F.col("_pos")) <= distance)
    full = near.groupBy("row", "window", "pos").agg(F.count_distinct("term_id").alias("_n")).join(count, "window").where("_n = _need").select("row", "window", "pos")
    return full.unionByName(start.join(others, "window", "left_anti").select("row", "window", "pos"))


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_words, n_hit (words inside any occurrence of an item's window), n_items and items (the ids,
    as strings in order, of items with occurring windows) and contaminated (n_hit > 0).

    Null and empty texts have no words and no hits. Repeated rows and ids and null ids each give a row of their own. Repeated items
    count by their ids; a null item id counts as the string null. Without documents the result is empty, without items nothing is hit.
    Further columns of either table aren't looked at.
    """
    windows, owners = item_windows(items, n, "item_id", "text")
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    terms = stored(terms.select("term", F.monotonically_increasing_id().alias("term_id")), "vocabulary")
    index = build_index(docs, terms, id_col, text_col)
    found = phrase_matches(index, window_terms(windows, terms, index))
    end = F.col("start") + F.col("len")
    spans = found.groupBy("row", "start").agg(F.max(end).alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    hit = spans.withColumn("_before", F.coalesce(before, F.lit(0))).groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "_before"))).alias("n_hit"))
    owned = found.select("row", "window").distinct().join(small(owners), "window").select("row", F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item")).distinct()
    owned = owned.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    rows = index.where(F.col("term_id") == END).select("row", "doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))
    out = rows.join(hit.join(owned, "row"), "row", "left")
    none = F.array().cast("array<string>")
    items_of, hits = F.coalesce("items", none), F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "text_hash", "n_words", hits.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), (hits > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows."""
    bad = contamination(docs, items, n, id_col, text_col).where("contaminated").select(F.col("doc_id").alias("_id"), "text_hash").distinct()
    bad = stored(bad, "contaminated")
    docs = without_clashes(docs, "_hash").withColumn("_hash", F.xxhash64(text_col))
    return docs.join(small(bad), docs[id_col].eqNullSafe(bad["_id"]) & (docs["_hash"] == bad["text_hash"]), "left_anti").drop("_hash")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_start AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM item_start
), doc_start AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), hit AS (
  SELECT d.doc_id, d.i, d.n, win.item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM doc_start) d JOIN win ON d.g = win.g AND d.n = win.n
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), owned AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, len(doc.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN owned USING (doc_id)
"""
