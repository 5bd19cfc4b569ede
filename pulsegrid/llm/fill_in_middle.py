"""Fill-in-middle: texts are cut at unit boundaries into prefix, middle and suffix, which change places between markers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without_clashes

#: Insides of character classes.
SPACE = r"\x20\x09-\x0D"
#: What units may be, as the neighbouring classes (before, after) between which one unit ends and the next begins; a class is the inside of [...] and ^ is any character.
#: words: a word with the white space before it, and what white space ends the text. runs: words and white space apart. lines: lines with their line feed.
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "words": [(f"^{SPACE}", SPACE)],
    "runs": [(f"^{SPACE}", SPACE), (SPACE, f"^{SPACE}")],
    "lines": [(r"\n", r"\x00-\x{10FFFF}")],
    "characters": [(r"\x00-\x{10FFFF}", r"\x00-\x{10FFFF}")],
}
#: Between the two halves of a character over U+FFFF there is no boundary.
WHOLE = r"(?<![\x{D800}-\x{DBFF}](?=[\x{DC00}-\x{DFFF}]))"
MARKERS = ("<P>", "<S>", "<M>")


def boundary(grammar: list[tuple[str, str]]) -> str:
    """The zero-width pattern of a grammar's boundaries: a character of one class behind, one of the other ahead."""
    return "(?:" + "|".join(f"(?<=[{a}])(?=[{b}])" for a, b in grammar) + ")" + WHOLE


def units(text: Column, grammar: list[tuple[str, str]]) -> Column:
    """The units of a text, which make it up again when they are joined; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def _draw(k: int) -> Column:
    """The k-th group of eight digits of the row's hash as an unsigned number."""
    return F.conv(F.substring("_sha", 8 * k + 1, 8), 16, 10).cast("long")


def _joined(first: Column, n: Column) -> Column:
    return F.array_join(F.slice("_units", first, n), "")


def fill_in_middle(
    docs: DataFrame, grammar: list[tuple[str, str]] | None = None, seed: int = 42, percent: int = 50, spm_percent: int = 80,
    markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """docs plus n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    Cuts and forms are drawn from the hash of seed and id, so reruns agree: of n units the prefix ends after the smaller of two draws from 0 to n, the middle after the larger. psm is
    marker P, prefix, marker S, suffix, marker M, middle; spm is marker S, suffix, marker P, prefix, marker M, middle. `percent` of the texts are changed at all, `spm_percent` of these to spm.

    Null and empty texts have no units and stay empty, as plain; texts that hold a marker are plain too. A null id draws like an id without digits; rows that repeat an id draw alike.
    Pieces may be empty. Very long texts are one array of units at a time. Columns of docs named like the new ones are replaced, all others keep their values, whatever their
    names. An empty table gives an empty result.

    One scan without a shuffle: the boundaries are zero-width patterns between neighbouring classes, so Spark's split keeps every character.
    """
    p, s, m = markers
    if len({*markers}) != 3 or not all(re.fullmatch(r"<[^<>]+>", x) for x in markers):  # so that none can begin before or within another or a piece
        raise ValueError("markers are three different names in <>")
    docs = without_clashes(docs, "n", "form", "prefix_chars", "middle_chars", "output")
    own = docs.columns
    text = F.coalesce(F.col("_text"), F.lit(""))
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_own"), F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    x = x.select("_own", text.alias("_text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("_id", F.lit(""))).cast("binary"), 256).alias("_sha"))
    x = x.withColumn("_units", units(F.col("_text"), grammar or GRAMMARS["words"])).withColumn("n", F.size("_units").cast("long"))
    cuts = [_draw(k) % (F.col("n") + 1) for k in (0, 1)]
    marked = F.col("_text").contains(p) | F.col("_text").contains(s) | F.col("_text").contains(m)
    form = F.when((F.col("_text") == "") | marked | (_draw(2) % 100 >= percent), "plain").when(_draw(3) % 100 < spm_percent, "spm").otherwise("psm")
    x = x.withColumns({"_a": F.least(*cuts).cast("int"), "_b": F.greatest(*cuts).cast("int"), "form": form})
    changed = F.col("form") != "plain"
    pieces = {"_prefix": _joined(F.lit(1), F.col("_a")), "_middle": _joined(F.col("_a") + 1, F.col("_b") - F.col("_a")), "_suffix": _joined(F.col("_b") + 1, F.size("_units") - F.col("_b"))}
    x = x.withColumns({k: F.when(changed, v) for k, v in pieces.items()})
    spm = F.concat(F.lit(s), "_suffix", F.lit(p), "_prefix", F.lit(m), "_middle")
    psm = F.concat(F.lit(p), "_prefix", F.lit(s), "_suffix", F.lit(m), "_middle")
    output = F.when(F.col("form") == "spm", spm).when(F.col("form") == "psm", psm).otherwise(F.col("_text"))
    new = [F.char_length(f"_{c}").cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return x.select("_own.*", "n", "form", *new, output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of a form was made from. Pieces hold no marker, and none can lie across a piece's end, so markers are found where they were put."""
    pieces = F.split(output, "|".join(re.escape(x) for x in markers), -1)
    at = lambda i: F.get(pieces, i)
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS sha,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, cast('0x' || substr(sha, 1, 8) AS BIGINT) % (len(units) + 1) AS c1, cast('0x' || substr(sha, 9, 8) AS BIGINT) % (len(units) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR cast('0x' || substr(sha, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN cast('0x' || substr(sha, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), pieces AS (
  SELECT doc_id, text, n::BIGINT AS n, form, coalesce(array_to_string(units[1:least(c1, c2)], ''), '') AS prefix,
         coalesce(array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS middle, coalesce(array_to_string(units[greatest(c1, c2) + 1:n], ''), '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""
