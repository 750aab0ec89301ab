"""Fill-in-the-middle examples in column expressions alone.

A text is cut into its code points by regexp_extract_all; digits of a SHA-256 of the document's id give the two cuts and
the form, slice and array_join build the arrangement with sentinels, and the sentinels' places give the text back.

Defined cases: a null or empty text is plain, as is one that holds a sentinel; a null doc_id is hashed as no digits;
repeated rows get the same cuts; equal cuts leave the middle empty; whole texts are cut, whatever their length; an empty
table gives no rows; further columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, so many are rearranged, and of these so many begin with the suffix.
REARRANGED, SUFFIX_FIRST = 90, 20
UNIT = "(?s)."


def _digits(hashed: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, from 1, as a number."""
    return F.conv(F.substring(hashed, 8 * k - 7, 8), 16, 10).cast("long")


def arranged(docs: DataFrame, seed: str = "1") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("whole"), hashed.alias("hashed"))
    rows = rows.select("doc_id", "whole", F.length("whole").cast("long").alias("n"), *[_digits(F.col("hashed"), k).alias(f"h{k}") for k in range(1, 5)])
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    plain = (F.col("n") == 0) | (F.col("h3") % 100 >= REARRANGED)
    for s in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.col("whole").contains(s)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    rows = rows.select("doc_id", "whole", "n", form.alias("form"), F.least(one, two).cast("int").alias("lo"), F.greatest(one, two).cast("int").alias("hi"))
    cut = F.col("form") != "plain"
    units = F.when(cut, F.regexp_extract_all("whole", F.lit(UNIT), F.lit(0)))
    rows = rows.select("*", units.alias("units"))
    part = lambda at, size: F.array_join(F.slice("units", at, size), "")
    rows = rows.select(
        "doc_id", "whole", "n", "form", "lo", "hi",
        part(F.lit(1), F.col("lo")).alias("prefix"), part(F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("middle"), part(F.col("hi") + 1, F.col("n").cast("int") - F.col("hi")).alias("suffix"),
    )
    p, s, m = (F.concat(F.lit(x), F.col(c)) for x, c in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    output = F.when(~cut, F.col("whole")).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.concat(p, s, m))
    return rows.select("doc_id", "n", "form", F.when(cut, F.col("lo").cast("long")).alias("prefix_chars"), F.when(cut, (F.col("hi") - F.col("lo")).cast("long")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Parts hold no sentinel and sentinels can't overlap, so each is found at its first place."""
    first, second = F.when(form == "spm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    head = F.substring_index(output, MIDDLE, 1)
    middle = F.substr(output, F.length(head) + len(MIDDLE) + 1)
    one = F.substr(F.split_part(head, second, F.lit(1)), F.length(first) + 1)
    two = F.split_part(head, second, F.lit(2))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = arranged(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
e AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substring(t, 1, lo) AS p, substring(t, lo + 1, hi - lo) AS m, substring(t, hi + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM g
"""
