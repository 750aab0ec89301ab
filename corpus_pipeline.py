"""From raw documents to packed sequences in five stages, each calling one operator of quillstone.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`, in the order and with the further columns they came with, whatever their names. run() writes each stage's
rows and reads them again for the next. All stages read whole texts, give no rows for an empty table, and take repeated
rows and nulls in any column.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import langid, mixing, neardup, packing, secret_scan
from quillstone.llm.common import give_back, pieces, settled, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay; null and empty texts, those without a letter and those of no clear language go.

    Repeated rows are judged alike. Of two languages equally likely the first by name counts.
    """
    return langid.accepted(docs, langid.learned(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of the smallest doc_id, once if it is repeated.

    Null, empty and blank texts are in no group, nor are rows with a null doc_id: all of these stay.
    """
    return neardup.unique(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, overlapping ones as one; no document goes. n_chars follows the text. A null text stays null."""
    columns = docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            at = whole.schema.get_field_index("text")
            for b in pieces(whole, 2_000_000):
                text = pa.array([None if t is None else secret_scan.masked(t) for t in b.column("text").to_pylist()], whole.schema.field(at).type)
                yield b.set_column(at, whole.schema.field(at), text)
        give_back()

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns) if "n_chars" in columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole passes, and once more for a part of a pass with that part's chance.

    Null and blank texts are never taken. Rows that share a doc_id, null ids among them, are all taken as often as the largest of
    them. Reruns agree: the chance is a seeded hash of the doc_id.
    """
    own = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names of the documents' columns can't clash with those below
    at = f"c{docs.columns.index('doc_id')}"
    taken = mixing.mixed(docs).filter("taken > 0").groupBy(F.col("doc_id").alias("mix_id")).agg(F.max(F.struct("size", "taken")).alias("m")).select("mix_id", "m.size", "m.taken")
    chance = F.conv(F.substring(F.md5(F.concat(F.lit("part:"), F.coalesce(F.col("mix_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 2**32
    copies = (F.floor(F.col("taken") / F.col("size")) + F.when(chance < (F.col("taken") % F.col("size")) / F.col("size"), 1).otherwise(0)).cast("int")
    copies = taken.select("mix_id", copies.alias("copies")).filter("copies > 0")
    both = own.join(copies, F.col(at).eqNullSafe(F.col("mix_id"))).withColumn("one", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return both.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens; each row is a document, null and empty texts have the end id alone."""
    return packing.packed(docs, forget=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("sequences", sequences)]

#: SQL can't express the language model, the shingle links, the key structures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs, f"stage-{name}")
    return docs
