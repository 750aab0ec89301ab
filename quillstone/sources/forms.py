"""Form schemas as data: JSON files, one form each, validated into (ok, error)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BOX = "struct<page:int,x:double,y:double,w:double,h:double,size:double>"
FORM = f"form_id string, display_name string, insurer string, pdf_path string, fill_mode string, hosts array<string>, internal boolean, fields array<struct<id:string,label:string,pdf_field_name:string,type:string,source:string,description:string,options:array<string>,step:string,box:{BOX}>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The forms of a folder; of two files with one form_id the later by name counts."""
    raw = spark.read.schema(FORM).option("multiLine", True).json(path).withColumn("_file", F.input_file_name())
    last = raw.withColumn("_n", F.row_number().over(W.partitionBy("form_id").orderBy(F.col("_file").desc()))).filter("_n = 1")
    return last.drop("_n", "_file").withColumns({"fill_mode": F.coalesce("fill_mode", F.lit("acroform")), "internal": F.coalesce("internal", F.lit(False))})


def catalogue(forms: DataFrame, show_internal: bool = False) -> DataFrame:
    return forms.filter(~F.col("internal") | F.lit(show_internal))


def fields(forms: DataFrame) -> DataFrame:
    return forms.select("form_id", F.posexplode("fields").alias("ord", "f")).select("form_id", "ord", "f.*")


def checked(forms: DataFrame) -> DataFrame:
    """form_id and error: null, or why the form can't be addressed."""
    error = (
        F.when((F.col("fill_mode") == "web") & F.col("pdf_path").isNotNull(), "a web form has no pdf_path")
        .when((F.col("fill_mode") == "overlay") & F.exists("fields", lambda f: f["box"].isNull()), "an overlay field needs a box")
        .when((F.col("fill_mode") == "acroform") & F.exists("fields", lambda f: f["pdf_field_name"].isNull()), "an acroform field needs its name")
    )
    return forms.select("form_id", error.alias("error"))
