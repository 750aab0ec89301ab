"""What comes from files and requests: pattern files, requests as typed rows, and corpora of cases."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATIENT = "struct<full_name:string,nric:string,dob:date,phone:string,address:string,policy_number:string,insurer:string,clinical_text:string>"
LIVE_FIELD = "struct<label:string,type:string,description:string,options:array<string>,instance:int>"
#: Requests by their kind.
REQUESTS = {
    "parse": "struct<text:string,full_name:string>",
    "map": f"struct<form_id:string,patient:{PATIENT},schema:string>",
    "map-redacted": f"struct<fields:array<{LIVE_FIELD}>,redacted_text:string>",
    "map-live": f"struct<fields:array<{LIVE_FIELD}>,patient:{PATIENT}>",
    "fill": "struct<values:map<string,string>,schema:string,pdf_base64:string>",
    "upload": "struct<pdf_base64:string,filename:string,insurer:string>",
    "known": "struct<sha256:string>",
}
NEEDED = ("nric", "phone", "email")


class PatternError(ValueError):
    """A pattern file that would let identifiers through."""


def patterns(spark: SparkSession, path: str) -> tuple[tuple[tuple[str, str, int], ...], tuple[str, ...]]:
    """((pattern, token, first number), ...) and shields of a JSON file; there is no fallback to patterns of our own.

    Fails if the file isn't there or has no patterns, or none for one of the identifiers that the parser needs.
    """
    body = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    try:
        spec = json.loads(body)
    except ValueError as e:
        raise PatternError("the pattern file isn't JSON") from e
    found = spec.get("patterns") or []
    missing = [f for f in NEEDED if f not in {p.get("field") for p in found}]
    if not found or missing:
        raise PatternError(f"the pattern file has no pattern for {', '.join(missing) or 'anything'}")
    flags = lambda p: "(?iU)" if p.get("ignore_case") else "(?U)"
    return tuple((flags(p) + p["regex"], p["token"], int(p["start"])) for p in found), tuple(flags(s) + s["regex"] for s in spec.get("shields") or [])


def requests(raw: DataFrame, kind: str) -> DataFrame:
    """raw (request_id, body) as typed rows with an error for bodies that can't be read; no error names what was in one."""
    j = raw.withColumn("r", F.from_json("body", REQUESTS[kind]))
    readable = F.try_parse_json("body").isNotNull() & F.trim("body").startswith("{")
    return j.select("request_id", F.when(readable, F.col("r")).alias("r"), F.when(~F.coalesce(readable, F.lit(False)), "not readable").alias("error")).select("request_id", "error", "r.*")


def corpus(spark: SparkSession, path: str, case: str) -> DataFrame:
    """The cases of a JSON file {"cases": [...]}, a row each. case: the type of one, as DDL."""
    return spark.read.schema(f"cases array<{case}>").option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")
