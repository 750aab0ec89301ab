"""Models as providers: a provider turns requests (key, prompt) into replies (key, stop, reply). Two are built in: one plays recorded replies, one asks any function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import TOKEN
from .review import REPLY, assembled, coerced, parsed_replies, with_demographics
from .tables import written

Provider = Callable[[DataFrame], DataFrame]


def recorded(recordings: DataFrame) -> Provider:
    """Replies by the prompt's SHA-256. recordings: prompt_sha256, stop, reply. A request without a recording has no reply."""
    r = recordings.dropDuplicates(["prompt_sha256"])

    def play(requests: DataFrame) -> DataFrame:
        return requests.withColumn("prompt_sha256", F.sha2(F.col("prompt"), 256)).join(r, "prompt_sha256", "left").select("key", "stop", "reply")

    return play


LEDGER = "prompt_sha256 string, stop string, reply string"


def asking(work: Callable[[str], tuple[str, str | None]], folder: str, rounds: int = 8, workers: int = 4, tries: int = 3, seconds: float = 240.0) -> Provider:
    """A provider that asks with work(prompt) -> (stop, reply), `workers` prompts of a task at a time, each of which has `tries` times `seconds`.

    Prompts are asked once, whoever asks them: replies go to a ledger, a table in the folder, by the prompt's SHA-256. They are asked in rounds by
    their hash, and each round is in the ledger before the next begins, so that what lost executors cost is at most a round, and a later call asks
    only what the ledger hasn't. A prompt whose tries all fail gets no reply and is not in the ledger.
    """

    def ledger(spark: SparkSession) -> DataFrame:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return spark.read.schema(LEDGER).parquet(folder) if there else spark.createDataFrame([], LEDGER)

    def one(prompt: str) -> tuple[str, str | None] | None:
        for _ in range(tries):
            try:
                return work(prompt)
            except Exception:  # whatever a model's client raises: its message may quote the prompt, so it isn't kept
                continue
        return None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.schema([("prompt_sha256", pa.string()), ("stop", pa.string()), ("reply", pa.string())])
        for whole in it:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                pool = ThreadPoolExecutor(workers)
                waiting = [pool.submit(one, p) for p in b.column("prompt").to_pylist()]
                rows = []
                for key, w in zip(b.column("prompt_sha256").to_pylist(), waiting, strict=True):
                    try:
                        got = w.result(seconds * tries)
                    except TimeoutError:
                        got = None
                    if got is not None:
                        rows.append((key, *got))
                pool.shutdown(wait=False, cancel_futures=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))], schema=names)

    def play(requests: DataFrame) -> DataFrame:
        spark = requests.sparkSession
        asked = requests.withColumn("prompt_sha256", F.sha2(F.col("prompt"), 256))
        each = written(asked.select("prompt_sha256", "prompt").filter("prompt IS NOT NULL").dropDuplicates(["prompt_sha256"]), "prompts")
        for k in range(rounds):
            mine = each.filter(F.pmod(F.xxhash64("prompt_sha256"), F.lit(rounds)) == k)
            mine.join(ledger(spark).select("prompt_sha256"), "prompt_sha256", "left_anti").mapInArrow(run, LEDGER).write.mode("append").parquet(folder)
        return asked.join(ledger(spark).dropDuplicates(["prompt_sha256"]), "prompt_sha256", "left").select("key", "stop", "reply")

    return play


def sweep_requests(texts: DataFrame) -> DataFrame:
    """(key, prompt) of redacted texts (key, redacted_text): which identifiers has the redaction left?"""
    ask = "Which names of persons, identity numbers, phone numbers, e-mail addresses or street addresses stand in this text and are not [TOKENS] already? Give each as it is written, one a line, or answer NONE.\n\n<text>\n"
    return texts.select("key", F.concat(F.lit(ask), "redacted_text", F.lit("\n</text>")).alias("prompt"))


def swept(texts: DataFrame, provider: Provider) -> DataFrame:
    """(key, findings): what a provider finds left in redacted texts, as redact.redacted takes it; nothing where there is no reply."""
    replies = provider(sweep_requests(texts))
    return replies.select("key", sweep_findings(F.col("reply")).alias("findings"))


def question_lines(fields: DataFrame) -> DataFrame:
    """(form, questions): a form's questions for the model as JSON, in order; options only where there are some. fields: form, ord, id, type, source, description, options."""
    some = F.when(F.size("options") > 0, F.col("options"))
    one = F.struct("ord", F.struct("id", "type", F.coalesce("description", F.lit("")).alias("description"), some.alias("options")).alias("q"))
    g = fields.filter("source = 'llm'").groupBy("form").agg(F.array_sort(F.collect_list(one)).alias("qs"))  # a form's own questions
    return g.select("form", F.to_json(F.transform("qs", lambda x: x["q"])).alias("questions"))


def map_requests(claims: DataFrame, fields: DataFrame) -> DataFrame:
    """(key, prompt): a claim's redacted note with its form's questions. claims: key, form, redacted_text."""
    text = F.concat(F.lit("Form fields to fill:\n"), "questions", F.lit("\n\nDe-identified clinical notes:\n<notes>\n"), "redacted_text", F.lit("\n</notes>"))
    return claims.join(question_lines(fields), "form").select("key", text.alias("prompt"))


def reply_errors(replies: DataFrame) -> DataFrame:
    """Adds error: why a reply can't be used, or null."""
    bad = F.from_json("reply", REPLY).getField("fields").isNull()
    error = F.when(F.col("stop") == "refusal", "refused").when(F.col("stop") == "max_tokens", "cut short").when(F.col("reply").isNull(), "no text").when(bad, "not readable")
    return replies.withColumn("error", error)


def mapped(claims: DataFrame, fields: DataFrame, provider: Provider, records: DataFrame | None = None, mode: str = "server") -> tuple[DataFrame, DataFrame]:
    """(review rows, errors) of claims (key, form, redacted_text) by a provider's replies.

    server: demographics are copied in from records (claim and a column each), and ambiguous dates are held. redacted: rows name the demographic instead.
    """
    replies = reply_errors(provider(map_requests(claims, fields)))
    good = replies.filter("error IS NULL").select(F.col("key").alias("claim"), "reply")
    asked = claims.select(F.col("key").alias("claim"), "form").join(good.select("claim"), "claim", "left_semi").join(fields, "form")
    rows = assembled(coerced(asked, parsed_replies(good)), mode)
    if mode == "server" and records is not None:
        rows = with_demographics(rows, records)
    return rows, replies.filter("error IS NOT NULL").select("key", "error")


def sweep_findings(reply: Column) -> Column:
    """What a sweep's reply lists, a line each without its bullet; none if it says so."""
    lines = F.transform(F.split(F.trim(reply), r"\r\n|[\n\r]"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[-• ]+", "")))
    return F.coalesce(F.filter(lines, lambda x: (x != "") & (F.upper(x) != "NONE")), F.array().cast("array<string>"))


def restored_or_none(text: Column, entries: Column) -> Column:
    """A citation with its tokens turned back; null if any token stays."""
    from .redact import remerged

    back = remerged(text, entries)
    return F.when((text != "") & ~back["text"].rlike(TOKEN), back["text"])


def note_text(pages: DataFrame, least: int = 60) -> DataFrame:
    """(file, text, error) of files' pages (file, page, text): non-blank pages in order with a blank line between; a file with hardly any text is refused."""
    own = F.trim(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    g = pages.withColumn("t", own).groupBy("file").agg(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("page", "t")))).alias("ps"))  # a file's own pages
    text = F.array_join(F.transform("ps", lambda x: x["t"]), "\n\n")
    return g.select("file", F.when(F.length(text) >= least, text).alias("text"), F.when(F.length(text) < least, "hardly any text").alias("error"))
