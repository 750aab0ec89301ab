"""De-identification: shield, dictionary pass, pattern pass, optional sweep; reversible by a token map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_first, renderings
from ..functions.patterns import INSTITUTION, TOKENED
from ..functions.text import HOLD, find_all, interleave, let, numbered, numbered_map, unresolved

ENTRIES = "array<struct<token:string,value:string>>"


def quoted(text: Column) -> Column:
    """The text as a pattern that matches it alone."""
    return F.regexp_replace(text, r"([\\\[\](){}.*+?^$|\-#&~ ])", r"\\$1")


def flexible(value: Column, strict: bool = False) -> Column:
    """A value as a pattern, any white space for each run of it. strict: also where the value ends in punctuation."""
    parts = F.filter(F.split(value, r"(?U)\s+"), lambda p: p != "")
    body = F.array_join(F.transform(parts, quoted), r"\s+")
    return F.concat(F.lit(r"(?<!\w)"), body, F.lit(r"(?!\w)")) if strict else F.concat(F.lit(r"\b"), body, F.lit(r"\b"))


def scrub_patterns(text: Column) -> Column:
    """Pattern pass alone: identifiers that nobody told us of become numbered tokens."""
    step = lambda pattern, base, start: lambda x: numbered(x, pattern, base, start)
    for spec in TOKENED:
        text = let(text, step(*spec))  # each pass names its text several times
    return text


def pattern_pass(text: Column, specs: tuple = TOKENED) -> Column:
    """The same as struct(text, entries), with the (token, value) entries in order; each pattern is looked for once.

    specs: (pattern, token, first number), our own or those of a file (sources.registry.patterns).
    """
    def one(pattern: str, base: str, start: int):
        def step(x: Column) -> Column:
            more = F.coalesce(numbered_map(x["text"], pattern, base, start), F.array().cast(ENTRIES))
            return F.struct(numbered(x["text"], pattern, base, start).alias("text"), F.concat(x["entries"], more).alias("entries"))

        return step

    out = F.struct(text.alias("text"), F.array().cast(ENTRIES).alias("entries"))
    for spec in specs:
        out = let(out, one(*spec))
    return out


def pattern_entries(text: Column) -> Column:
    return pattern_pass(text)["entries"]


def _named(col: str) -> Column:
    return F.nullif(F.trim(F.col(col)), F.lit(""))


def dictionary(strict: bool = False) -> Column:
    """(pattern, token) of a record's own identifiers, the most specific first; blank values are absent."""
    nric, phone, policy, address, name = (_named(c) for c in ("nric", "phone", "policy_number", "address", "full_name"))
    chars = F.array_join(F.transform(F.filter(F.split(nric, ""), lambda c: F.trim(c) != ""), quoted), r"\s?")
    digits = F.regexp_replace(phone, r"\D", "")
    digits = F.when(digits.startswith("65") & (F.length(digits) == 10), F.substring(digits, 3, 8)).otherwise(digits)
    one = lambda pattern, token: F.when(pattern.isNotNull(), F.array(F.struct(pattern.alias("pattern"), F.lit(token).alias("token"))))
    many = lambda patterns, token: F.transform(patterns, lambda p: F.struct(p.alias("pattern"), F.lit(token).alias("token")))
    words = F.split(name, r"(?U)\s+")
    turned = F.when(F.size(words) > 1, flexible(F.array_join(F.concat(F.slice(words, 2, F.size(words)), F.slice(words, 1, 1)), " "), strict))
    parts = F.transform(words, lambda w: F.concat(F.when(F.length(w) >= 3, F.lit("(?i)")).otherwise(F.lit("(?-i)")), F.lit(r"\b"), quoted(w), F.lit(r"\b")))
    any_case = lambda p: F.concat(F.lit("(?i)"), p)
    names = F.concat(F.array(any_case(flexible(name, strict))), F.coalesce(F.array(any_case(turned)), F.array().cast("array<string>")), parts)
    born = F.transform(renderings(F.col("dob")), lambda v: F.concat(F.lit(r"(?i)\b"), quoted(v), F.lit(r"\b")))
    none = F.array().cast("array<struct<pattern:string,token:string>>")
    found = [
        one(any_case(F.concat(F.lit(r"\b"), chars, F.lit(r"\b"))), "[NRIC]"),
        one(F.concat(F.lit(r"(?<!\d)(?:\+65[ -]?)?"), F.array_join(F.filter(F.split(digits, ""), lambda c: c != ""), "[ -]?"), F.lit(r"(?!\d)")), "[PHONE]"),
        one(any_case(flexible(policy, strict)), "[POLICY_NO]"),
        many(born, "[DOB]"),
        one(any_case(flexible(address, strict)), "[ADDRESS]"),
        many(names, "[PATIENT]"),
    ]
    usable = lambda e: e["pattern"].isNotNull()
    return F.filter(F.concat(*[F.coalesce(x, none) for x in found]), usable)


def redacted(notes: DataFrame, strict: bool = False, sweep: Column | None = None) -> DataFrame:
    """Adds redacted_text and redaction_map (token, value entries in order) to notes.

    notes: full_name, nric, dob (date), phone, address, policy_number and clinical_text. sweep: further values to remove.
    """
    kept = find_all(F.col("clinical_text"), INSTITUTION)
    shielded = interleave(F.col("clinical_text"), INSTITUTION, lambda m, k, i: F.concat(F.lit(f"{HOLD}INST"), (i - 1).cast("string"), F.lit(HOLD)))
    df = notes.withColumns({"_kept": kept, "_text": shielded, "_dict": dictionary(strict)})
    passed = F.aggregate("_dict", F.col("_text"), lambda acc, e: F.regexp_replace(acc, F.concat(F.lit("(?U)"), e["pattern"]), e["token"]))
    df = df.withColumn("_one", F.regexp_replace(passed, r"\[PATIENT\](?:\s+\[PATIENT\])+", "[PATIENT]"))
    entry = lambda token, value: F.array(F.struct(F.lit(token).alias("token"), value.alias("value")))
    optional = lambda token, c: F.when(_named(c).isNotNull(), entry(token, F.col(c))).otherwise(F.array().cast(ENTRIES))
    entries = F.concat(
        entry("[PATIENT]", F.col("full_name")), entry("[NRIC]", F.upper(F.replace(F.col("nric"), F.lit(" "), F.lit("")))), entry("[DOB]", day_first(F.col("dob"))),
        optional("[PHONE]", "phone"), optional("[POLICY_NO]", "policy_number"), optional("[ADDRESS]", "address"), F.col("_two.entries"),
    )
    df = df.withColumn("_two", pattern_pass(F.col("_one"))).withColumn("redaction_map", entries)
    restored = F.aggregate(F.transform("_kept", lambda v, i: F.struct(v.alias("v"), i.alias("i"))), F.col("_two.text"), lambda acc, e: F.replace(acc, F.concat(F.lit(f"{HOLD}INST"), e["i"].cast("string"), F.lit(HOLD)), e["v"]))
    df = df.withColumn("redacted_text", restored)
    if sweep is not None:
        clean = F.filter(F.transform(sweep, lambda f: F.trim(f)), lambda f: (f != "") & ~f.rlike(r"^\[[A-Z][A-Z0-9_]*\]$"))
        zero = F.struct(F.col("redacted_text").alias("text"), F.array().cast(ENTRIES).alias("found"))

        def step(acc: Column, f: Column) -> Column:
            pattern = F.concat(F.lit("(?iU)"), flexible(f, strict))
            token = F.concat(F.lit("[REDACTED_"), (F.size(acc["found"]) + 1).cast("string"), F.lit("]"))
            hit = F.regexp_like(acc["text"], pattern)
            return F.when(hit, F.struct(F.regexp_replace(acc["text"], pattern, token).alias("text"), F.concat(acc["found"], F.array(F.struct(token.alias("token"), f.alias("value")))).alias("found"))).otherwise(acc)

        df = df.withColumn("_swept", F.aggregate(clean, zero, step))
        df = df.withColumns({"redacted_text": F.col("_swept.text"), "redaction_map": F.concat("redaction_map", "_swept.found")}).drop("_swept")
    return df.drop("_kept", "_text", "_dict", "_one", "_two")


def remerged(text: Column, entries: Column) -> Column:
    """The text with tokens turned back into values, entry by entry, and the tokens that stay: struct(text, unresolved)."""
    t = F.aggregate(entries, text, lambda acc, e: F.replace(acc, e["token"], e["value"]))
    return F.struct(t.alias("text"), unresolved(t).alias("unresolved"))
