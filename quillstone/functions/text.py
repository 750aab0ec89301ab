"""Column expressions on text: all built-in, so they stay in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import EMAIL, LABEL_RULES, NOISE, NRIC, PHONE, TOKEN

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
#: A sentinel that no note holds.
HOLD = "\u0000"


def may_hold(text: Column, pattern: str) -> Column | None:
    """A cheap test that no match of the pattern fails, or None if there is none: most texts hold no mail sign and few long numbers."""
    if pattern == EMAIL:
        return text.contains("@")
    return text.rlike(r"(?U)\d{4}") if pattern in (NRIC, PHONE) else None


def find_all(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    test = may_hold(text, pattern)
    return found if test is None else F.when(~test, F.array().cast("array<string>")).otherwise(found)


def let(value: Column, body) -> Column:
    """body(value), the value being worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def interleave(text: Column, pattern: str, put) -> Column:
    """The text with each match replaced by put(match, place among the distinct matches from 1, place among all from 1)."""
    found = F.struct(text.alias("t"), find_all(text, pattern).alias("m"), F.split(text, pattern, -1).alias("g"))

    def joined(x: Column) -> Column:
        def one(seen: Column) -> Column:
            replaced = F.transform(x["m"], lambda v, i: put(v, F.array_position(seen, v), i + 1))
            return F.array_join(F.zip_with(x["g"], replaced, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")

        return F.when(F.size(x["m"]) > 0, let(F.array_distinct(x["m"]), one)).otherwise(x["t"])

    test = may_hold(text, pattern)
    held = F.when(text.isNotNull(), let(found, joined))
    return held if test is None else F.when(~test, text).otherwise(held)


def numbered(text: Column, pattern: str, base: str, start: int) -> Column:
    """Matches become [BASE_n], numbered by first appearance of each verbatim value."""
    return interleave(text, pattern, lambda m, k, i: F.concat(F.lit(f"[{base}_"), (k + (start - 1)).cast("string"), F.lit("]")))


def numbered_map(text: Column, pattern: str, base: str, start: int) -> Column:
    """The (token, value) entries that numbered() makes, in order."""
    return let(F.array_distinct(find_all(text, pattern)), lambda seen: F.transform(seen, lambda v, i: F.struct(F.concat(F.lit(f"[{base}_"), (i + start).cast("string"), F.lit("]")).alias("token"), v.alias("value"))))


def lines(text: Column) -> Column:
    """Physical lines; one empty line at the end is dropped."""
    a = F.split(text, LINE_END, -1)
    return F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a)


def logical_lines(text: Column) -> Column:
    """Lines, a line that ends in a joiner going on in the next."""
    ends = lambda s: F.rtrim(s).rlike(r"[·|;,—-]$")
    step = lambda acc, x: F.when((F.size(acc) > 0) & ends(F.element_at(acc, -1)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.rtrim(F.element_at(acc, -1)), F.lit(" "), F.trim(x))))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(lines(text), F.array().cast("array<string>"), step)


def blocks(text: Column) -> Column:
    """Runs of lines between blank ones, each joined by line ends."""
    parts = F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n(?:[ \t]*\n)+", -1)
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, r"^\n+|\n+$", ""))
    return F.filter(trimmed, lambda p: F.trim(p) != "")


def label_key(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), "[^a-z]", "")


def normalised(text: Column) -> Column:
    """Lower case without leading numbering, letters and digits only, single blanks."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[\s(]*(?:\d+\s*[a-z]?|[ivxlc]+)[\s.)\-:]+", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def label_words(normal: Column) -> Column:
    """The content words of a normalised label."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: (t != "") & ~t.isin(*NOISE)))


def content_tokens(text: Column) -> Column:
    return label_words(normalised(text))


def dice(a: Column, b: Column, same: Column) -> Column:
    """Of token sets; 1 for equal normalised texts, 0 if either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(same, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def option_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def squashed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def scrub_label(text: Column) -> Column:
    """Labels of a page: blanks squashed, then the four rules in their own order, tokens without numbers."""
    t = squashed(text)
    for pattern, token in LABEL_RULES:
        t = F.regexp_replace(t, pattern, token)
    return t


def scrub_changes(text: Column) -> Column:
    """Whether a label holds anything that its scrubbing takes away."""
    return scrub_label(text) != squashed(text)


def emitted_options(texts: Column, most: int = 30) -> Column:
    """Options as an inventory may show them: count, truncated, withheld and values; if scrubbing changes one of them, none is shown."""
    held = F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.trim(t) != "")
    shut = F.exists(held, scrub_changes)
    none = F.array().cast("array<string>")
    return F.struct(
        F.size(held).alias("count"), (~shut & (F.size(held) > most)).alias("truncated"), shut.alias("withheld"),
        F.when(shut, none).otherwise(F.transform(F.slice(held, 1, most), scrub_label)).alias("values"),
    )


def slug(text: Column, most: int = 40) -> Column:
    s = F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(most))
    s = F.regexp_replace(s, "_+$", "")
    return F.when(s == "", "field").otherwise(s)


def numbered_slugs(labels: Column) -> Column:
    """Slugs of labels in order, repeated ones as base_2, base_3, ..., never one that is taken."""
    def step(acc: Column, label: Column) -> Column:
        base = slug(label)
        free = F.filter(F.sequence(F.lit(2), F.size(acc) + 2), lambda n: ~F.array_contains(acc, F.concat(base, F.lit("_"), n.cast("string"))))
        return F.concat(acc, F.array(F.when(F.array_contains(acc, base), F.concat(base, F.lit("_"), F.get(free, F.lit(0)).cast("string"))).otherwise(base)))

    return F.aggregate(labels, F.array().cast("array<string>"), step)


def display_label(label: Column, ident: Column) -> Column:
    w = F.replace(ident, F.lit("_"), F.lit(" "))
    return F.coalesce(F.nullif(label, F.lit("")), F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))


def unresolved(text: Column) -> Column:
    return F.array_sort(F.array_distinct(find_all(text, TOKEN)))


def older_than(a: Column, b: Column) -> Column:
    """Versions by numeric parts; missing and unreadable parts count as 0."""
    parts = lambda v: F.transform(F.split(F.coalesce(v, F.lit("")), r"\."), lambda p: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(p, r"^\s*(\d+)\s*$", 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0).cast("long")))
    diff = F.filter(F.zip_with(parts(a), parts(b), lambda x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))), lambda d: d != 0)
    return F.coalesce(F.get(diff, F.lit(0)) < 0, F.lit(False))
