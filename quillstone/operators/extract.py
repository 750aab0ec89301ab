"""Entity extraction that offers candidates rather than guess, pass by pass: what an earlier pass has found, stays.

1 labelled lines and patient lines, 2 header lines, 3 header blocks, 4 labels within lines, 5 sole matches that nobody
else owns, 6 dates old enough for a birth (offered only), 7 lines with a postal code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import birth_dates, parse_date
from ..functions.patterns import ALIASES, DATE, EMAIL, HARD_GAP, INSURER, INSURER_NAMES, LABELLED, LABELS, NRIC, PHONE, POLICY, POLICY_WORD, POSTAL, QUALIFIERS, STRICT_PHONE, whole
from ..functions.text import find_all, label_key, let, logical_lines, squashed
from .lines import LEAST_FIELDS, LEAST_WORDS, is_name, is_owned, is_same_name, none, reading, unowned, words
from .tables import spread

FIELDS = ("full_name", "nric", "dob", "phone", "address", "policy_number", "insurer")


def field_of(label: Column) -> Column:
    found = F.create_map(*[F.lit(x) for kv in sorted(ALIASES.items()) for x in kv])
    return F.try_element_at(found, label_key(label))


def insurer_values(text: Column) -> Column:
    """Distinct insurers that a text names, by the name a form wants."""
    names = F.create_map(*[F.lit(x) for kv in INSURER_NAMES.items() for x in kv])
    return F.array_distinct(F.transform(find_all(text, INSURER), lambda v: F.try_element_at(names, F.lower(squashed(v)))))


def insurer_of(text: Column) -> Column:
    """The insurer if the text names exactly one, else null."""
    found = insurer_values(text)
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def nric_values(text: Column) -> Column:
    return F.array_distinct(F.transform(find_all(text, NRIC), _bare))


def _bare(v: Column) -> Column:
    return F.upper(F.replace(v, F.lit(" "), F.lit("")))


def normalised_value(field: Column, value: Column) -> Column:
    """A labelled insurer off the list stays as it was written; a labelled number that isn't one is no value."""
    nric = F.when(_bare(value).rlike("^[STFGM][0-9]{7}[A-Z]$"), _bare(value))
    return F.when(field == "nric", nric).when(field == "insurer", F.coalesce(insurer_of(value), F.trim(value))).otherwise(F.trim(value))


def phone_key(value: Column) -> Column:
    d = F.regexp_replace(value, r"\D", "")
    return F.when((F.length(d) == 10) & d.startswith("65"), F.substring(d, 3, 8)).otherwise(d)


def phone_values(text: Column) -> Column:
    """Distinct numbers in order; one written two ways is one."""
    return F.aggregate(find_all(text, STRICT_PHONE), F.array().cast("array<string>"), lambda acc, v: F.when(F.exists(acc, lambda x: phone_key(x) == phone_key(v)), acc).otherwise(F.concat(acc, F.array(v))))


def policy_values(text: Column) -> Column:
    """Distinct policy numbers in order. Two with the same digits whose letters begin alike are one: the longer stands in the place of the first."""
    letters = lambda v: F.regexp_extract(v, "^[A-Z]+", 0)
    digits = lambda v: F.regexp_extract(v, "[0-9]+$", 0)
    one = lambda x, v: (x == v) | ((digits(x) == digits(v)) & (letters(x).startswith(letters(v)) | letters(v).startswith(letters(x))))

    def step(acc: Column, v: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda x: one(x, v)), F.lit(True))
        longer = F.transform(acc, lambda x, i: F.when((i + 1 == at) & (F.length(v) > F.length(x)), v).otherwise(x))
        return F.when(at > 0, longer).otherwise(F.concat(acc, F.array(v)))

    return F.aggregate(find_all(text, POLICY), F.array().cast("array<string>"), step)


def date_values(text: Column, as_of: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(find_all(text, DATE), lambda x: F.date_format(parse_date(x, as_of), "yyyy-MM-dd")), lambda d: d.isNotNull()))


def values_of(field: Column, text: Column, as_of: Column) -> Column:
    """Distinct values of a field's shape, ready to use."""
    return (
        F.when(field == "nric", nric_values(text)).when(field == "dob", date_values(text, as_of)).when(field == "phone", phone_values(text))
        .when(field == "policy_number", policy_values(text)).when(field == "insurer", insurer_values(text))
    )


def segment(piece: Column, as_of: Column) -> Column:
    """One piece of a patient line as struct(field, value); null where it is no field's."""
    t = F.trim(F.trim(piece), F.lit(",."))
    policy = F.trim(F.regexp_replace(t, POLICY_WORD, ""))
    born = F.date_format(parse_date(t, as_of), "yyyy-MM-dd")
    one = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    return (
        F.when(t == "", None).when(t.rlike(whole(NRIC)), one("nric", _bare(t))).when(born.isNotNull(), one("dob", born)).when(t.rlike(whole(PHONE)), one("phone", t))
        .when(t.rlike(whole(EMAIL)), None).when(policy.rlike(whole(POLICY)), one("policy_number", policy)).when(t.rlike(POSTAL), one("address", t))
        .when(insurer_of(t).isNotNull(), one("insurer", insurer_of(t))).when(~t.rlike(r"\d"), one("full_name", t))
    )


def birth_candidates(text: Column, as_of: Column) -> Column:
    """Old enough dates of the text: offered, never filled in."""
    found = F.transform(find_all(text, DATE), lambda x: parse_date(x, as_of))
    return F.array_distinct(F.transform(birth_dates(found, as_of), lambda d: F.date_format(d, "yyyy-MM-dd")))


def label_field(label: Column) -> Column:
    """The field that a form's label asks for, words that still mean the patient's own aside; null for any other."""
    longest = sorted(QUALIFIERS, key=len, reverse=True)

    def step(t: Column, _: Column) -> Column:
        out = None
        for q in longest:
            longer = F.length(t) > len(q)
            first, last = t.startswith(q) & longer, t.endswith(q) & longer
            cut, shorter = F.substr(t, F.lit(len(q) + 1)), F.left(t, F.length(t) - len(q))
            out = F.when(first, cut).when(last, shorter) if out is None else out.when(first, cut).when(last, shorter)
        return out.otherwise(t)

    key = label_key(label)
    some = "|".join(longest)
    bare = F.when(~key.rlike(f"^(?:{some})|(?:{some})$"), key).otherwise(F.aggregate(F.sequence(F.lit(0), F.floor(F.length(key) / 3).cast("int")), key, step))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(ALIASES.items()) for x in kv]), bare)


FACT = "struct<pass:int,line:int,k:int,field:string,value:string,how:string>"
ASK = "struct<pass:int,line:int,k:int,field:string,candidates:array<string>,how:string>"


def _fact(n: int, line: Column, k: Column, field: Column, value: Column, how: str) -> Column:
    return F.struct(F.lit(n).alias("pass"), line.alias("line"), k.cast("int").alias("k"), field.alias("field"), value.alias("value"), F.lit(how).alias("how"))


def _line(s: Column, line: Column, known: Column, as_of: Column) -> Column:
    """struct(line, blank, fits, several, rest, fields, facts) of a line; facts are what it says by itself."""

    def of(x: Column) -> Column:
        field, value, r, p = x["field"], x["value"], F.get(x["both"], F.lit(0)), F.get(x["both"], F.lit(1))
        fact = lambda n, k, f, v, how: _fact(n, line, k, f, v, how)
        listed = lambda n, pairs, how: F.transform(pairs, lambda y, k: fact(n, k, y["field"], y["value"], how))
        sole = lambda names, n, how: F.when(F.size(names) == 1, F.array(fact(n, F.lit(99), F.lit("full_name"), F.get(names, F.lit(0)), how))).otherwise(none(FACT))
        head = lambda h, n, how: F.concat(listed(n, h["fields"], how), sole(h["names"], n, how))
        born = F.date_format(parse_date(value, as_of), "yyyy-MM-dd")
        own = F.when(field == "dob", born).otherwise(normalised_value(field, value))
        pieces = F.filter(F.split(value, HARD_GAP, -1), lambda y: F.trim(y) != "")
        cut = F.filter(F.transform(pieces, lambda y: segment(y, as_of)), lambda y: y.isNotNull())
        single = F.array(fact(1, F.lit(0), F.lit("full_name"), F.trim(value), "labelled"))
        by_name = F.when(p["head"].isNotNull(), head(p["head"], 1, "patient-line")).when(F.size(pieces) <= 1, single).otherwise(listed(1, cut, "patient-line"))
        by_label = F.when(field == "full_name", by_name).when(field.isNotNull(), F.array(fact(1, F.lit(0), field, own, "labelled")))
        by_header = F.when(r["head"].isNotNull(), head(r["head"], 2, "header-line"))
        place = F.trim(F.regexp_replace(F.trim(s), rf"(?iU)^(?:{'|'.join(LABELS['address'])})\s*[:.\-]?\s+", ""))
        by_place = F.when(s.rlike(POSTAL) & ~is_owned(s, POSTAL) & r["head"].isNull(), F.array(fact(7, F.lit(0), F.lit("address"), place, "sole-match")))
        inner = F.transform(r["regions"], lambda y, k: fact(4, k, y["field"], y["value"], "labelled-inline"))
        facts = F.concat(*[F.coalesce(y, none(FACT)) for y in (by_label, by_header, inner, by_place)])
        several = r["n"] > 0
        fits = F.when(several, r["rest"] == "").otherwise(is_name(r["rest"]))
        return F.struct(line.alias("line"), (~s.rlike(r"(?U)\S")).alias("blank"), fits.alias("fits"), several.alias("several"), r["rest"].alias("rest"), r["fields"].alias("fields"), facts.alias("facts"))

    field = field_of(F.regexp_extract(s, LABELLED, 1))
    value = F.when(field.isNotNull(), F.regexp_extract(s, LABELLED, 2))
    both = F.transform(F.array(s, F.when(field == "full_name", value)), lambda y: reading(y, known, as_of))  # of the line, and of the name that it labels
    parts = F.struct(field.alias("field"), value.alias("value"), both.alias("both"))
    return let(parts, of)


def _blocks(ls: Column, known: Column) -> Column:
    """Facts of runs of two or more lines, each of which is one value or one name and nothing else."""

    def cut(stops: Column) -> Column:
        of = lambda k: F.slice(ls, F.get(stops, k) + 2, F.get(stops, k + 1) - F.get(stops, k) - 1)
        return F.transform(F.sequence(F.lit(0), F.size(stops) - 2), of)

    stops = F.concat(F.array(F.lit(-1)), F.transform(F.filter(ls, lambda x: x["blank"]), lambda x: x["line"]), F.array(F.size(ls)))
    whole = F.filter(let(stops, cut), lambda b: (F.size(b) >= 2) & F.forall(b, lambda x: x["fits"]))

    def facts(b: Column) -> Column:
        values = F.flatten(F.transform(b, lambda x: F.transform(x["fields"], lambda y: F.struct(x["line"].alias("line"), y["field"].alias("field"), y["value"].alias("value")))))
        names = F.filter(F.transform(b, lambda x: F.when(~x["several"], x["rest"])), lambda n: F.coalesce(n != "", F.lit(False)))
        mine = F.filter(names, lambda n: is_same_name(n, known))
        long = F.filter(names, lambda n: F.size(words(n)) >= LEAST_WORDS)
        name = let(F.when(F.coalesce(known, F.lit("")) != "", mine).otherwise(long), lambda c: F.when(F.size(c) == 1, F.array(_fact(3, F.get(b, F.lit(0))["line"], F.lit(99), F.lit("full_name"), F.get(c, F.lit(0)), "header-block"))).otherwise(none(FACT)))
        listed = lambda vs: F.when(F.size(F.array_distinct(F.transform(vs, lambda y: y["field"]))) >= LEAST_FIELDS, F.concat(F.transform(vs, lambda y, k: _fact(3, y["line"], k, y["field"], y["value"], "header-block")), name)).otherwise(none(FACT))
        return let(values, listed)

    return F.flatten(F.transform(whole, facts))


def parsed(notes: DataFrame, as_of: Column) -> DataFrame:
    """(note_id, field, value, how, choices). Two candidates mean neither: value is null and choices lists them.

    notes: note_id (one row each), text and, if there is one, known_name, which a header's name is then checked against. Each note is read
    once and by itself: notes are dealt to all cores, and no row meets another.
    """
    known = F.col("known_name") if "known_name" in notes.columns else F.lit(None).cast("string")
    rows = spread(notes.filter("text IS NOT NULL").select("note_id", "text", known.alias("known")), "note_id").select("note_id", "text", "known", logical_lines(F.col("text")).alias("lines"))
    rows = rows.select("note_id", "text", "known", "lines", F.transform("lines", lambda s, i: _line(s, i, F.col("known"), as_of)).alias("ls"))

    ask = lambda n, line, k, field, candidates, how: F.struct(F.lit(n).alias("pass"), line.alias("line"), k.alias("k"), field.alias("field"), candidates.alias("candidates"), F.lit(how).alias("how"))
    zero = F.lit(0)
    free = lambda pattern: F.array_join(F.transform("lines", lambda x: unowned(x, pattern)), "\n")
    wide = ((5, "nric", nric_values(free(NRIC))), (5, "phone", phone_values(free(STRICT_PHONE))), (5, "insurer", insurer_values(free(INSURER))), (6, "dob", birth_candidates(F.col("text"), as_of)))
    own = F.flatten(F.transform("ls", lambda x: x["facts"]))
    rows = rows.select("note_id", F.concat(own, _blocks(F.col("ls"), F.col("known"))).alias("facts"), F.array(*[ask(n, zero, zero, F.lit(f), c, "sole-match") for n, f, c in wide]).alias("wide"))

    of_pass = lambda test: F.filter("facts", lambda x: test(x["pass"]) & (x["value"] != ""))
    inner = F.transform(of_pass(lambda n: n == 4), lambda x: ask(4, x["line"], x["k"], x["field"], values_of(x["field"], x["value"], as_of), "labelled-inline"))
    spots = F.array_distinct(F.transform(of_pass(lambda n: n == 7), lambda x: x["value"]))
    asked = F.filter(F.concat(inner, F.col("wide"), F.array(ask(7, zero, zero, F.lit("address"), spots, "sole-match"))), lambda x: F.size(x["candidates"]) > 0)
    rows = rows.select("note_id", of_pass(lambda n: n < 4).alias("said"), asked.alias("asked"))

    alone = F.filter("asked", lambda x: (F.size(x["candidates"]) == 1) & (x["pass"] != 6))
    sure = F.concat(F.col("said"), F.transform(alone, lambda x: F.struct(x["pass"].alias("pass"), x["line"].alias("line"), x["k"].alias("k"), x["field"].alias("field"), F.get(x["candidates"], zero).alias("value"), x["how"].alias("how"))))
    open_ = F.filter("asked", lambda x: (F.size(x["candidates"]) > 1) | (x["pass"] == 6))
    rows = rows.select("note_id", F.array_sort(sure).alias("sure"), F.array_sort(open_).alias("open"))  # by pass, line and place in it
    first = lambda c, f: F.get(F.filter(c, lambda x: x["field"] == f), zero)
    each = F.transform(F.array(*map(F.lit, FIELDS)), lambda f: F.struct(f.alias("field"), first("sure", f).alias("v"), first("open", f)["candidates"].alias("choices")))
    rows = rows.select("note_id", F.explode_outer(F.filter(each, lambda x: x["v"].isNotNull() | x["choices"].isNotNull())).alias("x"))
    rows = rows.filter("x IS NOT NULL")  # without `outer` Spark tests the list's size first, for which it works out the whole note again
    return rows.select("note_id", "x.field", F.col("x.v.value").alias("value"), F.col("x.v.how").alias("how"), F.when(F.col("x.v").isNull(), F.col("x.choices")).alias("choices"))
