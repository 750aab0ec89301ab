"""Lines of notes: values against plain search, and headers, names, blocks and labels on authored layouts."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.functions.patterns import INSURER_NAMES, MONTHS, OWNER, compiled
from quillstone.operators import extract, lines

AS_OF = datetime.date(2024, 1, 1)
PIECES = (
    "Tan Wei Ling", "S1234567D", "s 7211043 c", "04/11/1972", "31/02/1990", "1.2.1950", "4 Nov 1972", "91234567", "+65 8123 4567", "6512-3456", "GHS-41234567", "ABC12345", "Blk 18 Toa Payoh, Singapore 310018", "310018",
    "S123456", "AIA", "great  eastern life", "husband", "Clinic tel", "NRIC", "DOB", "Policy no", "seen with cough", "·", "|", ";", "—", "\t", ".", "é日本",
)


def day(text):
    t = text.strip().rstrip(".,")
    for pattern in (r"(?P<d>\d{1,2})[/.\-](?P<m>\d{1,2})[/.\-](?P<y>\d{4})", r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})", r"(?P<d>\d{1,2})\s+(?P<m>[A-Za-z]{3,9})\.?\s+(?P<y>\d{4})"):
        if m := re.fullmatch(pattern, t):
            names = [x.lower() for x in MONTHS]
            try:
                month = int(m["m"]) if m["m"].isdigit() else next(i + 1 for i, x in enumerate(names) if m["m"].lower() in (x, x[:3]))
                found = datetime.date(int(m["y"]), month, int(m["d"]))
            except (ValueError, StopIteration):
                return None
            return found.isoformat() if datetime.date(1900, 1, 1) <= found <= AS_OF else None
    return None


def plain_spans(line):
    owner = compiled(OWNER).search(line)
    ready = {"dob": day, "insurer": lambda x: INSURER_NAMES.get(" ".join(x.lower().split())), "nric": lambda x: x.replace(" ", "").upper()}
    taken, out = set(), []
    for field, pattern in lines.SHAPES.items():
        now = set()
        for m in compiled(pattern).finditer(line):
            value = ready.get(field, str.strip)(m[0].strip())
            if value and not (owner and m.start() >= owner.end()) and not taken & set(range(m.start(), m.end())):
                out.append((m.start(), m.end(), field, value))
                now |= set(range(m.start(), m.end()))
        taken |= now
    return sorted(out)


def test_spans_against_plain_search(spark):
    r = random.Random(2)
    made = ["".join(r.choice(PIECES) + r.choice([" ", " ", ", ", "  ", ""]) for _ in range(r.randrange(9))) for _ in range(1500)]
    made += [x for row in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("text").limit(300).collect() for x in (row["text"] or "").split("\n")]
    rows = spark.createDataFrame(list(enumerate(made)), "i long, s string").repartition(4)
    got = {x["i"]: [tuple(y) for y in x["v"]] for x in rows.select("i", lines.spans(F.col("s"), F.lit(AS_OF)).alias("v")).collect()}
    hits = 0
    for i, s in enumerate(made):
        assert got[i] == plain_spans(s), s
        hits += len(got[i])
    assert hits > 1000


#: Layouts of one patient's details: note, name known beforehand, and what must come of it: field -> (value, how) or the choices.
FULL = {"nric": "S7211043C", "dob": "1972-11-04"}
CASES = {
    "labels with colons": ("Name: Chua Beng Huat\nNRIC: S7211043C\nDOB: 4 Nov 1972", None, dict.fromkeys(("nric", "dob", "full_name"), "labelled"), {**FULL, "full_name": "Chua Beng Huat"}),
    "labels with dashes": ("Pt name - Chua Beng Huat\nIC no - s7211043c\nBorn - 1972-11-04", None, {"full_name": "labelled"}, {**FULL, "full_name": "Chua Beng Huat"}),
    "a line of dots": ("Chua Beng Huat · S7211043C · 04/11/1972 · 91112233", None, dict.fromkeys(("nric", "dob", "phone", "full_name"), "header-line"), {**FULL, "phone": "91112233", "full_name": "Chua Beng Huat"}),
    "a line of blanks": ("Chua Beng Huat S7211043C 04/11/1972", None, dict.fromkeys(("nric", "dob"), "header-line"), {**FULL, "full_name": "Chua Beng Huat"}),
    "lower case before the first value": ("chua beng huat S7211043C 04.11.1972", None, {"nric": "header-line"}, {**FULL}),
    "one lower-case name that is known": ("chua beng huat S7211043C 04/11/1972", "Chua Beng Huat", {"full_name": "header-line"}, {**FULL, "full_name": "chua beng huat"}),
    "two names, one of them known": ("Chua Beng Huat · Tan Wei Ling · S7211043C · 04/11/1972", "Tan Wei Ling", {"full_name": "header-line"}, {**FULL, "full_name": "Tan Wei Ling"}),
    "two names, none of them known": ("Chua Beng Huat · Tan Wei Ling · S7211043C · 04/11/1972", "Lim Ah Kow", {}, {**FULL}),
    "two names and nothing known": ("Chua Beng Huat · Tan Wei Ling · S7211043C · 04/11/1972", None, {}, {**FULL}),
    "family name last": ("Beng Huat Chua, S7211043C, 04/11/1972", "Chua Beng Huat", {"full_name": "header-line"}, {**FULL, "full_name": "Beng Huat Chua"}),
    "an address after the name": ("Chua Beng Huat 18 Toa Payoh Singapore 310018 S7211043C 04/11/1972", "Chua Beng Huat", {"address": "header-line"}, {**FULL, "address": "18 Toa Payoh Singapore 310018"}),
    "a postal code alone": ("S7211043C 04/11/1972 Singapore 310018", None, {"address": "header-line"}, {**FULL, "address": "Singapore 310018"}),
    "a unit number before it": ("S7211043C; #04-12 Block 7, 310018", None, {"address": "header-line"}, {"nric": "S7211043C", "address": "#04-12 Block 7, 310018"}),
    "a header block": ("Chua Beng Huat\nS7211043C\n04/11/1972\n\nWell today.", None, dict.fromkeys(("nric", "dob", "full_name"), "header-block"), {**FULL, "full_name": "Chua Beng Huat"}),
    "a block with prose in it": ("Chua Beng Huat\nS7211043C\n04/11/1972\nwell today", None, {"nric": "sole-match"}, {"nric": "S7211043C", "dob": ["1972-11-04"]}),
    "prose between values": ("Seen 02/08/2023, sore throat. Covered by AIA.", None, {"insurer": "sole-match"}, {"insurer": "AIA"}),
    "an owner before the value": ("Clinic tel 62551234\nHer husband S6234567C", None, {}, {}),
    "an owner after the value": ("91112233, clinic tel 62551234", None, {"phone": "sole-match"}, {"phone": "91112233"}),
    "labels within a line": ("NRIC S7211043C  HP 91112233 seen for cough", None, {"nric": "labelled-inline", "phone": "labelled-inline"}, {"nric": "S7211043C", "phone": "91112233"}),
    "two numbers behind one label": ("HP 91112233 / 81234567 for calls", None, {}, {"phone": ["91112233", "81234567"]}),
    "a label that the note talks about": ("Policy discussed with patient", None, {}, {}),
    "labels that win over shapes": ("NRIC: S7211043C\nS1234567D seen too", None, {"nric": "labelled"}, {"nric": "S7211043C"}),
    "a patient line": ("Patient: Chua Beng Huat · S7211043C · 04/11/1972", None, dict.fromkeys(("nric", "dob", "full_name"), "patient-line"), {**FULL, "full_name": "Chua Beng Huat"}),
    "a line that goes on": ("Chua Beng Huat ·\nS7211043C · 04/11/1972", None, {"full_name": "header-line"}, {**FULL, "full_name": "Chua Beng Huat"}),
    "impossible and future dates": ("DOB 31/02/1990\nseen 01/01/2031", None, {}, {}),
    "a young date is no birth": ("seen on 03/06/2023", None, {}, {}),
    "insurers that are two": ("AIA first, then Bupa Global", None, {}, {"insurer": ["AIA", "Bupa"]}),
    "particles in a name": ("Siti binte Osman S7211043C 04/11/1972", None, {"full_name": "header-line"}, {**FULL, "full_name": "Siti binte Osman"}),
    "nothing at all": ("Seen alone. Well.", None, {}, {}),
}


@pytest.fixture(scope="module")
def read(spark):
    rows = [(name, note, known) for name, (note, known, _, _) in CASES.items()] + [("null", None, None), ("empty", "", None)]
    out = {name: {} for name, *_ in rows}
    for r in extract.parsed(spark.createDataFrame(rows, "note_id string, text string, known_name string"), F.lit(AS_OF)).collect():
        out[r["note_id"]][r["field"]] = r
    return out


@pytest.mark.parametrize("name", CASES)
def test_layouts(read, name):
    _, _, hows, want = CASES[name]
    got = read[name]
    for field, value in want.items():
        assert (got[field]["choices"] if isinstance(value, list) else got[field]["value"]) == value, (field, got)
    for field, how in hows.items():
        assert got[field]["how"] == how
    assert set(got) == set(want)


def test_notes_are_read_once_in_the_jvm(spark, read):
    assert read["null"] == read["empty"] == {}
    df = extract.parsed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("note_id"), "text"), F.lit(AS_OF))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and plan.count("FileScan") == 1


def test_notes_of_one_file_part_are_read_by_all_cores(spark):
    """Notes in one part are dealt to several, and the plan works a note out once: nothing tests the size of what it gives beforehand."""
    from pyspark.sql import functions as F

    from quillstone.operators import extract

    notes = spark.createDataFrame([(k, f"NRIC: S123456{k}D") for k in range(8)], "note_id int, text string").coalesce(1)
    got = extract.parsed(notes, F.lit("2024-01-01").cast("date"))
    assert got.rdd.getNumPartitions() > 1 and got.count() == 8
    assert "(size(" not in "".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if x.strip(" +-:").startswith("Filter"))


def test_each_scrubbing_pass_names_its_text_once(spark):
    """The expression grows with the number of patterns, not as a power of it."""
    from pyspark.sql import functions as F

    from quillstone.operators import redact

    df = spark.createDataFrame([("Call 91234567 or a@b.sg",)], "t string").select(redact.scrub_patterns(F.col("t")).alias("t"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 3 and df.first()[0] == "Call [PHONE_2] or [EMAIL_1]"
