"""Quiet points of streams: restarts, late and repeated events give the rows of the table."""

import datetime
import random
import time

from quillstone.streaming import pages

DDL = "page string, at timestamp, ord long, sig string"
DAY = datetime.datetime(2024, 1, 1)


def event(page, seconds, o, sig):
    return (page, DAY + datetime.timedelta(seconds=seconds), o, sig)


def made():
    """Three rounds of events of some pages; the second one has late and repeated events, the last one ends the day."""
    r = random.Random(7)
    every = [event(f"p{r.randrange(5)}", round(r.uniform(0, 300), 3), k, r.choice([None, None, "a", "b", "c"])) for k in range(200)]
    every += [event("p0", 200.5, 900, "tie"), event("p0", 200.5, 901, "tie2"), (None, DAY, 902, "x"), ("p1", None, 903, "x")]
    cut = [[e for e in every if e[1] is None or e[1] < DAY + datetime.timedelta(seconds=160)], [e for e in every if e[1] and e[1] >= DAY + datetime.timedelta(seconds=160)]]
    moved = [e for e in cut[0] if e[1] and e[1] > DAY + datetime.timedelta(seconds=150)][::2]  # they come a round late
    rounds = [[e for e in cut[0] if e not in moved], cut[1] + moved + moved[:3] + cut[1][:4]]
    return rounds + [[event("end", 5000, 999, "z")]]


def write(spark, folder, k, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")


def key(r):
    return tuple(r)


def test_streamed_points_equal_the_table_s(spark, tmp_path):
    rounds = made()
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    stream = lambda: pages.points(spark.readStream.schema(DDL).parquet(f"{source}/*"), 4, 60, "30 seconds")
    for k, rows in enumerate(rounds):  # each round is a run of its own, begun from the checkpoint of the one before
        write(spark, f"{tmp_path}/in", k, rows)
        got = pages.drained(stream(), out)
    want = pages.points_of(spark.createDataFrame([e for rows in rounds for e in rows], DDL), 4, 60).filter("page <> 'end'")
    got, want = sorted(map(key, got.collect())), sorted(map(key, want.collect()))
    assert got == want and len(want) > 30
    assert {w[4] for w in want} == {True, False} and sum(w[5] for w in want) > 20


def brute(rows, wait, forget):
    """The rule said plainly, one page and one event at a time."""
    out = set()
    for page in {e[0] for e in rows if e[0] is not None}:
        own = sorted({(e[1], e[2], e[3]) for e in rows if e[0] == page and e[1] is not None}, key=lambda x: x[:2])
        events, answers = [e for e in own if e[2] is not None], {e[:2] for e in own if e[2] is None}
        last = None
        for k, (at, o, sig) in enumerate(events):
            if k + 1 < len(events) and (events[k + 1][0] - at).total_seconds() < wait:
                continue
            if last and (at - last[0]).total_seconds() >= forget:
                answers = {a for a in answers if (a[0] - last[0]).total_seconds() > forget}
                last = None
            changed = last is None or last[1] != sig
            ended = {a for a in answers if changed and (a[0] - at).total_seconds() <= wait}
            answers -= ended
            out.add((page, at, o, sig, changed, len(ended)))
            last = (at, sig)
    return out


def test_points_of_a_table(spark):
    rows = [e for r in made() for e in r]
    for wait, forget in ((4, 60), (4, 9), (1, 1e9), (30, 40)):
        assert {key(r) for r in pages.points_of(spark.createDataFrame(rows, DDL), wait, forget).collect()} == brute(rows, wait, forget)
    assert pages.points_of(spark.createDataFrame([], DDL), 4).count() == 0


def test_too_late_events_are_dropped(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    stream = lambda: pages.points(spark.readStream.schema(DDL).parquet(f"file://{source}/*"), 4)
    for k, rows in enumerate([[event("a", 10, 1, "x"), event("b", 500, 2, "x")], [event("a", 12, 3, "y"), event("b", 900, 4, "x")]]):
        write(spark, source, k, rows)
        got = pages.drained(stream(), out)
    assert {(r["page"], r["ord"], r["changed"]) for r in got.collect()} == {("a", 1, True), ("b", 2, True)}


def test_a_page_of_many_events_takes_time_by_their_number():
    class Kept:
        def __init__(self):
            self.rows = []

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

    class Last:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def listTimers(self):
            return iter(())

        def registerTimer(self, ms):
            pass

    class Clock:
        ms = 0

        def getCurrentWatermarkInMs(self):
            return self.ms

    import pandas as pd

    page, clock, n = pages.QuietPoints(1, 1e9), Clock(), 40000
    page.handle, page.open, page.answers, page.last = Handle(), Kept(), Kept(), Last()
    rows = pd.DataFrame({"us": [k * 1_000_000 for k in range(n)], "ord": range(n), "sig": [None if k % 2 else f"s{k}" for k in range(n)]})
    began = time.process_time()
    assert sum(len(x) for x in page.handleInputRows(("p",), iter([rows, rows]), clock)) == 0
    clock.ms = 10**9
    got = next(page.handleExpiredTimer(("p",), clock, None))
    assert time.process_time() - began < 8 and len(got) == n // 2 and got["changed"].all() and got["discarded"].tolist() == [1] * (n // 2)
    assert not page.open.rows and not page.answers.rows
