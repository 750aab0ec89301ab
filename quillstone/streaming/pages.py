"""Pages as streams: quiet points after which a rule runs, changes of what they show, and answers that a change discards.

`points` works on a stream and keeps a page's state between micro-batches; `points_of` gives the same rows of a table.
Both take rows of page, at (a timestamp), ord (breaks ties, a row's own number) and sig (what the page shows; null for an
answer, which neither disturbs the quiet nor ends it). They give a row for each event after which no other follows on its page
for `seconds`: page, at, ord, sig, changed (sig differs from that of the quiet point before, or there is none) and discarded
(answers that a change ends: those up to its announcement, `seconds` after the event, that no earlier one has ended). After
`forget` seconds without a quiet point a page's state is gone: its next one counts as a change, and answers from before are not
counted any more.

Defined cases: events repeated with the same at and ord count once; late events within the watermark are put in their place,
later ones are dropped; rows with a null page or time are ignored; a point is decided when the watermark has passed its
announcement, so the last one of a page waits for that.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

POINTS = "page string, at timestamp, ord long, sig string, changed boolean, discarded long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: No event's own number is greater.
MOST = 2**63
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(seconds: float) -> int:
    return int(seconds * 1_000_000)


class QuietPoints(StatefulProcessor):
    """State of a page: events not decided yet, answers not discarded yet, and the last quiet point."""

    def __init__(self, seconds: float, forget: float) -> None:
        self.wait, self.forget = _micros(seconds), _micros(forget)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "at long, ord long, sig string")
        self.answers = handle.getListState("answers", "at long, ord long")
        self.last = handle.getValueState("last", "at long, sig string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, told = list(self.open.get()), list(self.answers.get())
        open_, answers = {x[:2]: x[2] for x in held}, set(told)
        for pdf in rows:
            for at, o, sig in zip(pdf["us"].tolist(), pdf["ord"].tolist(), pdf["sig"].tolist(), strict=True):
                if sig is None or sig != sig:  # null, as pandas has it
                    answers.add((int(at), int(o)))
                else:
                    open_.setdefault((int(at), int(o)), sig)
        yield from self._decided(key, open_, answers, timerValues.getCurrentWatermarkInMs() * 1000, len(held), len(told), True)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held, told = list(self.open.get()), list(self.answers.get())
        yield from self._decided(key, {x[:2]: x[2] for x in held}, set(told), timerValues.getCurrentWatermarkInMs() * 1000, len(held), len(told), False)

    def _decided(self, key: Any, open_: dict, answers: set, watermark: int, held: int, told: int, other: bool) -> Iterator[pd.DataFrame]:
        """The points that the watermark has passed; what is left is kept. Events and answers are gone through once, in order."""
        events, waiting, before = sorted(open_), sorted(answers), self.last.get()
        last, out, done, gone = before, [], 0, 0  # events decided and answers ended or forgotten

        def ended(upto: int) -> int:
            nonlocal gone
            was, gone = gone, bisect_right(waiting, (upto, MOST), gone)
            return gone - was

        for at, o in events:
            if at + self.wait >= watermark:
                break
            done += 1
            if done < len(events) and events[done][0] - at < self.wait:
                continue
            if last is not None and at - last[0] >= self.forget:
                ended(last[0] + self.forget)
                last = None
            sig = open_[at, o]
            changed = last is None or last[1] != sig
            out.append((key[0], at, o, sig, changed, ended(at + self.wait) if changed else 0))
            last = (at, sig)
        left = events[done:]
        if last is not None and not left and last[0] + self.forget < watermark:
            ended(last[0] + self.forget)
            last = None
        if len(left) != held or done:
            self._keep(self.open, [(*x, open_[x]) for x in left], held)
        if len(waiting) - gone != told or gone:
            self._keep(self.answers, waiting[gone:], told)
        if last is not None and last != before:
            self.last.update(last)
        elif last is None and before is not None:
            self.last.clear()
        if other and (held or before is not None):  # a timer that has expired is gone by itself, and a new page has none
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        due = [left[0][0] + self.wait] if left else [last[0] + self.forget] if last is not None else []
        for us in due:
            self.handle.registerTimer(us // 1000 + 1)
        if out:
            pdf = pd.DataFrame(out, columns=["page", "at", "ord", "sig", "changed", "discarded"])
            yield pdf.assign(at=pd.to_datetime(pdf["at"], unit="us", utc=True))

    @staticmethod
    def _keep(state: Any, rows: list, held: int) -> None:
        if rows:
            state.put(rows)
        elif held:
            state.clear()

    def close(self) -> None:
        pass


def points(events: DataFrame, seconds: float, forget: float = 1e9, late: str = "0 seconds") -> DataFrame:
    """The quiet points of a stream, each once it is decided."""
    own = events.select(F.col("page").cast("string").alias("page"), F.col("at").cast("timestamp").alias("at"), F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.col("ord").cast("long").alias("ord"), F.col("sig").cast("string").alias("sig"))
    own = own.filter("page IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    return own.groupBy("page").transformWithStateInPandas(statefulProcessor=QuietPoints(seconds, forget), outputStructType=POINTS, outputMode="Append", timeMode="EventTime")


def points_of(events: DataFrame, seconds: float, forget: float = 1e9) -> DataFrame:
    """The quiet points of a table, by windows."""
    wait, gone = _micros(seconds), _micros(forget)
    own = events.select(F.col("page").cast("string").alias("page"), F.col("at").cast("timestamp").alias("at"), F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.col("ord").cast("long").alias("ord"), F.col("sig").cast("string").alias("sig"))
    own = own.filter("page IS NOT NULL AND at IS NOT NULL").dropDuplicates(["page", "us", "ord"])
    w = W.partitionBy("page").orderBy("us", "ord")
    gap = F.lead("us").over(w) - F.col("us")
    quiet = own.filter("sig IS NOT NULL").withColumn("gap", gap).filter(F.col("gap").isNull() | (F.col("gap") >= wait)).drop("gap")
    q = quiet.withColumns({"p_us": F.lag("us").over(w), "p_sig": F.lag("sig").over(w)})
    forgot = F.col("us") - F.col("p_us") >= gone
    changed = F.col("p_us").isNull() | forgot | (F.col("sig") != F.col("p_sig"))
    q = q.withColumns({"changed": changed, "forgot": F.when(forgot, F.col("p_us") + gone)})
    # Answers up to here were ended or forgotten before.
    low = F.greatest(F.max(F.when(F.col("changed"), F.col("us") + wait)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.max("forgot").over(w.rowsBetween(W.unboundedPreceding, 0)))
    q = q.withColumn("low", low)
    ends = q.filter("changed").select("page", "us", "ord", F.explode(F.array(F.struct((F.col("us") + wait).alias("t"), F.lit(1).alias("sign")), F.struct(F.coalesce("low", F.lit(-(2**62))).alias("t"), F.lit(-1).alias("sign")))).alias("e")).select("page", "us", "ord", "e.t", "e.sign")
    both = own.filter("sig IS NULL").select("page", "us", "ord", F.col("us").alias("t"), F.lit(0).alias("sign")).union(ends)
    upto = F.count_if(F.col("sign") == 0).over(W.partitionBy("page").orderBy("t").rangeBetween(W.unboundedPreceding, 0))
    ended = both.withColumn("n", upto).filter("sign <> 0").groupBy("page", "us", "ord").agg(F.greatest(F.sum(F.col("n") * F.col("sign")), F.lit(0)).alias("discarded"))
    return q.join(ended, ["page", "us", "ord"], "left").select("page", "at", "ord", "sig", "changed", F.coalesce("discarded", F.lit(0)).cast("long").alias("discarded"))


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State of the kinds above needs the store that keeps lists and timers."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before is not None else spark.conf.unset(PROVIDER)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all there is now into a table in the folder; called again with the folder, it goes on from where it was."""
    spark = stream.sparkSession
    with rocks(spark):
        run = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
