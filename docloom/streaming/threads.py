"""Threads of messages that arrive over time, equal to those of one batch.

The state of a subject and participant is its runs: stretches of time in which no two neighbouring messages lie further apart than
the window, each with one message that stands for it. A new message is linked to every run that it comes within the window of,
and such runs become one: a late message can thus join two threads. An undated message links to all of its participant's, and
so does everything after it. State is one row for each gap in a participant's mail, however many messages there are, and a
busy subject is spread over its participants. Subjects and participants are dealt into BUCKETS keys of state, whose runs are read and
written together: calls to the state are bounded by the keys and triggers, not by the participants, and a key stays small.

Links only ever get more, so they are appended to a table; threads are the components of that table, made when they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from docloom.functions import fixed
from docloom.operators import edges
from docloom.operators.range_joins import micros

LINKS = "subject string, message_key string, linked string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = 86_400_000_000
#: Keys of state; with a hundred million runs one holds some 100,000.
BUCKETS = 1_024

Run = tuple[int | None, int | None, str]


def take_in(runs: list[Run], message: str, at: int | None, window: int) -> tuple[list[Run], list[str]]:
    """The runs after a message, and the messages that it is linked to. A run without bounds takes all."""
    if any(first is None for first, _, _ in runs):
        return runs, [rep for first, _, rep in runs if first is None]
    if at is None:
        return [(None, None, message)], [rep for _, _, rep in runs]
    near = [r for r in runs if r[0] - window <= at <= r[1] + window]
    rest = [r for r in runs if not (r[0] - window <= at <= r[1] + window)]
    joined = (min([at, *(r[0] for r in near)]), max([at, *(r[1] for r in near)]), near[0][2] if near else message)
    return [*rest, joined], [r[2] for r in near]


class ThreadRuns(StatefulProcessor):
    """Keyed by bucket; rows are (subject, who, message_key, at) with `at` in microseconds, and state is the runs of each subject and who."""

    def __init__(self, window: int, forget: bool):
        self.window, self.forget = window, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "subject string, who string, first long, last long, rep string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], list[Run]] = {}
        for subject, who, *run in self.runs.get():
            held.setdefault((subject, who), []).append(tuple(run))
        came: dict[tuple[str, str], set] = {}
        for part in rows:
            for subject, who, m, at in zip(part["subject"], part["who"], part["message_key"], part["at"]):
                came.setdefault((subject, who), set()).add((m, None if at is None or at != at else int(at)))
        out = []
        for seat, messages in came.items():
            runs = held.get(seat, [])
            for message, at in sorted(messages, key=lambda x: (x[1] is None, x[1] or 0, x[0])):
                runs, linked = take_in(runs, message, at, self.window)
                out += [(seat[0], message, other) for other in [message, *linked]]
            held[seat] = runs
        self._keep([(*seat, *run) for seat, runs in held.items() for run in runs])
        yield pd.DataFrame(out, columns=["subject", "message_key", "linked"])

    def _keep(self, runs: list[tuple]) -> None:
        self.runs.put(runs) if runs else self.runs.clear()
        if self.forget:
            self._remind(runs)

    def _remind(self, runs: list[tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = [last for *_, last, _ in runs if last is not None]
        if ends:
            self.handle.registerTimer((min(ends) + self.window) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Runs that no message can reach any more go."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self._keep([r for r in map(tuple, self.runs.get()) if r[3] is None or r[3] + self.window >= now])
        yield pd.DataFrame({"subject": [], "message_key": [], "linked": []}, dtype="str")

    def close(self) -> None:
        pass


def _seats(rows: DataFrame) -> DataFrame:
    """(subject, who, message_key, sent_at, at): the participants of messages of rows(message_key, subject, src, dst, sent_at)."""
    named = rows.withColumn("subject", edges.normalise_subject(F.col("subject"))).filter("subject <> ''")
    seats = named.select("subject", F.explode(F.array("src", "dst")).alias("who"), "message_key", F.col("sent_at").cast("timestamp").alias("sent_at"), micros(F.col("sent_at")).alias("at"))
    return seats.filter("who IS NOT NULL AND message_key IS NOT NULL")


def start_links(letters: DataFrame, sink: str, checkpoint: str, window_days: float = fixed.THREAD_WINDOW_DAYS, late: str | None = None):
    """A query that takes what there is of a stream letters(message_key, subject, src, dst, sent_at), appends links and stops.

    Started again on the same checkpoint it goes on with its state. Without `late` all runs are kept; with it, say "90 days", rows
    later than that are dropped and runs that nothing can reach are forgotten. Copies of a message should agree in their date.
    """
    session = letters.sparkSession
    held = session.conf.get(_PROVIDER, None)
    session.conf.set(_PROVIDER, _ROCKS)
    try:
        seats = _seats(letters)
        seats = seats.withWatermark("sent_at", late) if late else seats
        seats = seats.withColumn("bucket", F.pmod(F.xxhash64("subject", "who"), F.lit(BUCKETS)))
        links = seats.groupBy("bucket").transformWithStateInPandas(ThreadRuns(int(window_days * _DAY), late is not None), LINKS, "Append", "EventTime" if late else "None")
        return links.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        session.conf.unset(_PROVIDER) if held is None else session.conf.set(_PROVIDER, held)


def threads_of(spark: SparkSession, sink: str, letters: DataFrame, min_messages: int = fixed.MIN_THREAD_MESSAGES) -> tuple[DataFrame, DataFrame]:
    """(thread nodes, participation edges) of the links appended so far and the letters that they came from."""
    links = spark.read.schema(LINKS).parquet(sink).distinct()
    return edges.threads_by_links(letters, links.filter("message_key <> linked").select("subject", "message_key", F.col("linked").alias("before")), min_messages)
