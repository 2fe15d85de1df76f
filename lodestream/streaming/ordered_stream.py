"""Conditional updates over a stream, in event order, with recovery from its checkpoint.

Attempts arrive in any order and in any batch. Each waits in its id's state
until the watermark has passed its time, when nothing earlier can come any
more; then those that are due are applied in ascending seq. What waits, and the
current revision, lie in the state store and its checkpoint, so a query that
is started again goes on where it ended.
"""

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "id string, seq bigint, status int, revision bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: Outcomes of an id at once.
PIECE = 100_000


class OrderedUpdates(StatefulProcessor):
    """Per id: ``now``, its revision and the last seq applied; ``waiting``, (seq, expected, at in ms) of attempts that aren't due, as they came.

    State is read and written in lists, as each call goes to the JVM and back.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "known boolean, revision bigint, last bigint")
        self.waiting = handle.getListState("waiting", "seq bigint, expected double, at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return
        first, known = None, self.now.exists()
        for frame in rows:
            if not known:
                stored = frame["revision"].iloc[0]
                known = True
                self.now.update((not pd.isna(stored), None if pd.isna(stored) else int(stored), None))
            expected = [None if pd.isna(x) else float(x) for x in frame["expected"].tolist()]
            self.waiting.appendList(list(zip(frame["seq"].tolist(), expected, frame["ms"].tolist())))
            first = min(frame["ms"].min(), frame["ms"].min() if first is None else first)
        if first is not None:
            self.handle.registerTimer(int(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        due = sorted(((seq, expected) for seq, expected, at in held if at <= limit), key=lambda x: x[0])
        later = [x for x in held if x[2] > limit]
        if not due:
            return
        known, revision, last = self.now.get()
        for lo in range(0, len(due), PIECE):
            status, after, part = [], [], due[lo : lo + PIECE]
            for seq, expected in part:
                if last is not None and seq <= last:
                    raise ValueError(f"{key[0]!r}: an attempt of seq {seq} was given before, or is later in time than in order")
                last = seq
                if not known:
                    status.append(404)
                elif expected == revision:
                    revision += 1
                    status.append(200)
                else:
                    status.append(409)
                after.append(revision)
            yield pd.DataFrame({"id": key[0], "seq": [s for s, _ in part], "status": status, "revision": pd.array(after, dtype="Int64")})
        self.now.update((known, revision, last))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(int(min(x[2] for x in later)))
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that timers and maps need; streams have to start inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def revise_in_order(attempts: DataFrame, records: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming outcomes (id, seq, status, revision) of streaming attempts (id, seq, expected, at), in order of seq whatever order they arrive in.

    ``at`` is an attempt's time, after 1970, which in an id must not fall as seq rises; the
    clock is the greatest ``at`` seen in all the stream, less ``delay``, by
    which arrivals may be late. An attempt is answered once the clock passes it, so the last ones
    wait for a later row: one with a null id moves the clock and is not answered.
    An attempt without a time is due with the next batch.
    Spark drops what is later than ``delay``. A repeated (id, seq) raises once it is
    due, and so does one below an attempt already answered. A record's stored revision, of
    which ``records`` has one an id, counts when its first attempt arrives; an
    id that it lacks gets 404 each time.

    State is 24 bytes for each attempt within the delay and a revision an id; an
    id's waiting attempts are read when some of them are due.
    Needs ``keyed_state`` while the query starts.
    """
    timed = attempts.withWatermark("at", delay)
    stored = records.where("id is not null").select("id", F.col("revision").cast("bigint").alias("revision"))
    ms = F.coalesce(F.unix_millis("at"), F.lit(0))  # 0 is due at once
    # not "id is not null" alone, which would be moved below the watermark and hide the rows that move the clock
    seeded = timed.join(stored, "id", "left").where("id is not null or at is null")
    rows = seeded.select("id", F.col("seq").cast("bigint").alias("seq"), F.col("expected").cast("double").alias("expected"), "revision", ms.alias("ms"), "at")
    return rows.groupBy("id").transformWithStateInPandas(OrderedUpdates(), outputStructType=OUT, outputMode="append", timeMode="eventTime")
