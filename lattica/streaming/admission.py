"""Admission under daily caps as a stateful stream (an extension): what is below both caps of its UTC day gets in.

Two stateful steps. The first holds, per day and lane of users, whose rows have counted, until a
lane has sent as many as get in on a day: of the later ones none can. The second, per day, holds how
many of those that were sent have counted; the ids of other rows pass it in blocks, in lanes of
their own. A timer at the end of the day, UTC, drops a day's state. Within a micro-batch rows are
taken in order of time; a step holds no more of them than the cap of the day.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lattica.functions.storage import session_dir, ship

DAY_MS = 86_400_000
LANES = 64  # of a day's users
BLOCK = 4096  # ids of rows that don't count, in a row
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Own(StatefulProcessor):
    """Sends a lane's rows that count for their users to lane -1 of their day, and the ids of others on in blocks."""

    def __init__(self, user_limit: int, limit: int) -> None:
        self.user_limit, self.limit = user_limit, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "users array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.sent.get()
        if known is None:
            self.handle.registerTimer((int(key[0]) + 1) * DAY_MS)
        users = list(known[0]) if known else []
        room = self.limit - len(users)
        first: list[tuple[int, int, int, Row]] = []  # the earliest rows that count, in order
        rest: list[int] = []
        for k, row in enumerate(rows):
            new, out = (row.at, row.id, k, row), row
            if room > 0 and (len(first) < room or new < first[-1]):
                insort(first, new)
                own = [x for x in first if x[-1].user == row.user]
                over = own[-1] if len(own) + users.count(row.user) > self.user_limit else first[-1] if len(first) > room else None
                out = over and over[-1]
                if over:
                    first.remove(over)
            if out:
                rest.append(out.id)
                if len(rest) == BLOCK:
                    yield Row(day=out.day, lane=key[1], id=None, at=None, ts=row.ts, rest=rest)
                    rest = []
        if rest:
            yield Row(day=row.day, lane=key[1], id=None, at=None, ts=row.ts, rest=rest)
        for at, ident, _, x in first:
            yield Row(day=x.day, lane=-1, id=ident, at=at, ts=x.ts, rest=None)
        self.sent.update((users + [x[-1].user for x in first],))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.sent.clear()
        yield from ()


class _All(StatefulProcessor):
    """Counts a day's rows of lane -1 up to the cap; rows of other lanes go by."""

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[1] >= 0:
            for row in rows:
                yield Row(ids=row.rest, day=row.day, admitted=False)
            return
        known = self.count.get()
        if known is None:
            self.handle.registerTimer((int(key[0]) + 1) * DAY_MS)
        spent = known[0] if known else 0
        first: list[tuple[int, int, int, Row]] = []  # the earliest rows, the latest of them on top
        for k, row in enumerate(rows):
            heapq.heappush(first, (-row.at, -row.id, -k, row))
            if len(first) > self.cap - spent:
                out = heapq.heappop(first)[-1]
                yield Row(ids=[out.id], day=out.day, admitted=False)
        for *_, row in first:
            yield Row(ids=[row.id], day=row.day, admitted=True)
        self.count.update((spent + len(first),))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.count.clear()
        yield from ()


def admitted(events: DataFrame, at: str, user: str, ident: str, user_limit: int, global_limit: int, delay: str = "1 day") -> DataFrame:
    """The stream (id, day, admitted) of a stream of events; ``day`` is the number of the UTC day.

    ``ident`` is a whole number that orders events of one time. Rows that are later than ``delay``
    behind the latest are dropped; times and ids that are null too. The session must keep
    state in RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    ship(events.sparkSession)
    ts = F.col(at).cast("timestamp")
    rows = events.select(F.unix_date(F.to_date(ts)).cast("long").alias("day"), F.col(user).cast("string").alias("user"), F.col(ident).cast("long").alias("id"), F.unix_micros(ts).alias("at"), ts.alias("ts"))
    rows = rows.where("id is not null and at is not null").withWatermark("ts", delay)
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("user"), F.lit(LANES)).cast("long"))
    own = rows.groupBy("day", "lane").transformWithState(_Own(user_limit, global_limit), "day long, lane long, id long, at long, ts timestamp, rest array<long>", "Append", "EventTime", eventTimeColumnName="ts")
    each = own.groupBy("day", "lane").transformWithState(_All(global_limit), "ids array<long>, day long, admitted boolean", "Append", "EventTime")
    return each.select(F.explode("ids").alias("id"), "day", "admitted")


def run(events: DataFrame, at: str, user: str, ident: str, user_limit: int, global_limit: int, delay: str = "1 day") -> DataFrame:
    """All that ``admitted`` gives for what the stream has now, as a table in the shared folder."""
    spark = events.sparkSession
    out, key = f"{session_dir(spark)}/admission-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        rows = admitted(events, at, user, ident, user_limit, global_limit, delay)
        q = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, was)
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")
