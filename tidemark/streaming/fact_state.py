"""Facts as the state of a stream: reads are counted, and facts that expire or lie idle leave it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store for state that outgrows memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What a stream of facts is made of: a ``store`` row brings a fact, a ``read`` row uses it.
CHANGES = (
    "id long, at timestamp, kind string, ticker string, fact_type string, content string, source string, "
    "confidence double, expires_at timestamp"
)
#: One row per change of a fact; that of the greatest ``version`` holds.
VERSIONS = (
    "id long, version long, fate string, ticker string, fact_type string, content string, source string, confidence double, "
    "created_at timestamp, expires_at timestamp, access_count long, last_accessed timestamp"
)
# The state holds moments as microseconds, so that no time zone comes into play.
TEXTS = ["ticker", "fact_type", "content", "source", "confidence"]
STATE = (
    "version long, ticker string, fact_type string, content string, source string, confidence double, "
    "created_at long, expires_at long, access_count long, last_accessed long"
)
FIELDS = [field.split()[0] for field in STATE.split(", ")]
DAY = 86_400_000_000


class FactState(StatefulProcessor):
    """Keeps one live fact per key. Its timers are the moment it expires and the one by which it must
    have been read; a change that arrives in the same batch as such a moment is judged by its own
    time, so results do not depend on how the stream is cut into batches."""

    def __init__(self, idle_days: int) -> None:
        self.idle = idle_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fact = handle.getValueState("fact", STATE)

    def stored(self) -> dict | None:
        found = self.fact.get()
        return dict(zip(FIELDS, found)) if found else None

    def fate(self, fact: dict, at: int) -> str:
        """What has become of a fact by ``at``. A moment that is reached is not yet passed."""
        unread = fact["created_at"] + self.idle if fact["access_count"] == 0 else at
        if min(unread, fact["expires_at"]) >= at:
            return "kept"
        return "pruned" if unread < fact["expires_at"] else "expired"

    def forget(self, key: int, fact: dict, fate: str) -> Row:
        self.fact.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return Row(id=key, fate=fate, **(fact | {"version": fact["version"] + 1}))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (number,), known = key, self.stored()
        fact = known
        for row in sorted(rows, key=lambda r: (r.at_us, r.kind != "store")):
            if fact is not None and (gone := self.fate(fact, row.at_us)) != "kept":
                yield self.forget(number, fact, gone)
                fact = None
            if row.kind == "store" and fact is None:
                fact = {"version": row.at_us, **{name: row[name] for name in TEXTS}, "created_at": row.at_us,
                        "expires_at": row.expires_us, "access_count": 0, "last_accessed": None}
            elif row.kind == "read" and fact is not None:
                fact = fact | {"version": fact["version"] + 1, "access_count": fact["access_count"] + 1, "last_accessed": row.at_us}
        if fact is not None and fact != known:
            if known is None or known["created_at"] != fact["created_at"]:
                for moment in (fact["expires_at"], fact["created_at"] + self.idle):
                    self.handle.registerTimer(moment // 1000 + 1)
            self.fact.update(tuple(fact.values()))
            yield Row(id=number, fate="kept", **fact)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (number,), fact = key, self.stored()
        if fact is not None and (gone := self.fate(fact, expiredTimerInfo.getExpiryTimeInMs() * 1000)) != "kept":
            yield self.forget(number, fact, gone)

    def close(self) -> None:
        pass


def fact_versions(changes: DataFrame, idle_days: int = 30, delay: str = "0 seconds") -> DataFrame:
    """:data:`VERSIONS` of a stream of :data:`CHANGES`.

    State holds live facts only: a fact leaves it once the watermark has passed the moment it
    expires, or ``idle_days`` after it came if it was never read. Changes of a fact may come in any
    order within ``delay``; a read of a fact that is gone, or that never came, counts nothing. The
    query must run with :data:`STATE_STORE`.
    """
    timed = changes.withWatermark("at", delay).select(
        "id", "at", "kind", *TEXTS, F.unix_micros("at").alias("at_us"), F.unix_micros("expires_at").alias("expires_us")
    )
    names = [field.split()[0] for field in VERSIONS.split(", ")]
    kinds = dict(zip(FIELDS, [field.split()[1] for field in STATE.split(", ")])) | {"id": "long", "fate": "string"}
    changed = timed.groupBy("id").transformWithState(
        statefulProcessor=FactState(idle_days),
        outputStructType=", ".join(f"{name} {kinds[name]}" for name in names),
        outputMode="Update",
        timeMode="EventTime",
    )
    moments = ["created_at", "expires_at", "last_accessed"]
    return changed.select(*[F.timestamp_micros(name).alias(name) if name in moments else F.col(name) for name in names])


def standing_facts(versions: DataFrame, as_of: Column, idle_days: int = 30) -> DataFrame:
    """The facts that are live at ``as_of``, from all versions written so far."""
    latest = Window.partitionBy("id").orderBy(F.desc("version"))
    last = versions.withColumn("_turn", F.row_number().over(latest)).filter("_turn = 1 AND fate = 'kept'").drop("_turn")
    idle = (F.col("access_count") == 0) & (F.col("created_at") + F.make_dt_interval(days=F.lit(idle_days)) < as_of)
    return last.filter(~idle & (F.col("expires_at") >= as_of)).drop("version", "fate")
