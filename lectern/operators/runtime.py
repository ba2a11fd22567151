"""Request lifecycles, retention and the completion feed, over tables of ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ["completed", "failed", "cancelled"]
#: seconds that a terminal record is kept
TTL = {"completed": 900, "failed": 1800, "cancelled": 600}
FEED = 1000


def last_state(events: DataFrame) -> DataFrame:
    """request_id, state, seq, submitted_at, finished_at: where each request stands.  The first terminal
    event is final; before it the latest event counts."""
    final = F.col("state").isin(TERMINAL)
    g = events.groupBy("request_id").agg(
        F.min(F.when(final, F.struct("seq", "state", "t"))).alias("f"), F.max(F.struct("seq", "state")).alias("l"), F.min_by("t", "seq").alias("submitted_at"),
    )
    return g.select("request_id", F.coalesce("f.state", "l.state").alias("state"), F.coalesce("f.seq", "l.seq").alias("seq"), "submitted_at", F.col("f.t").alias("finished_at"))


def completions(events: DataFrame) -> DataFrame:
    """The feed: one event for each request that ended, numbered by order of its end within nothing but
    the event sequence itself, so no global ranking is needed."""
    return last_state(events).where(F.col("state").isin(TERMINAL)).select("seq", "request_id", "state", "finished_at")


def feed_page(feed: DataFrame, cursor: int, limit: int) -> DataFrame:
    return feed.where(F.col("seq") > cursor).orderBy("seq").limit(max(1, min(FEED, limit)))


def feed_retained(feed: DataFrame, keep: int = FEED) -> DataFrame:
    return feed.orderBy(F.desc("seq")).limit(keep)


def expired(states: DataFrame, now: Column, ttl: dict[str, int] = TTL) -> DataFrame:
    """Terminal records past their time; 0 keeps for ever."""
    limit = F.lit(0)
    for k, v in ttl.items():
        limit = F.when(F.col("state") == k, v).otherwise(limit)
    since = F.coalesce("finished_at", "submitted_at")
    return states.where(F.col("state").isin(TERMINAL) & (limit > 0) & (now - since >= limit))


def oldest(states: DataFrame, many: int, buckets: int = 1000) -> DataFrame:
    """The ``many`` oldest terminal records with their place, 1 the oldest.  A histogram of their times (a
    number for each bucket) says in which bucket the last of them is; later ones are never sorted, and
    the others only within their bucket."""
    old = states.where(F.col("state").isin(TERMINAL)).withColumn("_t", F.coalesce("finished_at", "submitted_at"))
    low, high = old.agg(F.min("_t"), F.max("_t")).first()
    if low is None or many <= 0:
        return old.where(F.lit(False)).withColumn("place", F.lit(0).cast("bigint")).drop("_t")
    old = old.withColumn("_b", F.floor((F.col("_t") - low) * buckets / (high - low + 1)).cast("int"))
    before, total = {}, 0
    for r in old.groupBy("_b").count().orderBy("_b").collect():
        if total >= many:
            break
        before[r["_b"]], total = total, total + r["count"]
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_b"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_t", "request_id")) + start
    return old.where(F.col("_b") <= max(before)).withColumn("place", place.cast("bigint")).where(F.col("place") <= many).drop("_t", "_b")


def overflow(states: DataFrame, most: int) -> DataFrame:
    """The oldest terminal records beyond ``most`` records in all."""
    return oldest(states, max(0, states.count() - most)).drop("place")


def durations(events: DataFrame) -> DataFrame:
    """request_id, waited, ran (seconds, never negative)."""
    first = lambda s: F.min(F.when(F.col("state").isin(s), F.col("t")))
    g = events.groupBy("request_id").agg(first(["queued"]).alias("q"), first(["running"]).alias("r"), first(TERMINAL).alias("f"))
    return g.select("request_id", F.greatest(F.lit(0), F.col("r") - F.col("q")).alias("waited"), F.greatest(F.lit(0), F.col("f") - F.col("r")).alias("ran"))


def queue_positions(states: DataFrame, lane: str | None = None) -> DataFrame:
    """request_id, position: 1-based place among the queued of a lane, by sequence."""
    w = Window.partitionBy(*([lane] if lane else [])).orderBy("seq")
    return states.where("state = 'queued'").withColumn("position", F.row_number().over(w))


def submissions(requests: DataFrame) -> DataFrame:
    """request_id, seq, outcome: 202 for the first, 200 for the same payload again, 409 for another."""
    first = F.min_by("payload", "seq")
    f = requests.groupBy("request_id").agg(first.alias("first"), F.min("seq").alias("first_seq"))
    code = F.when(F.col("seq") == F.col("first_seq"), 202).when(F.col("payload").eqNullSafe(F.col("first")), 200).otherwise(409)
    return requests.join(f, "request_id").select("request_id", "seq", code.alias("outcome"))


def overlay_request(body: DataFrame, source: DataFrame, texts: list[str], flags: list[str], defaults: dict[str, str]) -> DataFrame:
    """A re-run's fields: its own if given, else the source's, else the default; a given false stays."""
    j = body.alias("b").join(source.alias("s"), "request_id", "left")
    text = lambda c: F.coalesce(F.nullif(F.trim(F.col(f"b.{c}")), F.lit("")), F.col(f"s.{c}"), F.lit(defaults.get(c)))
    return j.select("request_id", *[text(c).alias(c) for c in texts], *[F.coalesce(F.col(f"b.{c}"), F.col(f"s.{c}"), F.lit(True)).alias(c) for c in flags])
