"""Which snapshots a retention policy keeps, and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Policy:
    """Limits of each stage (0 skips it, below 0 is without limit), then caps (0 or less: none)."""

    last: int = 0
    hour: int = 0
    day: int = 0
    week: int = 0
    month: int = 0
    year: int = 0
    max_amount: int = 0
    max_lifetime: int = 0
    zone: str = "UTC"


def _bucket(stage: str, local: Column) -> Column:
    if stage == "last":
        return F.col("id").cast("string")
    if stage == "week":
        return F.concat_ws("/", F.extract(F.lit("YEAROFWEEK"), local), F.lpad(F.extract(F.lit("WEEK"), local).cast("string"), 2, "0"))
    return F.date_format(local, {"hour": "yyyy/MM/dd/HH", "day": "yyyy/MM/dd", "month": "yyyy/MM", "year": "yyyy"}[stage])


def plan(backup: DataFrame, policy: Policy, now: int, partition: tuple[str, ...] = ()) -> DataFrame:
    """partition, id, keep, reason for snapshots (partition, id, timestamp, timestamp_ns_part, protected) at `now` (seconds).

    Newest first, stages last, hour, day, week, month, year: a stage walks the snapshots that are not yet
    kept nor protected; a bucket that holds a kept one, or one met before, supersedes; the walk stops at the
    first that would open one bucket too many.  Buckets follow time, so each stage is a pass of windows.
    """
    newest = [F.desc("timestamp"), F.desc("timestamp_ns_part"), F.desc("id")]
    local = F.from_utc_timestamp(F.timestamp_seconds("timestamp"), policy.zone)
    rows = backup.withColumn("at", F.row_number().over(Window.partitionBy(*partition).orderBy(*newest))).withColumns({"mark": F.lit(None).cast("string"), "fallback": F.lit(None).cast("string")})
    for stage in ("last", "hour", "day", "week", "month", "year"):
        limit = getattr(policy, stage)
        if not limit:
            continue
        rows = rows.withColumn("bucket", _bucket(stage, local))
        own = Window.partitionBy(*partition, "bucket")
        every = Window.partitionBy(*partition).orderBy("at")
        kept = F.col("mark").startswith("keep") & ~F.col("protected")
        rows = rows.withColumn("holder", F.max_by("id", F.when(kept, F.col("at"))).over(own))
        open_ = F.col("mark").isNull() & ~F.col("protected")
        rows = rows.withColumn("fresh", open_ & F.col("holder").isNull())
        rows = rows.withColumn("opens", F.col("fresh") & (F.min(F.when(F.col("fresh"), F.col("at"))).over(own) == F.col("at")))
        rows = rows.withColumn("number", F.sum(F.col("opens").cast("int")).over(every))
        reached = F.lit(True) if limit < 0 else F.col("number") <= limit
        rows = rows.withColumn("leader", F.min_by("id", F.when(F.col("fresh"), F.col("at"))).over(own))
        say = lambda who: F.concat(F.lit("superseded by "), who.cast("string"), F.lit(f" ({stage})"))
        rows = rows.withColumn("fallback", F.coalesce("fallback", F.when(reached & open_ & F.col("holder").isNotNull(), say(F.col("holder")))))
        mark = F.when(F.col("opens"), F.concat(F.lit(f"keep {stage} "), F.col("number").cast("string"))).otherwise(say(F.col("leader")))
        rows = rows.withColumn("mark", F.coalesce("mark", F.when(reached & F.col("fresh"), mark)))
    reason = F.when(F.col("protected"), "keep protected").otherwise(F.coalesce("mark", "fallback", F.lit("unmarked")))
    rows = rows.withColumn("reason", reason).withColumn("keep", F.col("reason").startswith("keep"))
    old = F.lit(now) - F.col("timestamp") > policy.max_lifetime if policy.max_lifetime > 0 else F.lit(False)
    before = Window.partitionBy(*partition).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    fit = F.col("keep") & ~F.col("protected") & ~old
    rows = rows.withColumn("kept_before", F.coalesce(F.sum(fit.cast("int")).over(before), F.lit(0)))
    full = F.col("kept_before") >= policy.max_amount if policy.max_amount > 0 else F.lit(False)
    cap = F.when(F.col("keep") & ~F.col("protected"), F.when(full, "max_amount exceeded").when(old, "max_lifetime exceeded"))
    return rows.select(*partition, "id", (F.col("keep") & cap.isNull()).alias("keep"), F.coalesce(cap, "reason").alias("reason"))
