"""Fixed analytics over events: frequencies, summaries, interval correlation, percentiles, sliding windows, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = {"minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month"}


def event_frequency(events: DataFrame, unit: str = "day", by: tuple[str, ...] = ("event_type",), fill: bool = True, compat_month_step: bool = False) -> DataFrame:
    """bucket (timestamp), *by, n: events in each bucket of one ``unit`` (weeks begin on Monday).

    With fill, every bucket between the first and the last has a row for every value of by that occurs, with n = 0 where
    nothing happened; the grid is built from the aggregate, not from the events. Months are calendar months, or 30 days with
    compat_month_step. No events, no buckets.
    """
    counts = events.groupBy(F.date_trunc(unit, "timestamp").alias("bucket"), *by).agg(F.count(F.lit(1)).alias("n"))
    if not fill:
        return counts
    step = "30 days" if unit == "month" and compat_month_step else STEP[unit]
    span = events.agg(F.date_trunc(unit, F.min("timestamp")).alias("lo"), F.date_trunc(unit, F.max("timestamp")).alias("hi")).where("lo is not null")
    each = counts.select(*by).distinct().join(F.broadcast(span)) if by else span  # the span is one row
    buckets = each.select(*by, F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias("bucket"))
    got = buckets.join(counts, ["bucket", *by], "left")
    return got.select("bucket", *by, F.coalesce("n", F.lit(0)).alias("n"))


def summary_totals(events: DataFrame) -> DataFrame:
    """One row: total, entities, types, first and last time, days (whole, at least 1) and events_per_day."""
    days = F.greatest(F.floor((F.unix_timestamp(F.max("timestamp")) - F.unix_timestamp(F.min("timestamp"))) / 86400), F.lit(1))
    return events.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("entity_id").alias("entities"), F.count_distinct("event_type").alias("types"),
        F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), days.alias("days"), (F.count(F.lit(1)) / days).alias("events_per_day"),
    )


def top_counts(events: DataFrame, column: str, k: int = 10, with_share: bool = True) -> DataFrame:
    """The k most frequent values: value, n, share in percent; ties by value."""
    counts = events.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(k)
    if not with_share:
        return top
    total = events.agg(F.count(F.lit(1)).alias("all_"))
    return top.join(F.broadcast(total)).select("value", "n", (F.col("n") * 100.0 / F.col("all_")).alias("share"))


def correlation(events: DataFrame, type_a: str, type_b: str, window_s: int, keys: tuple[str, ...] = ("tenant_id", "entity_id")) -> DataFrame:
    """One row: total_a, total_b, pairs, percent (pairs by total_a), mean_gap_s: a and b of one entity, at most window_s whole
    seconds apart in either direction.

    Times are cut into buckets of the window's width and an a meets only the b of its own and the two next to it, so an
    entity with many events is no square; only counts leave the join.
    """
    width = max(1, window_s + 1)
    at = lambda side: events.where(F.col("event_type") == side)
    bucket = F.floor(F.unix_seconds("timestamp") / width)
    a = at(type_a).select(*keys, F.col("timestamp").alias("ta"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    b = at(type_b).select(*keys, F.col("timestamp").alias("tb"), bucket.alias("bucket"))
    gap = F.abs(F.timestamp_diff("SECOND", F.col("ta"), F.col("tb")))
    pairs = a.join(b, [*keys, "bucket"]).select(gap.alias("gap")).where(F.col("gap") <= window_s).agg(F.count(F.lit(1)).alias("pairs"), F.avg("gap").alias("mean_gap_s"))
    totals = events.agg(F.count_if(F.col("event_type") == type_a).alias("total_a"), F.count_if(F.col("event_type") == type_b).alias("total_b"))
    one = totals.join(F.broadcast(pairs))  # one row by one row
    return one.select("total_a", "total_b", "pairs", F.when(F.col("total_a") > 0, F.col("pairs") * 100.0 / F.col("total_a")).otherwise(0.0).alias("percent"), "mean_gap_s")


def percentiles(df: DataFrame, column: str, ranks: tuple[float, ...] = (50, 90, 95, 99), by: tuple[str, ...] = ()) -> DataFrame:
    """*by, rank, value: exact percentiles with linear interpolation; nulls do not count."""
    got = df.groupBy(*by).agg(F.percentile(column, F.array(*[F.lit(r / 100) for r in ranks])).alias("v"))
    return got.select(*by, F.explode(F.arrays_zip(F.array(*[F.lit(float(r)) for r in ranks]).alias("rank"), F.col("v").alias("value"))).alias("z")).select(*by, "z.rank", "z.value")


def spread(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """*by, n, mean, variance, stddev (of the population), min, max."""
    c = F.col(column)
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance"), F.stddev_pop(c).alias("stddev"), F.min(c).alias("min"), F.max(c).alias("max"))


def sliding(events: DataFrame, base: str, size: int, slide: int) -> DataFrame:
    """start, end (timestamps of base buckets), n: windows of ``size`` filled base buckets, every ``slide`` of them; a partial
    last window is dropped. The windows run over counts by bucket."""
    grid = event_frequency(events, base, by=())
    order = Window.orderBy("bucket")
    frame = order.rowsBetween(0, size - 1)
    got = grid.select("bucket", F.row_number().over(order).alias("at"), F.sum("n").over(frame).alias("n"), F.count(F.lit(1)).over(frame).alias("held"), F.max("bucket").over(frame).alias("end"))
    return got.where((F.col("held") == size) & ((F.col("at") - 1) % slide == 0)).select(F.col("bucket").alias("start"), "end", "n")


def with_sessions(events: DataFrame, gap_s: int = 1800, keys: tuple[str, ...] = ("tenant_id", "entity_id")) -> DataFrame:
    """events with session, numbered from 1 in each entity: a new one begins after a gap of more than gap_s whole seconds."""
    w = Window.partitionBy(*keys).orderBy("timestamp", "id")
    new = F.coalesce(F.timestamp_diff("SECOND", F.lag("timestamp").over(w), F.col("timestamp")) > gap_s, F.lit(True))
    return events.withColumn("new_", new.cast("long")).withColumn("session", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def sessions(events: DataFrame, gap_s: int = 1800, keys: tuple[str, ...] = ("tenant_id", "entity_id")) -> DataFrame:
    """*keys, session, n, started, ended, seconds."""
    got = with_sessions(events, gap_s, keys).groupBy(*keys, "session").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"))
    return got.withColumn("seconds", F.timestamp_diff("SECOND", F.col("started"), F.col("ended")))


def daily_usage(events: DataFrame, unit: str = "day") -> DataFrame:
    """tenant_id, bucket, n without filling."""
    return events.groupBy("tenant_id", F.date_trunc(unit, "timestamp").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def with_trailing(events: DataFrame, seconds: int, keys: tuple[str, ...], **columns: Column) -> DataFrame:
    """events with the sum of each of columns over the ``seconds`` up to each event, its own moment whole, in each key.

    Time is cut into spans as long as the window, which so holds the own span up to the event and the end of the span before.
    Each row stands in its own span and, later by the window's length, in the next one; both parts are then running sums, the
    second one backwards. The work is that of a sort, however many events a window holds, and no sum is a difference.
    """
    length = seconds * 1_000_000
    shifts = F.explode(F.array(*[F.lit(x).cast("long") for x in ([0, length] if length else [0])]))
    rows = events.select("*", *[c.alias(f"{name}_") for name, c in columns.items()], shifts.alias("shift_")).withColumn("at_", F.unix_micros("timestamp") + F.col("shift_"))
    rows = rows.where("shift_ = 0 OR at_ IS NOT NULL").withColumn("span_", F.col("at_") - F.pmod("at_", F.lit(length or 1)))
    span = Window.partitionBy(*keys, "span_")
    until, since = (span.orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow) for c in (F.col("at_"), F.col("at_").desc()))
    for name in columns:
        here = F.sum(F.when(F.col("shift_") == 0, F.col(f"{name}_"))).over(until)
        before = F.sum(F.when(F.col("shift_") > 0, F.col(f"{name}_"))).over(since)
        rows = rows.withColumn(f"{name}_here_", here).withColumn(f"{name}_before_", before)
    total = {name: F.coalesce(F.col(f"{name}_here_") + F.col(f"{name}_before_"), f"{name}_here_", f"{name}_before_") for name in columns}
    return rows.where("shift_ = 0").withColumns(total).select(*events.columns, *[c for c in columns if c not in events.columns])


def anomalies(events: DataFrame, event_type: str, limit: int, seconds: int, keys: tuple[str, ...] = ("tenant_id", "entity_id")) -> DataFrame:
    """*keys, alerts, most: events of a type at which at least ``limit`` of them, itself included, lie in the ``seconds`` before."""
    got = with_trailing(events.where(F.col("event_type") == event_type), seconds, keys, near=F.lit(1).cast("long"))
    return got.where(F.col("near") >= limit).groupBy(*keys).agg(F.count(F.lit(1)).alias("alerts"), F.max("near").alias("most"))


def unusual_volume(events: DataFrame, times: float = 5.0, keys: tuple[str, ...] = ("tenant_id", "entity_id")) -> DataFrame:
    """*keys, hour, n, mean: hours with more than ``times`` the entity's mean events in its active hours."""
    hours = events.groupBy(*keys, F.date_trunc("hour", "timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.withColumn("mean", F.avg("n").over(Window.partitionBy(*keys))).where(F.col("n") > F.col("mean") * times)
