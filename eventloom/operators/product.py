"""Product analytics: cohorts, funnels, paths, attribution, segments, churn, lifetime value, forecast, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cohorts(events: DataFrame, unit: str = "week") -> DataFrame:
    """cohort (first active unit), age (units later), entities active then."""
    active = events.select("entity_id", F.date_trunc(unit, "timestamp").alias("at")).distinct()
    first = active.groupBy("entity_id").agg(F.min("at").alias("cohort"))
    days = {"day": 1, "week": 7}[unit]
    age = F.floor(F.datediff("at", "cohort") / days)
    return active.join(first, "entity_id").groupBy("cohort", age.alias("age")).agg(F.count(F.lit(1)).alias("entities"))


def funnel(events: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """step, event_type, entities that reached it in order: each step's first time after the last step's, by one aggregate a step."""
    at = None
    parts = []
    for i, step in enumerate(steps):
        own = events.where(F.col("event_type") == step).select("entity_id", "timestamp")
        got = own if at is None else own.join(at, "entity_id").where("timestamp > reached")
        at = got.groupBy("entity_id").agg(F.min("timestamp").alias("reached"))
        parts.append(at.agg(F.count(F.lit(1)).alias("entities")).select(F.lit(i + 1).alias("step"), F.lit(step).alias("event_type"), "entities"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paths(events: DataFrame, length: int = 3) -> DataFrame:
    """path, n: the most frequent runs of ``length`` consecutive types of an entity."""
    w = Window.partitionBy("entity_id").orderBy("timestamp", "id")
    steps = [F.lead("event_type", i).over(w) if i else F.col("event_type") for i in range(length)]
    got = events.select(*[s.alias(f"s{i}") for i, s in enumerate(steps)]).where(F.col(f"s{length - 1}").isNotNull())
    return got.groupBy(F.concat_ws(" > ", *[f"s{i}" for i in range(length)]).alias("path")).agg(F.count(F.lit(1)).alias("n"))


def attribution(events: DataFrame, touches: tuple[str, ...], goal: str, model: str = "linear", window_s: int = 7 * 86400, half_life_s: float = 86400.0) -> DataFrame:
    """event_type, credit: each goal's value shared over the entity's touches in the window before it.

    first, last, linear, or time_decay by half-life. Times are bucketed by the window, so a goal meets only touches near it.
    """
    bucket = F.floor(F.unix_seconds("timestamp") / window_s)
    goals = events.where(F.col("event_type") == goal).select("entity_id", F.col("id").alias("goal"), F.col("timestamp").alias("won"), "value", F.explode(F.array(bucket - 1, bucket)).alias("b"))
    seen = events.where(F.col("event_type").isin(*touches)).select("entity_id", "event_type", "timestamp", "id", bucket.alias("b"))
    age = F.timestamp_diff("SECOND", F.col("timestamp"), F.col("won"))
    met = goals.join(seen, ["entity_id", "b"]).where((F.col("timestamp") < F.col("won")) & (age <= window_s))
    w = Window.partitionBy("goal")
    weight = {
        "first": (F.row_number().over(w.orderBy("timestamp", "id")) == 1).cast("double"),
        "last": (F.row_number().over(w.orderBy(F.desc("timestamp"), F.desc("id"))) == 1).cast("double"),
        "linear": F.lit(1.0),
        "time_decay": F.pow(F.lit(0.5), age / half_life_s),
    }[model]
    share = met.withColumn("w_", weight).withColumn("all_", F.sum("w_").over(w))
    return share.groupBy("event_type").agg(F.sum(F.col("value") * F.col("w_") / F.col("all_")).alias("credit"))


def rfm(events: DataFrame, goal: str, now) -> DataFrame:
    """entity_id, recency_days, frequency, monetary and quartiles r, f, m from 1 (best)."""
    got = events.where(F.col("event_type") == goal).groupBy("entity_id").agg(
        F.datediff(F.lit(now).cast("timestamp"), F.max("timestamp")).alias("recency_days"), F.count(F.lit(1)).alias("frequency"), F.sum("value").alias("monetary")
    )
    tile = lambda *order: F.ntile(4).over(Window.orderBy(*order, "entity_id"))  # noqa: E731  over one row per entity
    return got.select("*", tile("recency_days").alias("r"), tile(F.desc("frequency")).alias("f"), tile(F.desc(F.round("monetary", 6))).alias("m"))


def churn(events: DataFrame, now, after_days: int = 7) -> DataFrame:
    """churned, entities: whether the last event lies more than after_days whole days back."""
    last = events.groupBy("entity_id").agg(F.max("timestamp").alias("last"))
    return last.groupBy((F.datediff(F.lit(now).cast("timestamp"), F.col("last")) > after_days).alias("churned")).agg(F.count(F.lit(1)).alias("entities"))


def lifetime_value(events: DataFrame, goal: str) -> DataFrame:
    """One row: entities, buyers, revenue, value per entity and per buyer."""
    each = events.groupBy("entity_id").agg(F.sum(F.when(F.col("event_type") == goal, F.col("value"))).alias("v"))
    return each.agg(F.count(F.lit(1)).alias("entities"), F.count("v").alias("buyers"), F.sum("v").alias("revenue"), (F.sum("v") / F.count(F.lit(1))).alias("per_entity"), F.avg("v").alias("per_buyer"))


def forecast(events: DataFrame, horizon: int = 7) -> DataFrame:
    """day_number, n: a least-squares line through events by day, carried on for ``horizon`` days."""
    days = events.groupBy(F.to_date("timestamp").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    span = days.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    at = days.join(F.broadcast(span)).select(F.datediff("d", "lo").alias("x"), "n", F.datediff("hi", "lo").alias("last"))
    line = at.agg(F.regr_slope("n", "x").alias("a"), F.regr_intercept("n", "x").alias("b"), F.max("last").alias("last"))
    ahead = line.select("a", "b", F.explode(F.sequence(F.col("last") + 1, F.col("last") + horizon)).alias("day_number"))
    return ahead.select("day_number", (F.col("a") * F.col("day_number") + F.col("b")).alias("n"))


def stratified(events: DataFrame, column: str, k: int) -> DataFrame:
    """k events of each value of a column, those with the smallest hash of their ids: the same sample on each run."""
    w = Window.partitionBy(column).orderBy(F.md5(F.col("id").cast("string")), "id")
    return events.withColumn("at_", F.row_number().over(w)).where(F.col("at_") <= k).drop("at_")
