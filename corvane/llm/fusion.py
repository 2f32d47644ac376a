"""One ranking from several differently scaled scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.skew import exact_medians, hot_keys, hot_threshold, skew_join
from corvane.session import cut, stored

#: Makes the median absolute deviation of normal data equal to its standard deviation.
MAD_SCALE = 1.4826
#: A bounded score stays away from 0 and 1 by this much, so one lane can't veto an item alone.
FLOOR = 1e-9


def _weight(lane: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(lane == name, F.lit(float(w))).otherwise(out)
    return out


def _scale(mad: Column, mean: Column) -> Column:
    return F.when(mad > 0, mad * MAD_SCALE).when(mean > 0, mean)


def _gain(z: Column, weight: Column) -> Column:
    """What a standardised score adds over the neutral value, so lanes that lack an item need no row."""
    squashed = F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0)))), F.lit(0.5))
    return weight * (F.log(F.greatest(squashed, F.lit(FLOOR))) - F.log(F.lit(0.5)))


def _fuse_together(rows: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """(_g, _i, _x, lanes, _w) of groups that each fit a task: rows move once, by group, and all statistics are taken there."""
    rows = rows.repartition("_g").groupBy("_g", "_l", "_i").agg(F.max("_s").alias("_s"))
    own, whole = Window.partitionBy("_g", "_l"), Window.partitionBy("_g")
    rows = rows.withColumn("_d", F.abs(F.col("_s") - F.percentile("_s", F.lit(0.5)).over(own)).cast("double")).withColumn("_med", F.percentile("_s", F.lit(0.5)).over(own))
    scale = _scale(F.percentile("_d", F.lit(0.5)).over(own), F.avg("_d").over(own))
    total = F.aggregate(F.array_sort(F.collect_set("_l").over(whole)), F.lit(0.0), lambda a, x: a + _weight(x, weights))
    rows = rows.withColumn("_x", _gain((F.col("_s") - F.col("_med")) / scale, _weight(F.col("_l"), weights))).withColumn("_w", total)
    return rows.groupBy("_g", "_i").agg(F.sum("_x").alias("_x"), F.count(F.lit(1)).cast("int").alias("lanes"), F.first("_w").alias("_w"))


def _fuse_spread(rows: DataFrame, weights: Mapping[str, float], hot: int) -> DataFrame:
    """(_g, _i, _x, lanes, _w) of groups too large for a task: rows stay spread by item, and meet their lane's statistics there."""
    rows = stored(rows.groupBy("_g", "_i", "_l").agg(F.max("_s").alias("_s")).withColumn("_k", F.concat_ws("\u0001", F.col("_g").cast("string"), "_l")))
    middle = cut(exact_medians(rows, "_k", "_s", hot, "_med"))
    rows = stored(skew_join(rows, middle, "_k", "rows", F.col("_i"), hot).withColumn("_d", F.abs(F.col("_s") - F.col("_med"))))
    mad = exact_medians(rows.select("_k", "_d"), "_k", "_d", hot, "_mad")
    mean = rows.groupBy("_k").agg(F.avg("_d").alias("_mean"), F.first("_g").alias("_g"), F.first("_l").alias("_l"))
    scale = cut(mad.join(mean, "_k").select("_k", "rows", "_g", "_l", _scale(F.col("_mad"), F.col("_mean")).alias("_scale")))
    rows = skew_join(rows, scale.select("_k", "rows", "_scale"), "_k", "rows", F.col("_i"), hot)
    rows = rows.withColumn("_x", _gain((F.col("_s") - F.col("_med")) / F.col("_scale"), _weight(F.col("_l"), weights)))
    items = rows.groupBy("_g", "_i").agg(F.sum("_x").alias("_x"), F.count(F.lit(1)).cast("int").alias("lanes"))
    total = scale.withColumn("_w", _weight(F.col("_l"), weights)).groupBy("_g").agg(F.sum("_w").alias("_w"), F.sum("rows").alias("rows")).withColumn("_gk", F.col("_g").cast("string")).drop("_g")
    return skew_join(items.withColumn("_gk", F.col("_g").cast("string")), total, "_gk", "rows", F.col("_i"), hot).drop("_gk")


def fuse_scores(df: DataFrame, group: str = "query_id", lane: str = "lane", item: str = "chunk_id", score: str = "score", weights: Mapping[str, float] | None = None, hot_rows: int = 200_000) -> DataFrame:
    """(group, item, fused, lanes): each item's combined score in its group, within (0, 1).

    Each lane of a group is standardised by its median and median absolute deviation, squashed by a logistic function and
    combined as a weighted geometric mean over all lanes present in the group (weights by lane name, 1 by default).

    - Null, NaN and infinite scores, null groups, lanes and items are left out; a lane with no other score is not present.
    - A row delivered again counts once; should the scores differ, the highest counts.
    - An item that a present lane lacks gets the neutral 0.5 there, the value of the lane's median.
    - A lane whose deviation is 0 falls back on the mean absolute deviation; if that is 0 too, every item gets 0.5 there.
    - Other columns are ignored. An empty table gives an empty result.

    Rows move once, by group. Groups over `hot_rows` rows are known beforehand from counts; they stay spread by item, and
    their medians are selected without gathering them.
    """
    weights = dict(weights or {})
    ok = F.col("_s").isNotNull() & ~F.isnan("_s") & (F.abs("_s") < F.lit(float("inf"))) & F.col("_g").isNotNull() & F.col("_l").isNotNull() & F.col("_i").isNotNull()
    rows = df.select(F.col(group).alias("_g"), F.col(lane).cast("string").alias("_l"), F.col(item).alias("_i"), F.col(score).cast("double").alias("_s")).filter(ok)
    hot = hot_threshold(rows.count(), hot_rows)
    busy = hot_keys(rows, "_g", hot)
    if busy is None:
        fused = _fuse_together(rows, weights)
    else:
        keys = F.broadcast(busy.select("_g"))
        fused = _fuse_together(rows.join(keys, "_g", "left_anti"), weights).unionByName(_fuse_spread(rows.join(keys, "_g", "left_semi"), weights, hot))
    return fused.select(F.col("_g").alias(group), F.col("_i").alias(item), F.exp(F.col("_x") / F.col("_w") + F.log(F.lit(0.5))).alias("fused"), "lanes")


def best_item(fused: DataFrame, group: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """(group, item): the leader of each group; the smallest item wins a tie."""
    lead = F.min_by(F.struct(F.col(item).alias("i")), F.struct((-F.col("fused")).alias("s"), F.col(item).alias("i")))
    return fused.groupBy(group).agg(lead.alias("_lead")).select(group, F.col("_lead.i").alias(item))
