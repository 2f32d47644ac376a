"""Joins and medians that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import cut

#: No more hot keys than this are ever broadcast: the threshold rises with the number of rows, to 2 million rows at 10^12.
MOST_HOT_KEYS = 500_000
#: Parts into which one round of exact selection divides a hot group.
SELECT_PARTS = 64


def hot_threshold(total_rows: int, least: int) -> int:
    """Rows from which a key counts as hot; at most MOST_HOT_KEYS keys can reach it."""
    return max(least, total_rows // MOST_HOT_KEYS + 1)


def hot_keys(df: DataFrame, key: str, hot: int) -> DataFrame | None:
    """(key, rows) of the keys with more than `hot` rows, at most MOST_HOT_KEYS; None where there are none.

    Counts are partial aggregates over the key column alone."""
    busy = cut(df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > hot))
    return None if busy.isEmpty() else busy


def skew_join(left: DataFrame, right: DataFrame, key: str, rows: str, spread_by: Column, hot: int, how: str = "inner") -> DataFrame:
    """Joins left to the one-row-per-key frame right, whose column `rows` counts the rows left has for the key.

    Hot keys (more than `hot` rows) meet a broadcast of their few rows on the spot; the others are shuffled, where rows of hot
    keys and of null keys are scattered by `spread_by` instead of piling up in one partition. Columns of right other than key
    and rows are added; they must not exist in left. A null key matches nothing (how="inner" drops the row, "left" keeps it).
    """
    value = [c for c in right.columns if c not in (key, rows)]
    busy = right.filter(F.col(rows) > hot).select(F.col(key).alias("_hot_key"), F.struct(*value).alias("_hot"))
    rest = right.filter(F.col(rows) <= hot).select(F.concat(F.lit("k"), F.col(key).cast("string")).alias("_cold_key"), F.struct(*value).alias("_cold"))
    out = left.join(F.broadcast(busy), left[key] == F.col("_hot_key"), "left").drop("_hot_key")
    scattered = F.concat(F.lit("s"), F.pmod(F.xxhash64(spread_by), F.lit(4096)).cast("string"))
    out = out.withColumn("_probe", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(scattered))
    out = out.join(rest, F.col("_probe") == F.col("_cold_key"), "left").withColumn("_got", F.coalesce("_hot", "_cold"))
    if how == "inner":
        out = out.filter(F.col("_got").isNotNull())
    return out.select(*left.columns, *[F.col(f"_got.{c}").alias(c) for c in value])


def exact_medians(df: DataFrame, key: str, value: str, hot: int, out: str = "median") -> DataFrame:
    """(key, rows, out): the exact median of each group; the mean of the middle two where their number is even.

    df is read several times and should be cut. Groups of up to `hot` rows are sorted in memory; larger ones are narrowed in
    rounds: approximate quantiles divide the group into SELECT_PARTS parts, exact counts tell which parts hold the middle ranks,
    and only their rows stay. A round reads rows without moving them; partial aggregates are all that is shuffled.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    busy = cut(counts.filter(F.col("rows") > hot))
    if busy.isEmpty():
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.percentile(value, F.lit(0.5)).alias(out))
    small = df.join(F.broadcast(busy.select(key)), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.percentile(value, F.lit(0.5)).alias(out))
    groups = busy.withColumn("_lo", F.expr("(rows - 1) div 2")).withColumn("_hi", F.expr("rows div 2"))
    found = _select(df.select(key, value), key, value, groups, hot)
    return small.unionByName(busy.join(found, key).select(key, "rows", F.col("_median").alias(out)))


def exact_ranks(df: DataFrame, key: str, value: str, share: float, hot: int, out: str = "value") -> DataFrame:
    """(key, rows, out): each group's value at position round(share * (rows - 1)) from 0, halves to even. See exact_medians."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    at = f"cast(bround({share}D * (rows - 1), 0) as bigint)"
    busy = cut(counts.filter(F.col("rows") > hot))
    small = df.join(F.broadcast(busy.select(key)), key, "left_anti").groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("_v"), F.count(F.lit(1)).alias("rows"))
    small = small.select(key, "rows", F.expr(f"_v[cast({at} as int)]").alias(out))
    if busy.isEmpty():
        return small
    found = _select(df.select(key, value), key, value, busy.withColumn("_lo", F.expr(at)).withColumn("_hi", F.expr(at)), hot)
    return small.unionByName(busy.join(found, key).select(key, "rows", F.col("_median").alias(out)))


def _select(df: DataFrame, key: str, value: str, groups: DataFrame, hot: int) -> DataFrame:
    """(key, _median) of the hot groups by ranks _lo and _hi, counted from 0."""
    done: list[DataFrame] = []
    current = df.join(F.broadcast(groups.select(key)), key)
    while True:
        steps = [i / SELECT_PARTS for i in range(1, SELECT_PARTS)]
        edges = current.groupBy(key).agg(F.percentile_approx(value, F.array(*map(F.lit, steps)), F.lit(10 * SELECT_PARTS)).alias("_edges"), F.min(value).alias("_least"), F.max(value).alias("_most"))
        edges = cut(edges.withColumn("_edges", F.array_distinct("_edges")))
        # an edge that is a value opens a part of its own, so heavy ties end a search instead of repeating it
        part = F.expr(f"2 * size(filter(_edges, e -> e < {value})) + if(array_contains(_edges, {value}), 1, 0)")
        placed = current.join(F.broadcast(edges), key).withColumn("_part", part)
        table = placed.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"))
        shape = table.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_part", "_n", "_min", "_max"))).alias("_t")).join(F.broadcast(groups.select(key, "_lo", "_hi")), key)
        walk = """aggregate(_t, struct(0L as seen, array(cast(null as struct<part:int,before:bigint,n:bigint,lo:double,hi:double>)) as kept),
            (a, x) -> struct(a.seen + x._n as seen, if(a.seen + x._n > _lo and a.seen <= _hi,
                array_append(a.kept, struct(cast(x._part as int) as part, a.seen as before, x._n as n, cast(x._min as double) as lo, cast(x._max as double) as hi)), a.kept) as kept),
            a -> filter(a.kept, x -> x is not null))"""
        kept = cut(shape.select(key, "_lo", "_hi", F.expr(walk).alias("_kept")))
        flat = F.expr("forall(_kept, x -> x.lo = x.hi)")
        done.append(kept.filter(flat).select(key, F.expr("(element_at(_kept, 1).lo + element_at(_kept, -1).hi) / 2").alias("_median")))
        few = F.expr(f"aggregate(_kept, 0L, (a, x) -> a + x.n) <= {hot}")
        open_groups = kept.filter(~flat).select(key, (F.col("_lo") - F.expr("element_at(_kept, 1).before")).alias("_lo"), (F.col("_hi") - F.expr("element_at(_kept, 1).before")).alias("_hi"), F.expr("element_at(_kept, 1).lo").alias("_from"), F.expr("element_at(_kept, -1).hi").alias("_to"), few.alias("_few"))
        open_groups = cut(open_groups)
        left = current.join(F.broadcast(open_groups.select(key, "_from", "_to", "_few")), key).filter(F.col(value).between(F.col("_from"), F.col("_to")))
        last = left.filter("_few").groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("_v")).join(F.broadcast(open_groups), key)
        done.append(last.select(key, F.expr("(_v[cast(_lo as int)] + _v[cast(_hi as int)]) / 2").alias("_median")))
        groups = open_groups.filter(~F.col("_few")).select(key, "_lo", "_hi")
        if groups.isEmpty():
            break
        current = cut(left.filter(~F.col("_few")).select(key, value))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result
