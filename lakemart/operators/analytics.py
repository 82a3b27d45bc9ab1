"""Aggregates, windows and top-n, by column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemart.functions.columns import CONDITIONS, severity_rank
from lakemart.operators.numbering import numbered

Names = Sequence[str]


def weighted(measure: str, weight: str) -> Column:
    """Sum of measure * weight over the sum of weight; null if that is 0. A null measure's weight still counts."""
    return F.sum(F.col(measure) * F.col(weight)).cast("double") / F.nullif(F.sum(weight), F.lit(0)).cast("double")


def weighted_avg(df: DataFrame, by: Names, measures: dict[str, str], weight: str, total: str, *more: Column) -> DataFrame:
    """measures is {column: name}; total names the sum of weights. The rule for all measures that are averages already."""
    return df.groupBy(*by).agg(F.sum(weight).alias(total), *[weighted(m, weight).alias(n) for m, n in measures.items()], *more)


def hourly(df: DataFrame, by: Names, heavy: Column, speed: str, occupancy: str, *more: Column) -> DataFrame:
    """Counts, average and 85th percentile of speed for each group; groups without a key are left out."""
    known = df.dropna(subset=[*by])
    return known.groupBy(*by).agg(
        F.count("*").alias("vehicle_count"), F.count_if(heavy).alias("heavy_vehicle_count"), F.round(F.avg(speed), 1).alias("avg_speed"),
        F.round(F.percentile_approx(speed, F.lit(0.85), F.lit(10000)), 1).alias("p85_speed"), F.round(F.avg(occupancy), 2).alias("avg_occupancy"), *more,
    )


def weather_hourly(df: DataFrame) -> DataFrame:
    """One row per day and hour: mean temperature and precipitation, least visibility, worst condition."""
    worst = F.element_at(F.array(*[F.lit(c) for c in CONDITIONS]), F.max(severity_rank(F.col("condition_code"))))
    return df.groupBy(F.to_date("observed_ts").alias("event_date"), F.hour("observed_ts").alias("hour_of_day")).agg(
        F.avg("temperature_c").alias("avg_temp_c"), F.avg("precipitation_mm").alias("precipitation_mm"), F.min("visibility_m").alias("visibility_m"), worst.alias("condition_code")
    )


def percentiles(df: DataFrame, by: Names, column: str, named: dict[str, float], *more: Column) -> DataFrame:
    """Exact continuous percentiles by group."""
    return df.where(F.col(column).isNotNull()).groupBy(*by).agg(*[F.percentile(column, F.lit(p)).alias(n) for n, p in named.items()], *more)


def peak(value: str, at: str) -> Column:
    """The `at` of the greatest value, the smallest of several."""
    return F.max_by(at, F.struct(F.col(value), -F.col(at)))


def distinct_where(column: Column, condition: Column) -> Column:
    return F.count_distinct(F.when(condition, column))


def hours_seen(hour: Column, condition: Column | None = None) -> Column:
    """The hours of day (0 to 23) that occur, where a condition holds, as a mask of bits. Masks of several loads merge by all_hours."""
    met = hour.between(0, 23) if condition is None else hour.between(0, 23) & condition
    return F.coalesce(F.bit_or(F.when(met, F.call_function("shiftleft", F.lit(1), hour.cast("int")))), F.lit(0))


def all_hours(mask: str) -> Column:
    return F.bit_or(mask)


def hours_in(mask: Column) -> Column:
    return F.bit_count(mask)


#: Size of a quantile sketch, and how far a quantile's rank may be off, as a share of the values: twice what a sketch of this size keeps at 99 % confidence.
SKETCH_K = 800
SKETCH_ERROR = 0.01


def sketched(column: str, k: int = SKETCH_K) -> Column:
    """A mergeable sketch of a column's values, to be kept beside an hour's exact figures; null if there is no value."""
    return F.when(F.count(column) > 0, F.kll_sketch_agg_double(F.col(column).cast("double"), k))


def quantile_of_sketches(df: DataFrame, by: Names, sketch: str, named: dict[str, float], k: int = SKETCH_K) -> DataFrame:
    """Quantiles of any coarser grouping from sketches alone: what was counted once is merged, not read again."""
    merged = df.where(F.col(sketch).isNotNull()).groupBy(*by).agg(F.kll_merge_agg_double(sketch, k).alias("_sketch"))
    return merged.select(*by, F.kll_sketch_get_n_double("_sketch").alias("n_values"), *[F.kll_sketch_get_quantile_double("_sketch", F.lit(p)).alias(n) for n, p in named.items()])


def sketch_holds(df: DataFrame, by: Names, column: str, found: DataFrame, quantile: str, p: float, error: float = SKETCH_ERROR) -> DataFrame:
    """by, n_values and `within`: is the rank of the sketched quantile within `error` (and one value) of p, by the values themselves?"""
    rows = df.where(F.col(column).isNotNull()).join(found.select(*by, quantile), [*by])
    below, upto, n = F.count_if(F.col(column) < F.col(quantile)), F.count_if(F.col(column) <= F.col(quantile)), F.count("*")
    return rows.groupBy(*by).agg(n.alias("n_values"), ((below / n <= p + error + 1 / n) & (upto / n >= p - error - 1 / n)).alias("within"))


def share(condition: Column, of: Column | None = None) -> Column:
    """Percent of the rows, or of the non-null values of a column, that meet a condition."""
    whole = F.count("*") if of is None else F.count(of)
    return F.count_if(condition).cast("double") * 100 / F.nullif(whole, F.lit(0)).cast("double")


def listed(column: str, separator: str = ", ") -> Column:
    return F.array_join(F.sort_array(F.collect_set(column)), separator)


def rollup_report(df: DataFrame, columns: dict[str, str], *aggregates: Column) -> DataFrame:
    """columns is {column: label of its subtotal}; a null of the data is not taken for a subtotal."""
    names = [F.when(F.grouping(c) == 1, label).otherwise(F.col(c).cast("string")).alias(c) for c, label in columns.items()]
    made = df.rollup(*columns).agg(*aggregates, *[x.alias(f"_{c}") for x, c in zip(names, columns, strict=True)])
    return made.drop(*columns).withColumnsRenamed({f"_{c}": c for c in columns})


def cube_report(df: DataFrame, columns: dict[str, str], *aggregates: Column) -> DataFrame:
    made = df.cube(*columns).agg(*aggregates, *[F.when(F.grouping(c) == 1, label).otherwise(F.col(c).cast("string")).alias(f"_{c}") for c, label in columns.items()])
    return made.drop(*columns).withColumnsRenamed({f"_{c}": c for c in columns})


def grouping_sets_report(df: DataFrame, sets: Sequence[Names], columns: Names, labels: dict[int, str], *aggregates: Column) -> DataFrame:
    """Only the sets asked for, each row with its grouping id and that id's label."""
    made = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id(*columns).cast("int").alias("grouping_id"), *aggregates)
    return made.withColumn("level", F.coalesce(*[F.when(F.col("grouping_id") == k, v) for k, v in labels.items()]))


def pivoted(df: DataFrame, by: str, column: str, values: Names, amount: str) -> DataFrame:
    """Columns that don't depend on the day's data: one for each value, 0 where there is none."""
    return df.groupBy(by).pivot(column, [*values]).agg(F.sum(amount)).fillna(0)


def top_n_per_group(df: DataFrame, by: Names, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_with_ties(df: DataFrame, measure: str, n: int) -> DataFrame:
    """The n greatest and all that equal the last: the n-th value first, by a distributed top-n, then a filter."""
    least = df.where(F.col(measure).isNotNull()).select(measure).orderBy(F.desc(measure)).limit(n).agg(F.min(measure).alias("_least"))
    return df.crossJoin(F.broadcast(least)).where(F.col(measure) >= F.col("_least")).drop("_least")  # one row


def top_percent(df: DataFrame, order: Sequence[Column], percent: float) -> DataFrame:
    """The first rows of a total order, rounded up to whole rows: rows are numbered by ranges and cut at the last number."""
    placed = numbered(df, order, "_number")
    most = placed.agg(F.ceil(F.count("*") * percent / 100).alias("_most"))
    return placed.crossJoin(F.broadcast(most)).where(F.col("_number") <= F.col("_most")).drop("_number", "_most")  # one row


def nested_top_n(df: DataFrame, outer: str, measure: str, n: int, order: Sequence[Column], m: int) -> DataFrame:
    """The m first rows of each of the n outer values with the greatest sums."""
    best = df.groupBy(outer).agg(F.sum(measure).alias("outer_total")).orderBy(F.desc("outer_total"), outer).limit(n)
    return top_n_per_group(df.join(F.broadcast(best), outer), (outer,), order, m)  # best has n rows


def rank_both(df: DataFrame, measure: str) -> DataFrame:
    """Ranks with and without gaps over a table that is already aggregated."""
    w = Window.orderBy(F.desc(measure))
    return df.withColumns({"rank_with_gaps": F.rank().over(w), "rank_no_gaps": F.dense_rank().over(w)})


def quantile_bucket(df: DataFrame, order: Sequence[Column], n: int, name: str = "bucket") -> DataFrame:
    """n buckets of a total order, 1 first, whose sizes differ by one at most, larger ones first."""
    placed = numbered(df, order, "_number")
    rows = placed.agg(F.count("*").alias("_rows"))
    small, extra, at = F.floor(F.col("_rows") / n), F.col("_rows") % n, F.col("_number") - 1
    large = extra * (small + 1)
    bucket = F.when(at < large, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - large) / F.greatest(small, F.lit(1))))
    return placed.crossJoin(F.broadcast(rows)).withColumn(name, (bucket + 1).cast("int")).drop("_number", "_rows")  # one row


def running_share(df: DataFrame, by: Names, order: Names, column: str) -> DataFrame:
    whole = Window.partitionBy(*by)
    running = F.sum(column).over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"running": running, "pct_of_total": running.cast("double") * 100 / F.nullif(F.sum(column).over(whole), F.lit(0)).cast("double")})


def moving_avg(df: DataFrame, by: Names, order: Names, column: str, before: int, after: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-before, after)
    return df.withColumn("moving_avg", F.sum(column).over(w).cast("double") / F.count(column).over(w))


def pct_change(df: DataFrame, by: Names, order: Names, column: str) -> DataFrame:
    before = F.lag(column).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumns({"previous": before, "pct_change": (F.col(column) - before).cast("double") * 100 / F.nullif(before, F.lit(0)).cast("double")})


def gap_to_next(df: DataFrame, by: Names, ts: str, tie: str) -> DataFrame:
    """The next row's time in the group, and the minutes until then."""
    from lakemart.functions.columns import minute_lag

    after = F.lead(ts).over(Window.partitionBy(*by).orderBy(ts, tie))
    return df.withColumns({"next_ts": after, "minutes_to_next": minute_lag(F.col(ts), after)})


def first_flagged(df: DataFrame, by: Names, flag: Column, value: str, name: str) -> DataFrame:
    """Per group, the least value where the flag holds; groups where it never does are left out."""
    return df.groupBy(*by).agg(F.min(F.when(flag, F.col(value))).alias(name)).where(F.col(name).isNotNull())


def partition_baseline(df: DataFrame, by: Names, when: Column, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.max(F.when(when, F.col(column))).over(Window.partitionBy(*by)))


def latest_per_key(df: DataFrame, keys: Names, order: Sequence[Column]) -> DataFrame:
    return top_n_per_group(df, keys, order, 1, "_rank").drop("_rank")


def busiest_with_gaps(fact: DataFrame, day: str, entity: str, slot: str, count: str) -> DataFrame:
    """On the latest day, all slots of the busiest entity that still has empty ones."""
    last = fact.join(F.broadcast(fact.agg(F.max(day).alias(day))), day)  # one row
    pick = last.groupBy(entity).agg(F.sum(count).alias("_n"), F.count_if(F.col(count) == 0).alias("_empty")).where("_empty > 0").orderBy(F.desc("_n"), entity).limit(1)
    return last.join(F.broadcast(pick.select(entity)), entity).select(entity, day, slot, count)
