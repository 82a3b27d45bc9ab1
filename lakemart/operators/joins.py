"""Joins: lookups with an unknown member, versions valid at a time, latest-before, first child, spines, gaps and overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemart.functions.columns import UNKNOWN_KEY
from lakemart.sources.scratch import discard, written


def lookup_key(fact: DataFrame, dim: DataFrame, on: dict[str, str], key: str, unknown: int = UNKNOWN_KEY) -> DataFrame:
    """fact with the dimension's key; on is fact column -> dimension column. What isn't found gets the unknown member."""
    small = dim.select(F.col(key).alias("_key"), *[F.col(d).alias(f"_{d}") for d in on.values()])
    same = [fact[f] == small[f"_{d}"] for f, d in on.items()]
    return fact.join(small, same, "left").withColumn(key, F.coalesce("_key", F.lit(unknown))).drop("_key", *[f"_{d}" for d in on.values()])


def star_join(fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Inner joins on the key that each dimension shares with the fact."""
    for key, dim in dims.items():
        fact = fact.join(dim, key)
    return fact


def role_join(fact: DataFrame, dim: DataFrame, foreign: str, key: str, prefix: str, columns: Sequence[str]) -> DataFrame:
    """The same dimension in another role: its columns get the prefix."""
    role = dim.select(F.col(key).alias(foreign), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return fact.join(role, foreign)


def pit_join(fact: DataFrame, dim: DataFrame, on: dict[str, str], at: str, effective: str = "effective_date", expires: str = "expiration_date") -> DataFrame:
    """Left join to the version valid on the fact's date: equal business keys, the interval as a residual."""
    valid = [fact[f] == dim[d] for f, d in on.items()] + [fact[at] >= dim[effective], fact[at] <= dim[expires]]
    return fact.join(dim, valid, "left").drop(*[dim[d] for f, d in on.items() if f == d])


#: A key with more rows than this, of both sides together, is cut into ranges of time.
CROWDED = 1 << 22


def asof_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, by: Sequence[str], take: Sequence[str], tie: Sequence[str | Column] = (), crowded: int | None = CROWDED) -> DataFrame:
    """left with the columns `take` (prefixed right_) of the latest right row of its key at or before its time.

    Of right rows at the same time the one with the smallest `tie` counts, a null being the largest. Rows are unioned, and
    a running last does the rest, so no pair is made that isn't kept. Rows with a null key or time match nothing, and
    left ones of that kind stay out of the shuffle. Keys are counted first: those with more than `crowded` rows are dealt
    to many tasks (_met_in_ranges), so that no task has more rows of a key; what
    is written for that goes with the caller's scratch.cleared. With None nothing is counted.
    """
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    ties = F.struct(*[(F.col(t) if isinstance(t, str) else t).alias(f"t{k}") for k, t in enumerate(tie)] or [F.lit(0).alias("t0")])
    rights = right.where(known & F.col(right_ts).isNotNull()).select(
        *by, F.col(right_ts).alias("_ts"), ties.alias("_tie"), F.struct(*[F.col(c) for c in take]).alias("_right"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct("*").alias("x")).schema["x"].dataType).alias("_left")
    )
    nothing = lambda c: F.lit(None).cast(rights.schema[c].dataType).alias(c)
    lefts = left.where(known & F.col(left_ts).isNotNull()).select(*by, F.col(left_ts).alias("_ts"), nothing("_tie"), nothing("_right"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    order = ["_ts", "_side", *[F.desc_nulls_first(f"_tie.t{k}") for k in range(max(1, len(tie)))]]  # the smallest tie comes last, and is met last
    both = rights.unionByName(lefts)
    busy = None
    if crowded is not None:
        busy = written(both.select(*by).groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") > crowded).select(*by), "asof-busy")
        if busy.isEmpty():
            discard(busy)
            busy = None
    if busy is None:
        met = _running_last(both, by, order)
    else:
        met = _running_last(both.join(busy, [*by], "left_anti"), by, order).unionByName(_met_in_ranges(both.join(busy, [*by], "left_semi"), by, order))
    rest = left.where(~(known & F.col(left_ts).isNotNull())).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(f"right_{c}") for c in take])
    return met.select("_left.*", *[F.col(f"_met.{c}").alias(f"right_{c}") for c in take]).unionByName(rest)


def _running_last(both: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """(_left, _met) of the left rows: the last right row of the key until then."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_met", F.last("_right", ignorenulls=True).over(w)).where("_side = 1").select("_left", "_met")


def _met_in_ranges(both: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """As _running_last, where a key may have more rows than a task can take.

    Rows are range-partitioned by key and order, and written, so that each keeps the range it is in. A running last goes
    through a key's rows of a range; what it ends with, a row a key and range, is carried on to the key's later ranges.
    """
    dealt = written(both.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "asof")
    inside = Window.partitionBy(*by, "_range").orderBy(*order)
    held = dealt.withColumns({"_held": F.last("_right", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.lead(F.lit(1)).over(inside)})
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.where("_after is null").select(*by, "_range", F.last("_held", ignorenulls=True).over(before).alias("_carried"))
    return held.where("_side = 1").join(carried, [*by, "_range"]).select("_left", F.coalesce("_held", "_carried").alias("_met"))


def asof_join_unkeyed(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, take: Sequence[str], tie: Sequence[str | Column], buckets: int = 200) -> DataFrame:
    """As asof_join, where nothing but time joins the sides.

    right is reduced to one row per time and left to its distinct times; both are cut into buckets of time at quantiles,
    a running last goes through each, and the last row of a bucket is carried on to those after it. left then gets the
    row of its time by an equi-join, so no task has more than a bucket of either side's times.
    """
    ties = [x for t in tie for c in [F.col(t) if isinstance(t, str) else t] for x in (c.isNull(), c)]
    best = right.where(F.col(right_ts).isNotNull()).groupBy(F.col(right_ts).alias("_ts")).agg(F.min_by(F.struct(*take), F.struct(*ties or [F.lit(0)])).alias("_row"))
    asked = left.where(F.col(left_ts).isNotNull()).select(F.col(left_ts).alias("_ts")).distinct()
    times = best.unionByName(asked.withColumn("_row", F.lit(None).cast(best.schema["_row"].dataType))).groupBy("_ts").agg(F.max("_row").alias("_row"))
    micros = F.unix_micros(F.col("_ts").cast("timestamp"))
    times = times.withColumn("_us", micros)
    at = [k / buckets for k in range(1, buckets)]
    bounds = sorted(set(times.select(F.col("_us").cast("double").alias("u")).approxQuantile("u", at, 0.2 / buckets))) if at else []  # fewer than `buckets` numbers
    cut = F.array(*[F.lit(int(b)) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    dealt = times.withColumn("_bucket", F.size(F.filter(cut, lambda b: b <= F.col("_us"))))
    held = dealt.withColumn("_held", F.last("_row", ignorenulls=True).over(Window.partitionBy("_bucket").orderBy("_us").rowsBetween(Window.unboundedPreceding, 0)))
    last = dealt.where("_row is not null").groupBy("_bucket").agg(F.max_by("_row", "_us").alias("_last"))
    every = left.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("_bucket")).join(last, "_bucket", "left")
    carried = every.select("_bucket", F.last("_last", ignorenulls=True).over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))  # a row a bucket
    known = held.join(F.broadcast(carried), "_bucket").select("_ts", F.coalesce("_held", "_carried").alias("_row"))
    return left.join(known, F.col(left_ts) == F.col("_ts"), "left").select(*[left[c] for c in left.columns], *[F.col(f"_row.{c}").alias(f"right_{c}") for c in take])


def first_per_parent(parent: DataFrame, child: DataFrame, key: str, order: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Each parent with its first child by order; parents without one stay. Minima per key, so no group is gathered."""
    first = child.groupBy(key).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("_first"))
    return parent.join(first, key, "left").select(*[parent[c] for c in parent.columns], *[F.col(f"_first.{c}").alias(c) for c in take])


def dense_spine(members: DataFrame, slots: Sequence[int], slot: str, measured: DataFrame, on: Sequence[str], zero: Sequence[str]) -> DataFrame:
    """Every member in every slot, with what was measured there; counts are 0 where nothing was."""
    spine = members.withColumn(slot, F.explode(F.array(*[F.lit(s) for s in slots])))
    return spine.join(measured, [*on], "left").fillna(0, [*zero])


def cross_members(*lists: DataFrame) -> DataFrame:
    """All combinations of some short lists of names."""
    out, *rest = lists
    for x in rest:
        out = out.crossJoin(x)
    return out


def missing_members(source: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    return source.where(F.col(key).isNotNull()).select(key).distinct().join(dim.select(key), key, "left_anti")


def orphans(fact: DataFrame, dim: DataFrame, foreign: str, key: str | None = None) -> DataFrame:
    return fact.join(dim.select(F.col(key or foreign).alias(foreign)), foreign, "left_anti")


def filter_exists(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def overlapping_intervals(dim: DataFrame, business_key: str, key: str, effective: str = "effective_date", expires: str = "expiration_date") -> DataFrame:
    """Pairs of versions of one business key that are valid on some same day.

    A sweep over each key's days counts the versions begun until then: the place of a version is that count where it
    begins, and it meets those begun after it up to the count where it ends. Only these pairs are made, so a key of many
    versions that keep apart makes none. Rows with a null key or date meet nothing; versions that end before they begin
    meet what they begin and end within, as the two inequalities have it. Repeated rows pair as often as they are there.
    """
    v = dim.select(F.col(business_key).alias("_bk"), F.col(key).alias("_key"), F.col(effective).alias("_from"), F.col(expires).alias("_to")).dropna()
    versions = v.repartition("_bk").groupBy("_bk", "_key", "_from", "_to").agg(F.count("*").alias("_n"))
    days = versions.withColumn("_end", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_day", F.when(F.col("_end") == 0, F.col("_from")).otherwise(F.col("_to")))
    begun = F.sum(1 - F.col("_end")).over(Window.partitionBy("_bk").orderBy("_day", "_end", "_key", "_from", "_to").rowsBetween(Window.unboundedPreceding, 0))
    at = days.withColumn("_begun", begun).groupBy("_bk", "_key", "_from", "_to", "_n").agg(
        F.max(F.when(F.col("_end") == 0, F.col("_begun"))).alias("_place"), F.max(F.when(F.col("_end") == 1, F.col("_begun"))).alias("_last")
    )
    meets = at.where("_last > _place").withColumn("_other", F.explode(F.sequence(F.col("_place") + 1, F.col("_last"))))
    others = at.select("_bk", F.col("_place").alias("_other"), F.col("_key").alias("_key2"), F.col("_to").alias("_to2"), F.col("_n").alias("_n2"))
    pairs = meets.join(others, ["_bk", "_other"]).where((F.col("_from") <= F.col("_to2")) & (F.col("_key") != F.col("_key2")))
    copies = F.explode(F.sequence(F.lit(1), F.col("_n") * F.col("_n2")))
    return pairs.select(F.col("_bk").alias(business_key), F.least("_key", "_key2").alias("first_key"), F.greatest("_key", "_key2").alias("second_key"), copies.alias("_copy")).drop("_copy")


def stamp_counts(snapshot: DataFrame, events: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    counts = events.groupBy(*on).agg(F.count("*").alias(name))
    return snapshot.drop(name).join(counts, [*on], "left").fillna(0, [name])


def denormalized(base: DataFrame, *lookups: tuple[DataFrame, str, str, dict[str, str]]) -> DataFrame:
    """base with columns of other tables: (table, foreign key, its key, {its column: new name}), in order; a table may come twice."""
    for table, foreign, key, names in lookups:
        base = base.join(table.select(F.col(key).alias(foreign), *[F.col(c).alias(n) for c, n in names.items()]), foreign)
    return base


def full_counts(one: DataFrame, two: DataFrame, on: str) -> DataFrame:
    """Full outer join of two tables of counts, 0 where one has no row."""
    return one.join(two, on, "full").fillna(0)


def with_scalar(df: DataFrame, value: Column, name: str, of: DataFrame | None = None) -> DataFrame:
    """df with an aggregate over df (or another table) on every row."""
    return df.crossJoin(F.broadcast((of if of is not None else df).agg(value.alias(name))))  # one row
