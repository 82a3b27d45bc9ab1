"""Slowly changing dimensions as new snapshots: types 0, 1, 2, 3 and 6, and inferred members.

A snapshot is never changed in place: each function returns the next one, for the caller to write as a new version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemart.functions.columns import UNKNOWN_KEY, hash_diff
from lakemart.operators.numbering import numbered

OPEN_END = "9999-12-31"
VERSION_COLUMNS = ("effective_date", "expiration_date", "is_current", "version_number", "is_inferred", "hash_diff")


def with_new_keys(rows: DataFrame, key: str, order: Sequence[str], start: DataFrame) -> DataFrame:
    """Rows whose key is null get the numbers after the largest key of `start`. Only new members are numbered."""
    old = rows.where(F.col(key).isNotNull())
    top = start.agg(F.coalesce(F.max(F.when(F.col(key) > 0, F.col(key))), F.lit(0)).alias("_top"))
    new = numbered(rows.where(F.col(key).isNull()), order, "_number").crossJoin(F.broadcast(top))  # one row
    return old.unionByName(new.withColumn(key, (F.col("_top") + F.col("_number")).cast(start.schema[key].dataType)).drop("_top", "_number"))


def scd1_merge(dim: DataFrame, source: DataFrame, business_key: str, attributes: Sequence[str], key: str) -> DataFrame:
    """Attributes of the source overwrite; members that it doesn't have stay."""
    s = source.select(F.col(business_key).alias("_bk"), F.struct(*attributes).alias("_new"))
    both = dim.join(s, dim[business_key] == s["_bk"], "full")
    taken = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in attributes}
    rows = both.select(*[taken.get(c, F.coalesce(c, "_bk") if c == business_key else F.col(c)).alias(c) for c in dim.columns])
    return with_new_keys(rows, key, [business_key], dim)


def scd3_merge(dim: DataFrame, source: DataFrame, business_key: str, tracked: str, attributes: Sequence[str], key: str, load_date: str) -> DataFrame:
    """Where the tracked attribute [current_]<x> differs, its value moves to previous_<x>, and <x>_changed says when."""
    stem = tracked.removeprefix("current_")
    previous, changed = f"previous_{stem}", f"{stem}_changed"
    s = source.select(F.col(business_key).alias("_bk"), F.struct(tracked, *attributes).alias("_new"))
    both = dim.join(s, dim[business_key] == s["_bk"], "full")
    moved = F.col(key).isNotNull() & F.col("_new").isNotNull() & ~F.col(f"_new.{tracked}").eqNullSafe(F.col(tracked))
    given = F.col("_new").isNotNull()
    made = {
        business_key: F.coalesce(business_key, "_bk"),
        previous: F.when(moved, F.col(tracked)).otherwise(F.col(previous)),
        changed: F.when(moved, F.lit(load_date).cast("date")).otherwise(F.col(changed)),
    } | {c: F.when(given, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in (tracked, *attributes)}
    return with_new_keys(both.select(*[made.get(c, F.col(c)).alias(c) for c in dim.columns]), key, [business_key], dim)


def scd2_merge(dim: DataFrame, source: DataFrame, business_key: str, key: str, type2: Sequence[str], load_date: str, type1: Sequence[str] = (), type0: dict[str, str] | None = None, type6: dict[str, str] | None = None) -> DataFrame:
    """The next snapshot of a versioned dimension.

    Each current row takes one branch: an inferred member is completed in place; a version that began on load_date or
    later is corrected in place; one whose hash of `type2` differs expires the day before and gets a successor; `type1`
    columns are overwritten on the current row alone. type0 {column: source column} is set with the first real version
    and carried on. type6 {column: source column} has the current value on all versions. Unknown keys become version 1;
    members that the source lacks stay. The same source again changes nothing.
    """
    rows = with_new_keys(scd2_branches(dim.where("is_current"), source, business_key, key, type2, load_date, type1, type0), key, [business_key], dim)
    out = dim.where("not is_current").unionByName(rows)
    for c, origin in (type6 or {}).items():
        out = type6_sync(out, business_key, origin, c)
    return out


def scd2_branches(dim: DataFrame, source: DataFrame, business_key: str, key: str, type2: Sequence[str], load_date: str, type1: Sequence[str] = (), type0: dict[str, str] | None = None) -> DataFrame:
    """What becomes of a dimension's current rows, dim: each with its branch taken, and those that expire beside their
    successors. New versions have no key yet. Closed versions aren't needed, and aren't there."""
    type0 = type0 or {}
    day = F.lit(load_date).cast("date")
    s = source.withColumn("_hash", hash_diff(type2)).select(F.col(business_key).alias("_bk"), "_hash", F.struct(*source.columns).alias("_new"))
    both = dim.join(s, dim[business_key] == s["_bk"], "full")
    branch = (
        F.when(F.col("_bk").isNull(), "absent").when(F.col(key).isNull(), "new").when(F.col("is_inferred"), "completed")
        .when(F.col("hash_diff").eqNullSafe(F.col("_hash")), "same").when(F.col("effective_date") >= day, "corrected").otherwise("changed")
    )
    told = both.withColumn("_branch", branch)

    def row(is_new: Column, fresh: bool) -> Column:
        """The row after the branch; fresh: a version of its own."""
        given = set(source.columns)
        out = []
        for c in dim.columns:
            new, old = (F.col(f"_new.{c}") if c in given else None), F.col(c)
            if c == key:
                v = F.lit(None).cast(dim.schema[c].dataType) if fresh else old
            elif c == business_key:
                v = F.coalesce(old, F.col("_bk"))
            elif c in type0:
                v = F.when(F.col("_branch").isin("new", "completed"), F.col(f"_new.{type0[c]}")).otherwise(old)
            elif c == "hash_diff":
                v = F.when(is_new, F.col("_hash")).otherwise(old)
            elif c == "effective_date":
                v = day if fresh else old
            elif c == "expiration_date":
                v = F.lit(OPEN_END).cast("date") if fresh else old
            elif c == "is_current":
                v = F.lit(True)
            elif c == "version_number":
                v = F.coalesce(old, F.lit(0)) + 1 if fresh else old
            elif c == "is_inferred":
                v = F.when(is_new, F.lit(False)).otherwise(old)
            elif c in type1:
                v = F.when(F.col("_branch") != "absent", new).otherwise(old)
            elif new is not None:
                v = F.when(is_new, new).otherwise(old)
            else:
                v = old
            out.append(v.cast(dim.schema[c].dataType).alias(c))
        return F.struct(*out)

    in_place = row(F.col("_branch").isin("completed", "corrected"), False)
    successor = row(F.lit(True), True)
    ended = F.struct(*[
        {"expiration_date": F.date_sub(day, 1), "is_current": F.lit(False)}.get(c, F.col(c)).cast(dim.schema[c].dataType).alias(c) for c in dim.columns
    ])
    return told.select(F.explode(F.when(F.col("_branch") == "changed", F.array(ended, successor)).when(F.col("_branch") == "new", F.array(successor)).otherwise(F.array(in_place))).alias("_row")).select("_row.*")


def type6_sync(dim: DataFrame, business_key: str, source: str, target: str) -> DataFrame:
    """The current version's value on every version of its business key."""
    now = F.max(F.when(F.col("is_current"), F.col(source))).over(Window.partitionBy(business_key))
    return dim.withColumn(target, F.coalesce(now, F.col(target)).cast(dim.schema[target].dataType))


def first_versions(source: DataFrame, business_key: str, key: str, type2: Sequence[str], load_date: str, more: dict[str, Column] | None = None) -> DataFrame:
    """An initial snapshot: version 1 of every member."""
    rows = source.withColumns({
        "hash_diff": hash_diff(type2), "effective_date": F.lit(load_date).cast("date"), "expiration_date": F.lit(OPEN_END).cast("date"),
        "is_current": F.lit(True), "version_number": F.lit(1), "is_inferred": F.lit(False), **(more or {}),
    })
    return numbered(rows, (business_key,), key).withColumn(key, F.col(key).cast("int"))


def infer_members(facts: DataFrame, dim: DataFrame, business_key: str, key: str, defaults: dict[str, object], load_date: str) -> DataFrame:
    """dim with a skeleton for every business key that facts have and it doesn't, to be completed later."""
    new = facts.where(F.col(business_key).isNotNull()).select(business_key).distinct().join(dim.select(business_key), business_key, "left_anti")
    fixed = {
        "effective_date": F.lit(load_date).cast("date"), "expiration_date": F.lit(OPEN_END).cast("date"), "is_current": F.lit(True),
        "version_number": F.lit(1), "is_inferred": F.lit(True), "hash_diff": F.lit(""),
    }
    rows = new.select(*[F.col(c) if c == business_key else fixed.get(c, F.lit(defaults.get(c))).cast(dim.schema[c].dataType).alias(c) for c in dim.columns])
    return with_new_keys(dim.unionByName(rows), key, [business_key], dim)


def scd_history(dim: DataFrame, business_key: str, value: object) -> DataFrame:
    return dim.where(F.col(business_key) == value).orderBy("version_number")


def most_versioned(dim: DataFrame, business_key: str, n: int = 10) -> DataFrame:
    counts = dim.where(F.col("is_inferred") == F.lit(False)).groupBy(business_key).agg(F.count("*").alias("versions"))
    return counts.where("versions > 1").orderBy(F.desc("versions"), business_key).limit(n)


def mini_dimension(dim: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Type 4: the distinct combinations of fast-changing attributes, numbered."""
    return numbered(dim.select(*columns).distinct(), columns, key).withColumn(key, F.col(key).cast("int"))


def outrigger(dim: DataFrame, mini: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Type 5: the base dimension with the key of its current combination."""
    other = mini.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    return dim.join(other, same, "left").select(*dim.columns, F.coalesce("_key", F.lit(UNKNOWN_KEY)).alias(key))
