"""Generated members (calendar, minutes, weather bands), gaps in a calendar, and walks over a graph of edges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.functions import columns as C
from lakemart.sources.scratch import written

#: National holidays of the sample calendar, by month and day.
HOLIDAYS = {
    "0101": "New Year's Day", "0524": "St. Cyril and Methodius", "0802": "Republic Day (Ilinden)",
    "0908": "Independence Day", "1011": "Uprising Day", "1223": "Referendum Day",
}
#: Conditions with their names, and those that are severe in themselves.
CONDITION_NAMES = {"DRY": "Dry", "RAIN": "Rain", "SNOW": "Snow", "FOG": "Fog", "ICE": "Ice", "STORM": "Storm"}
SEVERE = ("SNOW", "FOG", "ICE", "STORM")


def days(spark: SparkSession, first: str, last: str, name: str = "full_date") -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(name))


def build_dim_date(spark: SparkSession, first: str = "2020-01-01", last: str = "2029-12-31", holidays: dict[str, str] = HOLIDAYS) -> DataFrame:
    d, weekday = F.col("full_date"), F.weekday("full_date") + 1
    season = F.element_at(F.array(*[F.lit(s) for s in ("Winter", "Spring", "Summer", "Autumn")]), (F.floor(F.month(d) % 12 / 3) + 1).cast("int"))
    named = F.coalesce(*[F.when(F.date_format(d, "MMdd") == k, v) for k, v in holidays.items()], F.lit(None).cast("string"))
    return days(spark, first, last).select(
        C.date_key(d).alias("date_key"), "full_date", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month_number"), F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "yyyy-MM").alias("year_month"), F.weekofyear(d).alias("week_of_year"), F.dayofmonth(d).alias("day_of_month"), weekday.alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"),
        (weekday > 5).cast("int").alias("is_weekend"), named.isNotNull().cast("int").alias("is_holiday"), named.alias("holiday_name"), season.alias("season"),
    )


def build_dim_time(spark: SparkSession) -> DataFrame:
    """One row a minute, with the rush of 07:00 to 08:59 and 16:00 to 18:29."""
    m, hour = F.col("id").cast("int"), F.floor(F.col("id") / 60).cast("int")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    part = C.band(hour, (6, 10, 14, 18, 22), ("Night", "Morning", "Midday", "Afternoon", "Evening", "Night"), "")
    return spark.range(1440).select(
        m.alias("time_key"), F.concat(two(hour), F.lit(":"), two(m % 60)).alias("time_bk"), hour.alias("hour"), (m % 60).alias("minute"),
        F.concat(two(hour), F.lit(":00 - "), two((hour + 1) % 24), F.lit(":00")).alias("hour_band"), part.alias("day_part"),
        (m.between(420, 539) | m.between(960, 1109)).cast("int").alias("is_rush_hour"),
    )


def build_dim_weather(spark: SparkSession) -> DataFrame:
    """All combinations of condition and bands, and one row per condition whose bands are unknown."""
    each = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    named = F.array(*[F.struct(F.lit(k).alias("condition_code"), F.lit(v).alias("condition_name")) for k, v in CONDITION_NAMES.items()])
    conditions = spark.range(0, 1, 1, 1).select(F.inline(named))  # one partition: a join of small frames would multiply theirs
    bands = {"temp_band": C.TEMPERATURE_NAMES, "precip_band": ("None", *C.PRECIPITATION_NAMES), "visibility_band": C.VISIBILITY_NAMES}
    known = conditions
    for name, values in bands.items():
        known = known.withColumn(name, each(values))
    unknown = conditions.withColumns({name: F.lit("Unknown") for name in bands})
    severe = F.col("condition_code").isin(*SEVERE) | (F.col("precip_band") == "Heavy") | (F.col("visibility_band") == "Poor")
    return known.unionByName(unknown).withColumn("is_severe", severe.cast("int"))


def with_unknown_member(dim: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """dim with the member -1, added once; columns without a default are null."""
    row = dim.sparkSession.range(1).select(*[F.lit(C.UNKNOWN_KEY if f.name == key else defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in dim.schema])
    return dim.unionByName(row.join(dim.select(key), key, "left_anti").select(dim.columns))


def date_gaps(facts: DataFrame, day: str, batches: DataFrame, batch_day: str) -> DataFrame:
    """Days without facts between the first and the last batch that has some, each with a verdict; if none, one row says so."""
    have = facts.select(F.to_date(day).alias("day")).distinct()
    loaded = batches.select(F.to_date(batch_day).alias("day")).distinct().join(have, "day", "left_semi")
    span = loaded.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo is not null")
    gaps = span.select(F.explode(F.sequence("lo", "hi")).alias("day")).join(have, "day", "left_anti").select("day", F.lit("MISSING").alias("verdict"))
    none = gaps.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("date").alias("day"), F.lit("NO GAPS").alias("verdict"))
    return gaps.unionByName(none)


def reachable(edges: DataFrame, start: int, max_hops: int, edge: str = "edge") -> DataFrame:
    """Every edge (edge, src, dst) met on paths of at most max_hops edges from a node that repeat none: one row (hop, edge, path) per path.

    Each hop is one join with the edges; path is the array of edges so far.
    """
    step = edges.select(F.col(edge), F.col("src"), F.col("dst").alias("next"))
    here = step.where(F.col("src") == start).select(F.lit(1).alias("hop"), edge, F.col("next").alias("at"), F.array(edge).alias("path"))
    out = here
    for _ in range(max_hops - 1):
        last = here.select("hop", F.col("at").alias("src"), "path")
        here = last.join(step, "src").where(~F.array_contains("path", F.col(edge))).select((F.col("hop") + 1).alias("hop"), edge, F.col("next").alias("at"), F.array_append("path", F.col(edge)).alias("path"))
        out = out.unionByName(here)
    return out.drop("at")


#: So many unfinished routes a hop are followed first, to find routes that others must then be shorter than.
BEAM = 1000


def still_to_go(edges: DataFrame, end: int, max_edges: int) -> DataFrame:
    """(at, hops, rest): the length of the shortest walk to `end` from a node with at most `hops` edges, for hops up to max_edges; no row if there is none."""
    step = edges.select(F.col("src"), F.col("dst").alias("at"), "length")
    exact = edges.sparkSession.range(1).select(F.lit(end).cast(edges.schema["dst"].dataType).alias("at"), F.lit(0).cast(edges.schema["length"].dataType).alias("rest"))
    walks = exact.withColumn("edges", F.lit(0))
    for k in range(1, max_edges):
        exact = step.join(exact, "at").groupBy(F.col("src").alias("at")).agg(F.min(F.col("length") + F.col("rest")).alias("rest"))
        walks = walks.unionByName(exact.withColumn("edges", F.lit(k)))
    within = walks.withColumn("hops", F.explode(F.sequence(F.col("edges"), F.lit(max_edges - 1))))
    return within.groupBy("at", "hops").agg(F.min("rest").alias("rest"))


def routes(edges: DataFrame, start: int, end: int, max_edges: int, k: int, beam: int = BEAM) -> DataFrame:
    """The k shortest routes of up to max_edges edges (src, dst, length) between two nodes, without a repeated node; none goes on from the end.

    The shortest walks to the end within the edges left bound each unfinished route from below; one that can't reach the
    end so is not followed. The `beam` most promising of each hop are followed first: the k-th route so found bounds the
    length from above, and all others are followed while they can still be as short. Whatever the beam, the routes are the
    same. Edges without a node or a length are none.
    """
    edges = edges.dropna(subset=["src", "dst", "length"])
    bounds = written(still_to_go(edges, end, max_edges), "routes")
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("next"), F.col("length").alias("more"))
    first = edges.where(F.col("src") == start).select(F.col("dst").alias("at"), F.lit(1).alias("hops"), F.array("src", "dst").alias("path"), "length")

    def hopeful(here: DataFrame, hops: int) -> DataFrame:
        left = bounds.where(F.col("hops") == max_edges - hops).select("at", "rest")
        return here.join(left, "at").withColumn("least", F.col("length") + F.col("rest"))

    def walked(keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        here = out = keep(hopeful(first, 1))
        for hops in range(2, max_edges + 1):
            on = here.where(F.col("at") != end).join(step, "at").where(~F.array_contains("path", F.col("next")))
            on = on.select(F.col("next").alias("at"), (F.col("hops") + 1).alias("hops"), F.array_append("path", F.col("next")).alias("path"), (F.col("length") + F.col("more")).alias("length"))
            here = keep(hopeful(on, hops))
            out = out.unionByName(here)
        return out.where(F.col("at") == end)

    told = walked(lambda here: here.orderBy("least", "path").limit(beam)).select("length").orderBy("length").limit(k).agg(F.count("*").alias("n"), F.max("length").alias("longest")).first()
    found = walked((lambda here: here.where(F.col("least") <= told.longest)) if told.n == k else lambda here: here)
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("route"), "hops", "length").orderBy("length", "hops", "route").limit(k)
