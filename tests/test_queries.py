"""Every registered query that has SQL gives the rows that DuckDB gives."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lakemart.plans import bindings, extracts, lake, samples, warehouse

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if v != v else float(f"{float(v):.9g}")
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query(spark, duck, name):
    df = bindings.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name in bindings.ORACLES:
        rel = duck.execute(bindings.ORACLES[name])
        names = [x[0] for x in rel.description]
        assert sorted(names) == columns
        assert got == sorted(([plain(r[names.index(c)]) for c in columns] for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() >= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["a1_weather_hourly", "d3_weather_dedup", "s3_weather_json"])
def test_the_weather_needs_no_job_over_events(spark, duck, monkeypatch, name):
    monkeypatch.setattr(samples, "_made", {})
    monkeypatch.setattr(lake, "run_day", None)
    test_query(spark, duck, name)


@pytest.mark.parametrize("name", ["b1_date", "b2_hour", "b3_time_of_day", "b6_weather"])
def test_generated_dimensions_need_no_night(spark, duck, monkeypatch, name):
    monkeypatch.setattr(samples, "_made", {})
    monkeypatch.setattr(lake, "run_day", None)
    monkeypatch.setattr(warehouse, "run_nightly", None)
    test_query(spark, duck, name)


@pytest.mark.parametrize("name", ["f1_event_fact", "j5_weather_lookup"])
def test_the_event_fact_needs_no_incident_hour_or_check(spark, duck, monkeypatch, name):
    monkeypatch.setattr(samples, "_made", {})
    monkeypatch.setattr(warehouse, "run_nightly", None)
    monkeypatch.setitem(extracts.EXTRACTS, "incident", ("incident", None))
    test_query(spark, duck, name)
