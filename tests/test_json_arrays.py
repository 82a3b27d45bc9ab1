import json
import random

import pytest

from lakemart.sources import feeds, json_arrays

SCHEMA = "id long, name string, inner struct<a:string,b:array<struct<c:long>>>, _corrupt_record string"
BLOCKS = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def blocks(spark):
    was, cost = spark.conf.get(BLOCKS), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda n: spark.conf.set(BLOCKS, str(n))
    spark.conf.set(BLOCKS, was)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def objects(n, seed=1):
    rnd = random.Random(seed)
    odd = ['}', '{', '"', '\\', '\\"', '}, {', '[{"id": 1}]', 'é\u2028', '\n', '', 'x' * 700, '\\\\"}']
    pick = lambda: "".join(rnd.choice(odd) for _ in range(rnd.randint(0, 3)))
    return [{"id": k, "name": pick(), **({"inner": {"a": pick(), "b": [{"c": j} for j in range(rnd.randint(0, 3))]}} if k % 3 else {})} for k in range(n)]


def rows(df):
    return sorted((json.dumps(r.asDict(True), sort_keys=True) for r in df.collect()))


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [97, 1500, 1 << 20])
def test_sound_arrays_give_the_rows_of_the_multi_line_reader(spark, tmp_path, blocks, indent, size):
    for k, n in enumerate((120, 1, 0, 40)):
        (tmp_path / f"part_{k}.json").write_text(json.dumps(objects(n, k), indent=indent, ensure_ascii=k % 2 == 0), encoding="utf-8")
    (tmp_path / "part_8.json").write_text(json.dumps(objects(2)[1]))
    (tmp_path / "part_9.json").write_text("")
    want = rows(spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path)))
    blocks(size)
    got = json_arrays.read_json_array(spark, str(tmp_path), SCHEMA)
    assert rows(got.drop("_path")) == want and len(want) == 162
    assert got.select("_path").distinct().count() == 4


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path, blocks):
    one = {"event_id": "e", "camera_code": "c", "detection": {"timestamp": "2026-06-01T08:00:00", "segment_code": "s}", "direction": "NB", "vehicle_class": "CAR", "speed_kmh": 50.5, "plate_hash": 'q"{'}}
    (tmp_path / "camera_events_20260601.json").write_text(json.dumps([one | {"event_id": str(k)} for k in range(20_000)]))
    blocks(1 << 18)
    pieces = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert pieces.rdd.getNumPartitions() >= 8
    got = feeds.read_camera_json(spark, str(tmp_path))
    assert got.where("_corrupt_record is null and detection.plate_hash = 'q\"{' and ingest_date = date '2026-06-01'").select("event_id").distinct().count() == got.count() == 20_000


def test_files_of_one_block_are_gone_through_once(spark, tmp_path, blocks, monkeypatch):
    """The survey gets the blocks of files that were cut, and no others."""
    (tmp_path / "a.json").write_text(json.dumps(objects(5)))
    (tmp_path / "b.json").write_text(json.dumps(objects(400)))
    told = []
    real = json_arrays.beginnings
    monkeypatch.setattr(json_arrays, "beginnings", lambda survey: told.append({r["path"][-6:] for r in survey}) or real(survey))
    blocks(1 << 14)
    assert json_arrays.read_json_array(spark, str(tmp_path), SCHEMA).count() == 405 and told == [{"b.json"}]
    blocks(1 << 24)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 22))
    got = json_arrays.read_json_array(spark, str(tmp_path), SCHEMA)
    assert told[1:] == [set()] and got.where("_corrupt_record is null").count() == got.count() == 405


GOOD = '{"id": 1, "name": "a"}'
CASES = {
    "a value of another kind": (f'[{GOOD}, {{"id": "x", "name": "b"}}, {GOOD}]', [(1, "a", None)] * 2 + [(None, "b", '{"id": "x", "name": "b"}')]),
    "a lost colon": (f'[{GOOD}, {{"id" 2}}, {GOOD}]', [(1, "a", None)] * 2 + [(None, None, '{"id" 2}')]),
    "something else than an object": (f'[{GOOD}, 7, null, {GOOD}, {GOOD}]', [(1, "a", None)] * 2 + [(None, None, f"7, null, {GOOD}")]),
    "cut off in a record": (f'[{GOOD}, {{"id": 2, "na', [(1, "a", None), (None, None, '{"id": 2, "na')]),
    "cut off before the last brace": (f'[{GOOD}, {GOOD[:-1]}', [(1, "a", None), (None, None, GOOD[:-1])]),
    "cut off after a record": (f"[{GOOD}, {GOOD}", [(1, "a", None)] * 2),
    "a brace too many": (f"[{GOOD}, }}, {GOOD}]", [(1, "a", None)] * 2 + [(None, None, "}")]),
    "a lost quote": (f'[{GOOD}, {{"id": 2, "name": "b}}, {GOOD}]', [(1, "a", None), (None, None, f'{{"id": 2, "name": "b}}, {GOOD}]')]),
    "an end that is none": (f"[{GOOD}] more", [(1, "a", None), (None, None, "] more")]),
    "text": ("no json", [(None, None, "no json")]),
}


@pytest.mark.parametrize("size", [3, 20, 1 << 20])
@pytest.mark.parametrize("case", CASES)
def test_what_is_corrupt_costs_itself_alone(spark, tmp_path, blocks, case, size):
    text, want = CASES[case]
    (tmp_path / "x.json").write_text(text)
    (tmp_path / "y.json").write_text(f"[{GOOD}]")
    blocks(size)
    got = json_arrays.read_json_array(spark, str(tmp_path), SCHEMA).select("id", "name", "_corrupt_record").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([*want, (1, "a", None)], key=repr)


def test_a_lost_quote_is_kept_in_parts(spark, tmp_path, blocks):
    rest = ', '.join(['{"id": "} '] + [GOOD] * 150_000) + "]"
    (tmp_path / "x.json").write_text("[" + f"{GOOD}, " * 50 + rest)
    blocks(1 << 20)
    got = json_arrays.read_json_array(spark, str(tmp_path), SCHEMA).collect()
    parts = [r._corrupt_record for r in got if r._corrupt_record]
    assert len(got) - len(parts) == 50 and len(parts) >= 2 and max(map(len, parts)) < 2.1 * json_arrays.RECORD_BYTES
    assert abs(sum(map(len, parts)) - len(rest)) <= 2 * len(parts)


def test_files_that_no_scan_cuts_get_no_survey(spark, tmp_path, blocks, monkeypatch):
    for k in range(3):
        (tmp_path / f"part {k}%20.json").write_text(json.dumps(objects(40, k)))
    monkeypatch.setattr(json_arrays, "_joined", None)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 22))
    monkeypatch.setattr(json_arrays, "_surveyed", None)
    got = json_arrays.read_json_array(spark, str(tmp_path), SCHEMA)
    want = spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path))
    assert rows(got.drop("_path")) == rows(want) and got.select("_path").distinct().count() == 3
