import base64
import hashlib
import io
import math
import os
import struct
from fractions import Fraction

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from lakemart.llm import embedding_near_dedup, topk_search, warc
from lakemart.llm.shared import components, fresh_path, prefix_sums, written

VECTORS = "vec_id long, embedding array<float>, label int"
ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 8, 1), (9004, [float("nan")] + [0.1] * 7, 1), (9005, [float("inf")] + [0.1] * 7, 1), (9006, [None] + [0.1] * 7, 1), (None, [0.5] * 8, 1), (9007, [0.5] * 8, None), (9100, [0.5] * 3, 1)]


def vectors(spark, n=400, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, 8))
    rows = []
    for k in range(n):
        v = centres[k % 12] * rnd.uniform(0.5, 2) + rnd.normal(size=8) * rnd.choice([0.0, 0.02, 0.1, 0.5])
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 3) if k % 4 else 0))
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(80)]  # a crowd of copies
    return rows, spark.createDataFrame(rows + ODD, VECTORS).withColumns({"score": F.lit("x"), "block": F.lit("y"), "kept": F.lit("z")}).repartition(3)


@pytest.mark.parametrize("block", [1024, 25])
def test_near_duplicate_vectors_match_brute_force(spark, block):
    rows, df = vectors(spark)
    x = np.array([r[1] for r in rows])
    n = np.sqrt((x**2).sum(axis=1))
    label = np.array([r[2] for r in rows])
    near = (x @ x.T / n[:, None] / n[None, :] >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    ids = np.array([r[0] for r in rows])
    want = ids.copy()
    while True:
        new = np.array([min(want[k], want[near[k]].min(initial=1 << 60)) for k in range(len(ids))])
        if (new == want).all():
            break
        want = new
    got = {r.vec_id: r for r in embedding_near_dedup.near_duplicates(df, block=block).collect()}
    assert len(got) == len(rows) + len(ODD)
    for k, i in enumerate(ids):
        r = got[int(i)]
        assert (r.n_links, r.component_id, r.kept) == (near[k].sum(), want[k], want[k] == i)
    assert all(got[v[0]].n_links == 0 and got[v[0]].component_id == v[0] and got[v[0]].kept for v in ODD)


def test_cover_tree_holds_its_bounds():
    x = np.random.default_rng(2).normal(size=(300, 3))
    unit = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
    t = embedding_near_dedup.CoverTree(x)
    assert any(map(len, t.children))
    for c, r, m, below in zip(t.centre, t.radius, t.members, t.children, strict=True):
        assert np.sqrt(((unit[m] - unit[c]) ** 2).sum(axis=1)).max() <= r + 1e-12
        if len(below):
            assert sorted(np.concatenate([t.members[b] for b in below])) == sorted(m)


def test_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert embedding_near_dedup.near_duplicates(none).count() == 0 and topk_search.search(none).count() == 0
    assert topk_search.search(spark.createDataFrame(ODD[:7], VECTORS), every=1).count() == 0


@pytest.mark.parametrize("block, query_block", [(2048, 256), (16, 3)])
def test_topk_matches_brute_force(spark, block, query_block):
    rows, df = vectors(spark)
    ids, x = np.array([r[0] for r in rows] + [9003, 9007]), np.floor(1024 * np.array([r[1] for r in rows] + [[0.0] * 8, [0.5] * 8])).astype(np.int64)
    got = {}
    for r in topk_search.search(df, every=50, block=block, query_block=query_block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        order = [k for k in np.lexsort((ids, -s)) if k != q][:10]
        want[int(ids[q])] = [(n, int(ids[k]), int(s[k])) for n, k in enumerate(order, 1)]
    assert got == want


def plain_best(rows, every, k=10):
    """(query row, rank, vec_id, score) by whole numbers of any size, held within a long."""
    whole = [(i, [math.floor(1024 * Fraction(c)) for c in x]) for i, x in rows]
    out = []
    for a, (i, x) in enumerate(whole):
        if i % every == 0:
            found = [(-max(-(2**63), min(2**63 - 1, sum(u * v for u, v in zip(x, y, strict=True)))), j) for b, (j, y) in enumerate(whole) if a != b and len(x) == len(y)]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [7e4, 3e9, 1e30])
def test_scores_are_exact_at_any_size(spark, scale):
    rnd = np.random.default_rng(4)
    rows = [(int(k), [float(x) for x in rnd.normal(size=5) * rnd.choice([1.0, scale])]) for k in range(120)]
    rows += [(0, rows[3][1]), (0, rows[0][1]), (7, rows[0][1])]  # rows of one id are candidates of each other
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], "vec_id long, embedding array<double>, label int").repartition(2)
    got = sorted(map(tuple, topk_search.search(df, every=20, block=16, query_block=3, in_task=2).collect()))
    assert got == plain_best(rows, 20)


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [3.0, -1.0], 0), (2, [1e6, 1e6], 0)], VECTORS)
    assert [(r.query_id, r.rank, r.vec_id) for r in topk_search.search(df, every=100).collect()] == [(0, 1, 2), (0, 2, 1)]


def test_long_and_short_vectors_link_by_their_angle(spark):
    rows = [(1, [1e200, 0.0], 1), (2, [1e-200, 1e-202], 1), (3, [0.0, 1e-310], 1), (4, [1e305, 1e305], 1), (5, [3.0, 0.1], 1), (5, [0.0, 2.0], 1)]
    got = sorted(map(tuple, embedding_near_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (4, 0, 4, True), (5, 1, 3, False), (5, 2, 1, False)]


def test_upper_levels_part_clusters(spark):
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(20, 16))
    x = np.concatenate([centres[k % 20] + rnd.normal(size=(1, 16)) * 0.05 for k in range(2000)])
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
    near = unit @ unit.T >= 0.98
    got = {r.vec_id: r.n_links for r in embedding_near_dedup.near_duplicates(df, block=100).collect()}
    assert [got[k] for k in range(2000)] == (near.sum(axis=1) - 1).tolist()


def test_links_of_dense_and_spread_points():
    rnd = np.random.default_rng(3)
    for width in (0.01, 0.1, 0.14, 0.3, 3.0):
        a, b = (rnd.normal(size=(1, 12)) * 0 + 1 + rnd.normal(size=(n, 12)) * width for n in (500, 300))
        x = np.concatenate([a, b])
        unit = embedding_near_dedup.directions(x)
        near = unit @ unit.T >= 0.98
        ta, tb = embedding_near_dedup.CoverTree(a), embedding_near_dedup.CoverTree(b)
        one = np.ones(800, np.int64)
        count, root = embedding_near_dedup.links(ta, tb, one[:500], one[:300], 0.98)
        assert count.tolist() == np.concatenate([near[:500, 500:].sum(axis=1), near[500:, :500].sum(axis=1)]).tolist()
        own, roots = embedding_near_dedup.links(ta, ta, one[:500], one[:500], 0.98)
        assert own.tolist() == (near[:500, :500].sum(axis=1) - 1).tolist()
        want = np.arange(500)
        while (new := np.array([want[near[k, :500]].min() for k in range(500)])).tolist() != want.tolist():
            want = new
        assert roots.tolist() == want.tolist()


# ---------------------------------------------------------------- WARC

PAGES = [(3, "http://a/", "<p>same</p>"), (1, "http://b/ x\r\ny", "<p>same</p>"), (2, None, None), (7, "u", ""), (8, "v", "é" * 1000), (9, "w", "x\r\n\r\nWARC/1.1\r\n" * 50), (None, "n", "<p>same</p>"), (10, "l", "long " * 200_000)]


def pages(spark):
    rows = PAGES + [(100 + k, f"http://h/{k}", f"<html>{'body text ' * (k % 9)}{k}</html>") for k in range(60)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit("clash"), "first": F.lit(0)}).repartition(3)


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    directory = fresh_path(spark, "warc")
    manifest = warc.write_archives(df, directory, sample_bytes=2000, archive_bytes=40_000)
    got = {r.page_id: r for r in warc.read_archives(manifest, directory).collect()}
    payloads = {i: (h or "").encode() for i, _, h in rows}
    assert set(got) == set(payloads) and manifest.agg(F.sum("records")).first()[0] == len(rows)
    for i, p in payloads.items():
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        same = [k for k, v in payloads.items() if v == p and k is not None]
        first = min(same)
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == first else ("revisit", first))
        assert got[i].payload is None if i != first else bytes(got[i].payload) == p


def test_records_can_be_read_alone_with_the_leading_dictionary(spark):
    import zstandard

    directory = fresh_path(spark, "warc")
    manifest = warc.write_archives(pages(spark)[1].coalesce(1), directory)
    fs, _ = pafs.FileSystem.from_uri(directory)
    raw = fs.open_input_stream(max(manifest.collect(), key=lambda r: r.records).path, compression=None).read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).decompressobj()
    assert one.decompress(raw[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert one.unused_data  # the frame ends there
    assert sum(1 for _ in warc.records_of(io.BytesIO(raw))) > 1


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_pages_are_all_responses(spark):
    df = spark.createDataFrame([(5, "u", "x"), (5, "u", "x"), (6, "u", "x")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type) for r in warc.round_trip(df).collect()) == [(5, "response"), (5, "response"), (6, "revisit")]


# ---------------------------------------------------------------- shared


def test_runs_are_cut_at_keys_and_at_most_rows():
    import pyarrow as pa

    from lakemart.llm.shared import runs

    keys = [1] * 5 + [2] * 3 + [3] * 9
    batches = [pa.record_batch([pa.array(keys[k : k + n]), pa.array(range(k, min(17, k + n)))], names=["k", "i"]) for k, n in ((0, 0), (0, 4), (4, 6), (10, 7))]
    assert [x.column("i").to_pylist() for x in runs(iter(batches), ["k"])] == [list(range(5)), list(range(5, 8)), list(range(8, 17))]
    assert [len(x) for x in runs(iter(batches), ["k"], 4)] == [4, 1, 3, 4, 4, 1]


def test_intermediate_tables_are_deleted(spark):
    from lakemart.llm.shared import cleared, shared_dir

    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    with cleared(spark):
        written(spark.range(5), "some")
        assert set(os.listdir(root)) != before
    assert set(os.listdir(root)) == before


def test_one_row_of_each_id_stays(spark):
    from lakemart.llm.shared import one_of_each

    rows = [(1, "b", 1, {"a": 1}), (1, "a", 2, None), (1, "a", 1, None), (2, None, 5, None), (2, "x", 0, None), (3, "y", 0, None), (None, "n", 0, None), (None, "n", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, row map<string,int>").repartition(4)
    got = one_of_each(docs, spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert got.columns == docs.columns
    assert sorted(map(str, got.drop("row").collect())) == sorted(map(str, spark.createDataFrame([rows[2], rows[3], rows[6], rows[7]], docs.schema).drop("row").collect()))


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 30)] + [(7, 7), (None, 3), (2, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert {got[k] for k in range(100, 141)} == {100} and got[50] == 1 and got[29] == 1
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_prefix_sums(spark):
    totals = written(spark.range(3000).select("id", (F.col("id") % 7).alias("n")), "totals")
    rows = sorted(prefix_sums(totals, "id", "n").collect())
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n
    assert {r.whole for r in rows} == {at}


def test_archives_keep_empty_urls_and_leave_nothing_behind(spark):
    from lakemart.llm.shared import shared_dir

    pages = spark.createDataFrame([(1, "", "a"), (2, None, "b"), (3, "http://x/ y", "a"), (None, "", None)], "page_id long, url string, html string")
    directory = fresh_path(spark, "warc")
    got = {r.page_id: r.url for r in warc.read_archives(warc.write_archives(pages, directory), directory).collect()}
    assert got == {1: "", 2: None, 3: "http://x/%20y", None: ""}
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert warc.round_trip(pages).count() == 4
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before] == ["records"]
