import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemart.llm import centroid_clustering, divergence_audit, substring_dedup
from tests.llm import cases

CLASH = ("n", "key", "h", "at", "g", "start", "anchors", "kept", "known", "cluster", "distance", "small", "x", "pivots", "term", "value", "rank", "item", "block", "width", "slot", "total")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


# ---------------------------------------------------------------- Substring dedup


def plain_passages(rows, window):
    """What is kept of (doc_id, text), by comparing whole windows: the rows of one doc_id have one text."""
    texts = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows if i is not None}
    first, gone = {}, {i: set() for i in texts}
    for i in sorted(texts):
        w = texts[i]
        for s in range(len(w) - window + 1):
            if first.setdefault(tuple(w[s : s + window]), (i, s)) != (i, s):
                gone[i].update(range(s, s + window))
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        rest = [x for k, x in enumerate(w) if k not in gone.get(i, ())]
        out.append((i, len(w), len(w) - len(rest), " ".join(rest)))
    return sorted(out, key=repr)


def passages(seed, n=60):
    rnd = random.Random(seed)
    shared = [cases.words(rnd, rnd.randint(13, 60)) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [cases.words(rnd, rnd.randint(0, 30)) if rnd.random() < 0.5 else rnd.choice(shared) for _ in range(rnd.randint(1, 6))]
        texts.append(rnd.choice([" ", "\n", "\t \x0b"]).join(parts))
    return texts


@pytest.mark.parametrize("window", [13, 14, 20, 33])
@pytest.mark.parametrize("stretch", [1 << 22, 300])
def test_passages_match_brute_force(spark, window, stretch, monkeypatch):
    texts = passages(window)
    rows = [*enumerate(texts), (100, texts[3]), (101, texts[3]), (102, texts[3] + " more"), (103, None), (104, ""), (105, " \n"), (106, "of " * 500), (None, texts[5]), (None, None), (7, texts[7]), (107, "Éa b  " * 40)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    monkeypatch.setattr(substring_dedup, "STRETCH", stretch)
    monkeypatch.setattr(substring_dedup, "CHUNK", min(stretch, substring_dedup.CHUNK))
    got = sorted((tuple(r) for r in substring_dedup.dedup(df, window=window).select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)
    assert got == plain_passages(rows, window)


def test_the_cover_holds_every_difference():
    assert all(any((k + s) % substring_dedup.PERIOD in substring_dedup.COVER for s in substring_dedup.COVER) for k in range(substring_dedup.PERIOD))


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_words_are_the_same_however_texts_are_cut(chunk, monkeypatch):
    import pyarrow as pa

    texts = [*passages(3, 12), None, "", "x" * 300, " a  b "]
    whole = list(substring_dedup.stretches(pa.array(texts)))
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    monkeypatch.setattr(substring_dedup, "STRETCH", 4 * chunk)
    parts = list(substring_dedup.stretches(pa.array(texts)))
    assert [b for b, *_ in parts] == [0, *[e for _, e, *_ in parts][:-1]] and parts[-1][1] == len(texts)
    for k in (2, 3):
        assert np.array_equal(np.concatenate([p[k] for p in parts]), np.concatenate([p[k] for p in whole]))
    assert Counter(np.concatenate([p[3] for p in parts]).tolist()) == Counter({k: n for k, t in enumerate(texts) if (n := len((t or "").split()))})


def test_passages_of_string_ids_digests_and_empty_tables(spark):
    text = cases.words(random.Random(5), 40)
    df = spark.createDataFrame([("b", text), ("a", text), ("é", "x " + text)], "doc_id string, text string")
    got = {r.doc_id: r for r in substring_dedup.dedup(df, digest=True).collect()}
    assert [(got[k].n_words, got[k].n_removed) for k in ("a", "b", "é")] == [(40, 0), (40, 40), (41, 40)]
    assert got["é"].kept == hashlib.sha256(b"x").hexdigest()
    assert substring_dedup.dedup(cases.empty(spark)).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.dedup(df, window=5)


# ---------------------------------------------------------------- Divergence


def plain_audit(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    within, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        within[lang].update(set(words))
        count[lang, source].update(words)
        count[lang].update(words)
    out = []
    for lang in within:
        kept = sorted(t for t, n in within[lang].items() if n >= least)
        p = {}
        for g in [lang, *[k for k in count if isinstance(k, tuple) and k[0] == lang]]:
            total = sum(count[g][t] for t in kept) + len(kept)
            p[g] = {t: 1 + 10**9 * (count[g][t] + 1) // total for t in kept}
        groups = [g for g in p if isinstance(g, tuple)]
        for g in groups:
            price = lambda h, t, g=g: (p[g][t] - p[h][t]) ** 2 // p[h][t]
            pairs = [(h[1], sum(price(h, t) for t in kept)) for h in groups if h != g]
            favoured = [(t, price(lang, t)) for t in kept if count[g][t] and p[g][t] > p[lang][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", favoured, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(*g, part, *x, k + 1) for k, x in enumerate(found[:most])]
    return sorted(out)


def languages(seed=2, n=150):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 4))) for _ in range(80)]
    rows = []
    for _ in range(n):
        lang, source = rnd.choice(["en", "de", None, "fr"]), rnd.choice(["a", "b", "c", "é", None, ""])
        words = [rnd.choice(vocabulary[: 20 if source == "a" else 80]) for _ in range(rnd.randint(0, 60))]
        rows.append((lang, source, rnd.choice([" ", "-", "1"]).join(w.upper() if rnd.random() < 0.2 else w for w in words)))
    rows += [("xx", "only", "one"), ("xx", "other", None), ("xx", "third", ""), ("en", "none", None), ("en", "digits", "12 34"), ("yy", "lone", "é é é"), *[("zz", s, "same same") for s in "abc"], *[rows[0]] * 3, ("en", "a", "long " * 3000)]
    return rows


@pytest.mark.parametrize(("cells", "width", "held"), [(1 << 20, 1 << 12, 1 << 19), (64, 8, 4), (1, 4, 1)])
def test_divergence_matches_brute_force(spark, cells, width, held, monkeypatch):
    for name, value in (("CELLS", cells), ("WIDTH", width), ("HELD", held), ("CHUNK", 50)):
        monkeypatch.setattr(divergence_audit, name, value)
    rows = languages()
    df = clashing(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string")).repartition(4)
    got = sorted(tuple(r) for r in divergence_audit.audit(df, top=7).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(rows, 3, 7)


def test_equal_subtrees_are_one_node_and_prices_are_those_of_the_leaves():
    rnd = np.random.default_rng(4)
    counts = rnd.choice([0, 0, 0, 1, 5], (6, 64))
    counts[:, 32:48] = counts[:, :16]
    counts[:, 60:] = -1
    trees = divergence_audit.Trees(counts)
    assert len(trees.children[-1][0]) <= 6 and len(trees.children[0][0]) < 6 * 32 // 2
    totals, kept = counts.clip(0).sum(axis=1), 60
    a, b = np.array([0, 1, 5]), np.array([3, 1, 2])
    forth, back = trees.priced(a, b, totals, kept)
    for k in range(3):
        p, q = (1 + 10**9 * (counts[g[k], :60] + 1) // (totals[g[k]] + kept) for g in (a, b))
        assert (forth[k], back[k]) == (((p - q) ** 2 // q).sum(), ((p - q) ** 2 // p).sum())


def test_shares_are_exact_for_great_counts(spark):
    whole = [9 * 10**15, 9 * 10**15 - 1, 7, 10**12 + 39]
    x = [8_999_999_999_999_999, 1, 7, 333_333_333_346]
    want = [1 + 10**9 * a // b for a, b in zip(x, whole, strict=True)]
    assert divergence_audit.shares(np.array(x), np.array(whole)).tolist() == want
    df = spark.createDataFrame(list(zip(x, whole, strict=True)), "x long, whole long")
    assert [r[0] for r in df.select(divergence_audit.share(F.col("x"), F.col("whole"))).collect()] == want


def test_divergence_of_an_empty_table(spark):
    assert divergence_audit.audit(cases.empty(spark)).collect() == []


# ---------------------------------------------------------------- Centroids


def plain_clusters(rows, k, rounds, dim, scale):
    """By Python's integers alone."""
    import math

    kept = [(i, [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        own = assign()
        for n in range(len(centroids)):
            mine = [x for (_, x), (_, m) in zip(kept, own, strict=True) if m == n]
            if mine:
                centroids[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    own = assign()
    most = (1 << 63) - 1
    inertia = Counter()
    for d, n in own:
        inertia[n] += min(d, most)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, min(d, most), min(most, inertia[n]), min(most, sum(inertia.values())), names[n]) for (i, _), (d, n) in zip(kept, own, strict=True)), key=repr)


def points(seed, n=300, dim=6, size=1.0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(9, dim)) * 3
    rows = [(k, [float(np.float32(x)) for x in (centres[k % 9] + rnd.normal(size=dim)) * size]) for k in range(n)]
    rows += [(k + 1000, rows[4][1]) for k in range(60)]
    return rows + [(None, rows[2][1]), (None, rows[9][1]), rows[1], rows[1], (2001, [0.0] * dim), (2002, [-0.0] * dim), (2003, [0.5 / 64] * dim)]


ODD = [(9001, None), (9002, []), (9003, [0.1] * 5), (9004, [float("nan")] + [0.1] * 5), (9005, [float("inf")] + [0.1] * 5), (9006, [None] + [0.1] * 5), (9007, [0.1] * 7)]


@pytest.mark.parametrize(("size", "extra"), [(1.0, []), (1e5, []), (1.0, [(5001, [1e30, -1e30, 1.0, 2.0, 3.0, 4.0]), (5002, [1e30, -1e30, 1.5, 2.0, 3.0, 4.0]), (5003, [3e38] * 6)]), (1e-3, [])])
def test_clusters_match_brute_force(spark, size, extra):
    rows = points(7, size=size) + extra
    df = clashing(spark.createDataFrame(rows + ODD, "vec_id long, embedding array<float>")).repartition(4)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = centroid_clustering.cluster(df, k=8, rounds=3, dim=6)
    got = sorted((tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)
    assert got == plain_clusters(rows, 8, 3, 6, 64)


def test_ptolemaic_bounds_hold_and_prune():
    rnd = np.random.default_rng(3)
    centres = rnd.integers(-4000, 4000, (16, 4))
    x = centres[rnd.integers(0, 16, 4000)] + rnd.integers(-60, 60, (4000, 4))
    pivots = x[centroid_clustering.farthest_first(x[:200].astype(object), 4)]
    model = centroid_clustering.Assigner(centres.tolist(), pivots.tolist(), 4, 64)
    low = centroid_clustering.lower_bounds(centroid_clustering.distances(x, model.pivots), model.other, model.between)
    exact = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (low * low <= exact * (1 + 1e-9)).all()
    who, best, found = centroid_clustering.nearest(x, low, model.centroids)
    assert (who == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert found < 0.4 * exact.size


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(k, [float(k)] * 6) for k in range(3)]
    got = centroid_clustering.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dim=6).collect()
    assert sorted((r.vec_id, r.distance) for r in got) == [(0, 0), (1, 0), (2, 0)] and len({r.cluster for r in got}) == 3
    assert centroid_clustering.cluster(spark.createDataFrame(ODD, "vec_id long, embedding array<float>"), dim=6).collect() == []
    assert centroid_clustering.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("value", [0, -1, 5, -(2**31), 2**31, 2**31 - 1, 2**130 + 3, -(2**130) - 3])
def test_limbs(value):
    assert sum(d << (32 * p) for p, d in centroid_clustering.limbs(value)) == value
