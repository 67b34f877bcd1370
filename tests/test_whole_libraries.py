"""Joins and indices pruned by pivots, bursts, eviction, exports and pictures, against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest

from shoebox.operators import index, lists, pivots, selection, vectors
from shoebox.sources import export

DAY = dt.datetime(2020, 1, 1)


def clustered(n, groups=12, dim=24, near=0.15, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    v = centres[rng.integers(0, groups, n)] / np.linalg.norm(centres, axis=1).mean() + near * rng.normal(size=(n, dim)) / dim**0.5
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[: n // 3] = v[0]  # a third of all rows are copies
    return v


def frame(spark, v, **more):
    rows = [(k, None if k == 5 else x.tolist()) for k, x in enumerate(v)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)


def plain_edges(v, threshold):
    s = np.round(v @ v.T, 6)
    return {(a, b) for a, b in zip(*np.nonzero(s >= threshold)) if a < b and 5 not in (a, b)}


@pytest.mark.parametrize("threshold", [0.95, 0.62])
def test_pruned_joins_lose_no_pair(spark, threshold):
    v = clustered(400)
    v[7] *= 3  # not of unit length
    d = frame(spark, v)
    got = vectors.sim_edges(d, threshold, "id", block=32, count=8).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b) for r in got} == plain_edges(v, threshold)
    assert {(r.a, r.b) for r in vectors.sim_edges(d, threshold, "id").collect()} == plain_edges(v, threshold)
    best = {tuple(r) for r in vectors.top_edges(d, threshold, "id", 3, block=32, count=8).collect()}
    assert best == {tuple(r) for r in vectors.capped(vectors.sim_edges(d, threshold, "id"), 3).collect()}
    assert best == {tuple(r) for r in vectors.top_edges(d, threshold, "id", 3).collect()}
    none = d.limit(0)
    assert vectors.sim_edges(none, threshold, "id", count=8).count() == 0 == vectors.top_edges(none, threshold, "id", count=8).count()


def test_pairs_of_blocks_are_skipped(spark):
    d = frame(spark, clustered(600))
    v = d.where("embedding is not null").selectExpr("id key", "embedding v")
    some = pivots.choose(v, 8)
    dealt, spans = pivots.blocks(d, "id", "embedding", some, 32)
    n = spans.count()
    assert dealt.groupBy("block").count().agg({"count": "max"}).first()[0] <= 100  # copies are split as well
    left = pivots.admitted(spans, 0.9).count()
    assert n > 10 and n <= left < n * (n + 1) / 4
    assert pivots.admitted(spans, -1.0).count() == n * (n + 1) / 2


def test_index_reads_few_blocks(spark, tmp_path):
    v = clustered(900, seed=3)
    d = frame(spark, v)
    path = str(tmp_path / "index")
    pivots.build(d, path, "id", count=8, block=32)
    blocks = len([p for p in (tmp_path / "index" / "vectors").iterdir() if p.name.startswith("block=")])
    rng = np.random.default_rng(1)
    for q in [v[0], v[700], v[450], rng.normal(size=24)]:
        q = q / np.linalg.norm(q)
        for k in (1, 7, 50):
            rows, read = pivots.search(spark, path, q.tolist(), k)
            want = sorted(((-s, i) for i, s in enumerate(np.round(v @ q, 6)) if i != 5))[:k]
            got = [(r["key"], r["score"]) for r in rows.collect()]
            assert [g[0] for g in got] == [i for _, i in want] and np.allclose([g[1] for g in got], [-s for s, _ in want], atol=2e-6)
    assert pivots.search(spark, path, v[700].tolist(), 5)[1] < blocks / 2
    assert len(pivots.search(spark, path, v[0].tolist(), 5000)[0].collect()) == 899
    with pytest.raises(ValueError):
        pivots.search(spark, path, (2 * v[0]).tolist(), 5)
    pivots.build(d.limit(0), str(tmp_path / "none"), "id")
    assert pivots.search(spark, str(tmp_path / "none"), v[0].tolist(), 5)[0].count() == 0


def test_several_anchors_in_one_scan(spark):
    v = clustered(300, seed=4)
    anchors = [v[k] for k in (0, 150, 299)]
    rows = pivots.nearest_many(frame(spark, v), [a.tolist() for a in anchors], 40, "id").collect()
    for n, a in enumerate(anchors):
        want = sorted((-s, i) for i, s in enumerate(np.round(v @ a, 6)) if i != 5)[:40]
        assert [r.key for r in sorted((r for r in rows if r.anchor == n), key=lambda r: r.rn)] == [i for _, i in want]


@pytest.mark.parametrize("newest", [True, False])
def test_bursts_of_a_library(spark, newest):
    rnd, rows = random.Random(6), []
    for k in range(500):
        a = rnd.choice([0.0, 0.1, 0.3, 0.5, 1.5])
        rows.append((k, None if k % 60 == 7 else DAY + dt.timedelta(seconds=rnd.choice([rnd.randrange(15_000), rnd.randrange(600), 300])), None if k % 45 == 3 else [float(np.cos(a)), float(np.sin(a))], rnd.random()))
    d = spark.createDataFrame(rows, "id long, taken timestamp_ntz, embedding array<double>, q double").repartition(6)
    order = sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0]), reverse=newest) + [r for r in rows if not r[1]]
    plain = selection.collapse_rows([(r[0], r[1] and (r[1] - DAY).total_seconds(), None if r[2] is None else np.array(r[2]), r[3]) for r in order])
    got = selection.collapse_library(d, newest_first=newest).collect()
    assert {(g.id, g.first_id) for g in got} == {(i, order[place][0]) for i, place in plain}
    assert len(got) < 400 and sum(g.members for g in got) == 500
    assert selection.collapse_library(d.limit(0)).count() == 0


@pytest.mark.parametrize("large", [1 << 20, 3])
def test_evictions_against_a_plain_order(spark, large):
    rnd = random.Random(9)
    rows = [(f"a{k}", "v", rnd.choice([None, 10, 30, 200]), rnd.choice([None, DAY, DAY, DAY + dt.timedelta(seconds=rnd.randrange(10**6))]), rnd.random() < 0.2) for k in range(120)]
    c = spark.createDataFrame(rows, "asset_id string, version string, bytes long, used timestamp_ntz, pinned boolean").repartition(4)
    total = sum(r[2] or 0 for r in rows)
    for budget in (total + 10, total, total // 2, 100, 0):
        want, freed = {}, 0
        for r in sorted((r for r in rows if not r[4] and r[0] != "a3"), key=lambda r: (r[3] is not None, r[3] or DAY, r[0])):
            if total - freed + 10 > budget:
                want[r[0]] = freed
            freed += r[2] or 0
        got = lists.eviction_plan(c, 10, budget, keep=("a3", "v"), large=large)
        assert {r.asset_id: r.freed_before for r in got.collect()} == want
    assert lists.eviction_plan(c.limit(0), 5, 0).count() == 0
    text = c.withColumn("used", c.used.cast("string"))
    assert lists.eviction_plan(text, 10, 100).count() == lists.eviction_plan(c, 10, 100).count()


def test_looks_at_the_cache_repair_it(spark):
    c = spark.createDataFrame([("a", "v", "p", 1, False), ("b", "v", "q", 2, True), ("b", "w", "r", 0, False)], "asset_id string, version string, path string, used int, pinned boolean")
    files = spark.createDataFrame([("q",), ("r",)], "path string")
    hit, after = lists.cached(c, "a", "v", files, 9)
    assert hit.count() == 0 and sorted(r.path for r in after.collect()) == ["q", "r"]
    hit, after = lists.cached(after, "b", "v", files, 9)
    assert [r.path for r in hit.collect()] == ["q"] and {r.path: r.used for r in after.collect()} == {"q": 9, "r": 0} and after.columns == c.columns
    assert lists.peek(c, "a", "v", files).count() == 0 and lists.peek(c, "b", "v", files).count() == 1
    assert [r.path for r in lists.cache_rows(c).collect()] == ["p", "q", "r"] and [r.path for r in lists.cache_rows(c, oldest_first=True).collect()] == ["r", "p", "q"]
    assert [r.path for r in lists.cache_rows(c, "b", unpinned_only=True).collect()] == ["r"]


def test_second_export_keeps_ids(spark, tmp_path):
    when = dt.datetime(2020, 5, 1, tzinfo=dt.timezone.utc)
    versions = {"original": (5, 400, 300, "heic", None), "thumb": (1, 40, 30, "jpeg", None)}
    kind = "id string, filename string, kind string, taken timestamp, added timestamp, width int, height int, bytes long, favorite boolean, hidden boolean, caption string, latitude double, longitude double, missing_since timestamp, versions map<string, struct<bytes: bigint, width: int, height: int, type: string, filename: string>>"

    def catalogue(ids):
        a = spark.createDataFrame([(i, f"{i}.heic", "movie" if i == "m" else "image", when, when, 400, 300, 5, i == "b", i == "h", None, None, None, None, versions) for i in ids], kind)
        return {
            "assets": a, "cache": spark.createDataFrame([("a", "thumb", "t/a"), ("gone", "thumb", "t/g")], "asset_id string, version string, path string"),
            "faces": spark.createDataFrame([(1, "a", [1, 2, 3, 5], 0.9, "thumb", [1.0], "p"), (2, "b", [0, 0, 9, 9], 0.8, "thumb", [1.0], "p"), (3, "b", [0, 0, 1, 1], None, None, [1.0], None), (4, "m", [0, 0, 1, 1], 1.0, "thumb", [1.0], "p")], "id long, asset_id string, box array<int>, det double, source string, embedding array<double>, person_id string"),
            "people": spark.createDataFrame([("p", "Ann B", "Ann")], "id string, name string, display_name string"), "index_state": spark.createDataFrame([("c",)], "asset_id string"),
            "collections": spark.createDataFrame([("best", when), ("none", when)], "name string, created timestamp"), "collection_assets": spark.createDataFrame([("best", "b", 2), ("best", "a", 1), ("best", "gone", 3)], "collection string, asset_id string, position long"),
        }

    first, keys = export.library(catalogue(["b", "c", "h", "m"]), "Photos", "/lib", when)
    export.write_library(first, keys, str(tmp_path / "1"))
    out, _ = export.library(catalogue(["a", "b", "h"]), "Photos", "/lib", when + dt.timedelta(days=1), export.read_keys(spark, str(tmp_path / "1")))
    name = lambda t: {r["name"]: r["id"] for r in t["afiles"].collect()}
    old, new = name(first), name(out)
    assert set(old) == {"b@b.heic", "c@c.heic", "m@m.heic"} and set(new) == {"a@a.heic", "b@b.heic"} and new["b@b.heic"] == old["b@b.heic"] and new["a@a.heic"] == 4
    assert [tuple(r) for r in first["athumbs"].select("file_id", "error_code").collect()] == [(old["m@m.heic"], 1)]
    assert [tuple(r) for r in out["athumbs"].select("file_id", "error_code", "thumb_path").collect()] == [(4, 0, "t/a")]
    assert sorted(r["path"] for r in out["afolders"].collect()) == ["/lib", "/lib/2020", "/lib/2020/05"]
    f = {r["id"]: r for r in out["faces"].collect()}
    assert len(f) == 3 and {r["file_id"] for r in f.values()} == {4, old["b@b.heic"]} and sorted(r["id"] for r in first["faces"].collect()) == [1, 2]
    assert '{"x":10.0,"y":20.0,"width":20.0,"height":30.0,"confidence":0.9}' in {r["bbox"] for r in f.values()}
    person = out["persons"].first()
    assert (person["name"], f[person["cover_face_id"]]["file_id"]) == ("Ann", old["b@b.heic"])
    assert {(r["file_id"], r["added_at"] - int(when.timestamp()) - 86400) for r in out["acollections_files"].collect()} == {(4, 0), (old["b@b.heic"], 1)}
    flags = {r["name"]: (r["has_faces"], r["is_favorite"], r["file_type"]) for r in first["afiles"].collect()}
    assert flags == {"b@b.heic": (1, 1, 1), "c@c.heic": (2, 0, 1), "m@m.heic": (0, 0, 2)}
    assert out["albums"].first()["total"] == 2


def test_pictures_are_measured(spark, tmp_path):
    rng = np.random.default_rng(2)
    sharp, flat = rng.integers(0, 255, (40, 30), dtype=np.uint8), np.full((40, 30), 9, np.uint8)
    for name, data in (("a.raw", sharp.tobytes()), ("b.raw", flat.tobytes()), ("c.raw", b"broken"), ("d.raw", bytes(5000)), ("e.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    d = index.files(spark, str(tmp_path), most=2000, pattern="*.raw")
    got = {r["asset_id"][-5:]: r["sharpness"] for r in index.sharpness(d.selectExpr("path asset_id", "data"), lambda b: np.frombuffer(b, np.uint8).reshape(40, 30)).collect()}
    assert got == {"a.raw": index.laplacian(sharp), "b.raw": 0.0, "c.raw": None, "d.raw": None}
    assets = spark.createDataFrame([("a.raw", 3.0), ("z", 3.0)], "id string, sharpness double")
    measured = spark.createDataFrame(list(got.items()), "asset_id string, sharpness double")
    assert {r["id"]: r["sharpness"] for r in index.with_sharpness(assets, measured).collect()} == {"a.raw": got["a.raw"], "z": None}
    wide = np.repeat(np.repeat(np.arange(8.0).reshape(2, 4), 300, axis=0), 300, axis=1)
    small = index.shrunk(wide)
    assert small.shape == (256, 512) and small[0, 0] == 0 and small[-1, -1] == 7 and index.shrunk(flat) is not flat and (index.shrunk(flat) == flat).all()
    assert index.shrunk(np.ones((1, 2000))).shape == (1, 512) and index.laplacian(np.ones((1, 5))) == 0


def test_captures_are_noted(spark):
    rows = [(k, DAY + dt.timedelta(days=k), False, None) for k in range(6)]
    a = spark.createDataFrame(rows, "id long, taken timestamp_ntz, favorite boolean, sharpness double")
    v = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(6)], "id long, embedding array<double>")
    note = lambda seen: selection.run(a, v, a.where("id < 4"), 2, with_captures=seen)[1][1]
    assert note(a) == ("filters", 4, "2 screen captures set aside") and note(None) == ("filters", 4, "")
