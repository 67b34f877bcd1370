"""Small literal cases of the catalogue's operators, nulls and ties included."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.functions import scalars as S
from shoebox.operators import faces, ingest, layout, lists, preflight, search, selection, summaries, vectors
from shoebox.operators.components import components
from shoebox.sources import catalogue, feed
from shoebox.streaming import sync

DAY = dt.datetime(2019, 7, 20, 12)


def assets(spark):
    rows = []
    for n in (1, 2, 3, 4, 5, 6, 7, 9):
        rows.append((f"A{n:03d}/x+y==", f"IMG_{n:04d}.{'MOV' if n == 9 else 'HEIC'}", "movie" if n == 9 else "image", False, DAY + dt.timedelta(days=n), n == 3, False, "Beach day" if n == 4 else None, 59.9 if n == 5 else None, None))
    rows += [("Z1", "Screenshot.PNG", "image", False, None, False, False, None, None, None), ("Z2", None, "image", False, None, False, True, "ÜBER 100%", None, DAY)]
    return spark.createDataFrame(rows, "id string, filename string, kind string, live boolean, taken timestamp_ntz, favorite boolean, hidden boolean, caption string, latitude double, missing_since timestamp_ntz")


def ids(df):
    return sorted(r["id"][:4] for r in df.select("id").collect())


def test_filters(spark):
    a = assets(spark)
    f = lambda **k: ids(search.apply_filters(a, search.Filters(**{"include_missing": True, "include_hidden": True} | k)))
    assert f(text="BEACH") == ["A004"]
    assert f(text="über") == []  # only ASCII is folded
    assert f(text="ÜBER 1__%") == ["Z2"]  # wildcards are live
    assert f(favorite=True) == ["A003"] and len(f(favorite=False)) == 9
    assert f(located=True) == ["A005"]
    assert f(screenshots=True) == ["Z1"] and "Z2" not in f(screenshots=False)
    assert f(ids=()) == [] and f(ids=("Z1",)) == ["Z1"]
    assert len(f()) == 10 and ids(search.apply_filters(a, search.Filters())) == f(include_missing=False, include_hidden=False) and len(f(include_missing=False, include_hidden=False)) == 9
    assert len(ids(search.apply_filters(a.drop("hidden", "missing_since"), search.Filters()))) == 10
    since, until = (S.parse_date(x, e).replace(tzinfo=None) for x, e in (("2019-07-22", False), ("2019-07-23", True)))
    assert f(since=since, until=until) == ["A002", "A003"]


def test_membership_filters(spark):
    a = assets(spark)
    rel = {
        "albums": spark.createDataFrame([("alb1", "Trip", "Trip"), ("alb2", "Family", "Folder/Family")], "id string, name string, fullname string"),
        "album_assets": spark.createDataFrame([("alb1", "A001/x+y=="), ("alb1", "A002/x+y=="), ("alb1", "gone")], "album_id string, asset_id string"),
        "faces": spark.createDataFrame([("A001/x+y==", "p1"), ("A001/x+y==", "p1"), ("A005/x+y==", "p2")], "asset_id string, person_id string"),
    }
    assert ids(search.apply_filters(a, search.Filters(album="Trip"), rel)) == ["A001", "A002"]
    assert ids(search.apply_filters(a, search.Filters(album="Folder/Family"), rel)) == []
    assert ids(search.apply_filters(a, search.Filters(people=("p1", "p2")), rel)) == ["A001", "A005"]


@pytest.mark.parametrize("size", [1, 3, 4, 20])
def test_pages_join_to_the_whole_order(spark, size):
    a = assets(spark)
    whole = [r["id"] for r in a.orderBy(F.desc_nulls_last("taken"), F.desc("id")).collect()]
    got, cursor = [], None
    while True:
        rows, cursor = search.page(a, size, cursor)
        got += [r["id"] for r in rows]
        if cursor is None:
            break
    assert got == whole
    with pytest.raises(ValueError):
        search.page(a, 3, "!!")


def test_lookup_and_entries(spark):
    a = assets(spark)
    assert [r["id"] for r in search.lookup(a, ["Z2", "Z1"]).collect()] == ["Z2", "Z1"]
    with pytest.raises(KeyError):
        search.lookup(a, ["Z1", "nobody"])
    assert ids(search.by_entry(a, "A001_x_y__")) == ["A001"]


def test_dates():
    d = lambda t, e=False: S.parse_date(t, e).replace(tzinfo=None)
    assert d("2019") == dt.datetime(2019, 1, 1) and d("2019", True) == dt.datetime(2020, 1, 1)
    assert d("2019-12", True) == dt.datetime(2020, 1, 1) and d("2019-02-28", True) == dt.datetime(2019, 3, 1)
    assert d("2019-02-28T10:00:00+02:00", True) == dt.datetime(2019, 2, 28, 10)
    with pytest.raises(ValueError):
        S.parse_date("soon")


def test_unindexed_and_never_indexed(spark):
    a = assets(spark)
    state = spark.createDataFrame([("A001/x+y==", "c2", "f1"), ("A002/x+y==", "c1", "f1"), ("A003/x+y==", None, "f1")], "asset_id string, clip_model string, face_model string")
    assert ids(search.unindexed(a, state, "c2", "f1")) == ["A002", "A003", "A004", "A005", "A006", "A007", "Z1"]
    assert ids(search.never_indexed(a, state)) == ["A004", "A005", "A006", "A007", "Z1"]


def test_decoded_text(spark):
    d = spark.createDataFrame([("SMO8cmdlbg==",), ("%%",), ("/w==",), (None,)], "t string").select(S.decoded_text(F.col("t")).alias("t"))
    assert [r[0] for r in d.collect()] == ["Hürgen", None, None, None]


def test_people(spark):
    p = spark.createDataFrame([("p1", "B", False), ("p2", None, False), ("p3", "A", False), ("p4", "C", True)], "id string, name string, deleted boolean")
    c = spark.createDataFrame([("p1", False), ("p1", True), ("p2", False), ("p2", False)], "person_id string, deleted boolean")
    f = spark.createDataFrame([("x", "p3"), ("x", "p3"), ("y", None)], "asset_id string, person_id string")
    assert [(r["id"], r["crops"], r["photos"]) for r in summaries.people(p, c, f).collect()] == [("p1", 1, 0), ("p3", 0, 1), ("p2", 2, 0)]


def test_fold_is_the_same_however_batches_fall(spark):
    rnd = random.Random(3)
    rows = [(f"k{rnd.randrange(6)}", s, rnd.random() < 0.3, rnd.choice([None, 1, 2, 3]), rnd.choice([None, "a", "b"])) for s in range(200)]
    schema = "key string, seq long, deleted boolean, v int, w string"
    whole = ingest.fold(spark.createDataFrame(rows, schema), "key", ["v", "w"], ["deleted"])
    want = {}
    for k, s, d, v, w in rows:
        o = want.get(k, (None, None, None, None))
        want[k] = (v if v is not None else o[0], w if w is not None else o[1], d, s)
    assert {r["key"]: (r["v"], r["w"], r["deleted"], r["seq"]) for r in whole.collect()} == want
    old = ingest.fold(spark.createDataFrame(rows[:90], schema), "key", ["v", "w"], ["deleted"])
    new = spark.createDataFrame(rows[90:], schema).withColumns({"v_seq": F.col("seq"), "w_seq": F.col("seq")})
    again = ingest.fold(old.unionByName(new), "key", ["v", "w"], ["deleted"])
    assert {r["key"]: (r["v"], r["w"], r["deleted"], r["seq"]) for r in again.collect()} == want


def test_missing_since(spark):
    rows = [("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, True), ("b", 2, False), ("c", 4, True)]
    d = ingest.missing_since(spark.createDataFrame(rows, "k string, seq long, deleted boolean"), "k")
    assert {r["k"]: (r["deleted"], r["missing_since"]) for r in d.collect()} == {"a": (True, 2), "b": (False, None), "c": (True, 4)}


def test_upsert(spark):
    schema = "id string, fingerprint string, zone string, v int, first_seen int, last_seen int, missing_since int"
    old = spark.createDataFrame([("same", "f", "z", 1, 1, 1, 5), ("changed", "f", "z", 1, 1, 1, None), ("left", "f", "z", 1, 1, 1, None), ("gone", "f", "z", 1, 1, 1, 3)], schema)
    new = spark.createDataFrame([("same", "f", None, 1, False), ("changed", "g", None, 2, True), ("fresh", "h", "y", 3, False), ("gone", "g", "z", 2, False)], "id string, fingerprint string, zone string, v int, deleted boolean")
    got = {r["id"]: (r["v"], r["zone"], r["first_seen"], r["last_seen"], r["missing_since"]) for r in ingest.upsert_assets(old, new, 9).collect()}
    # unchanged and back: it stays missing; changed and back: it doesn't
    assert got == {"same": (1, "z", 1, 9, 5), "changed": (2, "z", 1, 9, 9), "left": (1, "z", 1, 1, None), "fresh": (3, "y", 9, 9, None), "gone": (2, "z", 1, 9, None)}


def test_stream_resumes_and_pairs_late_masters(spark, tmp_path):
    root, zone = tmp_path / "feed", tmp_path / "feed" / "PrimarySync"
    zone.mkdir(parents=True)
    put = lambda n, rows: (zone / f"{n}.json").write_text(json.dumps(rows))
    put(0, [{"name": "A1", "type": "CPLAsset", "master_ref": "M1", "fields": {}}, {"name": "X", "type": "CPLMemory", "fields": {}}])
    put(1, [{"name": "M1", "type": "CPLMaster", "fields": {"a": 1}}])
    spark.dataSource.register(feed.ChangeFeed)
    log, check = str(tmp_path / "log"), str(tmp_path / "check")

    def go():
        sync.sync(spark.readStream.format("change_feed").load(str(root)), log, check)
        return sync.current(spark, log)

    folded, paired = go()
    assert [r["name"] for r in paired.collect()] == ["A1"] and folded.count() == 2
    put(2, [{"name": "A1", "type": None, "deleted": True, "fields": None}])
    folded, paired = go()
    assert paired.count() == 0
    assert folded.where("name = 'A1'").select("type", "deleted").first() == ("CPLAsset", True)


def test_tokens():
    assert feed.migrate_tokens(None, "t", ["own", "shared"]) == {"own": "t"}
    assert feed.migrate_tokens({"shared": "s"}, "t", ["own"]) == {"shared": "s"}


def test_catalogue_tables(spark, tmp_path):
    a = spark.createDataFrame([("x", DAY), ("y", None)], "id string, taken timestamp")
    catalogue.write(a, str(tmp_path), "assets", sort_by="taken")
    back = catalogue.read(spark, str(tmp_path), "assets")
    assert back.count() == 2 and "zone" in back.columns
    assert catalogue.get_meta(spark, str(tmp_path)) == {}
    catalogue.set_meta(spark, str(tmp_path), 1, cursor="a", gone="b")
    catalogue.set_meta(spark, str(tmp_path), 2, cursor="c", gone=None)
    assert catalogue.get_meta(spark, str(tmp_path)) == {"cursor": "c"}


def unit_rows(spark, vecs):
    return spark.createDataFrame([(k, [float(x) for x in v] if v is not None else None) for k, v in enumerate(vecs)], "id long, embedding array<float>")


def test_edges_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(70, 6)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    d = unit_rows(spark, [*m, None])
    s = np.round(m.astype(float) @ m.astype(float).T, 6)
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if s[i, j] >= 0.6}
    for block in (9, 1000):
        got = [(r["a"], r["b"]) for r in vectors.sim_edges(d, 0.6, "id", block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_chain_is_one_group(spark):
    chain = [(np.cos(0.28 * k), np.sin(0.28 * k)) for k in range(8)]
    d = unit_rows(spark, [*chain, (-1, 0), (0, 0), None])
    got = {r["id"]: (r["cluster"], r["size"]) for r in faces.build(d, threshold=0.9).collect()}
    assert got == {k: (1, 8) for k in range(8)}
    assert faces.build(d.where("id > 7"), threshold=0.9).count() == 0


def test_components_property(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)]
    root = {k: k for e in edges for k in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}


def test_match_and_rematch(spark):
    f = unit_rows(spark, [(1, 0), (0, 1), (0.6, 0.8), None]).withColumns({"person_id": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double"), "assigned": F.when(F.col("id") == 1, "user")})
    seeds = spark.createDataFrame([("s1", "p1", [1.0, 0.0]), ("s0", "p0", [1.0, 0.0])], "id string, person_id string, embedding array<float>")
    got = {r["id"]: (r["person_id"], r["similarity"]) for r in faces.match(f, seeds, 0.62).collect()}
    assert got[0] == ("p0", 1.0) and got[2][0] is None and abs(got[2][1] - 0.6) < 1e-6 and got[3] == (None, None)
    out, changed = faces.rematch(f, seeds, 0.62)
    assert changed.first()[0] == 1 and {r["id"]: r["assigned"] for r in out.collect()} == {0: "auto", 1: "user", 2: None, 3: None}
    none = faces.match(f, seeds.limit(0), 0.62).collect()
    assert all(r["person_id"] is None and r["similarity"] is None for r in none)


def test_name_and_unname(spark):
    a = spark.createDataFrame([(k, DAY + dt.timedelta(days=-k)) for k in range(30)], "id long, taken timestamp_ntz")
    f = spark.createDataFrame([(k, k, 1, "other" if k == 0 else None, None, None, [1.0], 0.5) for k in range(30)], "id long, asset_id long, cluster int, person_id string, assigned string, similarity double, embedding array<float>, det double")
    seeds = spark.createDataFrame([], "id string, person_id string, embedding array<float>, det double, origin string")
    g, s = faces.name_group(f, seeds, a, 1, "p", n_seeds=5)
    assert g.where("person_id = 'p'").count() == 29
    assert sorted(int(r["id"].split("-")[2]) for r in s.collect()) == [9, 14, 19, 24, 29]
    g2, s2 = faces.unname_group(g, s, 1)
    assert g2.where("person_id = 'p'").count() == 0 and s2.count() == 0


def test_collapse_against_plain_loop():
    def plain(rows):
        groups = []
        for place, (i, t, v, q) in enumerate(rows):
            for g in groups:
                if t is not None and v is not None and g["t"] is not None and g["v"] is not None and abs(t - g["t"]) <= 90 and v @ g["v"] >= 0.93:
                    if q > g["q"]:
                        g.update(i=i, t=t, v=v, q=q)
                    break
            else:
                groups.append(dict(i=i, t=t, v=v, q=q, place=place))
        return [(g["i"], g["place"]) for g in groups]

    rng = np.random.default_rng(0)
    for _ in range(60):
        rows = []
        for i in range(25):
            v = rng.normal(size=2)
            rows.append((i, None if rng.random() < 0.1 else float(rng.integers(0, 900)), None if rng.random() < 0.1 else v / np.linalg.norm(v), float(rng.random())))
        want = plain(rows)
        assert selection.collapse_rows(rows) == want
        # gaps above 90 seconds split the work without changing it
        dated = sorted((r for r in rows if r[1] is not None), key=lambda r: r[1])
        parts, last = [], None
        for r in dated:
            if last is None or r[1] - last > 90:
                parts.append([])
            parts[-1].append(r[0])
            last = r[1]
        kept = {r[0] for r in rows if r[1] is None}
        for p in parts:
            kept |= {k for k, _ in selection.collapse_rows([r for r in rows if r[0] in p])}
        assert kept == {k for k, _ in want}


def test_mmr_against_plain_loop():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n, want = int(rng.integers(1, 20)), int(rng.integers(1, 12))
        rel, buckets = np.round(rng.random(n), 1), [str(rng.integers(0, 3)) for _ in range(n)]
        vecs = [None if rng.random() < 0.2 else rng.normal(size=3) for _ in range(n)]
        vecs = [None if v is None else v / np.linalg.norm(v) for v in vecs]
        picked = []
        while len(picked) < min(want, n):
            best, top = None, -1e9
            for k in range(n):
                if k in picked:
                    continue
                sims = [float(vecs[k] @ vecs[p]) for p in picked if vecs[p] is not None] if vecs[k] is not None else []
                s = 0.55 * rel[k] - 0.45 * max(sims, default=0.0) - 0.5 * sum(buckets[p] == buckets[k] for p in picked)
                if s > top + 1e-12:
                    best, top = k, s
            picked.append(best)
        assert selection.mmr(rel, vecs, buckets, want, 0.45, True) == picked


def test_everyone():
    rel, people = np.array([0.9, 0.8, 0.1, 0.5]), [{"a"}, {"a"}, {"b"}, set()]
    assert selection.everyone([0, 1], rel, people, ("b", "c")) == ([0, 2], ["c"])
    assert selection.everyone([0], rel, people, ("b",)) == ([0, 2], [])


def test_funnel(spark):
    rows = [(k, DAY + dt.timedelta(seconds=10 * k if k < 4 else 86400 * k), k == 2, None) for k in range(12)]
    a = spark.createDataFrame(rows, "id long, taken timestamp_ntz, favorite boolean, sharpness double")
    v = unit_rows(spark, [(1, 0.01 * k) for k in range(12)])
    picks, stages, why = selection.run(a, v, a, 3, selection.Controls(spread="day"))
    assert [s[1] for s in stages] == [12, 12, 12, 9, 3] and why is None and picks.where("id = 2").count() == 1
    assert selection.run(a, v, a.where("false"), 3)[2] and selection.run(a, v, a, 3, anchor=[-1.0, 0.0])[2]


def test_eviction(spark):
    c = spark.createDataFrame([("a", "v", 50, 1, False), ("b", "v", 50, 2, True), ("c", "v", 50, 3, False), ("d", "v", 50, 4, False)], "asset_id string, version string, bytes long, used int, pinned boolean")
    plan = lambda need, budget, **k: sorted(r["asset_id"] for r in lists.eviction_plan(c, need, budget, **k).collect())
    assert plan(0, 200) == [] and plan(10, 200) == ["a"] and plan(60, 200) == ["a", "c"]
    assert plan(10, 200, keep=("a", "v")) == ["c"]
    out, left, fits = lists.make_room(c, 300, 200)
    assert out.count() == 3 and left.count() == 1 and not fits


def test_lists(spark):
    items = spark.createDataFrame([("t", "a", 1), ("t", "b", 2)], "collection string, asset_id string, position long")
    new = spark.createDataFrame([("t", "b", 1), ("t", "c", 2), ("u", "a", 1)], "collection string, asset_id string, n long")
    assert {(r[0], r[1]): r[2] for r in lists.append(items, new).collect()} == {("t", "a"): 1, ("t", "b"): 2, ("t", "c"): 4, ("u", "a"): 1}
    pages = spark.createDataFrame([("b", k, k) for k in range(1, 6)], "book string, id long, position long")
    order = lambda d: [r["id"] for r in d.orderBy("position").collect()]
    assert order(lists.move(pages, "b", 1, 4)) == [2, 3, 4, 1, 5] and order(lists.move(pages, "b", 5, 2)) == [1, 5, 2, 3, 4]
    assert order(lists.move(pages, "b", 9, 1)) == [1, 2, 3, 4, 5]
    assert [r["position"] for r in lists.renumber(pages.where("id <> 2")).orderBy("id").collect()] == [1, 2, 3, 4]


SIZES = [(2000, 3008), (4032, 3024), (4096, 4096), (3024, 4032), (6000, 3376), (4032, 3024), (2480, 3508), (3840, 2160), (15336, 3876)]


def test_layouts(spark):
    a = np.array([w / h for w, h in SIZES])
    s = layout.justified_slots(a, 1400.0, 933.0, 8.0)
    assert abs((s[:, 2] * s[:, 3]).sum() / (1400 * 933) - 1) < 0.1
    for y in set(np.round(s[:, 1], 6)):
        row = s[np.round(s[:, 1], 6) == y]
        assert abs(row[-1, 0] + row[-1, 2] - 1400) < 1e-6
    assert abs((s[:, 1] + s[:, 3]).max() - 933) < 1e-6
    t = layout.spread_slots(a, 1400.0, 933.0, 8.0)
    assert not any(x < 700 < x + w for x, _, w, _ in t)
    p = layout.scatter_slots(a, 1400.0, 933.0, 8.0)
    assert (p[:, 0] >= 0).all() and (p[:, 0] + p[:, 2] <= 1400).all() and (abs(p[:, 4]) <= 5).all()
    assert (p == layout.scatter_slots(a, 1400.0, 933.0, 8.0)).all()
    d = spark.createDataFrame([(1, k) for k in range(9)], "page long, id long")
    g = layout.grid(d, "page", "id", 1400.0, 933.0, 8.0)
    assert g.first()["cols"] == 3
    assert layout.hero(d.limit(1), "page", "id", 1400.0, 933.0, 8.0).first()["w"] == 1400.0
    assert len(layout.justified_slots(np.array([1.0]), 10.0, 10.0, 1.0)) == 1


def test_crop_holds_faces(spark):
    d = spark.createDataFrame([(4000.0, 2000.0, None, None), (4000.0, 2000.0, 0.0, 0.2), (4000.0, 2000.0, 0.1, 0.9), (1000.0, 1000.0, 0.0, 0.1)], "w double, h double, lo double, hi double")
    c = layout.crop_box(F.col("w"), F.col("h"), F.lit(1.0), F.col("lo"), F.col("hi"), F.col("lo"), F.col("hi"))
    assert [tuple(r[0]) for r in d.select(c).collect()] == [(2000, 2000, 1000, 0), (2000, 2000, 0, 0), (2000, 2000, 1000, 0), (1000, 1000, 0, 0)]


def test_normalised_faces(spark):
    d = spark.createDataFrame([([[0.0, 0.0, 50.0, 50.0], [1.0]], 100, 100), ([[0.0, 0.0, 50.0, 50.0], [0.0, 0.0, 200.0, 50.0]], 100, 100), ([[0.0, 0.0, 50.0, 50.0]], None, 100)], "b array<array<double>>, w int, h int")
    got = [r[0] for r in d.select(layout.normalised_faces(F.col("b"), F.col("w"), F.col("h"))).collect()]
    assert got == [[[0.0, 0.0, 0.5, 0.5]], [], []]


def test_preflight(spark):
    p = preflight.profiles(spark)
    assert {r["profile"]: (r["page_w_px"], r["page_h_px"]) for r in p.collect()}["a4-landscape"] == (3508, 2480)
    rows = [(1, f"s{w}", 0, 0, 3508, 2480, 3508, 2480, w, f) for w, f in ((4032, [[0.4, 0.4, 0.6, 0.6], [0.0, 0.1, 0.2, 0.2]]), (2200, []), (1200, []), (0, [[0.0, 0.0, 1.0, 1.0]]))]
    s = spark.createDataFrame(rows, "page int, id string, x int, y int, w int, h int, laid_w int, laid_h int, source_px int, faces array<array<double>>").crossJoin(p.where("profile = 'a4-landscape'"))
    found = preflight.findings(s)
    assert {(r["id"], r["kind"], r["severity"]) for r in found.collect()} == {("s4032", "trim", "stop"), ("s2200", "resolution", "look"), ("s1200", "resolution", "stop"), ("s0", "resolution", "look")}
    assert preflight.book(found, 5, multiple_of=4).first() == (5, 3, 2, False)
