"""Feeds with failing zones, settings, ranks over ranges, page plans and passes of models."""

import datetime as dt
import io
import json
import os
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.functions import scalars as S
from shoebox.model import SCHEMAS
from shoebox.operators import index, ingest, layout, ranks, selection
from shoebox.operators.components import components, union_find
from shoebox.sources import catalogue as state
from shoebox.sources import feed, settings
from shoebox.streaming import pairing, sync


def write(zone, n, rows):
    zone.mkdir(parents=True, exist_ok=True)
    (zone / f"{n}.json").write_text(rows if isinstance(rows, str) else json.dumps(rows))


def record(name, **more):
    return {"name": name, "type": "CPLAsset", "modified": 1_500_000_000_000, "fields": {"fields": {"masterRef": {"value": {"recordName": "M" + name}}}}} | more


def reader(folder, **options):
    return feed._StreamReader({"path": str(folder), "delays": "", **options})


def read(r, start, end):
    return [x for p in r.partitions(start, end) for x in r.read(pickle.loads(pickle.dumps(p)))]


class SilentFeed(feed.JsonFeed):
    """A zone with a file `silent` gives no tokens."""

    def ends(self, zone, token):
        if os.path.exists(f"{self.root}/{zone}/silent"):
            raise OSError("silent")
        return super().ends(zone, token)

    def pages(self, zone, token):
        for p in super().pages(zone, token):
            READ.append((zone, p[1]))
            yield p


READ = []
SILENT = {"feed": f"{__name__}:SilentFeed"}


def test_replay_ends_where_a_zone_failed_before(tmp_path):
    own, other = tmp_path / "PrimarySync", tmp_path / "SharedSync-1"
    write(own, 0, [record("a"), record("b")])
    write(own, 1, [record("c")])
    write(other, 0, [record("x")])
    (other / "silent").touch()
    r = reader(tmp_path, pages_per_batch="1", **SILENT)
    start = r.initialOffset()
    READ.clear()
    end = r.latestOffset()
    assert list(end["errors"]) == ["SharedSync-1"] and end["tokens"] == {"PrimarySync": "1"} and READ == []  # no page was read for an offset
    first = read(r, start, end)
    assert [(x[0], x[7]) for x in first] == [("a", 0), ("b", 1)]
    assert first[0][3] == dt.datetime(2017, 7, 14, 2, 40, tzinfo=dt.timezone.utc) and first[0][4] == "Ma"
    (other / "silent").unlink()  # the zone answers now, but not in that batch
    assert read(r, start, end) == first
    last = r.latestOffset()
    second = read(r, end, last)
    assert [(x[0], x[7]) for x in second] == [("c", 1 << 24), ("x", 2 << 24)] and last["errors"] == {}
    again = reader(tmp_path, **SILENT)
    assert again.partitions(end, last) == r.partitions(end, last) and again.latestOffset() == last  # a restart goes on behind the last batch
    assert [x[0] for x in read(r, start, last)] == ["a", "b", "c", "x"]
    assert read(r, last, last) == []
    (own / "silent").touch()
    with pytest.raises(feed.FeedError):
        r.latestOffset()
    r = reader(tmp_path, shared="false")
    assert list(r.latestOffset()["tokens"]) == ["PrimarySync"]
    (own / "1.json").unlink()
    with pytest.raises(ValueError):
        r.partitions(start, last)


def test_pages_are_dealt_to_partitions(tmp_path):
    for zone in ("PrimarySync", "SharedSync-1"):
        for k in range(10):
            write(tmp_path / zone, k, [record(f"{zone}{k}-{n}") for n in range(k % 3)])
    r = reader(tmp_path, pages_per_partition="4", first="7")
    start, end = r.initialOffset(), r.latestOffset()
    parts = r.partitions(start, end)
    assert [(p.token, p.count, p.first) for p in parts] == [(None, 4, 7), ("4", 4, 11), ("8", 2, 15), (None, 4, 17), ("4", 4, 21), ("8", 2, 25)]
    rows = read(r, start, end)
    assert len(rows) == 18 and [x[7] for x in rows] == sorted({x[7] for x in rows})


def test_pages_of_a_shared_zone_that_fail_are_read_later(tmp_path):
    own, other = tmp_path / "PrimarySync", tmp_path / "SharedSync-1"
    write(own, 0, [record("a")])
    for k in range(3):
        write(other, k, [record(f"x{k}")])
    write(other, 1, "broken")
    r = reader(tmp_path)
    rows = read(r, r.initialOffset(), r.latestOffset())
    assert [(x[0], x[1]) for x in rows] == [("a", "CPLAsset"), ("x0", "CPLAsset"), (None, feed.ERROR)]
    left = json.loads(rows[2][5])
    assert (left["zone"], left["token"], left["count"], left["first"]) == ("SharedSync-1", "1", 2, 2) and left["error"]
    write(other, 1, [record("x1")])
    late = feed._RangeReader({"path": str(tmp_path), "ranges": json.dumps([left])})
    assert [(x[0], x[7]) for p in late.partitions() for x in late.read(p)] == [("x1", 2 << 24), ("x2", 3 << 24)]
    write(own, 0, "broken")
    with pytest.raises(feed.FeedError):
        read(reader(tmp_path), r.initialOffset(), reader(tmp_path).latestOffset())


def test_stream_restarts_after_a_failing_zone(spark, tmp_path):
    own, other = tmp_path / "feed" / "PrimarySync", tmp_path / "feed" / "SharedSync-1"
    write(own, 0, [record("a")])
    write(other, 0, "broken")
    spark.dataSource.register(feed.ChangeFeed)
    log, check = str(tmp_path / "log"), str(tmp_path / "check")
    go = lambda: sync.sync(spark.readStream.format("change_feed").option("delays", "").load(str(tmp_path / "feed")), log, check)
    go()
    assert [r["name"] for r in sync.records(spark, log).where("name is not null").collect()] == ["a"]
    write(other, 0, [record("x")])
    write(own, 1, [record("a", deleted=True, type=None, fields=None)])
    gaps = [json.loads(r["json"]) for r in sync.records(spark, log).where("name is null").collect()]
    assert sync.fill(spark, log, gaps, {"path": str(tmp_path / "feed"), "delays": ""}, ["SharedSync-1"])["zone SharedSync-1"] == 1
    go()
    got = {r["name"]: (r["zone"], r["deleted"]) for r in sync.current(spark, log)[0].collect()}
    assert got == {"a": ("PrimarySync", True), "x": ("SharedSync-1", False)}
    assert sync.records(spark, log).where("modified is not null").count() == 3


def pairs(k, when=0, **more):
    """A master and its asset."""
    a = record(f"a{k}", fields={"fields": {"masterRef": {"value": {"recordName": f"m{k}"}}, "isFavorite": {"value": when}}}, **more)
    return [a, {"name": f"m{k}", "type": "CPLMaster", "fields": {"fields": {"resOriginalRes": {"value": {"size": 5}}}}}]


def test_runs_say_what_they_did(spark, tmp_path):
    own, other, root = tmp_path / "feed" / "PrimarySync", tmp_path / "feed" / "SharedSync-1", str(tmp_path / "root")
    options = {"path": str(tmp_path / "feed"), "delays": ""}
    value = lambda **f: {"fields": {k: {"value": v} for k, v in f.items()}}
    write(own, 0, pairs(1) + pairs(2) + [{"name": "w", "type": "CPLMemory"}])
    write(own, 1, pairs(3) + [{"name": "r", "type": "CPLContainerRelation", "fields": value(containerId="l", itemId="a1")}, {"name": "p", "type": "CPLPerson", "fields": value(personType=1)}, {"name": "c", "type": "CPLFaceCrop", "fields": value(type=1)}])
    write(other, 0, "broken")
    (tmp_path / "feed" / "albums.json").write_text(json.dumps([{"id": "l", "name": "Trip"}]))
    short = lambda s: {k: v for k, v in s.items() if k not in ("started", "finished", "zones")}
    s = sync.run(spark, options, root)
    none = {"new": 0, "changed": 0, "same": 0, "missing": 0, "relations": 0, "people": 0, "face_crops": 0, "tombstones": 0, "resumed": False, "albums": 1}
    assert short(s) == none | {"mode": "full", "pages": 2, "records": 10, "new": 3, "relations": 1, "people": 1, "face_crops": 1}
    assert s["zones"]["PrimarySync"] == {"records": 10, "new": 3, "shared": False} and "error" in s["zones"]["SharedSync-1"]
    assert s["started"] <= s["finished"] and len(s) == 16
    write(other, 0, pairs(9))
    s = sync.run(spark, options, root)  # the gap is read at last
    assert short(s) == none | {"mode": "changes", "pages": 1, "records": 2, "new": 1} and s["zones"]["SharedSync-1"] == {"records": 2, "new": 1, "shared": True}
    s = sync.run(spark, options, root)
    assert short(s) == none | {"mode": "changes", "pages": 0, "records": 0}
    write(own, 2, pairs(1, 1)[:1] + pairs(2)[:1] + [{"name": "a3", "type": None, "deleted": True}, {"name": "zz", "deleted": True}])
    write(own, 3, pairs(4)[:1])  # waits for its master
    s = sync.run(spark, options, root)
    assert short(s) == none | {"mode": "changes", "pages": 2, "records": 5, "changed": 1, "same": 1, "missing": 1, "tombstones": 2}
    write(own, 4, pairs(4)[1:])
    state.set_meta(spark, root, 2**62, running="1")  # as a run that died leaves it
    assert short(sync.run(spark, options, root)) == none | {"mode": "changes", "pages": 1, "records": 1, "new": 1, "resumed": True}
    rows = {r["id"]: (r["favorite"], r["missing_since"] is not None, r["zone"]) for r in sync.assets(spark, root).collect()}
    assert rows == {"a1": (True, False, "PrimarySync"), "a2": (False, False, "PrimarySync"), "a3": (False, True, "PrimarySync"), "a4": (False, False, "PrimarySync"), "a9": (False, False, "SharedSync-1")}
    whole = {tuple(r) for r in sync.current(spark, f"{root}/log")[0].collect()}
    assert {tuple(r) for r in sync.snapshot(spark, root).collect()} == whole
    before = sync._manifest(spark, root)["buckets"]
    assert len(set(before.values())) > 1 and sync.vacuum(spark, root)
    assert {tuple(r) for r in sync.snapshot(spark, root).collect()} == whole


def test_snapshots_read_only_buckets_of_new_records(spark, tmp_path):
    rnd, root, log = random.Random(8), str(tmp_path), str(tmp_path / "log")
    seq = 0
    for batch in range(4):
        rows = []
        for _ in range(40 if batch == 0 else 3):
            seq += 1
            gone = rnd.random() < 0.3
            rows.append((f"n{rnd.randrange(30)}", None if gone else "CPLAsset", gone, None, None if gone else f"m{rnd.randrange(3)}", None if gone else str(seq), "z", seq))
        spark.createDataFrame(rows, SCHEMAS["records"]).write.parquet(f"{log}/batch={batch}")
        was = sync._manifest(spark, root)["buckets"]
        assert sync.refold(spark, root, log, buckets=16) is not None
        now = sync._manifest(spark, root)["buckets"]
        names = {r[0] for r in spark.createDataFrame(rows, SCHEMAS["records"]).select((F.pmod(F.xxhash64("name"), F.lit(16))).cast("string")).collect()}
        assert {b for b in now if now[b] != was.get(b)} == names
        assert {tuple(r) for r in sync.snapshot(spark, root).collect()} == {tuple(r) for r in sync.current(spark, log)[0].collect()}
    assert sync.refold(spark, root, log) is None


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_pairs_like_a_fold_of_the_log(spark, tmp_path, seed):
    rnd, rows = random.Random(seed), []
    for q in range(150):
        k, kind = rnd.randrange(20), rnd.random()
        if kind < 0.4:
            rows.append((f"M{k % 8}", "CPLMaster", False, None, None, f"m{q}", "z", q))
        elif kind < 0.6:
            rows.append((rnd.choice([f"M{k % 8}", f"A{k}"]), None, True, None, None, None, None, q))
        else:  # an asset may move to another master, or name none
            rows.append((f"A{k}", "CPLAsset", False, None, rnd.choice([f"M{rnd.randrange(8)}", None]) if rnd.random() < 0.3 else f"M{k % 8}", f"a{q}", "z", q))
    d = spark.createDataFrame(rows, SCHEMAS["records"])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        cuts = [0, *sorted(rnd.sample(range(1, 150), 2)), 150]
        for a, b in zip(cuts, cuts[1:]):
            d.where(f"seq >= {a} and seq < {b}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            changes = pairing.paired(spark.readStream.schema(SCHEMAS["records"]).parquet(f"{tmp_path}/in"))
            changes.writeStream.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
            now = {tuple(r) for r in pairing.latest(spark.read.parquet(f"{tmp_path}/out")).select("name", "json", "master_id", "master_json").collect()}
            want = {tuple(r) for r in ingest.pair(ingest.fold_records(d.where(f"seq < {b}"))).select("name", "json", "master_id", "master_json").collect()}
            assert now == want and want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_listings_and_retries(spark, tmp_path):
    for z in ("SharedSync-1", "PrimarySync"):
        (tmp_path / z).mkdir()
    f = feed.opened({"path": str(tmp_path)})
    assert [tuple(r) for r in feed.zone_listing(spark, f).collect()] == [(0, "PrimarySync", False), (1, "SharedSync-1", True)]
    assert feed.album_listing(spark, f).count() == 0
    (tmp_path / "albums.json").write_text(json.dumps([{"id": "1", "name": "Trip"}]))
    assert feed.album_listing(spark, f).first() == ("1", "Trip", "Trip")
    calls, slept = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("later")
        return 7

    assert feed.retried(call, "x", (1, 3), slept.append) == 7 and slept == [1, 3]
    with pytest.raises(feed.FeedError, match="x: no answer in 2 attempts"):
        feed.retried(lambda: 1 / 0, "x", (1,), slept.append)

    def refused():
        raise feed.FeedError("no")

    with pytest.raises(feed.FeedError, match="^no$"):
        feed.retried(refused, "x", (1,), slept.append)
    assert slept == [1, 3, 1] and feed.DELAYS == (2, 5, 15, 45, 120)


def test_settings(tmp_path, spark):
    assert settings.load(tmp_path / "none.toml") == settings.Settings()
    s = settings.Settings().changed("cache_budget_mb", "5").changed("shared_zones", "no").changed("source", 'a "b"')
    settings.save(s, tmp_path / "x" / "s.toml")
    assert settings.load(tmp_path / "x" / "s.toml") == s and s.cache_budget == 5 << 20
    with pytest.raises(KeyError):
        s.changed("nope", "1")
    d, out = spark.range(2), io.StringIO()
    assert settings.emit(d, out) == 2 and settings.emit(d, out, lambda r: f"no {r['id']}") == 2
    assert out.getvalue().split("\n") == ['{"id":0}', '{"id":1}', "no 0", "no 1", ""]


def test_cursors_and_dates():
    for place in ((None, 7), ("2019-07-20 12:00:00", "A/x+y=&ü"), ("2019-07-20 12:00:00.5", 0)):
        assert S.decode_cursor(S.encode_cursor(*place)) == place
    for bad in ("", "x", "n=1&t=2", "n=x", "%"):
        with pytest.raises(ValueError):
            S.decode_cursor(bad)
    assert S.parse_date("2020-1").month == 1 and S.parse_date("2020-12", end=True).year == 2021 and S.parse_date("2020-2-9", end=True).day == 10


def test_ranges_number_the_whole_table(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([None, rnd.randrange(400)]), rnd.randrange(9)) for k in range(500)]
    d = spark.createDataFrame(rows, "id long, t long, v long").repartition(7)
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    got = {r["id"]: r["n"] for r in ranks.numbered(d, "n", F.asc_nulls_last("t"), F.asc("id")).collect()}
    assert got == {r[0]: k for k, r in enumerate(want, 1)}
    sums, total = {}, 0
    for k, _, v in want:
        sums[k] = total
        total += v
    assert {r["id"]: r["s"] for r in ranks.summed_before(d, "v", "s", F.asc_nulls_last("t"), F.asc("id")).collect()} == sums
    assert ranks.numbered(d.limit(0), "n", F.asc("id")).count() == 0


def test_places_within_hot_groups(spark):
    rnd = random.Random(5)
    rows = [(k, rnd.choice([1, 1, 1, 1, 2, 3, None]), rnd.randrange(50)) for k in range(600)]
    d = spark.createDataFrame(rows, "id long, g long, v long").repartition(6)
    want = {}
    for g in (1, 2, 3, None):
        want |= {r[0]: n for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])), 1)}
    assert {r["id"]: r["n"] for r in ranks.numbered_within(d, "n", "g", F.asc("v"), F.asc("id")).collect()} == want


def test_sessions_of_the_whole_table(spark):
    rnd = random.Random(3)
    at = dt.datetime(2020, 1, 1)
    rows = [(k, None if k % 40 == 0 else at + dt.timedelta(seconds=rnd.randrange(20_000))) for k in range(400)]
    want, n, last = {}, 0, None
    for k, t in sorted(rows, key=lambda r: (r[1] is None, r[1] or at, r[0])):
        if last is None or t is None or (t - last).total_seconds() > 90:
            n += 1
        want[k], last = n, t
    d = spark.createDataFrame(rows, "id long, taken timestamp_ntz").repartition(5)
    assert {r["id"]: r["session"] for r in selection.sessions(d).collect()} == want


def test_components_in_rounds(spark):
    rnd = random.Random(4)
    for edges in ([(k, k + 1) for k in range(600)], [(9, k) for k in range(600)], [(rnd.randrange(900), rnd.randrange(900)) for _ in range(500)], [(-5, 2**62), (1, 1)]):
        root = {k: k for e in edges if e[0] != e[1] for k in e}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            if a != b:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
        got = components(spark.createDataFrame(edges, "a long, b long"), task_edges=100)
        assert {r["node"]: r["label"] for r in got.collect()} == {k: find(k) for k in root}
    nodes, roots = union_find(np.array([1, 2, 8]), np.array([2, 3, 9]))
    assert len(set(roots[:3])) == 1 and len(set(roots[3:])) == 1 and nodes.tolist() == [1, 2, 3, 8, 9]


def test_rows_are_balanced():
    def plain(aspects, rows):
        out, row, total, done = [], [], sum(aspects), 0.0
        for k, a in enumerate(aspects):
            row.append(k)
            done += a
            to_come, left = rows - len(out) - 1, len(aspects) - k - 1
            if to_come and left >= to_come and (left == to_come or done >= (len(out) + 1) * total / rows):
                out.append(row)
                row = []
        return [r[0] for r in [*out, row]]

    rng = np.random.default_rng(6)
    for _ in range(300):
        a = rng.integers(1, 25, int(rng.integers(1, 12))) / 8  # sums without rounding
        for rows in range(1, len(a) + 1):
            assert layout.balanced_rows(a, rows).tolist() == plain(a.tolist(), rows)
    assert layout.balanced_rows(np.ones(2), 3) is None


def test_everyone_against_a_plain_loop():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        rel, people = np.round(rng.random(n), 1), [{p for p in "abc" if rng.random() < 0.4} for _ in range(n)]
        picked = [int(k) for k in rng.permutation(n)[: rng.integers(1, n + 1)]]
        out, absent = list(picked), []
        for p in "bcd":
            if any(p in people[k] for k in out):
                continue
            rows = sorted((k for k in range(n) if p in people[k]), key=lambda k: (-rel[k], k))
            if not rows:
                absent.append(p)
                continue
            free = [i for i, k in enumerate(out) if all(sum(q in people[o] for o in out) > 1 for q in people[k])]
            if free:
                out[min(free, key=lambda i: (rel[out[i]], i))] = rows[0]
            else:
                out.append(rows[0])
        assert selection.everyone(picked, rel, people, tuple("bcd")) == (out, absent)


def test_kernels_of_many_pages(spark):
    rows = [(None if k % 10 == 9 else k % 10, k, None if k % 7 == 0 else 0.5 + k % 5) for k in range(95)]
    d = spark.createDataFrame(rows, "page long, id long, aspect double")
    for name, kernel in layout.KERNELS.items():
        got = {}
        for r in layout.by_page(d, name, "page", "id", "aspect", 1400.0, 933.0, 8.0).collect():
            got[r["page"], r["id"]] = (r["x"], r["y"], r["w"], r["h"], r["rotate"], r["mount"])
        assert len(got) == 95
        for page in [None, *range(9)]:
            own = [(i, 1.0 if a is None else a) for p, i, a in rows if p == page]
            s = kernel(np.array([a for _, a in own]), 1400.0, 933.0, 8.0)
            for (i, _), w in zip(own, s.tolist(), strict=True):
                assert got[page, i][: len(w)] == tuple(w)


def test_plan_leaves_room_for_a_caption(spark):
    d = spark.createDataFrame([(1, k, 400 + k, 300, [[0.0, 0.0, 0.1, 0.1]]) for k in range(5)], "page long, id long, width int, height int, faces array<array<double>>")
    for template in ("justified", "grid", "hero", "filmstrip", "scatter"):
        got = layout.plan(d, template, "page", "id", long_edge=1000, caption="x").collect()
        assert len(got) == 5 and all(r["page_w"] == 1000 and r["band"] == 45 and r["y"] + r["h"] <= r["page_h"] - 45 + 1 for r in got)
        assert all(r["crop"]["w"] <= 400 + r["id"] and r["crop"]["h"] <= 300 and (r["crop"]["x"], r["crop"]["y"]) == (0, 0) for r in got)


def test_index_pass(spark):
    none = {"faces": "id long, asset_id string, box array<int>, det double, age int, gender int, embedding array<float>, source string, person_id string, similarity double, assigned string", "index_state": "asset_id string, clip_model string, face_model string, source string, indexed timestamp, faces int", "clip": "asset_id string, embedding array<float>", "person_seeds": "id string, person_id string, embedding array<float>"}
    tables = {k: spark.createDataFrame([], v) for k, v in none.items()}
    tables["faces"] = spark.createDataFrame([(4, "b", None, 1.0, None, None, [1.0, 0.0], "thumb", None, None, None), (5, "b", None, 1.0, None, None, [1.0, 0.0], "thumb", "q", None, "user")], none["faces"])
    tables["person_seeds"] = spark.createDataFrame([("s", "p", [1.0, 0.0])], none["person_seeds"])
    pictures = spark.createDataFrame([("a", bytearray(b"2"), "thumb"), ("b", bytearray(b"0"), "medium"), ("c", bytearray(b"x"), "thumb")], "asset_id string, data binary, version string")

    def embed(data):
        return [[float(int(d)) + 1, 0.0] for d in data]

    def detect(data):
        return [[{"box": [0, 0, 1, 1], "det": 0.5, "age": None, "gender": None, "embedding": [1.0, 0.0]}] * int(d) for d in data]

    got = index.run(pictures, tables, embed, detect, "m", "f", 0.5, dt.datetime(2020, 1, 1))
    assert {r["asset_id"]: r["embedding"] for r in got["clip"].collect()} == {"a": [1.0, 0.0], "b": [1.0, 0.0]}
    assert sorted((r["id"], r["asset_id"], r["person_id"], r["assigned"]) for r in got["faces"].collect()) == [(5, "b", "q", "user"), (6, "a", "p", "auto"), (7, "a", "p", "auto")]
    assert {r["asset_id"]: (r["faces"], r["source"]) for r in got["index_state"].collect()} == {"a": (2, "thumb"), "b": (0, "medium")}
    versions = spark.createDataFrame([("a", "m", None, {"thumb": (1, 1, 1, "jpeg", None)}), ("b", "m", None, {"original": (9 << 20, 1, 1, "heic", None)})], "id string, master_id string, zone string, versions map<string, struct<bytes: bigint, width: int, height: int, type: string, filename: string>>")
    assert [(r["id"], r["version"]) for r in index.todo(versions).collect()] == [("a", "thumb")]


def test_laplacian():
    flat, sharp = np.full((20, 20), 7), np.indices((20, 20)).sum(axis=0) % 2 * 255
    assert index.laplacian(flat) == 0 and index.laplacian(sharp) > 1e5


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from shoebox.session import shared_folder

    named = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: folder), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(named("spark://x", "s3://b/c/")) == "s3://b/c" and shared_folder(named("local[2]", None)).startswith("file://")
    with pytest.raises(RuntimeError):
        shared_folder(named("spark://x", None))
