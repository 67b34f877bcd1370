"""Queries over whole libraries: pruned joins and indices, bursts, snapshots, exports that are run twice, measured pictures.

The same stand-ins as in `queries` and `state`.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import faces, index, ingest, layout, lists, pivots, preflight, ranks, search, selection, summaries, vectors
from ..session import shared_folder
from ..sources import export
from ..streaming import sync
from .queries import _BASE, _DOT, _EDGES, _FACES, _PHOTOS, ASSETS, _cache, _faces, _photos, _pool, assets, first_vector, query, table, vecs
from .state import NOW, _library, _log


def _folder(spark: SparkSession) -> str:
    """A folder of this query's own in the shared one, which goes with the driver."""
    path = f"{shared_folder(spark)}/shoebox/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


# --- vectors --------------------------------------------------------------------------


@query(f"select * from {_EDGES}")
def sim_edges_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The similarity join by blocks that pivots admit."""
    return vectors.sim_edges(vecs(spark, sf), 0.4, "id", block=256, count=8)


@query(f"select source, target, score, rn from (select *, row_number() over (partition by source order by score desc, target) rn from (select a source, b target, score from {_EDGES} union all select b, a, score from {_EDGES})) where rn <= 2")
def top_edges(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.top_edges(vecs(spark, sf), 0.4, "id", 2)


@query(f"select b.vec_id as id, {_DOT} as score from embeddings a, embeddings b where a.vec_id = 0 order by score desc, id limit 200")
def knn_index(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest neighbours from an index that is written and then read by block."""
    path = _folder(spark)
    pivots.build(vecs(spark, sf), path, "id", count=16, block=128)
    return pivots.search(spark, path, first_vector(spark, sf), 200)[0].withColumnRenamed("key", "id")


@query(f"select anchor, key, score, rn from (select a.vec_id as anchor, b.vec_id as key, {_DOT} as score, row_number() over (partition by a.vec_id order by {_DOT} desc, b.vec_id) as rn from embeddings a, embeddings b where a.vec_id < 5) where rn <= 20")
def knn_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Several anchors in one scan."""
    anchors = [r[0] for r in vecs(spark, sf).where("id < 5").orderBy("id").select("embedding").collect()]
    return pivots.nearest_many(vecs(spark, sf), anchors, 20, "id").withColumn("anchor", F.col("anchor").cast("long"))


# --- bursts ---------------------------------------------------------------------------


def _bursts(same: float, within: int) -> str:
    """The greedy collapse row by row, newest first; the state is the list of groups."""
    group = lambda *x: "{" + ", ".join(f"'{k}': {v}" for k, v in zip(("id", "first_id", "members", "tm", "e", "q"), x, strict=True)) + "}"
    none = group("-1::bigint", "-1::bigint", "0::bigint", "0.0::double", "list_value(0.0::double)", "0.0::double")
    near = f"list_filter(g, lambda x: abs(x.tm - r.tm) <= {within} and list_dot_product(x.e, r.e) >= {same})[1].first_id"
    better, other = group("id", "x.first_id", "x.members + 1", "tm", "e", "q"), group("x.id", "x.first_id", "x.members + 1", "x.tm", "x.e", "x.q")
    return (
        f"with recursive r as materialized (select row_number() over (order by taken desc, id desc) as n, id, epoch_us(taken) / 1e6 as tm, e, q from {_BASE}),"
        f" step as (select 0::bigint as n, list_value({none})[2:] as g union all select n, case when hit is null then list_append(g, {group('id', 'id', '1::bigint', 'tm', 'e', 'q')})"
        f" else list_transform(g, lambda x: case when x.first_id <> hit then x when q > x.q then {better} else {other} end) end"
        f" from (select r.n, g, r.id, r.tm, r.e, r.q, {near} as hit from step join r on r.n = step.n + 1))"
        " select x.id, x.first_id, x.members from (select unnest(g) as x from step where n = (select max(n) from r))"
    )


@query(_bursts(selection.SAME, selection.WITHIN))
def burst_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts of the whole library: the best row, the first one and how many."""
    return selection.collapse_library(_pool(spark, sf))


@query(_bursts(0.2, 3600))
def burst_groups_wide(spark: SparkSession, sf: str) -> DataFrame:
    """With looser limits, so that rows of the tables do collapse."""
    return selection.collapse_library(_pool(spark, sf), same=0.2, within=3600)


@query(f"select b.id, r.pool_rn from ({_bursts(selection.SAME, selection.WITHIN)}) b join (select id, row_number() over (order by taken desc, id desc) as pool_rn from {_BASE}) r on r.id = b.first_id")
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """The best row of each burst at the place of its first one, newest first."""
    pool = _pool(spark, sf)
    return selection.collapse_library(pool).join(pool.select(F.col("id").alias("first_id"), "pool_rn"), "first_id").select("id", "pool_rn")


# --- snapshots ------------------------------------------------------------------------


@query(
    f"select 'A' || o_orderkey as name, '{ingest.ASSET}' as type, o_orderstatus = 'P' as deleted, o_orderkey * 10 + case when o_orderstatus = 'P' then 5 else 0 end as seq from orders"
    f" union all select 'M' || o_orderkey, '{ingest.MASTER}', false, o_orderkey * 10 + 1 from orders"
    f" union all select 'R' || o_orderkey, '{ingest.RELATION}', o_orderkey % 3 = 0, o_orderkey * 10 + case when o_orderkey % 3 = 0 then 6 else 2 end from orders"
    f" union all select 'F' || o_orderkey, '{ingest.CROP}', false, o_orderkey * 10 + 3 from orders"
    f" union all select 'P' || c_custkey, '{ingest.PERSON}', c_acctbal < 0, c_custkey + case when c_acctbal < 0 then 1000000000000 else 0 end from customer"
)
def fold_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The log in two batches, each merged into a snapshot by buckets of names."""
    path, log = _folder(spark), _log(spark, sf)
    for number, part in enumerate((log.where("seq % 10 < 5"), log.where("seq % 10 >= 5"))):
        part.write.option("compression", "zstd").parquet(f"{path}/log/batch={number}")
        sync.refold(spark, path, f"{path}/log", buckets=8)
        sync.vacuum(spark, path)
    return sync.snapshot(spark, path).select("name", "type", "deleted", "seq")


# --- export ---------------------------------------------------------------------------


def _exported(spark: SparkSession, sf: str, rows: DataFrame) -> dict[str, DataFrame]:
    """The library of some orders as assets, their lines as faces, suppliers as people, customers as collections."""
    line = _faces(spark, sf)
    rendition = F.struct(F.lit(1).cast("long").alias("bytes"), F.lit(40).alias("width"), F.lit(30).alias("height"))
    a = rows.select(
        F.col("id").cast("string").alias("id"), "filename", F.lit("image").alias("kind"), F.col("taken").cast("timestamp").alias("taken"), F.col("taken").cast("timestamp").alias("added"), F.lit(40).alias("width"), F.lit(30).alias("height"), "bytes",
        F.lit(False).alias("favorite"), F.lit(False).alias("hidden"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), F.lit(None).cast("timestamp").alias("missing_since"),
        F.create_map(F.lit("original"), rendition, F.lit("thumb"), rendition).alias("versions"),
    )
    f = line.select("id", F.col("asset_id").cast("string").alias("asset_id"), F.array(F.lit(0), F.lit(0), (F.col("id") % 7 + 1).cast("int"), F.lit(2)).alias("box"), "det", F.lit("thumb").alias("source"), F.array(F.lit(1.0)).alias("embedding"), "person_id")
    return {
        "assets": a, "faces": f, "people": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("display_name")),
        "cache": a.where("bytes % 2 = 0").select(F.col("id").alias("asset_id"), F.lit("thumb").alias("version"), F.concat(F.lit("t"), "id").alias("path")), "index_state": a.select(F.col("id").alias("asset_id")),
        "collections": table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.lit(NOW).cast("timestamp").alias("created")),
        "collection_assets": table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("collection"), F.col("o_orderkey").cast("string").alias("asset_id"), F.col("o_orderkey").alias("position")),
    }


_TWICE = (
    "with runs as (select o_orderkey::varchar as id, '/lib/' || strftime(o_orderdate, '%Y/%m') as path, o_orderkey % 2 = 0 as one, o_orderstatus <> 'P' as two, floor(o_totalprice)::bigint as bytes, c_name, '/lib/' || strftime(o_orderdate, '%Y/%m') || '/' || o_orderkey || '@' || o_orderpriority as file from orders left join customer on c_custkey = o_custkey),"
    " f1 as (select file, row_number() over (order by file) as k from runs where one), f as (select * from f1 union all select file, (select count(*) from f1) + row_number() over (order by file) from runs where two and not one),"
    " p1 as (select distinct path from (select path from runs where one union all select path[:-4] from runs where one union all select '/lib')), p2 as (select distinct path from (select path from runs where two union all select path[:-4] from runs where two) where path not in (select path from p1)),"
    " p as (select path, row_number() over (order by path) as k from p1 union all select path, (select count(*) from p1) + row_number() over (order by path) from p2),"
    f" seen as (select l.*, runs.one, runs.two, s_name from {_FACES} l join runs on runs.id = l.asset_id::varchar left join supplier on s_suppkey = person_id),"
    " n1 as (select distinct s_name from seen where one and s_name is not null), n as (select s_name, row_number() over (order by s_name) as k from n1 union all select s_name, (select count(*) from n1) + row_number() over (order by s_name) from (select distinct s_name from seen where two and s_name is not null and s_name not in (select s_name from n1))),"
    " c as (select c_name, row_number() over (order by c_name) as k from customer), t1 as (select f.k from runs join f using (file) where one and bytes % 2 = 0),"
    " t as (select k, row_number() over (order by k::varchar) as tk from t1 union all select k, (select count(*) from t1) + row_number() over (order by k::varchar) from (select f.k from runs join f using (file) where two and bytes % 2 = 0) where k not in (select k from t1))"
    " select 'file' as what, f.k as id, p.k as parent from runs join f using (file) join p using (path) where two"
    " union all select 'thumb', t.tk, f.k from runs join f using (file) join t on t.k = f.k where two and bytes % 2 = 0"
    " union all select 'face', n.k, f.k from seen join runs using (id) join f using (file) left join n using (s_name) where false"
    " union all select 'item', c.k, f.k from runs join f using (file) join c using (c_name) where two"
    " union all select 'person', k, null from n where s_name in (select s_name from seen where two)"
    " union all select 'loose', 0, 0 where false"
)


@query(_TWICE)
def export_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of a second export, after assets came and went; `loose` are keys that lead to no row."""
    a = assets(spark, sf)
    keys = export.first_keys(_exported(spark, sf, a.where("id % 2 = 0")), "/lib", NOW)
    out, _ = export.library(_exported(spark, sf, a.where("kind <> 'P'")), "Album", "/lib", NOW, keys)
    pick = lambda t, what, id_, parent: out[t].select(F.lit(what).alias("what"), F.col(id_).cast("long").alias("id"), parent.cast("long").alias("parent"))
    loose = lambda t, key, to: out[t].where(F.col(key).isNotNull()).join(out[to].select(F.col("id").alias(key)), key, "left_anti").select(F.lit("loose").alias("what"), F.col(key).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"))
    parts = [pick("afiles", "file", "id", F.col("folder_id")), pick("athumbs", "thumb", "id", F.col("file_id")), pick("acollections_files", "item", "collection_id", F.col("file_id")), pick("persons", "person", "id", F.lit(None))]
    parts += [loose(*x) for x in (("afiles", "folder_id", "afolders"), ("athumbs", "file_id", "afiles"), ("faces", "file_id", "afiles"), ("faces", "person_id", "persons"), ("persons", "cover_face_id", "faces"), ("acollections_files", "file_id", "afiles"), ("acollections_files", "collection_id", "acollections"))]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


# --- pictures -------------------------------------------------------------------------


def _cell(i: str, j: str) -> str:
    edge = lambda x: f"(case when {x} = -1 then 1 when {x} = 8 then 6 else {x} end)"
    return f"p[{edge(i)} * 8 + {edge(j)} + 1]"


_SHARP = (
    "(select vec_id as id, list_var_pop(list_transform(range(64), lambda k: "
    + " + ".join(_cell(f"(k // 8 + {i})", f"(k % 8 + {j})") for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1)))
    + " - 4 * p[k + 1])) as sharpness from (select vec_id, list_transform(embedding, lambda x: (floor(x::double * 100) + 128)::bigint) as p from embeddings))"
)


def _pictures(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as grey pictures of 8 x 8 pixels."""
    pixel = F.transform("embedding", lambda x: F.lpad(F.hex(F.floor(x.cast("double") * 100) + 128), 2, "0"))
    return vecs(spark, sf).select(F.col("id").alias("asset_id"), F.unhex(F.array_join(pixel, "")).alias("data"))


def _grey(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, 8)


@query(f"select id, round(sharpness, 6) as sharpness from {_SHARP}")
def sharpness_measured(spark: SparkSession, sf: str) -> DataFrame:
    return index.sharpness(_pictures(spark, sf), _grey).select(F.col("asset_id").alias("id"), F.round("sharpness", 6).alias("sharpness"))


_FOCUSED = f"(select s.id, 0.45 * (1 / (1 + exp(-(log10(greatest(sharpness, 1.0)) - 2.08) * 3.2))) + 0.55 * (case when event_type = 'click' then 1.0 else 0.0 end) as q from {_SHARP} s join events on event_id = s.id)"


@query(
    f"with f as (select * from {_FOCUSED}), m as (select count(*) as n, count(*) filter (q >= {selection.SOFT}) as sharp from f) select 0::bigint as place, 'library' as stage, n as kept, '' as note from m union all select 1, 'filters', n, (select count(*) from events where event_type = 'view' and event_id in (select vec_id from embeddings)) || ' screen captures set aside' from m"
    f" union all select 2, 'pool', n, '' from m union all select 3, 'near-duplicates', n, '0 near copies set aside' from m union all select 4, 'sharp only', case when sharp > 0 then sharp else n end, case when sharp > 0 then '' else 'nothing was sharp; kept all' end from m union all select 5, 'variety', least(70, case when sharp > 0 then sharp else n end), '' from m"
)
def funnel_measured(spark: SparkSession, sf: str) -> DataFrame:
    """The funnel with sharpness from pictures, and its notes; views stand for screen captures beside the library."""
    d = index.with_sharpness(_pool(spark, sf).select("id", "taken", "favorite"), index.sharpness(_pictures(spark, sf), _grey))
    views = table(spark, sf, "events").where("event_type = 'view'").select(F.col("event_id").alias("id")).join(d.select("id"), "id", "left_semi")
    _, stages, _ = selection.run(d, vecs(spark, sf), d, 70, selection.Controls(sharp_only=True), with_captures=d.select("id").unionAll(views))
    return spark.createDataFrame([(k, n, c, note) for k, (n, c, note) in enumerate(stages)], "place long, stage string, kept long, note string")


# --- caches and lists -----------------------------------------------------------------


@query(f"select id as asset_id, row_number() over (order by taken, id, kind) as by_use, row_number() over (order by id, kind) as by_asset from {ASSETS} where filename <> '1-URGENT'")
def cache_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Unpinned entries in both orders of the listing."""
    both = []
    for oldest, name in ((True, "by_use"), (False, "by_asset")):
        rows = lists.cache_rows(_cache(spark, sf), unpinned_only=True, oldest_first=oldest)
        order = ([F.asc("used")] if oldest else []) + [F.asc("asset_id"), F.asc("version")]
        both.append(ranks.numbered(rows, name, *order).select("asset_id", name))
    return both[0].join(both[1], "asset_id")


@query(
    f"with c as (select id, kind, bytes, filename = '1-URGENT' as pinned, taken from {ASSETS}), two as (select min(id) as dead, min(id) filter (id % 5 > 0) as live from c) select c.id as asset_id, case when c.id = two.live then timestamp '2000-01-01' else taken end as used from c, two where c.id % 5 > 0 or c.id <> (select min(id) from c where id % 5 = 0)"
)
def cache_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """A look at an entry whose file is gone, and at one whose file is there."""
    c = _cache(spark, sf).withColumn("path", F.concat(F.lit("p"), F.col("asset_id")))
    there = c.where("asset_id % 5 > 0").select("path")
    dead = c.where("asset_id % 5 = 0").orderBy("asset_id").first()
    live = c.where("asset_id % 5 > 0").orderBy("asset_id").first()
    when = NOW.replace(tzinfo=None)
    gone, c = lists.cached(c, dead.asset_id, dead.version, there, when)
    hit, c = lists.cached(c, live.asset_id, live.version, there, when)
    assert gone.isEmpty() and not hit.isEmpty()
    return c.select("asset_id", "used")


@query(f"select count(*) as files, sum(bytes)::bigint as bytes, (sum(bytes) filter (filename = '1-URGENT'))::bigint as pinned_bytes, 1000000000 as budget, greatest(1000000000 - sum(bytes), 0)::bigint as free from {ASSETS}")
def cache_budget(spark: SparkSession, sf: str) -> DataFrame:
    d = summaries.usage(_cache(spark, sf), 1_000_000_000)
    return d.select("files", F.col("bytes").cast("long").alias("bytes"), F.col("pinned_bytes").cast("long").alias("pinned_bytes"), F.col("budget").cast("int").alias("budget"), F.col("free").cast("long").alias("free"))


@query(
    f"with new as (select owner, id, row_number() over (partition by owner order by id) as position from {ASSETS} where kind = 'O'), old as (select owner, id, row_number() over (partition by owner order by id) as position from {ASSETS} where kind = 'F') select owner as collection, id as asset_id, position from old where owner <> 1 and id % 7 > 0 union all select owner, id, position from new where owner = 1"
)
def collection_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """One collection filled anew instead of appended to; every seventh item removed."""
    a = assets(spark, sf)
    items = lambda kind, name: ranks.numbered_within(a.where(F.col("kind") == kind).select(F.col("owner").alias("collection"), F.col("id").alias("asset_id")), name, "collection", F.asc("asset_id"))
    old = lists.remove(items("F", "position"), a.where("id % 7 = 0").select(F.col("id").alias("asset_id")), ["asset_id"])
    return lists.fill(old, items("O", "n").where("collection = 1"), 1, replace=True).select("collection", "asset_id", "position")


@query("select p_partkey as id, p_size as position from part where p_brand = (select min(p_brand) from part)")
def pages_of_a_book(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("book"), F.col("p_size").alias("position"))
    return lists.children(p, "book", p.agg(F.min("book")).first()[0], "position", "id").select("id", "position")


@query(f"with g as (select person_id as cluster, id from {_FACES} where person_id is not null) select id, case when cluster = 3 then 'Ann' end as person_id, case when cluster = 3 then 'cluster' end as assigned from g")
def group_named(spark: SparkSession, sf: str) -> DataFrame:
    """A group gets a name, another one gets it and loses it again."""
    f = _faces(spark, sf).where("person_id is not null").select("id", "asset_id", F.col("person_id").alias("cluster"), F.lit(None).cast("string").alias("person_id"), F.lit(None).cast("string").alias("assigned"), F.lit(None).cast("double").alias("similarity"), F.array(F.lit(1.0)).alias("embedding"), "det")
    seeds = spark.createDataFrame([], "id string, person_id string, embedding array<double>, det double, origin string")
    a = assets(spark, sf).select("id", "taken")
    f, seeds = faces.name_group(f, seeds, a, 3, "Ann")
    f, seeds = faces.name_group(f, seeds, a, 4, "Ben")
    f, seeds = faces.unname_group(f, seeds, 4)
    return f.select("id", "person_id", "assigned")


@query("select trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-')[1:40] as slug, count(*) as n from part group by 1")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(S.slug(F.col("p_name")).alias("slug")).agg(F.count("*").alias("n"))


@query("select o_orderkey as id from orders where o_orderpriority <> '5-LOW' and o_orderstatus <> 'P' and o_orderkey % 3 = 0")
def search_favourites(spark: SparkSession, sf: str) -> DataFrame:
    """Filters leave hidden and missing assets out unless told otherwise."""
    return search.apply_filters(_library(spark, sf), search.Filters(favorite=True)).select("id")


# --- pages ----------------------------------------------------------------------------

_PLACE = "(id % 10) * 0.1::double"


def _faced(spark: SparkSession, sf: str) -> DataFrame:
    """Photographs with a face each, a tenth of the frame wide, in pixels."""
    at = (F.col("id") % 10) * 0.1
    return _photos(spark, sf).withColumn("box", F.array(F.array(at * F.col("pw"), F.col("ph") * 0.4, (at + 0.1) * F.col("pw"), F.col("ph") * 0.6)))


@query(
    f"with s as (select page, id, pw, {_PLACE} as a, round_even(1400.0::double / 1400 * 4961, 0) as slot from {_PHOTOS}), d as (select *, pw / (slot / 4961 * 420.0 / 25.4) as dpi from s)"
    " select page, id, 'resolution' as kind, case when dpi < 150 then 'stop' else 'look' end as severity from d where dpi < 220"
    " union all select page, id, case when a < 8.0 / 420 or a + 0.1 > 1 - 8.0 / 420 then 'trim' else 'gutter' end, case when a < 8.0 / 420 or a + 0.1 > 1 - 8.0 / 420 then 'stop' else 'look' end from d where a < 8.0 / 420 or a + 0.1 > 1 - 8.0 / 420 or (a < 0.5 + 6.0 / 420 and a + 0.1 > 0.5 - 6.0 / 420)"
)
def gutter_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Faces of a spread that the trim or the spine may take."""
    d = _faced(spark, sf)
    slots = d.select("page", "id", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(1400).alias("w"), F.lit(990).alias("h"), F.lit(1400).alias("laid_w"), F.lit(990).alias("laid_h"), F.col("pw").alias("source_px"), layout.normalised_faces(F.col("box"), F.col("pw"), F.col("ph")).alias("faces"))
    p = preflight.profiles(spark).where("profile = 'a4-spread'")
    return preflight.findings(slots.join(F.broadcast(p))).select("page", "id", "kind", "severity")  # one profile


@query(
    f"with d as (select page, id, pw / (4961.0::double / 4961 * 420.0 / 25.4) as dpi, {_PLACE} as a from {_PHOTOS}), f as (select count(*) filter (dpi < 150) + count(*) filter (a < 8.0 / 420 or a + 0.1 > 1 - 8.0 / 420) as stop, count(*) filter (dpi >= 150 and dpi < 220) + count(*) filter (not (a < 8.0 / 420 or a + 0.1 > 1 - 8.0 / 420) and a < 0.5 + 6.0 / 420 and a + 0.1 > 0.5 - 6.0 / 420) as look from d)"
    f" select n as pages, stop + 1 + case when n % 4 > 0 then 1 else 0 end as stop, look, false as ready from f, (select count(distinct page) as n from {_PHOTOS})"
)
def book_report(spark: SparkSession, sf: str) -> DataFrame:
    """What a shop that prints books of a million pages at least, in fours, would say."""
    found = gutter_findings(spark, sf)
    return preflight.book(found, _photos(spark, sf).select("page").distinct().count(), multiple_of=4, minimum=1_000_000)


@query(f"select id, case when id % 7 = 0 then 0 else 1 end::bigint as faces, case when id % 7 > 0 then round(least(greatest({_PLACE}, 0), 1), 9) end as first from {_PHOTOS}")
def faces_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes as fractions; those of every seventh picture are in pixels of a larger one, so none counts."""
    d = _faced(spark, sf).withColumn("pw", F.when(F.col("id") % 7 == 0, F.col("pw") / 100).otherwise(F.col("pw")))
    f = layout.normalised_faces(F.when(F.col("id") % 7 == 0, F.array(F.array(F.col("pw") * 2, F.lit(0.0), F.col("pw") * 3, F.lit(1.0)))).otherwise(F.col("box")), F.col("pw"), F.col("ph"))
    return d.select("id", F.size(f).cast("long").alias("faces"), F.round(F.try_element_at(F.try_element_at(f, F.lit(1)), F.lit(1)), 9).alias("first"))


@query(
    f"with d as (select id, pw::double as w, ph::double as h, {_PLACE} as lo, ({_PLACE}) + 0.1 as hi from {_PHOTOS} where pw > ph), s as (select *, least(h / w, 1.0) as span from d), m as (select *, greatest(0.0, 1 - span) as room, least(greatest((lo + hi) / 2 - span / 2, 0.0), greatest(0.0, 1 - span)) as mid from s),"
    " l as (select *, case when lo < mid then least(greatest(lo - 0.01, 0.0), room) else mid end as l from m), b as (select *, case when room <= 0 then 0.0 when hi - lo <= span then case when hi > l + span then least(greatest(hi - span + 0.01, 0.0), room) else l end else mid end as start from l)"
    " select id, round_even(h, 0)::bigint as w, round_even(start * w, 0)::bigint as x from b"
)
def crops_with_faces(spark: SparkSession, sf: str) -> DataFrame:
    """Square crops of wide pictures that keep their faces."""
    at = (F.col("id") % 10) * 0.1
    c = layout.crop_box(F.col("pw"), F.col("ph"), F.lit(1.0), at, at + 0.1, F.lit(0.4), F.lit(0.6))
    return _photos(spark, sf).where("pw > ph").select("id", c["w"].alias("w"), c["x"].alias("x"))


@query("select p_partkey as id, case when p_partkey % 2 = 0 then p_partkey end::int as width, case when p_partkey % 2 = 0 then 30 end as height from part")
def rendition_sizes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    one = F.struct(F.lit(1).cast("long").alias("bytes"), k.cast("int").alias("width"), F.lit(30).alias("height"))
    d = table(spark, sf, "part").select(k.alias("id"), F.when(k % 2 == 0, F.create_map(F.lit("medium"), one)).otherwise(F.create_map(F.lit("thumb"), one)).alias("versions"))
    size = layout.rendition_size(F.col("versions"), "medium")
    return d.select("id", size["width"].alias("width"), size["height"].alias("height"))


@query("select n_nationkey as id, n_name as name, null::timestamp as synced from nation where n_regionkey > 1")
def albums_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """The listing of a run takes the place of the albums before; what it doesn't say is null."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    old = n.where("n_regionkey < 3").select("id", "name", F.lit(NOW).cast("timestamp").alias("synced"))
    return ingest.replace_albums(old, n.where("n_regionkey > 1").select("id", "name"))


@query(f"select id, case when id <> (select min(id) from {_FACES} where person_id is not null) then person_id end as person_id from {_FACES} where person_id is not null")
def face_unassigned(spark: SparkSession, sf: str) -> DataFrame:
    """A face that is given to a person and then taken back."""
    f = _faces(spark, sf).where("person_id is not null").select("id", "person_id", F.lit(None).cast("string").alias("assigned"), F.array(F.lit(1.0)).alias("embedding"), "det")
    one = f.agg(F.min("id")).first()[0]
    seeds = spark.createDataFrame([], "id string, person_id int, embedding array<double>, det double, origin string")
    f, seeds = faces.assign(f, seeds, one, 99)
    f, seeds = faces.assign(f, seeds, one, None)
    assert seeds.isEmpty()
    return f.select("id", "person_id")
