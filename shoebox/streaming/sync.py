"""The change feed as a stream that keeps the log of records, and the tables that follow from it.

Each micro-batch is written to a folder of its own, named by the batch, so a batch that
is run again replaces what it wrote.  Current state is a fold of the log: `current` folds
all of it, `refold` keeps a snapshot by buckets of names and reads only what came since.
"""

from __future__ import annotations

import json
import threading
import time
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..model import SCHEMAS
from ..operators.ingest import CROP, PERSON, RELATION, crops_of, fold_records, kept, pair, people_of, relations, sync_assets, touched
from ..sources import catalogue as state
from ..sources.feed import ERROR, SHARED, ChangeFeed, again, opened

#: Buckets of names of a snapshot; one that no new record falls into stays as it is.
BUCKETS = 64
FEED = "feed"


def append_batch(log: str):
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{log}/batch={number}")

    return write


def sync(stream: DataFrame, log: str, checkpoint: str, follow: bool = False) -> StreamingQuery:
    """Read all that the feed has now and stop, or go on following it."""
    q = stream.writeStream.foreachBatch(append_batch(log)).option("checkpointLocation", checkpoint).start()
    if not follow:
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return q


def records(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["records"]).parquet(log)


def zone_errors(query: StreamingQuery) -> dict[str, str]:
    """What the zones that didn't answer in the last batch said."""
    progress = query.lastProgress
    if not progress or not progress["sources"]:
        return {}
    end = progress["sources"][0]["endOffset"]
    return (json.loads(end) if isinstance(end, str) else end or {}).get("errors", {})


def current(spark: SparkSession, log: str) -> tuple[DataFrame, DataFrame]:
    """Folded records, and live assets with their masters."""
    folded = fold_records(records(spark, log))
    return folded, pair(folded)


def catalogue(spark: SparkSession, log: str, old: DataFrame, now) -> dict[str, DataFrame]:
    """The tables that the log stands for: assets (old ones merged with it), people, face_crops, album_assets."""
    folded = fold_records(records(spark, log))
    return {"assets": sync_assets(old, folded, now), "people": people_of(folded), "face_crops": crops_of(folded), "album_assets": relations(folded)}


# --- snapshot ---------------------------------------------------------------------------


def _folders(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def _manifest(spark: SparkSession, root: str) -> dict:
    """version of the snapshot, the log's folders that it holds, and the version that each bucket was written with."""
    raw = state.get_meta(spark, root).get("snapshot")
    return json.loads(raw) if raw else {"version": 0, "upto": -1, "others": [], "buckets": {}}


def _set(spark: SparkSession, root: str, **values: str | None) -> None:
    state.set_meta(spark, root, time.time_ns(), **values)


def _new_folders(folders: list[str], manifest: dict) -> list[str]:
    def old(name: str) -> bool:
        number = name.partition("=")[2]
        return int(number) <= manifest["upto"] if number.isdigit() else name in manifest["others"]

    return [f for f in folders if f.startswith("batch=") and not old(f)]


def _buckets(spark: SparkSession, root: str, manifest: dict, schema, some: list[str]) -> DataFrame:
    paths = [f"{root}/snapshot/{manifest['buckets'][b]}/bucket={b}" for b in some if b in manifest["buckets"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def refold(spark: SparkSession, root: str, log: str, buckets: int = BUCKETS) -> DataFrame | None:
    """Merge the log's new batches into the snapshot; returns what they fold to, or nothing without any.

    Only buckets with a new record are read and written again, so the cost follows what is
    new.  Records are dealt by bucket and a part of it before they are folded, so they are
    shuffled once and a task writes few buckets.  The manifest changes last, in one row: a run that dies before leaves the snapshot
    as it was, and the next one does its work again.
    """
    m = _manifest(spark, root)
    new = _new_folders(_folders(spark, log), m)
    if not new:
        return None
    n = m.get("n", buckets)
    fresh = records_of(spark, log, new)
    hashed = F.xxhash64("name")
    some = [str(r[0]) for r in fresh.where(kept()).select(F.pmod(hashed, F.lit(n)).alias("bucket")).distinct().collect()]  # no more than there are buckets
    plain = fold_records(fresh)
    old = _buckets(spark, root, m, plain.schema, some)
    parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n)
    rows = old.unionByName(fresh, allowMissingColumns=True).withColumns({"bucket": F.pmod(hashed, F.lit(n)), "part": F.pmod(F.shiftright(hashed, 32), F.lit(parts))})
    merged = fold_records(rows.repartition("bucket", "part"), ("bucket", "part")).drop("part")
    version = m["version"] + 1
    merged.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/snapshot/{version}")
    numbers = [int(x) for f in new if (x := f.partition("=")[2]).isdigit()]
    others = m["others"] + [f for f in new if not f.partition("=")[2].isdigit()]
    done = {"version": version, "n": n, "upto": max([m["upto"], *numbers]), "others": others, "buckets": m["buckets"] | {b: version for b in some}}
    _set(spark, root, snapshot=json.dumps(done))
    return plain


def records_of(spark: SparkSession, log: str, folders: list[str]) -> DataFrame:
    return spark.read.schema(SCHEMAS["records"]).parquet(*(f"{log}/{f}" for f in folders))


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Folded records of all batches that were merged so far."""
    m = _manifest(spark, root)
    return _buckets(spark, root, m, fold_records(state.empty(spark, "records")).schema, list(m["buckets"]))


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete the buckets of older versions, which the manifest no longer names; nothing may be reading them."""
    m = _manifest(spark, root)
    gone = []
    for version in _folders(spark, f"{root}/snapshot"):
        for bucket in _folders(spark, f"{root}/snapshot/{version}"):
            if str(m["buckets"].get(bucket.partition("=")[2])) != version:
                at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshot/{version}/{bucket}")
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
                gone.append(f"{version}/{bucket}")
    return gone


# --- a whole run ------------------------------------------------------------------------


def counts(zones: list[str]) -> list[Column]:
    """What a run says of its records; names of zones are few."""
    real = ~F.col("type").eqNullSafe(ERROR)
    of = lambda kind, name: F.count_if(~F.col("deleted") & (F.col("type") == kind)).alias(name)
    by_zone = [F.count_if(real & (F.col("zone") == z)).alias(f"zone {z}") for z in zones]
    return [F.count_if(real).alias("records"), F.count_if("deleted").alias("tombstones"), of(RELATION, "relations"), of(PERSON, "people"), of(CROP, "face_crops"), *by_zone]


class Counted(StreamingQueryListener):
    """Sums of what the batches of one query observed, and where the feed's offsets began and ended."""

    def __init__(self, name: str) -> None:
        self.name, self.sums, self.first, self.last, self.ended = name, {}, None, None, threading.Event()
        self.run: str | None = None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = str(event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) != self.run:
            return
        offset = lambda x: json.loads(x) if x and x != "None" else None
        if self.last is None:
            self.first = offset(p.sources[0].startOffset)
        self.last = offset(p.sources[0].endOffset)
        row = p.observedMetrics.get(FEED)
        for k, v in (row.asDict() if row else {}).items():
            self.sums[k] = self.sums.get(k, 0) + v

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.ended.set()


def fill(spark: SparkSession, log: str, gaps: list[dict], options: dict[str, str], zones: list[str]) -> dict[str, int]:
    """Read the pages that an earlier run couldn't, into a folder of their own; returns their counts."""
    seen = Observation(FEED)
    again(spark, gaps, options).observe(seen, *counts(zones)).write.parquet(f"{log}/batch=again-{time.time_ns()}")
    return seen.get


def run(spark: SparkSession, options: dict[str, str], root: str) -> dict:
    """Bring the catalogue under `root` up to date with a feed; returns the run's statistics, which are kept as well.

    Counts of records come from the stream while it runs, counts of assets from the write
    of their table, so nothing is read a second time.  An asset counts once a run.  Tables:
    log, snapshot (folded records) and assets; `meta` has what the next run needs.  A run
    that died is resumed: the stream at its last committed batch, the rest as if it were new.
    """
    spark.dataSource.register(ChangeFeed)
    started = datetime.now(timezone.utc)
    meta = state.get_meta(spark, root)
    log, feed = f"{root}/log", opened(options)
    zones = [z for z in feed.zones() if options.get("shared", "true") == "true" or not z.startswith(SHARED)]
    _set(spark, root, running="1")
    sums: dict[str, int] = {}
    if gaps := json.loads(meta.get("gaps") or "[]"):
        sums = dict(fill(spark, log, gaps, options, zones))
    name = f"{FEED} {time.time_ns()}"
    counted = Counted(name)
    spark.streams.addListener(counted)
    try:
        stream = spark.readStream.format(ChangeFeed.name()).options(**options).load().observe(FEED, *counts(zones))
        q = stream.writeStream.queryName(name).foreachBatch(append_batch(log)).option("checkpointLocation", f"{root}/checkpoint").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        counted.ended.wait(60)
    finally:
        spark.streams.removeListener(counted)
    for k, v in counted.sums.items():
        sums[k] = sums.get(k, 0) + v
    first = counted.first or (json.loads(meta["tokens"]) if "tokens" in meta and counted.last is None else {"tokens": {}, "pages": {}})
    last = counted.last or first
    folders = _new_folders(_folders(spark, log), _manifest(spark, root))
    failed = [json.loads(r.json) for r in records_of(spark, log, folders).where(F.col("type") == ERROR).select("json").collect()] if folders else []  # a row a failed range
    delta = refold(spark, root, log)
    assets, by_zone = _assets(spark, root, meta, delta, started, zones)
    errors = last.get("errors", {}) | {x["zone"]: x["error"] for x in failed}
    albums = feed.albums() if hasattr(feed, "albums") else []
    out = {
        "started": started.isoformat(), "mode": "changes" if zones and zones[0] in first["tokens"] else "full", "pages": sum(last["pages"].values()) - sum(first["pages"].values()) - sum(x["count"] for x in failed) + sum(x["count"] for x in gaps), "records": sums.get("records", 0),
        **assets, **{k: sums.get(k, 0) for k in ("relations", "people", "face_crops", "tombstones")}, "resumed": bool(meta.get("running") and zones and zones[0] in first["tokens"]),
        "zones": {z: {"error": errors[z]} if z in errors else {"records": sums.get(f"zone {z}", 0), "new": by_zone[z], "shared": z.startswith(SHARED)} for z in zones},
        "albums": len(albums), "finished": datetime.now(timezone.utc).isoformat(),
    }
    _set(spark, root, tokens=json.dumps(last), gaps=json.dumps(failed), last_sync=json.dumps(out), running=None)
    return out


def assets(spark: SparkSession, root: str) -> DataFrame:
    version = state.get_meta(spark, root).get("assets")
    return state.read(spark, f"{root}/{version}", "assets") if version else state.empty(spark, "assets")


def _assets(spark: SparkSession, root: str, meta: dict[str, str], delta: DataFrame | None, now: datetime, zones: list[str]) -> tuple[dict[str, int], dict[str, int]]:
    """Write the assets that the snapshot and the new records give; counts of the run, and new ones by zone."""
    names = ["new", "changed", "same", "missing"]
    if delta is None:
        return dict.fromkeys(names, 0), dict.fromkeys(zones, 0)
    old = state.read(spark, f"{root}/{meta['assets']}", "assets") if meta.get("assets") else state.empty(spark, "assets")
    seen, status = Observation("assets"), F.col("__status")
    merged = sync_assets(old, touched(snapshot(spark, root), delta), now, "__status")
    gone = status.isNull() & (F.col("missing_since") == F.lit(now))
    by_zone = [F.count_if((status == "new") & (F.col("zone") == z)).alias(f"zone {z}") for z in zones]
    merged = merged.observe(seen, *(F.count_if(status == c).alias(c) for c in names[:3]), F.count_if(gone).alias("missing"), *by_zone)
    version = f"assets/v{int((meta.get('assets') or 'v0').rpartition('v')[2]) + 1}"
    state.write(merged, f"{root}/{version}", "assets")
    _set(spark, root, assets=version)
    got = seen.get
    return {c: got[c] for c in names}, {z: got[f"zone {z}"] for z in zones}
