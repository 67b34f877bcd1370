"""Matching faces to people and grouping those that nobody named."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ascii_lower, unit
from ..session import ship
from .components import components
from .ranks import numbered, numbered_within
from .vectors import top_edges

#: Bytes of seed vectors sent to every worker; more are scanned block by block.
SEED_BYTES = 64 << 20


def _match(ids: list, seeds: np.ndarray, people: list, threshold: float, schema: str):
    def go(batches):
        for x in batches:
            v = x.column("embedding")
            some = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False)) if len(ids) else np.zeros(0, np.int64)
            best, who = np.zeros(len(v)), np.zeros(len(v), np.int64)
            if some.size:
                scores = np.round(v.drop_null().flatten().to_numpy().reshape(some.size, -1) @ seeds.T, 6)
                who[some] = scores.argmax(axis=1)
                best[some] = scores[np.arange(some.size), who[some]]
            none = np.ones(len(v), bool)
            none[some] = False
            seed = pa.array(ids, pa.string()).take(pa.array(who, mask=none)) if len(ids) else pa.nulls(len(v), pa.string())
            yield pa.RecordBatch.from_arrays([x.column("id"), seed, pa.array(best, mask=none)], ["id", "seed", "similarity"])

    return go


def match(faces: DataFrame, seeds: DataFrame, threshold: float) -> DataFrame:
    """id, person_id, similarity: the person of the nearest seed if near enough, and the similarity in any case.

    Of equally near seeds the smallest id counts; without seeds both are null.  Seeds are
    sent to the workers in blocks of bounded size.
    """
    spark = faces.sparkSession
    ship(spark)
    rows = seeds.where("embedding is not null").select(F.col("id").cast("string").alias("id"), F.col("person_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    size = rows.agg(F.sum(8 * F.size("embedding"))).first()[0] or 0
    blocks = max(1, -(-size // SEED_BYTES))
    f = faces.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = faces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, seed string, similarity double"
    parts = None
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).orderBy("id").collect()
        m = np.array([r["embedding"] for r in own], np.float64)
        part = f.mapInArrow(_match([r["id"] for r in own], m, [], threshold, schema), schema)
        parts = part if parts is None else parts.unionByName(part)
    if blocks > 1:
        parts = parts.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "seed")).alias("m")).select("id", F.col("m.seed").alias("seed"), (-F.col("m.s")).alias("similarity"))
    who = rows.select(F.col("id").alias("seed"), "person_id")
    return parts.join(who, "seed", "left").select("id", F.when(F.col("similarity") >= threshold, F.col("person_id")).alias("person_id"), "similarity")


def rematch(faces: DataFrame, seeds: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """All faces after matching those that are unassigned or matched before, and the number that changed."""
    open_ = F.col("assigned").isNull() | (F.col("assigned") == "auto")
    new = match(faces.where(open_), seeds, threshold).withColumnsRenamed({"person_id": "__p", "similarity": "__s"})
    both = faces.join(new, "id", "left").withColumn("__open", open_)
    changed = both.where(F.col("__open") & ~F.col("person_id").eqNullSafe(F.col("__p"))).agg(F.count("*").alias("changed"))
    out = both.withColumn("person_id", F.when(F.col("__open"), F.col("__p")).otherwise(F.col("person_id")))
    out = out.withColumn("similarity", F.when(F.col("__open"), F.col("__s")).otherwise(F.col("similarity")))
    out = out.withColumn("assigned", F.when(F.col("__open"), F.when(F.col("__p").isNotNull(), "auto")).otherwise(F.col("assigned")))
    return out.drop("__p", "__s", "__open"), changed


def seed_people(crops: DataFrame, people: DataFrame, faces_of_crops: DataFrame, seeds: DataFrame) -> DataFrame:
    """A seed for each live crop of a named person that has none: the surest face in it."""
    named = people.where("not deleted and coalesce(display_name, name) is not null").select(F.col("id").alias("person_id"))
    todo = crops.where("not deleted").join(named, "person_id").join(seeds.select(F.col("id")), "id", "left_anti").select("id", "person_id")
    best = faces_of_crops.groupBy("crop_id").agg(F.max_by("embedding", F.struct("det", (-F.col("face_no")).alias("first"))).alias("embedding"), F.max("det").alias("det"))
    return todo.join(best, F.col("id") == F.col("crop_id")).select("id", "person_id", "embedding", "det", F.lit("face-crop").alias("origin"))


def put_faces(faces: DataFrame, new: DataFrame) -> DataFrame:
    """Replaces the automatic and unassigned faces of the assets in `new`; faces that a user or a cluster named stay."""
    seen = new.select("asset_id").distinct().withColumn("__seen", F.lit(True))
    kept = faces.join(seen, "asset_id", "left").where(F.col("__seen").isNull() | F.coalesce(F.col("assigned").isin("user", "cluster"), F.lit(False))).drop("__seen")
    return kept.unionByName(new, allowMissingColumns=True)


def assign(faces: DataFrame, seeds: DataFrame, face, person) -> tuple[DataFrame, DataFrame]:
    """A user's decision: the face gets the person and becomes a seed. person None takes both back; a later match may name it again."""
    own = F.col("id") == F.lit(face)
    sid = f"face:{face}"
    out = faces.withColumn("person_id", F.when(own, F.lit(person)).otherwise(F.col("person_id"))).withColumn("assigned", F.when(own, F.lit("user" if person is not None else None)).otherwise(F.col("assigned")))
    rest = seeds.where(F.col("id") != sid)
    if person is not None:
        rest = rest.unionByName(faces.where(own).select(F.lit(sid).alias("id"), F.lit(person).alias("person_id"), "embedding", "det", F.lit("user").alias("origin")), allowMissingColumns=True)
    return out, rest


def find_person(people: DataFrame, name: str) -> DataFrame:
    """By id, or by name or display name without regard to ASCII case; of several the smallest id."""
    low = name.translate({c: c + 32 for c in range(65, 91)})
    hit = (F.col("id") == name) | (ascii_lower(F.col("name")) == low) | (ascii_lower(F.col("display_name")) == low)
    return people.where(hit & ~F.col("deleted")).orderBy("id").limit(1)


def build(faces: DataFrame, threshold: float = 0.62, min_size: int = 2, top: int = 24, key: str = "id") -> DataFrame:
    """key, cluster: groups over the best `top` links of each face, numbered from 1 by size and then smallest member.

    A link stays if either end keeps it; ends of a chain need not match.  Faces without
    a vector, or with a zero one, and groups below min_size have no row.
    """
    v = faces.select(key, unit(F.col("embedding")).alias("embedding")).where("embedding is not null")
    links = top_edges(v, threshold, key, top)
    labels = components(links.select(F.col("source").alias("a"), F.col("target").alias("b")))
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"), F.min("node").alias("first")).where(F.col("size") >= min_size)
    return labels.join(numbered(sizes, "cluster", F.desc("size"), F.asc("first")), "label").select(F.col("node").alias(key), "cluster", "size")


def build_statistics(faces: DataFrame, clusters: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """faces, links (both directions count), clusters, grouped, loose, threshold."""
    a = faces.agg(F.count("*").alias("faces"))
    b = links.agg(F.count("*").alias("links"))
    c = clusters.agg(F.countDistinct("cluster").alias("clusters"), F.count("*").alias("grouped"))
    return a.join(b).join(c).withColumn("loose", F.col("faces") - F.col("grouped")).withColumn("threshold", F.lit(threshold))


def groups(faces: DataFrame, assets: DataFrame, limit: int, named: bool | None = None, min_size: int = 2, sample: int = 8) -> DataFrame:
    """Largest groups first: size, dates, how many are named, the most frequent person, and the surest faces."""
    from .summaries import most_frequent, top_per_group

    own = faces.where("cluster is not null").join(assets.select(F.col("id").alias("asset_id"), "taken"), "asset_id")
    g = own.groupBy("cluster").agg(F.count("*").alias("size"), F.count("person_id").alias("named"), F.min("taken").alias("first"), F.max("taken").alias("last")).where(F.col("size") >= min_size)
    g = g.join(most_frequent(own, "cluster", "person_id").drop("n"), "cluster", "left")
    if named is not None:
        g = g.where(F.col("person_id").isNotNull() if named else F.col("person_id").isNull())
    g = g.orderBy(F.desc("size"), "cluster").limit(limit)
    best = top_per_group(own, "cluster", sample, F.desc("det"), "id").groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("rn", "id"))).alias("s"))
    return g.join(best, "cluster", "left").withColumn("sample", F.expr("transform(s, x -> x.id)")).drop("s").orderBy(F.desc("size"), "cluster")


def name_group(faces: DataFrame, seeds: DataFrame, assets: DataFrame, cluster: int, person, n_seeds: int = 12, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Faces of a group claimed for a person, and seeds spread over their dates."""
    own = F.col("cluster") == cluster
    free = F.lit(True) if force else F.col("person_id").isNull() | (F.col("person_id") == F.lit(person))
    claim = own & free
    out = faces.withColumn("__c", F.coalesce(claim, F.lit(False)))
    mine = out.where("__c").join(assets.select(F.col("id").alias("asset_id"), "taken"), "asset_id", "left")
    picked = stride(mine, n_seeds, F.asc_nulls_last("taken"), "id").select(F.concat(F.lit(f"cluster-{cluster}-"), F.col("id").cast("string")).alias("id"), F.lit(person).alias("person_id"), "embedding", "det", F.lit("cluster").alias("origin"))
    for c, v in (("person_id", F.lit(person)), ("assigned", F.lit("cluster")), ("similarity", F.lit(None).cast("double"))):
        out = out.withColumn(c, F.when(F.col("__c"), v).otherwise(F.col(c)))
    return out.drop("__c"), seeds.join(picked.select("id"), "id", "left_anti").unionByName(picked, allowMissingColumns=True)


def unname_group(faces: DataFrame, seeds: DataFrame, cluster: int) -> tuple[DataFrame, DataFrame]:
    own = (F.col("cluster") == cluster) & (F.col("assigned") == "cluster")
    out = faces.withColumn("person_id", F.when(own, None).otherwise(F.col("person_id"))).withColumn("assigned", F.when(own, None).otherwise(F.col("assigned")))
    return out, seeds.where(~F.col("id").startswith(f"cluster-{cluster}-"))


def stride(rows: DataFrame, n: int, *order, group: str | None = None) -> DataFrame:
    """Every step-th row in order, n at most, step = max(1, rows // n); with a group, of each group."""
    if group:
        rows = numbered_within(rows, "__place", group, *(F.asc(o) if isinstance(o, str) else o for o in order)).withColumn("__place", F.col("__place") - 1)
        sizes = rows.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n"))
        rows = rows.join(sizes, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")
    else:
        total = rows.agg(F.count("*").alias("__n"))
        rows = numbered(rows, "__place", *(F.asc(o) if isinstance(o, str) else o for o in order)).withColumn("__place", F.col("__place") - 1).join(F.broadcast(total))  # one row
    rows = rows.withColumn("__step", F.greatest(F.lit(1).cast("long"), F.floor(F.col("__n") / n)))
    return rows.where((F.col("__place") % F.col("__step") == 0) & (F.floor(F.col("__place") / F.col("__step")) < n)).drop("__step", "__place", "__n")


def unassigned(faces: DataFrame, assets: DataFrame, least: float, limit: int) -> DataFrame:
    """Faces that no person has and that were detected surely enough, likeliest first; without a similarity last, then by id."""
    own = faces.where(F.col("person_id").isNull() & (F.col("det") >= least)).select("id", "asset_id", "det", "similarity")
    return own.join(assets.select(F.col("id").alias("asset_id"), "taken", "filename"), "asset_id").orderBy(F.desc_nulls_last("similarity"), "id").limit(limit)


def faces_of(faces: DataFrame, people: DataFrame, asset) -> DataFrame:
    """The faces of an asset with the names of their people, by id."""
    named = people.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    return faces.where(F.col("asset_id") == F.lit(asset)).drop("embedding").join(named, "person_id", "left").orderBy("id")


def crop(box, width, height):
    """The part of a picture around a face: padded by .35 of its longer side, clamped, at least 8 pixels; without a box the middle half."""
    pad = 0.35 * F.greatest(box[2] - box[0], box[3] - box[1])
    x1, y1 = F.greatest(F.lit(0), F.floor(box[0] - pad)), F.greatest(F.lit(0), F.floor(box[1] - pad))
    x2, y2 = F.least(width, F.ceil(box[2] + pad)), F.least(height, F.ceil(box[3] + pad))
    good = box.isNotNull() & (x2 - x1 >= 8) & (y2 - y1 >= 8)
    part = lambda a, b: F.when(good, a).otherwise(b).cast("long")
    return F.struct(part(x1, F.floor(width / 4)).alias("x"), part(y1, F.floor(height / 4)).alias("y"), part(x2 - x1, F.floor(width / 2)).alias("w"), part(y2 - y1, F.floor(height / 2)).alias("h"))
