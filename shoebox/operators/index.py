"""Reading pictures with models: what is to do, and what a pass writes.

Models are functions over Arrow batches that the caller brings: an embedder gives one
vector a picture, a detector a list of faces, a focus meter one number.  Pictures that
can't be read give nulls and do not end a pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import unit
from ..session import ship
from .faces import match, put_faces
from .lists import analysed
from .vectors import put

FACE = "struct<box: array<int>, det: double, age: int, gender: int, embedding: array<float>>"
Embed = Callable[[list[bytes]], list]
Detect = Callable[[list[bytes]], list]


def applied(pictures: DataFrame, model: Callable[[list[bytes]], list], kind: str, name: str, batch: int = 25) -> DataFrame:
    """asset_id and what the model says of each picture (asset_id, data), in batches; null where it fails."""
    ship(pictures.sparkSession)
    schema = pictures.sparkSession.createDataFrame([], f"asset_id {pictures.schema['asset_id'].dataType.simpleString()}, {name} {kind}").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def each(data: list[bytes]) -> list:
        try:
            return list(model(data))
        except Exception:  # one picture that can't be read must not cost the others their result
            return [None] if len(data) == 1 else [x for d in data for x in each([d])]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, batch):
                part = x.slice(at, batch)
                yield pa.RecordBatch.from_arrays([part.column("asset_id").cast(arrow.field(0).type), pa.array(each(part.column("data").to_pylist()), arrow.field(1).type)], schema=arrow)

    return pictures.select("asset_id", "data").mapInArrow(go, schema)


def todo(assets: DataFrame, source: str = "thumb") -> DataFrame:
    """id, master_id, zone and the rendition to read of each asset; those without a usable one are left out."""
    return assets.select("id", "master_id", "zone", analysed(F.col("versions"), source=source).alias("version")).where("version is not null")


def laplacian(picture: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian of a grey picture, edges mirrored: small where it is out of focus."""
    p = np.pad(picture.astype(float), 1, mode="reflect" if min(picture.shape) > 1 else "edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


#: The longer side that pictures are measured at.
SIDE = 512


def shrunk(picture: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A grey picture whose longer side is at most `side`, by linear interpolation between the centres of pixels."""
    if max(picture.shape) <= side:
        return picture.astype(float)
    k, out = side / max(picture.shape), picture.astype(float)
    for axis in (0, 1):
        old = picture.shape[axis]
        new = max(1, int(old * k))
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.minimum(at.astype(int), max(old - 2, 0))
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, old - 1), axis) * part
    return out


def files(spark: SparkSession, path: str, most: int = 64 << 20, pattern: str | None = None) -> DataFrame:
    """path, bytes, data of the picture files below a folder; a file over `most` bytes has null data, so none fills a task."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    d = (read.option("pathGlobFilter", pattern) if pattern else read).load(path)
    small = d.where(F.col("length") <= most).select("path", F.col("length").alias("bytes"), F.col("content").alias("data"))
    return small.unionByName(d.where(F.col("length") > most).select("path", F.col("length").alias("bytes"), F.lit(None).cast("binary").alias("data")))


def sharpness(pictures: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """asset_id and sharpness of pictures (asset_id, data); null where there is no data or `decode`, which gives a grey picture, fails."""

    def measure(data: list[bytes]) -> list[float]:
        return [laplacian(shrunk(np.asarray(decode(d)))) for d in data]

    return applied(pictures, measure, "double", "sharpness")


def with_sharpness(assets: DataFrame, measured: DataFrame) -> DataFrame:
    """Rows of the selection funnel (id and more) with what was measured; null where nothing was."""
    return assets.drop("sharpness").join(measured.select(F.col("asset_id").alias("id"), "sharpness"), "id", "left")


def run(pictures: DataFrame, tables: dict[str, DataFrame], embed: Embed, detect: Detect, clip_model: str, face_model: str, threshold: float, now, source: str = "thumb") -> dict[str, DataFrame]:
    """clip, faces and index_state after a pass over pictures (asset_id, data, version).

    Faces are matched to the seeds at once.  A picture without a vector gets no index
    state, so the next pass tries it again.
    """
    vectors = applied(pictures, embed, "array<float>", "embedding").where("embedding is not null")
    vectors = vectors.withColumn("embedding", unit(F.col("embedding")).cast("array<float>"))
    found = applied(pictures, detect, f"array<{FACE}>", "found").join(vectors.select("asset_id"), "asset_id", "left_semi")
    last = tables["faces"].agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    rows = found.select("asset_id", F.posexplode("found").alias("k", "f")).select("asset_id", "k", "f.*")
    rows = rows.join(pictures.select("asset_id", F.col("version").alias("source")), "asset_id")
    from .ranks import numbered

    new = numbered(rows, "id", F.asc("asset_id"), F.asc("k")).join(F.broadcast(last)).withColumn("id", F.col("id") + F.col("__last")).drop("k", "__last")  # one row
    who = match(new, tables["person_seeds"], threshold)
    new = new.join(who, "id").withColumn("assigned", F.when(F.col("person_id").isNotNull(), "auto"))
    # of a picture without faces the old ones go as well
    kept = put_faces(tables["faces"], vectors.select("asset_id").withColumn("id", F.lit(None).cast("long"))).where("id is not null")
    n = found.select("asset_id", F.coalesce(F.size("found"), F.lit(0)).alias("faces"))
    state = n.join(pictures.select("asset_id", F.col("version").alias("source")), "asset_id").select("asset_id", F.lit(clip_model).alias("clip_model"), F.lit(face_model).alias("face_model"), "source", F.lit(now).cast("timestamp").alias("indexed"), "faces")
    old = tables["index_state"].join(state.select("asset_id"), "asset_id", "left_anti")
    return {"clip": put(tables["clip"], vectors), "faces": kept.unionByName(new, allowMissingColumns=True), "index_state": old.unionByName(state)}
