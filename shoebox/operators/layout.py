"""Page layouts: where photographs stand on a page, and what part of each is shown.

Closed forms are columns; row balancing and scattered prints are array kernels that run
page by page.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

# Page shapes as width and height in pixels at print size.
SHAPES = {"3:2": (4000, 2667), "2:3": (2667, 4000), "4:3": (4000, 3000), "1:1": (4000, 4000), "16:9": (4000, 2250), "a4": (3508, 2480)}
#: Sums of aspects within NEAR of a share have reached it; misses that agree to PLACES decimals are equal.
NEAR, PLACES = 1e-12, 9


def page_size(shape: str, long_edge: int | None = None, gap: float = 8, caption: str | None = None) -> tuple[int, int, float, int]:
    """Width, height, gap and the height of the caption's band."""
    w, h = SHAPES[shape]
    if long_edge:
        k = long_edge / max(w, h)
        w, h = max(1, round(w * k)), max(1, round(h * k))
    return w, h, gap * max(w, h) / 4000.0, max(28, round(0.045 * w)) if caption and caption.strip() else 0


def grid_columns(n, want):
    """Columns whose shape is nearest to the page's, with a price for empty cells; the fewest of equals."""
    err = lambda c: F.abs(c / F.ceil(n / c) - want * 0.82) + 0.9 * (c * F.ceil(n / c) - n) / n
    return F.array_min(F.transform(F.sequence(F.lit(1).cast("long"), n.cast("long")), lambda c: F.struct(err(c).alias("e"), c.alias("c"))))["c"]


def grid(photos: DataFrame, page: str, order: str, width: float, height: float, gap: float) -> DataFrame:
    """x, y, w, h of each photograph in even cells; a short last row is centred."""
    w = Window.partitionBy(page)
    d = photos.withColumn("n", F.count("*").over(w).cast("long")).withColumn("i", F.row_number().over(w.orderBy(order)).cast("long") - 1)
    d = d.withColumn("cols", grid_columns(F.col("n"), F.lit(width / height))).withColumn("rows", F.ceil(F.col("n") / F.col("cols")))
    d = d.withColumn("w", (width - gap * (F.col("cols") - 1)) / F.col("cols")).withColumn("h", (height - gap * (F.col("rows") - 1)) / F.col("rows"))
    r = F.floor(F.col("i") / F.col("cols"))
    in_row = F.least(F.col("cols"), F.col("n") - r * F.col("cols"))
    indent = (width - (in_row * F.col("w") + gap * (in_row - 1))) / 2
    return d.withColumn("x", indent + (F.col("i") % F.col("cols")) * (F.col("w") + gap)).withColumn("y", r * (F.col("h") + gap)).drop("n", "rows")


def filmstrip(photos: DataFrame, page: str, order: str, width: float, height: float, gap: float) -> DataFrame:
    """Frames of one width across the page."""
    w = Window.partitionBy(page)
    d = photos.withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy(order)).cast("long") - 1)
    return d.withColumn("w", (width - gap * (F.col("n") - 1)) / F.col("n")).withColumn("x", F.col("i") * (F.col("w") + gap)).withColumn("y", F.lit(0.0)).withColumn("h", F.lit(float(height))).drop("n")


def hero(photos: DataFrame, page: str, order: str, width: float, height: float, gap: float) -> DataFrame:
    """The first photograph large, the others in a grid beside or below it; alone it is a grid of one."""
    d = photos.withColumn("__i", F.row_number().over(Window.partitionBy(page).orderBy(order))).withColumn("__n", F.count("*").over(Window.partitionBy(page)))
    wide = width >= height
    bw, bh = (width * 0.615, float(height)) if wide else (float(width), height * 0.6)
    one = d.where("__n = 1").drop("__i", "__n")
    big = d.where("__n > 1 and __i = 1").drop("__i", "__n").selectExpr("*", "0L i", "1L cols", f"{bw}D w", f"{bh}D h", "0D x", "0D y")
    rest = d.where("__n > 1 and __i > 1").drop("__i", "__n")
    small = grid(rest, page, order, width - bw - gap if wide else width, height if wide else height - bh - gap, gap)
    small = small.withColumn("i", F.col("i") + 1).withColumn(*(("x", F.col("x") + bw + gap) if wide else ("y", F.col("y") + bh + gap)))
    return grid(one, page, order, width, height, gap).unionByName(big).unionByName(small)


def balanced_rows(aspects: np.ndarray, rows: int) -> np.ndarray | None:
    """The first place of each row, so that rows carry near equal sums of aspects; None if there are too few places.

    Row k ends at the first place where the sum reaches k of `rows` even shares, behind
    the row before, or earlier where just one place is left for each row to come, which
    then has that one.
    """
    n = len(aspects)
    if rows > n:
        return None
    sums, k = np.cumsum(aspects), np.arange(rows - 1)
    ends = np.searchsorted(sums, (k + 1) * (sums[-1] or 1.0) / rows - NEAR)
    ends = np.maximum.accumulate(ends - k) + k
    return np.append(0, np.minimum(ends, n - rows + k) + 1).astype(np.int64)


def justified_slots(aspects: np.ndarray, width: float, height: float, gap: float) -> np.ndarray:
    """(x, y, w, h) rows: lines that span the page and fill it, with the number of lines that needs least stretching, the fewest of equals."""
    n = len(aspects)
    best = None
    for rows in range(1, n + 1):
        first = balanced_rows(aspects, rows)
        if first is None:
            continue
        size = np.diff(np.append(first, n))
        sums = np.add.reduceat(aspects, first)
        tall = (width - gap * (size - 1)) / np.where(sums == 0, 1.0, sums)
        miss = round(abs(tall.sum() + gap * (rows - 1) - height), PLACES)
        if best is None or miss < best[0]:
            best = miss, first, size, sums, tall
    _, first, size, sums, tall = best
    high = tall * ((height - gap * (len(size) - 1)) / tall.sum() if tall.sum() else 1.0)
    top = np.concatenate([[0.0], np.cumsum(high + gap)[:-1]])
    row = np.repeat(np.arange(len(size)), size)
    w = (width - gap * (size[row] - 1)) * (aspects / np.where(sums == 0, 1.0, sums)[row])
    run = np.cumsum(w + gap) - (w + gap)
    return np.stack([run - run[first][row], top[row], w, high[row]], axis=1)


def spread_slots(aspects: np.ndarray, width: float, height: float, gap: float) -> np.ndarray:
    """Two facing pages with a gutter that nothing crosses."""
    if len(aspects) < 2:
        return justified_slots(aspects, width, height, gap)
    gutter = max(gap * 2.6, width * 0.035)
    side = (width - gutter) / 2
    half = (len(aspects) + 1) // 2
    left, right = justified_slots(aspects[:half], side, height, gap), justified_slots(aspects[half:], side, height, gap)
    right[:, 0] += side + gutter
    return np.concatenate([left, right])


def scatter_slots(aspects: np.ndarray, width: float, height: float, gap: float) -> np.ndarray:
    """(x, y, w, h, rotate, mount): prints dropped on cells of a table, shifted and tilted by fixed pseudo-random values."""
    n = len(aspects)
    cols = max(1, round((n * width / height) ** 0.5))
    cell_w, cell_h = width / cols, height / -(-n // cols)
    size = 0.98 * min(cell_w, cell_h)
    room = 0.17 * size
    i = np.arange(n)
    noise = lambda a, b: np.array([random.Random(int(k)).random() for k in i * a + b]) - 0.5
    w, h = np.where(aspects >= 1, size, size * aspects), np.where(aspects >= 1, size / aspects, size)

    def held(at: np.ndarray, span: np.ndarray, page: float) -> np.ndarray:
        most = page - span
        fits = most - room >= room
        return np.where(fits, np.clip(at, room, np.maximum(most - room, room)), np.clip(most / 2, 0.0, np.maximum(most, 0.0)))

    x = held((i % cols) * cell_w + (cell_w - w) / 2 + noise(7, 1) * cell_w * 0.26, w, width)
    y = held((i // cols) * cell_h + (cell_h - h) / 2 + noise(13, 5) * cell_h * 0.26, h, height)
    return np.stack([x, y, w, h, noise(31, 3) * 10.0, np.full(n, max(4.0, 0.035 * size))], axis=1)


KERNELS = {"justified": justified_slots, "spread": spread_slots, "scatter": scatter_slots}


def by_page(photos: DataFrame, template: str, page: str, order: str, aspect: str, width: float, height: float, gap: float) -> DataFrame:
    """page, order, x, y, w, h, rotate, mount of each photograph; an unknown aspect is 1.

    Pages are collected as lists inside the JVM, so a batch of Arrow rows holds many of
    them; a null page is one of its own.
    """
    ship(photos.sparkSession)
    kernel = KERNELS[template]
    types = {f.name: f.dataType.simpleString() for f in photos.schema.fields}
    columns = ("x", "y", "w", "h", "rotate", "mount")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("aspects")
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            out, at = np.zeros((values.size, 6)), 0
            for k in n.tolist():
                s = kernel(values[at : at + k], width, height, gap)
                out[at : at + k, : s.shape[1]] = s
                at += k
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("orders"), *(pa.ListArray.from_arrays(offsets, pa.array(out[:, k])) for k in range(6))], ["page", "orders", *columns])

    own = photos.select(F.col(page).alias("page"), F.struct(F.col(order).alias("o"), F.coalesce(F.col(aspect).cast("double"), F.lit(1.0)).alias("a")).alias("p"))
    lists = own.groupBy("page").agg(F.sort_array(F.collect_list("p")).alias("p")).select("page", F.col("p.o").alias("orders"), F.col("p.a").alias("aspects"))
    slots = lists.mapInArrow(go, f"page {types[page]}, orders array<{types[order]}>, " + ", ".join(f"{c} array<double>" for c in columns))
    rows = slots.select("page", F.explode(F.arrays_zip("orders", *columns)).alias("s"))
    return rows.select(F.col("page").alias(page), F.col("s.orders").alias(order), *(F.col(f"s.{c}").alias(c) for c in columns))


def rendition_size(versions, version):
    """Width and height of a rendition; null where the asset has none."""
    return F.struct(versions[version]["width"].alias("width"), versions[version]["height"].alias("height"))


def plan(photos: DataFrame, template: str, page: str, order: str, shape: str = "3:2", gap: float = 8, long_edge: int | None = None, caption: str | None = None, face_safe: bool = True) -> DataFrame:
    """The slots of each page in whole pixels, with the part of each photograph that its slot shows.

    photos: page, order, width, height and, for crops that keep faces, faces as fractions
    of the frame.  Columns: page, order, x, y, w, h, rotate, mount, crop and the page's
    page_w, page_h and band (the caption's height, which the slots leave free).
    """
    pw, ph, space, band = page_size(shape, long_edge, gap, caption)
    sized = photos.withColumn("__aspect", F.when(F.col("height") > 0, F.greatest(F.lit(0.05), F.col("width") / F.col("height"))))
    width, height = float(pw), float(ph - band)
    if template in KERNELS:
        slots = by_page(sized, template, page, order, "__aspect", width, height, space)
    else:
        slots = {"grid": grid, "hero": hero, "filmstrip": filmstrip}[template](sized.select(page, order), page, order, width, height, space)
        slots = slots.select(page, order, "x", "y", "w", "h", F.lit(0.0).alias("rotate"), F.lit(0.0).alias("mount"))
    d = slots.join(photos, [page, order])
    inner = lambda c: F.greatest(F.lit(1.0), F.col(c) - 2 * F.col("mount"))
    bounds: list = [None] * 4
    if face_safe and "faces" in photos.columns:
        bounds = [f(F.transform("faces", lambda b, i=i: b[i])) for f, i in ((F.array_min, 0), (F.array_max, 2), (F.array_min, 1), (F.array_max, 3))]
    whole = lambda c: F.bround(c).cast("long").alias(c)
    crop = crop_box(F.col("width"), F.col("height"), inner("w") / inner("h"), *bounds).alias("crop")
    return d.select(page, order, *(whole(c) for c in ("x", "y", "w", "h")), F.round("rotate", 2).alias("rotate"), whole("mount"), crop, F.lit(pw).alias("page_w"), F.lit(ph).alias("page_h"), F.lit(band).alias("band"))


def source_px(original_width, photo_width, crop_width):
    """Pixels of the original across its slot; an unknown original counts as the photograph at hand."""
    original = F.when(F.coalesce(original_width, F.lit(0)) > 0, original_width).otherwise(photo_width)
    part = F.when(F.coalesce(photo_width, F.lit(0)) > 0, crop_width / photo_width).otherwise(1.0)
    return F.bround(original * part).cast("long")


def window_start(span, lo, hi):
    """Where a window of width span in 0..1 starts: in the middle, or so that it holds lo..hi."""
    room = F.greatest(F.lit(0.0), 1 - span)
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), room)
    mid = clamp((lo + hi) / 2 - span / 2)
    left = F.when(lo < mid, clamp(lo - 0.01)).otherwise(mid)
    both = F.when(hi > left + span, clamp(hi - span + 0.01)).otherwise(left)
    held = F.when(hi - lo <= span, both).otherwise(mid)
    return F.when(room <= 0, 0.0).when(lo.isNull(), room / 2).otherwise(held)


def crop_box(width, height, slot_aspect, lo_x=None, hi_x=None, lo_y=None, hi_y=None):
    """w, h, x, y of the part of a picture that fills a slot; the bounds are those of its faces, null without any."""
    none = F.lit(None).cast("double")
    lo_x, hi_x, lo_y, hi_y = (none if c is None else c for c in (lo_x, hi_x, lo_y, hi_y))
    w, h = F.greatest(F.lit(1.0), width.cast("double")), F.greatest(F.lit(1.0), height.cast("double"))
    own = w / h
    cw, ch = h * slot_aspect, w / slot_aspect
    long_ = lambda c: F.bround(c).cast("long")
    whole = F.struct(long_(w).alias("w"), long_(h).alias("h"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    sides = F.struct(long_(cw).alias("w"), h.cast("long").alias("h"), long_(window_start(cw / w, lo_x, hi_x) * w).alias("x"), F.lit(0).cast("long").alias("y"))
    ends = F.struct(w.cast("long").alias("w"), long_(ch).alias("h"), F.lit(0).cast("long").alias("x"), long_(window_start(ch / h, lo_y, hi_y) * h).alias("y"))
    return F.when(F.abs(own - slot_aspect) < 1e-6, whole).when(own > slot_aspect, sides).otherwise(ends)


def normalised_faces(boxes, width, height):
    """Face boxes as fractions of the frame; none at all if one doesn't fit or the size is unknown."""
    four = F.filter(boxes, lambda b: F.size(b) == 4)
    part = F.transform(four, lambda b: F.array(b[0] / width, b[1] / height, b[2] / width, b[3] / height))
    bad = F.exists(part, lambda f: F.exists(f, lambda v: (v < -0.05) | (v > 1.05)) | (f[2] <= f[0]) | (f[3] <= f[1]))
    clamped = F.transform(part, lambda f: F.transform(f, lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))))
    empty = F.array().cast("array<array<double>>")
    return F.when(F.coalesce(width * height, F.lit(0)) == 0, empty).when(bad, empty).otherwise(clamped)
