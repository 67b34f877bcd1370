"""Near-duplicate documents by SuperMinHash signatures, banding and exact checks.

Signatures: each shingle visits the positions of a signature in an order of its own
(an affine permutation modulo a prime), and at its j-th position offers the value
j + r with r in [0, 1).  Ranks of one shingle are thus without replacement, which
lowers the variance against independent minima.  Step j runs over all shingles of all
documents at once; a document stops as soon as its largest value is below j.

Documents with equal sets form a class with one representative.  Representatives meet
in bands of the signature; a bucket's members are compared with its smallest member
first (one row each) and pairs already connected, as union-find groups them, are
skipped.  Where a bucket then still holds several components, its members are compared
on full sets in pairs of bounded blocks, so each pair of a bucket is in one component,
was checked, or differs too much in size.  A pair with the threshold's similarity misses
all bands with a probability below 1e-8 (threshold 0.85; 40 bands of 6).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .spark_tools import components, forget, saved, ship

BANDS, ROWS = 40, 6
#: A prime of at least BANDS * ROWS positions.
POSITIONS = 241
#: Bits of the filter that keeps texts of no interest out of a shuffle; when it fills up, it only saves less.
FILTER_BITS = 1 << 27
#: Pairs of one document that a task compares.
STAR = 4096
#: Documents and shingles of a block, about; two blocks are compared at once.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Parts that the rows of a bucket are dealt to when the number of its blocks is joined on.
SALTS = 16


def supermin(h: np.ndarray, off: np.ndarray, m: int = POSITIONS) -> np.ndarray:
    """Signatures (n x m) of the sets h[off[i]:off[i+1]]; an empty set's values are all ones."""
    n = off.size - 1
    sig = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(off))
    a = (K.mix(h + np.uint64(0x1234567)) % np.uint64(m - 1)).astype(np.int64) + 1
    b = (K.mix(h ^ np.uint64(0x5DEECE66D)) % np.uint64(m)).astype(np.int64)
    seed = K.mix(h * np.uint64(0xD6E8FEB86659FD93))
    for j in range(m):
        if not h.size:
            break
        value = np.uint64(j << 48) | K.mix(seed + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(16)
        np.minimum.at(sig, doc * m + (a * j + b) % m, value)
        open_ = (sig.reshape(n, m).max(axis=1) >> np.uint64(48)) > np.uint64(j)
        stay = open_[doc]
        if not stay.all():
            h, doc, a, b, seed = h[stay], doc[stay], a[stay], b[stay], seed[stay]
    return sig.reshape(n, m)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and their offsets."""
    buf, off = K.texts_of(column)
    low = K.lower_table()[buf]
    s, e, doc = K.runs(K.word_table()[low], off)
    h, d = K.shingles(K.Hashes(low).of(s, e), doc, off.size - 1, width)
    return K.distinct(h, d, off.size - 1)


def _signatures(width: int, bands: int, rows: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in K.slices(batches):
            h, off = shingle_sets(x.column("text"), width)
            n = off.size - 1
            sig = supermin(h, off, POSITIONS)[:, : bands * rows].reshape(n, bands, rows)
            key = np.zeros((n, bands), np.uint64)
            for r in range(rows):
                key = K.mix(key * np.uint64(0x100000001B3) + sig[:, :, r])
            key = K.mix(key + np.arange(bands, dtype=np.uint64))
            sums = [np.zeros(h.size + 1, np.uint64) for _ in range(2)]
            for to, salt in zip(sums, (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47), strict=True):
                np.cumsum(K.mix(h ^ np.uint64(salt)), out=to[1:])
            one, two = (K.signed(c[off[1:]] - c[off[:-1]]) for c in sums)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(K.signed(key.reshape(-1))))
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(np.diff(off)), pa.array(one), pa.array(two), lists], ["doc_id", "n_shingles", "h1", "h2", "bands"])

    return go


def places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    one = K.mix(ids.view(np.uint64))
    return [(one & np.uint64(bits - 1)).astype(np.int64), (one >> np.uint64(65 - bits.bit_length())).astype(np.int64)]


def _bits(n_bits: int):
    """The filter's bits of the ids of a task, in 64 blocks; of several tasks they are ORed."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bits, bool)
        for x in batches:
            for at in places(x.column("id").to_numpy(), n_bits):
                bits[at] = True
        blocks = np.packbits(bits).reshape(64, -1)
        some = [k for k in range(64) if blocks[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([blocks[k].tobytes() for k in some], pa.binary())], ["block", "bits"])

    return go


def _or_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for x in batches:
        for k, b in zip(x.column("block").to_pylist(), x.column("bits"), strict=True):
            b = np.frombuffer(b.as_buffer(), np.uint8)
            held[k] = held[k] | b if k in held else b
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([b.tobytes() for b in held.values()], pa.binary())], ["block", "bits"])


def id_filter(ids: DataFrame) -> bytes:
    """A Bloom filter of the column id, at most FILTER_BITS bits whatever the number of ids: it may let others through, but stops none of them.

    A task takes as many ids as fill FILTER_BITS / 32 places, so the parts that are ORed
    hold at most about half as many bytes as the ids.
    """
    n = ids.count()
    n_bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    parts = ids.select("id").coalesce(max(1, -(-n // (FILTER_BITS >> 5)))).mapInArrow(_bits(n_bits), "block long, bits binary").repartition(16, "block").mapInArrow(_or_bits, "block long, bits binary")
    out = np.zeros((64, n_bits // 512), np.uint8)
    for r in parts.toLocalIterator():
        out[r["block"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def _sets(width: int, sent):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(sent.value, np.uint8)).view(bool)
        for x in K.slices(batches):
            one, two = places(x.column("doc_id").fill_null(-1).to_numpy(), bits.size)
            x = x.filter(pa.array(bits[one] & bits[two]))
            h, off = shingle_sets(x.column("text"), width)
            some = np.flatnonzero(np.diff(off))
            yield pa.RecordBatch.from_arrays([x.column("doc_id").take(pa.array(some)), pa.array([h[off[k] : off[k + 1]].tobytes() for k in some], pa.binary())], ["id", "shingles"])

    return go


def _linked(percent: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for k, (p, q) in enumerate(zip(x.column("sa"), x.column("sb"), strict=True)):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                if 100 * min(p.size, q.size) < percent * max(p.size, q.size):
                    continue
                at = np.minimum(np.searchsorted(q, p), q.size - 1)
                both = int((q[at] == p).sum())
                if 100 * both >= percent * (p.size + q.size - both):
                    keep.append(k)
            yield x.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return go


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    A document that is `a` in very many pairs, the centre of a star, is dealt to parts of
    about STAR pairs, each of which gets its set once, so no task has all of them.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")).join(parts, "a").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    salted = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt"))
    return salted.join(two, "b").join(one, ["a", "salt"]).select("a", "b", "sa", "sb").mapInArrow(_linked(percent), "a long, b long")


def _block_links(percent: int):
    """Enough of the links between different labels in a pair of blocks to join what they join."""

    def go(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles")]
        label = table.column("label").to_numpy()
        size = np.array([s.size for s in sets], np.int64)
        _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = count[element] > 1
        row, element = np.repeat(np.arange(size.size), size)[keep], element[keep]
        place = np.cumsum(count > 1) - 1
        element = place[element]
        order = np.argsort(element, kind="stable")
        row, element = row[order], element[order]
        both = np.zeros((size.size, size.size), np.float32)  # whole numbers below 2**24
        for first in range(0, int(element[-1]) + 1 if element.size else 0, 4096):
            a, b = np.searchsorted(element, (first, first + 4096))
            part = np.zeros((size.size, 4096), np.float32)
            part[row[a:b], element[a:b] - first] = 1
            both += part @ part.T
        both = both.astype(np.int64)
        near = np.argwhere((label[:, None] != label[None, :]) & (100 * both >= percent * (size[:, None] + size[None, :] - both)))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                x = y
            return x

        picked = []
        for i, j in near[near[:, 0] < near[:, 1]].tolist():
            p, q = find(int(label[i])), find(int(label[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                picked.append((i, j))
        ids = table.column("id").combine_chunks()
        return pa.table({"a": ids.take(pa.array([i for i, _ in picked], pa.int64())), "b": ids.take(pa.array([j for _, j in picked], pa.int64()))})

    return go


def _links_in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different labels of the same bucket. members: bucket, rep, label, n_shingles.

    Of buckets with the same members one is enough.  A bucket that fills a block at most is
    compared as it is.  The documents of a larger one go to classes of set sizes, a class to
    blocks; each block meets the blocks of its class and of the next, which holds all sizes
    that can be similar.  The numbers of these blocks are joined on with a salt, so a hot
    bucket's rows stay spread.  No pair becomes a row before it is known to be linked.
    """
    blocks = lambda: F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks")
    same = (F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n"), blocks(), *same).groupBy("n", "x", "y").agg(F.min(F.struct("bucket", "blocks")).alias("b"))
    rows = saved(members.join(buckets.select("b.*"), "bucket"), "blocks")

    ratio = float(np.log(100 / percent)) if percent < 100 else 1e-9
    large = rows.where("blocks > 1").drop("blocks").withColumn("k", F.floor(F.log(F.col("n_shingles").cast("double")) / ratio).cast("long"))
    sizes = large.groupBy("bucket", "k").agg(blocks())
    # of each class: its blocks and those of the classes beside it
    of = lambda step, name: F.when(F.lit(step), F.col("blocks")).alias(name)
    beside = F.array(*(F.struct((F.col("k") + step).alias("k"), of(step == 0, "own"), of(step == 1, "before"), of(step == -1, "after")) for step in (-1, 0, 1)))
    around = sizes.select("bucket", F.explode(beside).alias("c")).groupBy("bucket", "c.k").agg(*(F.max(f"c.{c}").alias(c) for c in ("own", "before", "after"))).where("own is not null")
    around = around.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    large = large.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(SALTS)).cast("int")).join(around, ["bucket", "k", "salt"])
    large = large.withColumn("h", F.pmod(F.xxhash64("rep"), F.col("own")))
    index = lambda name: F.when(F.col(name) > 0, F.sequence(F.lit(0).cast("long"), F.col(name) - 1)).otherwise(F.array().cast("array<long>"))
    k, h = F.col("k"), F.col("h")
    meet = F.concat(
        F.transform(index("own"), lambda x: F.struct(k.alias("k1"), F.least(h, x).alias("h1"), k.alias("k2"), F.greatest(h, x).alias("h2"))),
        F.transform(index("before"), lambda x: F.struct((k - 1).alias("k1"), x.alias("h1"), k.alias("k2"), h.alias("h2"))),
        F.transform(index("after"), lambda x: F.struct(k.alias("k1"), h.alias("h1"), (k + 1).alias("k2"), x.alias("h2"))),
    )
    key = ["bucket", "k1", "h1", "k2", "h2"]
    dealt = large.select(F.col("rep").alias("id"), "label", "bucket", F.explode(meet).alias("m")).select("id", "label", "bucket", "m.*")
    mixed = dealt.groupBy(*key).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(*key)
    small = rows.where("blocks = 1").select(F.col("rep").alias("id"), "label", "bucket", *(F.lit(-1).cast("long").alias(c) for c in key[1:]))
    full = dealt.join(mixed, key, "left_semi").unionByName(small).join(sets, "id")
    return full.groupBy(*key).applyInArrow(_block_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text with fewer than
    `width` words has its whole sequence as its one shingle.  Documents are linked if
    100 * intersection >= percent * union; component_id is the smallest doc_id that
    links reach.  Empty and null texts have no shingles and link with nothing.  Rows with
    equal doc_ids are one document: n_shingles is each row's own, they link with whatever
    one of them links with and have one component.  A row with a null doc_id links with
    nothing, has a null component and is kept.  Other columns are ignored; an empty table
    gives an empty one.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = saved(docs.mapInArrow(_signatures(width, bands, rows), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"), "signatures")
    full = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = saved(full.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    # an empty text is in no class and stands for itself
    own = sigs.select("doc_id", "n_shingles", "h1", "h2").join(classes.drop("bands"), ["n_shingles", "h1", "h2"], "left")
    own = saved(own.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("rep")), "doc_id")).otherwise(F.col("doc_id")).alias("rep")), "own")
    several = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("doc_id", "a")
    same = saved(own.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")), "same")

    met = classes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    crowded = met.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("bucket", "first")
    members = saved(met.join(crowded, "bucket").where("rep <> first"), "members")
    forget(sigs, classes)
    # each member with the smallest member of each of its buckets
    stars = saved(members.select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    wanted = saved(stars.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    passed = docs.mapInArrow(_sets(width, docs.sparkSession.sparkContext.broadcast(id_filter(wanted))), "id long, shingles binary")
    # copies have equal sets: one of them is enough; a document of several rows may have several sets
    sets = saved(passed.join(wanted, "id", "left_semi").dropDuplicates(["id", "shingles"]), "sets")

    nearest = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    linked = saved(links(nearest, sets, percent), "edges")
    edges = linked.unionByName(same)
    labels = components(edges)

    def label(df: DataFrame, of: str, to: str) -> DataFrame:
        named = labels.select(F.col("node").alias(of), F.col("label").alias(to))
        return df.join(named, of, "left").withColumn(to, F.coalesce(to, of))

    rest = stars.join(nearest, ["a", "b"], "left_anti")
    rest = saved(label(label(rest, "a", "la"), "b", "lb").where("la <> lb").select("a", "b"), "rest")
    more = saved(links(rest, sets, percent), "edges")
    if more.limit(1).count():
        edges = edges.unionByName(more)
        labels = components(edges)
    # buckets whose members, the smallest left out as all others were compared with it, are in several components
    labelled = label(members, "rep", "label")
    split = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    open_ = saved(labelled.join(split, "bucket", "left_semi").select("bucket", "rep", "label", "n_shingles"), "open")
    if open_.limit(1).count():
        more = saved(_links_in_blocks(open_, sets, percent), "edges")
        if more.limit(1).count():
            labels = components(edges.unionByName(more))

    forget(members, stars, wanted, sets, linked, same, rest, open_)
    out = label(own, "rep", "component_id")
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which no near copy has a smaller doc_id, with their columns.

    Of rows with equal doc_ids the one with the smallest columns, in their order, stays.
    Rows with a null doc_id all stay.
    """
    rows = near_duplicates(docs, width, percent).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = saved(rows, "kept")
    ids = lambda where: rows.where(where).select(F.col("doc_id").alias("__kept"))
    own = F.col("doc_id").cast("long") == F.col("__kept")
    out = docs.join(ids("n = 1"), own, "left_semi").unionByName(docs.where("doc_id is null"))
    if rows.where("n > 1").limit(1).count():
        again = docs.join(ids("n > 1"), own, "left_semi").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("r"))
        out = out.unionByName(again.select("r.*"))
    return out
