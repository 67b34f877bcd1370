"""Benchmark passages in documents, with a few words changed, by pigeonhole and Myers.

A test item of m words may differ in k = floor(rate * m) word edits.  Of its k + 1
pieces one must then be in the document as it is; piece hits come from rolling hashes
and give places to verify with Myers' bit-parallel edit distance over words.  Words are
runs of letters and digits, lower-cased (A-Z and accented Latin-1 letters), so case,
spacing and punctuation don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .spark_tools import ship

RATE = 0.15
#: Items with fewer words must be found as they are: a few words with one changed are in many clean texts.
MIN_FUZZY = 8
#: Bytes of benchmark text sent to every worker at once; larger sets are scanned in blocks.
BLOCK_BYTES = 8 << 20
SCHEMA = "doc_id long, item_id long, distance long, item_words long, start_word long, end_word long"


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Word hashes, their documents and the number of documents."""
    buf, off = K.texts_of(column)
    low = K.lower_table()[buf]
    # accented capitals of Latin-1 too
    wide = np.flatnonzero(low[:-1] == 0xC3) + 1
    wide = wide[(low[wide] <= 0x9E) & (low[wide] != 0x97)]
    low[wide] += 0x20
    s, e, doc = K.runs(K.letters(low, digits=True), off)
    return K.Hashes(low).of(s, e), doc, off.size - 1


def myers(pattern: dict[int, int], m: int, text: list[int], limit: int) -> tuple[int, int]:
    """The least edit distance of the pattern to any stretch of the text, and where the first such ends; (limit + 1, -1) if above."""
    full = (1 << m) - 1
    pv, mv, score, top = full, 0, m, 1 << (m - 1)
    best, end = limit + 1, -1
    for j, c in enumerate(text):
        eq = pattern.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # row 0 stays at zero: a match may start anywhere
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Items:
    """The pieces of a block of test items, by length."""

    def __init__(self, ids: list[int], texts: list[str | None], rate: float, min_fuzzy: int = MIN_FUZZY) -> None:
        words, doc, n = word_spans(pa.array(texts, pa.string()))
        bounds = np.searchsorted(doc, np.arange(n + 1))
        self.items: list[tuple[int, list[int], int]] = []
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for i in range(n):
            own = words[bounds[i] : bounds[i + 1]]
            m = own.size
            if not m:
                continue
            k = int(rate * m) if m >= min_fuzzy else 0
            cuts = [p * m // (k + 1) for p in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                by_length.setdefault(b - a, []).append((int(windows(own[a:b], b - a)[0]), len(self.items), a))
            self.items.append((ids[i], own.tolist(), k))
        self.pieces = {}
        for length, rows in by_length.items():
            rows.sort()
            h = np.array([r[0] for r in rows], np.uint64)
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            self.pieces[length] = (h, bits, [r[1:] for r in rows])


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of so many words."""
    up, down = K.powers(words.size + 1)
    sums = np.zeros(words.size + 1, np.uint64)
    np.cumsum(words * up[: words.size], out=sums[1:])
    return K.mix((sums[length:] - sums[:-length]) * down[: words.size - length + 1] + np.uint64(length))


def matches(column: pa.Array, items: Items) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item id, distance, item words, start, end): the best place of each item in each text."""
    words, doc, n = word_spans(column)
    first = np.searchsorted(doc, np.arange(n + 1))
    places: set[tuple[int, int, int]] = set()
    for length, (h, bits, rows) in items.pieces.items():
        if words.size < length:
            continue
        seen = windows(words, length)
        maybe = np.flatnonzero(bits[(seen >> np.uint64(44)).astype(np.int64)])
        maybe = maybe[doc[maybe] == doc[maybe + length - 1]]
        lo, hi = np.searchsorted(h, seen[maybe]), np.searchsorted(h, seen[maybe], side="right")
        for at, a, b in zip(maybe[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            for k in range(a, b):
                places.add((int(doc[at]), rows[k][0], at - rows[k][1]))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    reached: dict[tuple[int, int], int] = {}
    for d, i, at in sorted(places):
        item_id, own, k = items.items[i]
        m = len(own)
        if (found := best.get((d, i))) and (found[0] == 0 or at + m + k <= reached[d, i]):
            continue
        a, b = max(int(first[d]), at - k), min(int(first[d + 1]), at + m + k)
        text = words[a:b].tolist()
        distance, end = myers(masks(own), m, text, k)
        reached[d, i] = b
        if distance <= k and (not found or distance < found[0]):
            back, start = myers(masks(own[::-1]), m, text[:end][::-1], k)
            start = end - start if back <= distance else max(0, end - m)
            best[d, i] = (distance, a + start - int(first[d]), a + end - int(first[d]))
    return [(d, items.items[i][0], *x[:1], len(items.items[i][1]), *x[1:]) for (d, i), x in sorted(best.items())]


def _scan(sent, rate: float, min_fuzzy: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*sent.value, rate, min_fuzzy)
        for x in K.slices(batches):
            found = matches(x.column("text"), items)
            if found:
                row, *rest = map(list, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([x.column("doc_id").take(pa.array(row)), *(pa.array(c, pa.int64()) for c in rest)], SCHEMA.replace(" long", "").split(", "))

    return go


def _clean(sent, rate: float, min_fuzzy: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*sent.value, rate, min_fuzzy)
        for x in K.slices(batches):
            bad = np.zeros(x.num_rows, bool)
            bad[[f[0] for f in matches(x.column("text"), items)]] = True
            yield x.filter(pa.array(~bad))

    return go


def _blocks(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> Iterator:
    """The distinct items, sent to the workers in blocks of bounded size."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("text <> ''").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES, min_fuzzy: int = MIN_FUZZY) -> DataFrame:
    """One row per document and test item that it holds: doc_id, item_id, distance, item_words, start_word, end_word.

    The place is the best one, the first of equals.  Items with fewer than min_fuzzy words
    must be found as they are.  Null and empty texts and items match nothing; repeated
    documents each give their rows, repeated items count once, and texts that share an
    item_id are items of their own; no items or no documents give an empty table.  The
    benchmark is sent to the workers in blocks of bounded size, each a scan of the
    documents; one block holds some tens of thousands of items.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("text <> ''")
    out = None
    for sent in _blocks(docs, benchmark, block_bytes):
        found = docs.mapInArrow(_scan(sent, rate, min_fuzzy), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES, min_fuzzy: int = MIN_FUZZY) -> DataFrame:
    """The rows whose text holds no test item, with their columns, whatever their doc_id; nothing is shuffled."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = docs.schema
    for sent in _blocks(docs, benchmark, block_bytes):
        docs = docs.mapInArrow(_clean(sent, rate, min_fuzzy), schema)
    return docs
