"""Substring deduplication over content-defined chunks.

A gear rolling hash decides the chunk ends from the last 16 bytes alone, so an insertion
moves only the chunks around it.  Ends lie after white space or, for
scripts without it, inside very long words; so chunks are whole words.  From each chunk
on, and up to each chunk, the fewest chunks of at least `min_words` words are a window.  A
window is a repeat where its digest occurs in a document of a smaller id or earlier in its
own, so its chunks follow each other in one place there; repeated windows are cut out, and
each passage stays once, in its smallest document.  Of a passage of that many words in
whole chunks the windows leave no chunk out.

Digests meet in an aggregation that combines before the shuffle and in a join, which
Spark can split where one passage is in very many documents.  A window is only taken for
equal to that of the first document if a second hash of both, 128 bits in all, is equal too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .minhash import id_filter, places
from .spark_tools import saved, ship

#: Chunks end after one white space in so many and, in words of more than LONG bytes, after one byte in so many.
WORDS, BYTES, LONG = 5, 256, 64
MIN_WORDS = 20


def gear(buf: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + G[buf[i]] modulo 2**16, by doubling: the last 16 bytes count."""
    h = (K.byte_values()[buf] >> np.uint64(40)).astype(np.uint16)
    for step in (1, 2, 4, 8):
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(step)
        h = more
    return h


def chunk(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the chunks of all texts, in order."""
    n = buf.size
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    h = gear(buf)
    white = ~K.word_table()[buf]
    place = np.arange(n, dtype=np.int64)
    last = np.maximum.accumulate(np.where(white, place, -1))
    cut = (h < np.uint16(65535 // BYTES)) & (place - last > LONG)
    cut |= white & (h < np.uint16(65535 // WORDS))
    cut[:-1] &= (buf[1:] & 0xC0) != 0x80
    # the first bytes of a text have no full window
    begin = off[:-1][np.diff(off) > 0]
    for k in range(15):
        at = begin + k
        cut[at[at < n]] = False
    cut[off[1:][np.diff(off) > 0] - 1] = True
    e = np.flatnonzero(cut) + 1
    s = np.concatenate([[0], e[:-1]])
    return s, e, np.searchsorted(off, s, side="right") - 1


def word_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    word = K.word_table()[buf]
    start = word.copy()
    start[1:] &= ~word[:-1]
    begin = off[:-1][np.diff(off) > 0]
    start[begin] = word[begin]
    return start


def windows(buf: np.ndarray, off: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the windows of all texts, by start and end; the words count as the window's text has them."""
    s, e, doc = chunk(buf, off)
    n = s.size
    if not n:
        return s, e, doc
    start = word_starts(buf, off)
    # words that begin before each chunk, and the same without the one that it begins inside
    before = np.concatenate([[0], np.cumsum(start)])[np.append(s, buf.size)]
    low = before[:-1] - (K.word_table()[buf[s]] & ~start[s])
    place = np.arange(n)
    to = np.maximum(np.searchsorted(before, low + min_words), place + 1)
    since = np.minimum(np.searchsorted(low, before[1:] - min_words, side="right") - 1, place)
    ahead = to <= np.searchsorted(doc, doc, side="right")
    back = since >= np.searchsorted(doc, doc)
    pairs = np.unique(np.concatenate([place[ahead] * (n + 1) + to[ahead], since[back] * (n + 1) + place[back] + 1]))
    first, last = pairs // (n + 1), pairs % (n + 1) - 1
    return s[first], e[last], doc[first]


def _digests(min_words: int, sent=None):
    """(digest, check, doc_id) of windows, of those alone that a Bloom filter lets through if there is one."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(sent.value, np.uint8)).view(bool) if sent is not None else None
        for x in K.slices(batches):
            buf, off = K.texts_of(x.column("text"))
            s, e, doc = windows(buf, off, min_words)
            h = K.Hashes(buf).of(s, e)
            if bits is not None:
                one, two = places(K.signed(h), bits.size)
                keep = bits[one] & bits[two]
                s, e, doc, h = s[keep], e[keep], doc[keep], h[keep]
            # once per document is enough: repeats inside are found again when they are cut
            order = np.lexsort((h, doc))
            first = np.ones(h.size, bool)
            first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            pick = order[first]
            check = K.Hashes(buf, K.other_values()).of(s[pick], e[pick])
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(h[pick])), pa.array(K.signed(check)), x.column("doc_id").take(pa.array(doc[pick]))], ["digest", "check", "doc_id"])

    return go


def _spans(min_words: int):
    """(row, start, end, words, first doc) of the bytes to cut out of each text of a batch."""

    def go(x: pa.RecordBatch) -> list[tuple[int, int, int, int, int]]:
        buf, off = K.texts_of(x.column("text"))
        s, e, doc = windows(buf, off, min_words)
        if not s.size:
            return []
        h = K.signed(K.Hashes(buf).of(s, e))
        check = K.Hashes(buf, K.other_values()).of(s, e)
        start = word_starts(buf, off)
        starts = np.concatenate([[0], np.cumsum(start)])
        inside = K.word_table()[buf] & ~start
        bounds = np.searchsorted(doc, np.arange(off.size))
        lists, out = x.column("repeats"), []
        ids = x.column("doc_id").to_pylist()
        for d in range(off.size - 1):
            a, b = bounds[d], bounds[d + 1]
            if a == b:
                continue
            own = h[a:b]
            order = np.lexsort((np.arange(b - a), check[a:b], own))
            again = np.zeros(b - a, bool)
            again[order[1:]] = (own[order[1:]] == own[order[:-1]]) & (check[a:b][order[1:]] == check[a:b][order[:-1]])
            known = lists[d].as_py() or []
            source = dict.fromkeys(own[again].tolist(), ids[d])
            source |= {r["digest"]: r["first_doc_id"] for r in known}
            at = np.flatnonzero(again | np.isin(own, np.array([r["digest"] for r in known], np.int64)))
            if not at.size:
                continue
            left, right = s[a + at], np.maximum.accumulate(e[a + at])
            firsts = [source[key] for key in own[at].tolist()]
            # windows that share text make one passage, and those that touch if one document has both
            split = [k for k in range(1, at.size) if left[k] > right[k - 1] or left[k] == right[k - 1] and firsts[k] != firsts[k - 1]]
            for p, q in zip([0, *split], [*split, at.size], strict=True):
                u, v = int(left[p]), int(right[q - 1])
                weigh: dict[int, int] = {}
                for key, w in zip(firsts[p:q], (e[a + at[p:q]] - left[p:q]).tolist(), strict=True):
                    weigh[key] = weigh.get(key, 0) + w
                out.append((d, u - int(off[d]), v - int(off[d]), int(starts[v] - starts[u] + inside[u]), min(weigh, key=lambda k: (-weigh[k], k))))
        return out

    return go


def _cut_spans(min_words: int):
    find = _spans(min_words)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in K.slices(batches):
            found = find(x)
            if found:
                row, start, end, words, first = map(list, zip(*found, strict=True))
                text = x.column("text").take(pa.array(row)).to_pylist()
                raw = [t.encode() for t in text]
                yield pa.RecordBatch.from_arrays(
                    [x.column("doc_id").take(pa.array(row)), pa.array(first, pa.int64()), pa.array([len(t[:a].decode()) for t, a in zip(raw, start, strict=True)], pa.int64()), pa.array([len(t[:b].decode()) for t, b in zip(raw, end, strict=True)], pa.int64()), pa.array(words, pa.int64()), pa.array([t[a:b].decode() for t, a, b in zip(raw, start, end, strict=True)])],
                    ["doc_id", "first_doc_id", "start", "end", "n_words", "passage"],
                )

    return go


def _cut_texts(min_words: int):
    find = _spans(min_words)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in K.slices(batches):
            texts = x.column("text").to_pylist()
            by_row: dict[int, list[tuple[int, int]]] = {}
            for row, start, end, _, _ in find(x):
                by_row.setdefault(row, []).append((start, end))
            for row, spans in by_row.items():
                raw, at, parts = texts[row].encode(), 0, []
                for a, b in spans:
                    parts.append(raw[at:a])
                    at = b
                texts[row] = b"".join([*parts, raw[at:]]).decode()
            keep = [c for c in x.schema.names if c != "repeats"]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else x.column(c) for c in keep], keep)

    return go


def _with_repeats(docs: DataFrame, min_words: int) -> DataFrame:
    """docs and, per document, the digests of its windows that a smaller document has.

    A digest that very many documents have is one group of narrow rows in the join, which
    Spark splits while adaptive execution is on.  Digests are made twice, for the counts and
    for the join: written down they would take more disk than a second scan takes time.  The
    second time a Bloom filter keeps most of those that occur once from the shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("text <> '' and doc_id is not null")
    marks = lambda sent=None: texts.mapInArrow(_digests(min_words, sent), "digest long, check long, doc_id long")
    first = (F.min("doc_id").alias("first_doc_id"), F.min_by("check", "doc_id").alias("first_check"), F.max("doc_id").alias("last"))
    shared = saved(marks().groupBy("digest").agg(*first).where("first_doc_id < last").drop("last"), "shared")
    sent = spark.sparkContext.broadcast(id_filter(shared.select(F.col("digest").alias("id"))))  # at most 16 MB
    later = marks(sent).join(shared, "digest").where("doc_id > first_doc_id and check = first_check").groupBy("doc_id").agg(F.collect_set(F.struct("digest", "first_doc_id")).alias("repeats"))
    return docs.join(later, "doc_id", "left")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per passage that an earlier place has: doc_id, first_doc_id, start, end (code points), n_words, passage.

    Each window of a passage stands in one piece in an earlier place: in the document with
    the smallest id, or earlier in the same one (then both ids are equal).  Where windows
    that share text have several such documents, first_doc_id is the one of most of it.  Null and empty texts have no passages.  Rows with equal
    doc_ids are taken as one document; null ids are left alone.
    """
    found = _with_repeats(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), min_words).where("text <> ''")
    return found.mapInArrow(_cut_spans(min_words), "doc_id long, first_doc_id long, start long, end long, n_words long, passage string")


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, with all their columns, without such passages; n_chars, where there is one, follows the text."""
    clash = "repeats" in docs.columns
    base = docs.withColumnRenamed("repeats", "__repeats") if clash else docs
    joined = _with_repeats(base.withColumn("doc_id", F.col("doc_id").cast("long")), min_words)
    schema = joined.drop("repeats").schema
    out = joined.mapInArrow(_cut_texts(min_words), schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    if clash:
        out = out.withColumnRenamed("__repeats", "repeats")
    return out.select(*docs.columns)
