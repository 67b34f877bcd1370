"""Order-preserving packing of token ids into windows by dynamic programming.

Documents keep their order within a partition.  Cuts may fall at document ends (free),
at sentence ends (a truncation penalty) and, in long stretches without sentences, every
few tokens, at the price of INSIDE tokens of padding: that takes one cut in 25 on the
test tables, most of them in texts of repeated words without a full stop.  The cost of a window is its padding plus
its cut's penalty; the best last cut before each position is the minimum of
cost - padding over a sliding range, kept in a monotone queue, so a block of tokens
takes time in proportion to its cuts.  Windows of a smaller power of two carry no
padding and are transitions of their own, at a fixed price.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import kernels as K
from .bpe import ByteBpe
from .spark_tools import ship

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long"
#: Tokens packed together; only a block's last window can be short.
BLOCK = 1 << 20
SENTENCE, INSIDE, SMALLER, STRETCH = 1.0, 128.0, 64.0, 12


def cuts(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and their penalties. ends: where the documents end."""
    marks = np.flatnonzero(sentence[ids]) + 1
    at = np.union1d(marks, ends)
    gaps = np.diff(at, prepend=0)
    wide = np.flatnonzero(gaps > STRETCH)
    if wide.size:
        more = (gaps[wide] - 1) // STRETCH
        base = np.repeat(at[wide] - gaps[wide], more)
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        inner = base + step * STRETCH
    else:
        inner = np.zeros(0, np.int64)
    every = np.concatenate([at, inner])
    price = np.concatenate([np.where(np.isin(at, ends), 0.0, SENTENCE), np.full(inner.size, INSIDE)])
    order = np.argsort(every, kind="stable")
    return every[order], price[order]


def windows(at: np.ndarray, price: np.ndarray, window: int) -> np.ndarray:
    """Ends of the cheapest windows that cover the positions up to at[-1]."""
    full = np.concatenate([[0], at])
    smaller: dict[int, list[int]] = {}
    size = window // 2
    while size >= max(1, window // 4):
        j = np.minimum(np.searchsorted(full, full - size), full.size - 1)
        for i in np.flatnonzero(full[j] == full - size).tolist():
            smaller.setdefault(i, []).append(int(j[i]))
        size //= 2
    # the first place that a window ending here can start at
    oldest = np.searchsorted(full, full - window).tolist()
    place = full.tolist()
    fee = np.concatenate([[0.0], price]).tolist()
    n = len(place)
    cost, came = [0.0] * n, [0] * n
    keys, who, head, tail = [0.0] * n, [0] * n, 0, 1  # the queue: cost + place, ascending, and its index
    for i in range(1, n):
        old = oldest[i]
        while who[head] < old:
            head += 1
        p = place[i]
        k = who[head]
        best = keys[head] + window - p
        if i in smaller:
            for j in smaller[i]:
                if cost[j] + SMALLER < best:
                    best, k = cost[j] + SMALLER, j
        best += fee[i]
        cost[i], came[i] = best, k
        best += p
        while tail > head and keys[tail - 1] >= best:
            tail -= 1
        keys[tail], who[tail] = best, i
        tail += 1
    out, i = [], len(place) - 1
    while i:
        out.append(place[i])
        i = came[i]
    return np.array(out[::-1], np.int64)


def _pack(vocabulary, window: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(vocabulary.value)
        sentence = bpe.ends_sentence()
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            doc_id = pa.concat_arrays([x[0] for x in held])
            ids = np.concatenate([x[1] for x in held])
            sizes = np.concatenate([x[2] for x in held])
            ends = np.cumsum(sizes)
            begin = ends - sizes
            seq_end = windows(*cuts(ids, ends, sentence), window)
            seq_begin = np.concatenate([[0], seq_end[:-1]])
            stop = np.union1d(seq_end, ends)
            start = np.concatenate([[0], stop[:-1]])
            doc = np.searchsorted(begin, start, side="right") - 1
            seq = np.searchsorted(seq_begin, start, side="right") - 1
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], np.int64)
            filled = seq_end - seq_begin
            padded = np.where((filled & (filled - 1)) == 0, filled, window)
            at = sequence
            sequence += seq_end.size
            return pa.RecordBatch.from_arrays(
                [doc_id.take(pa.array(doc)), *map(pa.array, (start - begin[doc], stop - start, crc, sizes[doc], at + seq, start - seq_begin[seq], padded[seq]))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"],
            )

        for x in K.slices(batches):
            ids, off = bpe.encode(*K.texts_of(x.column("text")))
            # id 0 closes each document
            own = np.insert(ids, off[1:], 0)
            sizes = np.diff(off) + 1
            held.append((x.column("doc_id"), own, sizes))
            tokens += own.size
            if tokens >= BLOCK:
                yield flush()
                held, tokens = [], 0
        if held:
            yield flush()

    return go


def pack(docs: DataFrame, vocabulary_path: str, window: int = 1024) -> DataFrame:
    """One row per piece of a document in a sequence of at most `window` tokens.

    A document's tokens are the ids of its text and then id 0; a null text counts as an
    empty one and so has id 0 alone.  Each token lies in exactly one piece, sequences
    are gapless from offset 0, and documents that repeat an id are packed each for
    itself.  padded_to is the sequence's length with padding; the last sequence of each
    input partition, and of each 2**20 tokens of it, is padded as it comes.  An empty table gives an
    empty one; columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # one file of a fixed vocabulary
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_pack(vocabulary, window), SCHEMA)
