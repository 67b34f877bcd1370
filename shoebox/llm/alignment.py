"""Two tokenizers aligned over a corpus: groups of tokens between shared ends, and pairs that end together.

Each task encodes texts with both, merges the two ascending lists of token ends and keeps a
row per document with its distinct pairs.  Spark counts the pairs over the corpus, takes
the highest count of each id on either side, and joins both back to the documents.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .bpe import ByteBpe
from .pieces import Pieces, gather, spaced
from .spark_tools import saved, ship

#: Rows of pairs that are sent to every task at most; beyond it the counts are joined by a shuffle.
BROADCAST_ROWS = 4 << 20
#: Bytes of text aligned at once; the written groups and their places take some hundred times as much.
SLICE = 1 << 20
LOW = (1 << 32) - 1
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<long>, n array<long>"


class Side:
    """Bytes of a vocabulary's tokens, one after another."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)


def byte_side(bpe: ByteBpe) -> Side:
    return Side([bpe.token_bytes.get(i, b"") for i in range(max(bpe.token_bytes) + 1)])


def piece_side(p: Pieces) -> Side:
    raw = p.bytes.tobytes()
    return Side([raw[s : s + n] for s, n in zip(p.starts.tolist(), p.sizes.tolist(), strict=True)])


def possible_pairs(a: Side, b: Side) -> int:
    """How many pairs of ids can end together in any text: of two that do, one's bytes are the end of the other's."""
    count, other = Counter(b.tokens), Counter(a.tokens)
    longer = sum(count[t[k:]] for t in a.tokens for k in range(len(t)))
    return longer + sum(other[t[k:]] for t in b.tokens for k in range(1, len(t)))


def _decimals(n: int) -> Side:
    return Side([b"%d," % i for i in range(n)])


def _same(ids: np.ndarray, at: np.ndarray, side: Side, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """By document: whether its tokens' bytes are its text's."""
    doc = np.repeat(np.arange(off.size - 1), np.diff(at))
    sizes = side.sizes[ids]
    same = np.bincount(doc, weights=sizes, minlength=off.size - 1).astype(np.int64) == np.diff(off)
    keep = same[doc]
    own = np.flatnonzero(np.repeat(same, np.diff(off)))
    apart = own[gather(side.flat, side.starts[ids[keep]], sizes[keep]) != buf[own]]
    same[np.searchsorted(off, apart, side="right") - 1] = False
    return same


def _only(ids: np.ndarray, at: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.where(same, np.diff(at), 0)
    return ids[np.repeat(same, np.diff(at))].astype(np.int64), np.concatenate([[0], np.cumsum(n)])


def aligned(buf: np.ndarray, off: np.ndarray, bpe: ByteBpe, pieces: Pieces, a: Side, b: Side, text: Side) -> tuple:
    """Per spaced text: numbers of tokens and groups, digest of the groups, distinct pairs and how often each is linked."""
    ids, at = bpe.encode(buf, off)
    more, to = pieces.encode(buf, off)
    same = _same(ids, at, a, buf, off) & _same(more, to, b, buf, off)
    ids, at = _only(ids, at, same)
    more, to = _only(more, to, same)
    # both lists of ends ascend over the whole batch, and each text's last ends are shared
    ends, stops = np.cumsum(a.sizes[ids]), np.cumsum(b.sizes[more])
    j = np.searchsorted(stops, ends)
    i = np.flatnonzero(stops[j] == ends) if ends.size else np.zeros(0, np.int64)
    j = j[i]
    groups = np.diff(np.searchsorted(i, at))
    # a token stands behind the other side's tokens of the groups before, those of B behind their own group's A
    g = np.searchsorted(i, np.arange(ids.size))
    before = np.concatenate([[0], j + 1])[g] if ids.size else g
    h = np.searchsorted(j, np.arange(more.size))
    token = np.empty(ids.size + more.size, np.int64)
    sign = np.full(token.size, ord(","), np.uint8)
    token[np.arange(ids.size) + before] = ids
    token[np.arange(more.size) + i[h] + 1] = more
    sign[i + before[i]] = ord("|")
    sign[j + i + 1] = ord(";")
    size = text.sizes[token]
    written = gather(text.flat, text.starts[token], size)
    last = np.cumsum(size)
    written[last - 1] = sign
    cut = np.concatenate([[0], last])[at + to]
    raw = written.tobytes()
    digests = [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    pair = ids[i] << 32 | more[j]
    doc = np.repeat(np.arange(groups.size), groups)
    order = np.lexsort((pair, doc))
    pair, doc = pair[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])) if pair.size else np.zeros(0, np.int64)
    times = np.diff(np.append(new, pair.size))
    per = np.searchsorted(doc[new], np.arange(groups.size + 1))
    return np.diff(at), np.diff(to), groups, digests, pair[new], times, per


def _align(vocabulary, model) -> Callable:
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, pieces = ByteBpe(vocabulary.value), Pieces(model.value)
        a, b = byte_side(bpe), piece_side(pieces)
        text = _decimals(max(len(a.tokens), len(b.tokens)))
        row = TaskContext.get().partitionId() << 40
        for f in frames:
            batch = pa.RecordBatch.from_arrays([pa.array(f["doc_id"], pa.int64(), from_pandas=True), pa.array(f["text"], pa.large_string(), from_pandas=True)], ["doc_id", "text"])
            del f
            for part in K.slices([batch], limit=SLICE):
                n_a, n_b, groups, digests, pair, times, per = aligned(*K.texts_of(spaced(part.column("text"))), bpe, pieces, a, b, text)
                cut = list(zip(per[:-1].tolist(), per[1:].tolist(), strict=True))
                yield pd.DataFrame({"row": row + np.arange(part.num_rows), "doc_id": part.column("doc_id").to_pandas(integer_object_nulls=True), "n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": groups, "groups_sha256": digests, "pair": [pair[x:y] for x, y in cut], "n": [times[x:y] for x, y in cut]})
                row += part.num_rows

    return go


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per document its tokens, groups and links, and how its links rank among those of the corpus.

    A link is a pair of tokens that end at one byte; as tokens have bytes, each group ends
    with exactly one.  A pair's count is how many links of the corpus hold it.  n_best counts
    the links whose count is the highest of their B id, n_best_a of their A id, ties
    included; count_sum adds up the counts over the links.  Texts that are null, empty, or
    whose tokens' bytes differ from the text with a space before it have zeros and an empty
    digest.  Rows that repeat an id, or have none, are documents of their own; an empty
    table gives an empty one; columns other than doc_id and text are ignored.

    As of two tokens that end together one is the end of the other, the vocabularies bound
    the number of pairs (`possible_pairs`), and so the counts are sent to every task.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(byte_path, "rb") as f, open(piece_path, "rb") as g:
        vocabulary, model = f.read(), g.read()
    bound = possible_pairs(byte_side(ByteBpe(vocabulary)), piece_side(Pieces(model)))
    send = spark.sparkContext.broadcast  # files of fixed vocabularies
    rows = saved(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInPandas(_align(send(vocabulary), send(model)), ALIGNED), "aligned")
    one = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    links = rows.select(*one, F.explode_outer(F.arrays_zip("pair", "n")).alias("x")).select(*one, "x.pair", "x.n")
    counts = saved(links.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    counts = counts.withColumns({"a": F.expr("shiftright(pair, 32)"), "b": F.col("pair").bitwiseAND(F.lit(LOW))})
    ranked = counts.join(counts.groupBy("b").agg(F.max("count").alias("of_b")), "b").join(counts.groupBy("a").agg(F.max("count").alias("of_a")), "a").select("pair", "count", "of_a", "of_b")
    joined = links.join(F.broadcast(ranked) if bound <= BROADCAST_ROWS else ranked, "pair", "left")
    best = lambda side: F.sum(F.when(F.col("count") == F.col(side), F.col("n")).otherwise(F.lit(0).cast("long")))
    out = joined.groupBy(*one).agg(best("of_b").alias("n_best"), F.coalesce(F.sum(F.col("n") * F.col("count")), F.lit(0).cast("long")).alias("count_sum"), best("of_a").alias("n_best_a"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a")
