"""SentencePiece ids of whole corpora, each distinct marked word segmented once.

Where no piece holds a white-space marker behind another character, segmentation never
crosses the start of a marked word (a run of markers and the characters up to the next
run).  So the texts of a block become codes of their distinct words; those that the task's
table doesn't hold yet are segmented and decoded in one call, and each document's codes
join what the table says of its words, by position.  Nothing is shuffled: dealing the words
of all blocks by a hash, to segment each once in the corpus, moves more bytes than it saves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import kernels as K
from .spark_tools import ship

#: Bytes of text of a block, and words beyond which a task begins its table anew.
BLOCK, HELD = 16 << 20, 1 << 19
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SPACE, MARK = b" ", "▁".encode()


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each, one after another."""
    first = np.cumsum(size) - size
    return flat[np.repeat(start - first, size) + np.arange(int(size.sum()))]


def spaced(texts: pa.Array) -> pa.Array:
    """A space before each text that isn't empty; null texts count as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))


class Pieces:
    """A segmentation model, and whether marked words may be segmented each for itself."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.sp = SentencePieceProcessor(model_proto=model)
        m = sentencepiece_model_pb2.ModelProto.FromString(model)
        rules, pieces = m.normalizer_spec, [p.piece for p in m.pieces if p.type != 6]
        mark = MARK.decode()
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        crosses = any(mark in p.lstrip(mark) for p in pieces)
        own = any(p.type == 4 for p in m.pieces)  # pieces that a text matches before any merge
        self.apart = plain and not crosses and not own and m.trainer_spec.model_type == 2 and not m.trainer_spec.treat_whitespace_as_suffix
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(mark, " ").encode() for p in m.pieces]
        self.sizes = np.array([len(b) for b in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def words(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts of the words of spaced texts, in order; whole texts where they can't be cut."""
        first = off[:-1][np.diff(off) > 0]
        if not self.apart:
            return first
        cover = buf == SPACE[0]
        start = cover.copy()
        at = np.flatnonzero(buf == MARK[0])
        at = at[at + 2 < buf.size]
        at = at[(buf[at + 1] == MARK[1]) & (buf[at + 2] == MARK[2])]
        start[at] = True
        for k in range(3):
            cover[at + k] = True
        start[1:] &= ~cover[:-1]
        start[first] = True
        return np.flatnonzero(start)

    def coded(self, buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words, the code of the word at each place, and the n+1 offsets of the texts in words."""
        s = self.words(buf, off)
        ends = np.append(s, buf.size).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), s.size, [None, pa.py_buffer(ends), pa.py_buffer(buf)])
        d = column.dictionary_encode()
        return d.dictionary, d.indices.to_numpy().astype(np.int64), np.searchsorted(s, off)

    def segment(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words (or texts) with the space or marker that they begin with, which the model adds itself."""
        texts = [(w[1:] if w[:1] == SPACE else w[len(MARK) :]).decode() for w in words]
        # the model adds no marker to an empty text
        lone = self.sp.piece_to_id(MARK.decode())
        return [x if t else [lone] for t, x in zip(texts, self.sp.encode(texts, num_threads=1), strict=True)]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spaced texts one after another, and the n+1 offsets of the texts; each distinct word is segmented once."""
        words, codes, at = self.coded(buf, off)
        found = self.segment(words.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int32, int(size.sum()))
        each = size[codes]
        return gather(flat, (np.cumsum(size) - size)[codes], each), np.concatenate([[0], np.cumsum(each)])[at]


def _digests(model):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.value)
        known: dict[bytes, tuple[int, bytes, bytes]] = {}  # of a word: ids, written in decimal, decoded
        for batch in K.slices(batches, "text", BLOCK):
            words, codes, at = pieces.coded(*K.texts_of(spaced(batch.column("text"))))
            words = words.to_pylist()
            if len(known) > HELD:
                known.clear()
            new = [w for w in words if w not in known]
            ids = pieces.segment(new)
            for w, x, t in zip(new, ids, pieces.sp.decode(ids) if ids else [], strict=True):
                known[w] = (len(x), ",".join(map(str, x)).encode(), t.encode())
            rows = [known[w] for w in words]
            size = np.array([r[0] for r in rows] or [0], np.int64)
            decimal, shown = [r[1] for r in rows], [r[2] for r in rows]
            n, written, decoded = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = codes[a:b]
                n.append(int(size[own].sum()) if b > a else 0)
                own = own.tolist()
                written.append(hashlib.sha256(b",".join([decimal[c] for c in own])).hexdigest())
                # the model takes away the marker that each word begins with
                decoded.append(hashlib.sha256(b" ".join([shown[c] for c in own])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(written, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return go


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """Number of ids, and digests of the ids and of the text decoded from them, of every document.

    Ids are those of `sentencepiece` without begin and end; a null text counts as an empty
    one, which has none.  Rows that repeat an id, or have none, are documents of their own;
    an empty table gives an empty one; columns other than doc_id and text are ignored.
    A model with other rules (pieces across markers, another normaliser, symbols of its
    own) has each distinct text segmented whole.  A task holds a block of 16 MB of text, or
    one document, and its table of words.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # one file of a fixed vocabulary
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_digests(model), SCHEMA)
