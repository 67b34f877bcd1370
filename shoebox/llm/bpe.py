"""Byte-level BPE ids of whole batches of texts.

The vocabulary file of the `tokenizers` library fixes the ids.  Texts made of ASCII and
Latin letters, without apostrophes and odd controls, are cut into pre-tokens by array
operations and looked up word by word in a bounded cache; other texts go through
`tokenizers` itself.  Both give the same ids.
"""

from __future__ import annotations

import json

import numpy as np

from . import kernels as K

_CACHE_BITS, _WIDTH = 19, 12
_LETTER, _DIGIT, _SPACE, _OTHER = range(4)


def _byte_of_char() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level BPE means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Not safe for threads; a worker keeps its own."""

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(vocabulary.decode())
        self.slow.encode_special_tokens = True
        chars, model = _byte_of_char(), json.loads(vocabulary)["model"]["vocab"]
        special = {x.content for x in self.slow.get_added_tokens_decoder().values()}
        self.token_bytes = {i: bytes(chars[c] for c in t) for t, i in model.items() if t not in special}
        self.words = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks={b: i for i, b in self.token_bytes.items()}, special_tokens={})
        cls = np.full(256, _OTHER, np.uint8)
        for b in range(256):
            if b >= 128 or chr(b).isalpha():
                cls[b] = _LETTER
            elif chr(b).isdigit():
                cls[b] = _DIGIT
        cls[[9, 10, 11, 12, 13, 32]] = _SPACE
        self.cls = cls
        odd = np.zeros(256, bool)
        odd[[*(b for b in range(32) if b not in (9, 10, 11, 12, 13)), 39, 127, *range(0xC0, 0xC3), *range(0xCA, 256)]] = True
        self.odd = odd
        n = 1 << _CACHE_BITS
        self.keys, self.lens = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        #: Ids of the cached words, slot by slot, and from `room` on those of the batch's other words.
        self.room = n * _WIDTH
        self.flat = np.zeros(self.room, np.int32)

    def ends_sentence(self) -> np.ndarray:
        """By id: whether the token ends with a full stop or holds a line break."""
        flags = np.zeros(max(self.token_bytes) + 2, bool)
        for i, b in self.token_bytes.items():
            flags[i] = b.rstrip()[-1:] in (b".", b"!", b"?") and b.rstrip() != b"" or b"\n" in b
        return flags

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, and the n+1 offsets of the documents."""
        n = off.size - 1
        bad = self.odd[buf]
        pair = np.flatnonzero(buf[:-1] == 0xC3)
        bad[pair] |= np.isin(buf[pair + 1], (0x97, 0xB7))
        sums = np.concatenate([[0], np.cumsum(bad)])
        slow = sums[off[1:]] > sums[off[:-1]]
        fast_ids, fast_off = self._fast(buf, off, ~slow)
        if not slow.any():
            return fast_ids, fast_off
        texts = [buf[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace") for d in np.flatnonzero(slow)]
        parts = [fast_ids[a:b] for a, b in zip(fast_off[:-1], fast_off[1:], strict=True)]
        for d, x in zip(np.flatnonzero(slow), self.slow.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            parts[d] = np.array(x.ids, np.int32)
        out = np.zeros(n + 1, np.int64)
        np.cumsum([p.size for p in parts], out=out[1:])
        return np.concatenate(parts), out

    def _fast(self, buf: np.ndarray, off: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the wanted documents; the others get none."""
        n = buf.size
        if not n or not want.any():
            return np.zeros(0, np.int32), np.zeros(off.size, np.int64)
        cls = self.cls[buf]
        first = np.zeros(n + 1, bool)
        first[off] = True
        change = np.ones(n + 1, bool)
        change[1:-1] = cls[1:] != cls[:-1]
        change |= first
        space = cls == _SPACE
        blank = np.zeros(n, bool)
        blank[1:] = buf[:-1] == 32
        start = change[:-1] & (space | ~blank | first[:-1])
        # the last of several white spaces stands alone or before the next word
        start |= space & change[1:] & ~first[1:]
        s = np.flatnonzero(start)
        e = np.append(s[1:], n)
        doc = np.searchsorted(off, s, side="right") - 1
        if not want.all():
            keep = want[doc]
            s, e, doc = s[keep], e[keep], doc[keep]
        h = K.Hashes(buf).of(s, e) | np.uint64(1)
        at = (h >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
        lens, place = self.lens[at], at * _WIDTH
        miss = np.flatnonzero(self.keys[at] != h)
        if miss.size:
            u, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            one = self.words._core_bpe.encode_single_piece
            raw = buf.tobytes()
            found = [one(raw[a:b]) for a, b in zip(s[miss[where]].tolist(), e[miss[where]].tolist(), strict=True)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            begin = np.cumsum(size) - size + self.room
            total = int(size.sum())
            if self.flat.size < self.room + total:
                self.flat = np.concatenate([self.flat[: self.room], np.zeros(2 * total, np.int32)])
            self.flat[self.room : self.room + total] = np.fromiter((i for x in found for i in x), np.int32, total)
            lens[miss], place[miss] = size[back], begin[back]
        first_id = np.cumsum(lens) - lens
        out = self.flat[np.repeat(place - first_id, lens) + np.arange(int(lens.sum()))]
        if miss.size:  # only now, as the slots' old words may be in use above
            # of several new words for a slot, one is kept
            slot = (u >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
            new = np.flatnonzero(size <= _WIDTH)
            _, pick = np.unique(slot[new], return_index=True)
            new = new[pick]
            self.keys[slot[new]], self.lens[slot[new]] = u[new], size[new]
            n_ids = size[new]
            first_id = np.cumsum(n_ids) - n_ids
            step = np.arange(int(n_ids.sum()))
            self.flat[np.repeat(slot[new] * _WIDTH - first_id, n_ids) + step] = self.flat[np.repeat(begin[new] - first_id, n_ids) + step]
        sizes = np.bincount(doc, weights=lens, minlength=off.size - 1).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(sizes)])
