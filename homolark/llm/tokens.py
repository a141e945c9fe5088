"""Whole-text encoding with a public tokenizer, fast enough for a corpus.

Both vocabularies cut a text at white space before they merge, so a text's ids are those of its pieces one after
the other; a piece is a word, for byte-level vocabularies with the white space before it. Pieces are found and hashed with numpy, each distinct one of a batch is
looked up once, those not seen before are encoded by the tokenizers library, and the ids are gathered. A piece is told by one 64-bit hash and checked by a
second, independent one at every place; texts in which the check fails, texts with white space other than ASCII's and texts
that hold a special token's letters are given to the library whole. The memory of pieces is bounded and starts anew when full.

The letters of a special token in a text become that token, as the library has it; `marks_as_text` makes them ordinary text.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import xxhash

from .common import U, WS, distinct, mix, trim, utf8, words

PIECES = 1_200_000  # remembered at most, at some 50 bytes each

# First bytes, and then second bytes, of the UTF-8 of white space and separators beyond ASCII's; U+001C to U+001F alone.
_LEAD = np.zeros(256, bool)
_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_SECOND = np.zeros((256, 256), bool)
_SECOND[0x1C:0x20] = True
for _a, _b in ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE1, 0xA0), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80), (0xEF, 0xBB)):
    _SECOND[_a, _b] = True


_ODD = re.compile("[" + "".join(chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2080), *range(0x3000, 0x3040), 0xFEFF)) + "]")


def odd_texts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(_LEAD[data])
    at = at[_SECOND[data[at], data[np.minimum(at + 1, len(data) - 1)]]] if len(at) else at
    return np.unique(np.searchsorted(off, at, "right") - 1)


class Encoder:
    def __init__(self, path: str, marks_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path, self._tok, self.marks_as_text = path, None, marks_as_text
        self.cutter = Tokenizer.from_file(path)  # the end mark is a token of its own and parts the pieces of a batch
        self.marks = [t.content.encode() for t in self.cutter.get_added_tokens_decoder().values()]
        self.mark = "<|endoftext|>"
        self.mark_id = self.cutter.token_to_id(self.mark)
        self.gaps = type(self.cutter.pre_tokenizer).__name__ == "ByteLevel"  # white space counts
        # a byte-level token's text has a character for each byte
        self.token_bytes = np.zeros(self.cutter.get_vocab_size(), np.int64)
        for token, i in self.cutter.get_vocab().items() if self.gaps else ():
            self.token_bytes[i] = len(token)
        self._reset()

    @property
    def tok(self):
        """For whole texts."""
        if not self.marks_as_text:
            return self.cutter
        if self._tok is None:
            self._tok = type(self.cutter).from_file(self.path)
            self._tok.encode_special_tokens = True
        return self._tok

    def rest(self) -> None:
        """To be called when a task ends: a worker that waits shall not hold much."""
        trim()

    def _reset(self) -> None:
        self.keys, self.places = np.zeros(0, U), np.zeros(0, np.int32)  # hashes in order, and their pieces' places
        self.flat = np.zeros(1 << 16, np.int32)
        self.start, self.size, self.check, self.used, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, U), 0, 0

    def _learn(self, new: list[bytes], plain: np.ndarray, check: np.ndarray) -> None:
        """Remembers new pieces; plain: white space and then a word without any."""
        sizes, flats = [], []
        n = int(plain.sum())  # these come first
        for a, b in [(a, min(a + 2000, n)) for a in range(0, n, 2000)] + [(a, a + 2000) for a in range(n, len(new), 2000)]:
            part = new[a:b]
            if self.gaps and a < n and (got := self._end_to_end(part)):
                sizes.append(got[0])
                flats.append(got[1])
                continue
            # a piece that holds the mark itself is never used: its text is encoded whole
            joined = b"".join(p.replace(self.mark.encode(), b"") + self.mark.encode() for p in part).decode()
            ids = np.array(self.cutter.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(ids == self.mark_id)
            sizes.append(np.diff(cuts, prepend=-1) - 1)
            flats.append(np.delete(ids, cuts))
        size, flat = np.concatenate(sizes), np.concatenate(flats)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(size) > len(self.start):
            self.start, self.size, self.check = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.size, self.check))
        self.flat[self.used : self.used + len(flat)] = flat
        own = slice(self.n, self.n + len(size))
        self.start[own], self.size[own], self.check[own] = self.used + np.cumsum(size) - size, size, check
        self.used, self.n = self.used + len(flat), self.n + len(size)

    def _end_to_end(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Byte-level pieces of white space and a word follow each other as in a text, and tokens keep all bytes: their lengths tell where a piece ends."""
        joined = b"".join(part)
        text = joined.decode()
        if self.mark in text or (len(text) != len(joined) and _ODD.search(text)):
            return None
        ids = np.array(self.cutter.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        ends = np.cumsum(self.token_bytes[ids])
        want = np.cumsum(list(map(len, part)))
        at = np.searchsorted(ends, want)
        if at[-1] >= len(ends) or (ends[at] != want).any():
            return None
        return np.diff(at, prepend=-1), ids

    def _pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts and ends of all pieces, their hashes of two seeds, and the index of each text's first."""
        s, e, first, h, check = words(data, off, 2)
        if not self.gaps:
            return s, e, h, check, first
        before = np.concatenate([[0], e[:-1]]) if len(e) else e
        has = np.flatnonzero(np.diff(first))
        before[first[:-1][has]] = off[:-1][has]
        gap = s - before
        one = np.flatnonzero(gap == 1)
        space = data[s[one] - 1].astype(U) + U(1)
        h[one] = mix(h[one] + space * U(0xE7037ED1A0B428DB))
        check[one] = mix(check[one] + space * U(0x8EBC6AF09C88C6E3))
        last = off[:-1].copy()
        last[has] = e[first[1:][has] - 1]
        tails = np.flatnonzero(last < off[1:])  # white space at the end of a text is a piece of its own
        raw = memoryview(np.ascontiguousarray(data))
        for i in np.flatnonzero(gap > 1).tolist():
            d = xxhash.xxh3_128_intdigest(raw[before[i] : e[i]])
            h[i], check[i] = d >> 64, d & 0xFFFFFFFFFFFFFFFF
        if len(tails):
            at = first[1:][tails]
            more = [xxhash.xxh3_128_intdigest(raw[last[t] : off[t + 1]]) for t in tails.tolist()]
            before, e = np.insert(before, at, last[tails]), np.insert(e, at, off[1:][tails])
            h, check = np.insert(h, at, np.array([x >> 64 for x in more], U)), np.insert(check, at, np.array([x & 0xFFFFFFFFFFFFFFFF for x in more], U))
            added = np.zeros(len(first), np.int64)
            added[tails + 1] = 1
            first = first + np.cumsum(added)
        return before, e, h, check, first

    def encode(self, texts: pa.Array | list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) one after the other, each with `end` appended, and their offsets."""
        data, off = utf8(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        n = len(off) - 1
        if len(self.keys) > PIECES:
            self._reset()
        raw = data.tobytes()
        odd = odd_texts(data, off) if len(data) else np.zeros(0, np.int64)
        held = [np.searchsorted(off, m.start(), "right") - 1 for mark in self.marks for m in re.finditer(re.escape(mark), raw)]
        s, e, h, check, first = self._pieces(data, off)
        key, place = distinct(h)
        at = np.empty(len(key), np.int64)
        at[place[::-1]] = np.arange(len(h))[::-1]
        slot = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        if len(self.keys):
            known = self.keys[np.minimum(slot, len(self.keys) - 1)] == key
        places = np.zeros(len(key), np.int32)
        places[known] = self.places[slot[known]]
        new = np.flatnonzero(~known)
        if len(new):
            a, b = s[at[new]], e[at[new]]
            plain = WS[data[a]] & ~WS[data[b - 1]]
            by = np.argsort(~plain, kind="stable")
            new, a, b, plain = new[by], a[by], b[by], plain[by]
            places[new] = self.n + np.arange(len(new))
            also = np.flatnonzero(~known)
            self.keys, self.places = np.insert(self.keys, slot[also], key[also]), np.insert(self.places, slot[also], places[also])
            self._learn([raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], plain, check[at[new]])
        p = places[place]
        size, start = self.size[p], self.start[p]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        doc = total[first]  # of each text in what its pieces give
        ids = self.flat.take(np.repeat(start - total[:-1].astype(np.int32), size) + np.arange(total[-1], dtype=np.int32))
        wrong = np.flatnonzero(self.check[p] != check)
        if len(wrong) or held:
            odd = np.unique(np.concatenate([odd, np.searchsorted(first, wrong, "right") - 1, np.array(held, np.int64)]))
        if not len(odd):
            out = np.full(len(ids) + n, end, np.int32)
            keep = np.ones(len(out), bool)
            keep[doc[1:] + np.arange(n)] = False
            out[keep] = ids
            return out, doc + np.arange(n + 1)
        whole = {k: np.array(self.tok.encode_batch_fast([raw[off[k] : off[k + 1]].decode()], add_special_tokens=False)[0].ids, np.int32) for k in odd.tolist()}
        parts = [whole.get(k, ids[doc[k] : doc[k + 1]]) for k in range(n)]
        tail = np.array([end], np.int32)
        return np.concatenate([x for p in parts for x in (p, tail)]), np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, marks_as_text: bool = False) -> Encoder:
    """One per worker process and vocabulary."""
    key = path, marks_as_text
    if key not in _encoders:
        _encoders[key] = Encoder(path, marks_as_text)
    return _encoders[key]
