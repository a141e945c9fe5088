"""The chunk format: a header, the lengths of all records, and the records, as they are or gzipped."""

from __future__ import annotations

import gzip
import struct

import numpy as np

# Fixed values of the chunk format: header layout, kinds of compression, bases per word, codes of bases and of the end.
HEADER = struct.Struct("<4BHHQQ32s")
RAW, BZIP2, GZIP = 0, 1, 2
TEXT, STRUCTURED, BASES = 0, 1, 2
PER_WORD, BASE_CODES, END_CODE = 21, "ACGTN", 7
CODE_OF = np.full(256, 4, np.uint64)
for _letter, _code in (("A", 0), ("C", 1), ("G", 2), ("T", 3)):
    CODE_OF[[ord(_letter), ord(_letter.lower())]] = _code
SHIFT = 3 * np.arange(PER_WORD, dtype=np.uint64)


def encode_chunk(records: list[bytes], kind: int = TEXT, compression: int = GZIP, first: int = 0, name: str = "") -> bytes:
    body = np.array([len(r) for r in records], "<u4").tobytes() + b"".join(records)
    body = gzip.compress(body) if compression == GZIP else body
    return HEADER.pack(1, 0, kind, compression, HEADER.size, 0, first, first + len(records), name.encode()[:32]) + body


def decode_chunk(blob: bytes) -> tuple[list[bytes], int, int]:
    """(records, first ordinal, kind)."""
    if len(blob) < HEADER.size:
        raise ValueError("chunk is shorter than its header")
    *_, kind, packed, start, _pad, first, last, _name = HEADER.unpack(blob[: HEADER.size])
    if packed not in (RAW, GZIP):
        raise ValueError("compression of this kind is not supported")
    body = gzip.decompress(blob[start:]) if packed == GZIP else blob[start:]
    n = last - first
    size = np.frombuffer(body[: 4 * n], "<u4").astype(np.int64)
    ends = np.cumsum(size)
    data = body[4 * n :]
    if len(size) < n or (n and ends[-1] > len(data)):
        raise ValueError("chunk is cut short")
    return [data[e - s : e] for s, e in zip(size.tolist(), ends.tolist(), strict=True)], first, kind


def pack_bases(text: str) -> bytes:
    """Three bits a base, 21 in a word, an end code after the last; what is not A, C, G or T is N."""
    letters = np.frombuffer(text.replace("\n", "").encode("ascii", "replace"), np.uint8)
    codes = np.zeros(-(-(len(letters) + 1) // PER_WORD) * PER_WORD, np.uint64)
    codes[: len(letters)] = CODE_OF[letters]
    codes[len(letters)] = END_CODE
    return np.bitwise_or.reduce(codes.reshape(-1, PER_WORD) << SHIFT, axis=1).astype("<u8").tobytes()


def unpack_bases(blob: bytes) -> str:
    words = np.frombuffer(blob, "<u8")
    codes = ((words[:, None] >> SHIFT) & np.uint64(7)).ravel()
    end = np.flatnonzero(codes == END_CODE)
    return np.frombuffer(BASE_CODES.encode() + b"??" + b"?", np.uint8)[codes[: end[0] if len(end) else len(codes)].astype(int)].tobytes().decode()
