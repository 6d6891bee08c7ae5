"""Cutting texts into units that a byte-level tokenizer encodes independently.

A unit is a run of white space and what follows it up to the next, or up to a mark like a
comma behind a letter or digit. The split pattern
of the vocabulary never joins characters across such a boundary, nor looks past it, so
the encoding of a text is the concatenation of its units' encodings and each
distinct unit has to be looked at once. Boundaries are found on the bytes of
a whole block of texts, and equal units are found by Arrow's dictionary encoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import WHITE

BLOCK_BYTES = 4_000_000
_WHITE = np.zeros(256, bool)
_WHITE[[ord(c) for c in WHITE]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
# Not the quote (contractions), nor what special strings are written with.
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ",.;:!?)\"#$%&*"]] = True


def _maybe_wide(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each position may be white space beyond ASCII (U+0085,
    U+00A0, U+1680, U+2000 and its block, U+205F, U+3000): no boundary there, to be safe."""
    b1 = data[at - 1]
    b2, b3 = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    two = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    three = ((b3 == 0xE1) & (b2 == 0x9A)) | ((b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81))) | ((b3 == 0xE3) & (b2 == 0x80))
    return (b1 >= 0x80) & (two | three)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ends, bytes) of a column of texts without nulls, without copying the bytes: text i is ``bytes[ends[i]:ends[i + 1]]``."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    return ends, np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)


def unit_blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, list[bytes], np.ndarray]]:
    """``(first row, end row, unit numbers in order, distinct units, first unit of each row and the end)``
    for blocks of about ``block_bytes``; ``texts`` has no nulls."""
    if not len(texts):
        return
    ends, data = text_bytes(texts)
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(ends, ends[a] + block_bytes, side="right")) - 1)
        d = data[ends[a]:ends[z]]
        white = _WHITE[d]
        start = white.copy()
        start[1:] &= ~white[:-1]
        at = np.flatnonzero(start)
        at = at[at > 0]
        start[at[_maybe_wide(d, at)]] = False
        start[1:] |= _MARK[d[1:]] & _WORD[d[:-1]]
        rows = ends[a:z + 1] - ends[a]
        start[rows[rows < len(d)]] = True
        at = np.flatnonzero(start)
        units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(d)).astype(np.int64)), pa.py_buffer(d)])
        coded = units.dictionary_encode()
        yield a, z, coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.searchsorted(at, rows)
        a = z


def gathered(codes: np.ndarray, values: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values (arrays of ``kind`` as bytes) of ``codes`` one after another, and where each ends."""
    flat = np.frombuffer(b"".join(values), kind)
    size = np.fromiter(map(len, values), np.int64, len(values)) // flat.itemsize
    first = np.cumsum(size) - size
    each = size[codes]
    end = np.cumsum(each)
    total = int(end[-1]) if len(end) else 0
    return flat[np.arange(total) + np.repeat(first[codes] - (end - each), each)], end


def cut(end: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the values of each row begin, and the end, from ``gathered``'s ends and the rows' first units."""
    return np.append(0, end)[bounds]
