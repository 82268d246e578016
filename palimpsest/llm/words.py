"""Words as the six ASCII space characters part them, and their 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix64

#: The low bytes that a word of so many bytes takes of eight.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 256
_STEP, _SALT = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)


def raw(texts: pa.Array) -> list[bytes]:
    """Texts as their bytes, a null as none."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def split(text: bytes) -> list[bytes]:
    """Words between the six ASCII spaces: of bytes, ``split`` knows these and no others."""
    return text.split()


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word. Eight bytes of all words are read and mixed in at a time."""
    raw = np.frombuffer(text + b"\n\0\0\0\0\0\0\0\0", np.uint8)
    n = len(text)
    space = np.ones(n + 2, bool)
    space[1:] = (raw[: n + 1] == 0x20) | (raw[: n + 1] - np.uint8(0x09) < 5)  # bytes below wrap around
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, size = edges[0::2], edges[1::2] - edges[0::2]
    eight = np.ndarray((n + 2,), "<u8", buffer=raw, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix64((eight[starts] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _STEP)
        done, live = 8, np.flatnonzero(size > 8)
        while len(live) and done < LONG:
            more = eight[starts[live] + done] & _MASK[np.minimum(size[live] - done, 8)]
            out[live] = mix64(out[live] * _STEP ^ (more + _SALT))
            done += 8
            live = live[size[live] > done]
    if len(live):
        from xxhash import xxh64_intdigest

        out[live] = [xxh64_intdigest(text[a : a + k], 7) for a, k in zip(starts[live].tolist(), size[live].tolist(), strict=True)]
    return out, starts
