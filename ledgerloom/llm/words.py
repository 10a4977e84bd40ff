"""Words of whole Arrow string columns as 64-bit numbers, eight bytes at a time."""
from __future__ import annotations

import numpy as np

from .common import IS_SPACE, mix

_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
_LENGTHS = mix(np.arange(256, dtype=np.uint64) * _LENGTH)


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool = False, cuts: np.ndarray | None = None,
                separators: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and, for each text, the number of its first word (one entry more than texts).

    `lower` takes A-Z as a-z. `cuts` are byte positions at which a word starts anew, instead of the starts of texts. Words of up to
    eight bytes never collide with words of the same length.
    """
    bounds, n = off if cuts is None else cuts, len(raw)
    empty = np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    if n == 0:
        return empty
    word = np.zeros(n + 1, bool)
    if separators is IS_SPACE:      # compared: faster than a look into the table
        np.logical_and(raw != 32, raw - np.uint8(9) > 4, out=word[:n])
    else:
        np.logical_not(separators[raw], out=word[:n])
    first, last = word[:n].copy(), word[:n].copy()
    first[1:] &= ~word[:n - 1]
    last &= ~word[1:]
    at = bounds[:-1][bounds[:-1] < n]
    first[at] = word[at]
    before = at[at > 0] - 1
    last[before] = word[before]
    starts = np.flatnonzero(first)
    if not len(starts):
        return empty
    size = np.flatnonzero(last) - starts + 1
    padded = np.zeros(n + 8, np.uint8)
    if lower:
        np.bitwise_or(raw, (raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5), out=padded[:n])
    else:
        padded[:n] = raw
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    h = _LENGTHS[size] if size.max() < len(_LENGTHS) else mix(size.astype(np.uint64) * _LENGTH)
    h ^= eight[starts] & _MASK[np.minimum(size, 8)]
    mix(h)
    rest = np.flatnonzero(size > 8)
    done = 8
    while len(rest):
        part = h[rest] ^ (eight[starts[rest] + done] & _MASK[np.minimum(size[rest] - done, 8)])
        h[rest] = mix(part)
        done += 8
        rest = rest[size[rest] > done]
    return h, np.searchsorted(starts, bounds)
