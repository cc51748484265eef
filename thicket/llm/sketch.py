"""Fast similarity sketching: t coordinates filled by rounds of hashed bin placement.

In round i < t every element goes to one hashed bin; in round t + b every element
goes to bin b, so that after 2t rounds each coordinate is filled, however small
the set.  A bin keeps the smallest value of the first round that reaches it.  Two
sets agree in a coordinate with probability J, with Chernoff-style concentration.
"""

from __future__ import annotations

import numpy as np

from thicket.llm.text import mix

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ROUND = np.uint64(0xA0761D6478BD642F)


def sketches(elements: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """(sets, t) coordinates of the sets elements[first[i]:first[i+1]]; EMPTY for an empty set."""
    n = len(first) - 1
    out = np.full((n, t), EMPTY, np.uint64)
    if not len(elements):
        return out
    flat, filled = out.reshape(-1), np.zeros(n * t, bool)
    size = np.diff(first)
    owner = np.repeat(np.arange(n), size)
    x = elements
    for i in range(2 * t):
        salt = mix(np.array([i + 1], np.uint64) * _ROUND)
        if i < t:
            h = mix(x ^ salt)
            slot = owner * t + (h % np.uint64(t)).astype(np.int64)
            new = ~filled[slot]
            np.minimum.at(flat, slot[new], h[new])
            filled[slot[new]] = True
        else:
            want = ~filled[owner * t + (i - t)]
            if want.any():
                slot = owner[want] * t + (i - t)
                np.minimum.at(flat, slot, mix(x[want] ^ salt))
                filled[slot] = True
        if i < 8 or i % 16 == 15:
            open_ = ~filled.reshape(n, t).all(axis=1) & (size > 0)
            if not open_.any():
                break
            more = open_[owner]
            if not more.all():
                x, owner = x[more], owner[more]
    return out


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """(sets, bands) 64-bit keys of the bands' coordinates; equal bands of two places differ in key."""
    n, t = sketch.shape
    rows = t // bands
    out = np.zeros((n, bands), np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + sketch[:, k : bands * rows : rows])
    return mix(out + np.arange(1, bands + 1, dtype=np.uint64) * _ROUND)
