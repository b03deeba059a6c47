"""Word shingles as 64-bit hashes, computed for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All of ASCII but letters and digits; bytes of other letters belong to words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _numbers(start: int, count: int) -> np.ndarray:
    return mix(np.arange(start + 1, start + 1 + count, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


_BYTE = _numbers(0, 256)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z are lower-cased
_PLACE = _numbers(1 << 20, 256)
_IN_SHINGLE = _numbers(1 << 21, 64)


def word_hashes(texts: list[bytes], between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many words each text has.

    A word is a run of bytes other than those ``between`` words (space and 0x09
    to 0x0D); A-Z count as a-z.
    """
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = between[flat]
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, np.r_[0, text_ends]))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    place = np.arange(len(flat)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(flat)]))
    longest = int(lengths.max())
    factors = _PLACE if longest <= len(_PLACE) else _numbers(1 << 20, longest)
    # The byte after a word and further blanks get factor 0 by the mask.
    terms = _BYTE[flat] * factors[np.minimum(place, len(factors) - 1)]
    terms[space] = 0
    return mix(np.add.reduceat(terms, starts)), counts


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text with fewer than ``words`` words has its whole sequence as the only
    shingle; one without words has none.
    """
    hashes, counts = word_hashes(texts)
    total = len(hashes) - words + 1
    rolled = np.zeros(max(0, total), np.uint64)
    for i in range(words):
        rolled += hashes[i : i + max(0, total)] * _IN_SHINGLE[i]
    rolled = mix(rolled)
    out, at = [], 0
    for count in counts.tolist():
        if count >= words:
            out.append(np.unique(rolled[at : at + count - words + 1]))
        elif count:
            whole = (hashes[at : at + count] * _IN_SHINGLE[:count]).sum(dtype=np.uint64)
            out.append(mix(np.array([whole + _U(count)])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out
