"""Words and their hashes over whole Arrow batches, in numpy.

A word is a longest run of characters outside space and U+0009 to U+000D. These are single
bytes in UTF-8 that occur in no other character, so words are found on bytes.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from threatloom.llm.frames import text_buffers

_NEWLINE = [pa.scalar(text, pa.large_string()) for text in ("", "\n")]  # what is joined, and the separator
_AS_IT_IS = np.arange(256, dtype=np.uint8)
_AS_IT_IS[9:14] = 32
_LOWER = _AS_IT_IS.copy()
_LOWER[65:91] += 32


@dataclass
class Words:
    """`data` holds each text's words with one space after each; word k is data[start[k] : start[k] + size[k]]."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray  # of each text, the number of its first word; n + 1 entries

    def of_text(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    """The words of each text, A-Z lower-cased if asked. Null and empty texts have none."""
    ended = pc.binary_join_element_wise(texts.cast(pa.large_string()).fill_null(""), *_NEWLINE)
    data, offsets = text_buffers(ended)
    data = (_LOWER if lower else _AS_IT_IS)[data]
    inside = data != 32
    after = np.zeros(len(data), dtype=bool)  # the one space kept behind each word
    after[1:] = inside[:-1] & ~inside[1:]
    out = data[inside | after]
    ends = np.flatnonzero(out == 32)
    start = np.zeros(len(ends), np.int64)
    start[1:] = ends[:-1] + 1
    return Words(out, start, ends - start, np.searchsorted(np.flatnonzero(after), offsets))


# --- Fixed values: the five primes of XXH64 --------------------------------------
_P1 = np.uint64(11400714785074694791)
_P2 = np.uint64(14029467366897019727)
_P3 = np.uint64(1609587929392839161)
_P4 = np.uint64(9650029242287828579)
_P5 = np.uint64(2870177450012600261)
# ----------------------------------------------------------------------------------
_LONG = 512


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lane(acc, value: np.ndarray) -> np.ndarray:
    return _turn(acc + value * _P2, 31) * _P1


def _same_length(data: np.ndarray, at: np.ndarray, length: int, seed: np.uint64) -> np.ndarray:
    """XXH64 of the strings data[at : at + length], all at once."""
    wide = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    half = np.ndarray((max(0, len(data) - 3),), "<u4", data, strides=(1,))
    done = 0
    if length >= 32:
        lanes = [np.full(len(at), v, np.uint64) for v in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        while done + 32 <= length:
            lanes = [_lane(lane, wide[at + (done + 8 * k)]) for k, lane in enumerate(lanes)]
            done += 32
        h = sum((_turn(lane, by) for lane, by in zip(lanes, (1, 7, 12, 18), strict=True)), np.zeros(len(at), np.uint64))
        for lane in lanes:
            h = (h ^ _lane(np.uint64(0), lane)) * _P1 + _P4
    else:
        h = np.full(len(at), seed + _P5, np.uint64)
    h = h + np.uint64(length)
    while done + 8 <= length:
        h = _turn(h ^ _lane(np.uint64(0), wide[at + done]), 27) * _P1 + _P4
        done += 8
    if done + 4 <= length:
        h = _turn(h ^ (half[at + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
        done += 4
    while done < length:
        h = _turn(h ^ (data[at + done].astype(np.uint64) * _P5), 11) * _P1
        done += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxh64(data: np.ndarray, at: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each string data[at : at + size], grouped by size; the few very long ones go to the library one by one."""
    out = np.zeros(len(at), np.uint64)
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    cuts = np.flatnonzero(np.diff(ranked)) + 1
    with np.errstate(over="ignore"):
        for group in np.split(order, cuts) if len(order) else []:
            length = int(sizes[group[0]])
            if length > _LONG:
                for k in group:
                    out[k] = xxhash.xxh64_intdigest(data[at[k] : at[k] + length].tobytes(), seed=seed)
            else:
                out[group] = _same_length(data, at[group], length, np.uint64(seed))
    return out


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word; it stands for the word wherever words are only compared."""
    return xxh64(words.data, words.start, words.size)
