"""Numbered distinct values and ragged arrays, shared by the text operators.

Text repeats its words, so the operators number the distinct pieces of a batch,
work once on each, and gather the results back with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Iterable, Iterator
from itertools import islice
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

T = TypeVar("T")


class Numbering(dict):
    """Give every new key the next number; looking a key up numbers it."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def space_keys(texts: pa.Array) -> pa.Array:
    """Cut texts where a byte-level pattern always starts a new match.

    That is before a single space or line break with no other white space
    beside it. Matching the pieces one by one then equals matching the text.
    Returns a list of keys per text; ``piece_text`` gives the characters of each.
    """
    odd = pc.match_substring_regex(texts, _ODD_SPACE)
    marked = pc.binary_join_element_wise(LITERAL, texts, "")
    keys = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
    if not pc.any(odd).as_py():
        return keys
    plain = pc.filter(keys, pc.invert(odd))
    cut = pa.array(
        [[LITERAL + piece for piece in _CUT(text)]
         for text in pc.filter(texts, odd).to_pylist()], pa.list_(pa.string()))
    is_odd = odd.to_numpy(zero_copy_only=False)
    place = np.where(is_odd, len(plain) + np.cumsum(is_odd) - 1, np.cumsum(~is_odd) - 1)
    return pa.concat_arrays([plain, cut]).take(pa.array(place))


# a key that starts so holds its text as it is
LITERAL = "\x00"
# white space of any kind side by side, or the mark itself
_ODD_SPACE = r"[\s\pZ\x{0b}\x{1c}-\x{1f}\x{85}]{2}|\x{00}"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)").split


def piece_text(key: str) -> str:
    """The characters of a key: a line break is kept, a space is implied."""
    if key.startswith(LITERAL):
        return key[1:]
    return key if key.startswith("\n") else " " + key


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Where each run starts, and where the last one ends."""
    found = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=found[1:])
    return found


def gather(offsets: np.ndarray, values: np.ndarray,
           chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``chosen`` of a ragged array, one after another, and offsets."""
    lengths = offsets[chosen + 1] - offsets[chosen]
    out = offsets_of(lengths)
    if not out[-1]:
        return values[:0], out
    at = np.arange(out[-1]) + np.repeat(offsets[chosen] - out[:-1], lengths)
    return values[at], out


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in ascending order."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def ragged(runs: Iterable, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list of lists."""
    runs = list(runs)
    lengths = np.fromiter(map(len, runs), np.int64, len(runs))
    out = offsets_of(lengths)
    values = np.fromiter(
        (x for run in runs for x in run), dtype, int(out[-1]))
    return out, values


def text_blocks(texts: pa.Array, max_chars: int) -> Iterator[pa.Array]:
    """Consecutive texts, null as empty, in arrays of about ``max_chars`` bytes.

    A longer text makes an array of its own.
    """
    texts = pc.fill_null(texts, "")
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > max_chars:
            yield texts.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield texts.slice(start)


_HELD: dict = {}


def held(key: Hashable, build: Callable[[], T]) -> T:
    """What ``build`` makes, kept by this worker until it needs another.

    Workers serve one operator after another, so that only one is kept.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


# distinct keys a worker remembers between batches
KNOWN_KEYS = 300_000


class KeyTable:
    """A ragged value per key, worked out once for each key met.

    ``learn`` takes new keys and gives their offsets and values. The table is
    only for speed: past ``known`` keys it forgets those met once, and all of
    them if too many are left.
    """

    def __init__(self, learn: Callable[[list], tuple[np.ndarray, np.ndarray]], dtype,
                 known: int | None = None):
        self.learn, self.dtype, self.known = learn, dtype, known or KNOWN_KEYS
        self._start([], np.zeros(1, np.int64), np.zeros(0, dtype))

    def _start(self, keys: list, starts: np.ndarray, values: np.ndarray) -> None:
        self.keys = Numbering(zip(keys, range(len(keys))))
        self.starts, self.values = starts, values
        self.met = np.zeros(len(keys), np.int64)

    def _forget(self) -> None:
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > self.known // 2:
            kept = kept[:0]
        names = list(self.keys)
        values, starts = gather(self.starts, self.values, kept)
        self._start([names[i] for i in kept.tolist()], starts, values)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text is a list of keys: its values in order, with offsets."""
        if len(self.keys) > self.known:
            self._forget()
        coded = texts.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.keys.__getitem__, names), np.int32, len(names))
        fresh = list(islice(self.keys, len(self.met), None))
        if fresh:
            starts, values = self.learn(fresh)
            self.starts = np.concatenate([self.starts, self.starts[-1] + starts[1:]])
            self.values = np.concatenate([self.values, values.astype(self.dtype)])
        every = number[coded.indices.to_numpy()]
        met = np.bincount(every, minlength=len(self.keys))
        met[:len(self.met)] += self.met
        self.met = met
        values, ends = gather(self.starts, self.values, every)
        sizes = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
        return ends[offsets_of(sizes)], values
