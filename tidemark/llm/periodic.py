"""Periodic runs of words by recompression.

The words of a slice of documents lie one after the other, every document
between two separators that equal nothing. A run-length grammar is built over
them level by level: block compression names every maximal block of one symbol
by (symbol, length); pair compression deals symbols to a left and a right side
and names every left-right pair. Names are exact (equal names, equal words), and
equal stretches are parsed alike but for their rims, so a longest common
extension walks up the levels and down again with one step a level, for all
queries of a slice at once. No suffix array is built.

Candidates come from a harmonic grid: a run of period p and at least four
periods has 3p neighbouring places that equal the place p further on, and one
of them is a multiple of 3p. So n / 3p places are tried for every p up to n / 4,
about n / 3 * ln n in all, and extended exactly to both sides. The same stretch
is found for multiples of its period; the smallest is kept.

Defined results: null and empty texts have no words and no runs; a null id stays;
repeated rows are rows of their own; other columns are left behind; an empty
table gives none. A document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices, small_batches, whole_text

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Symbols of a document at which no further level is built; candidates looked at together.
TOP, TOGETHER = 8, 500_000


@dataclass
class Level:
    """A string of symbols, and for all but the topmost the symbol of the next level
    that holds each (``parent``) and the first symbol that each of those holds (``first``,
    with one entry more). ``block``: the next level names blocks, otherwise pairs."""
    symbols: np.ndarray
    block: bool = False
    parent: np.ndarray | None = None
    first: np.ndarray | None = None


def _named(keys: np.ndarray, begin: int) -> tuple[np.ndarray, int]:
    """Names from ``begin`` on, equal for equal keys; and the next free name."""
    held, names = np.unique(keys, return_inverse=True)
    return names.astype(np.int64) + begin, begin + len(held)


def _sides(symbols: np.ndarray, turn: int) -> np.ndarray:
    """Left (False) or right (True) side of every symbol, by a hash of its name and the turn."""
    x = (symbols.astype(np.uint64) << np.uint64(16)) + np.uint64(turn)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(63)).astype(bool)


def recompress(symbols: np.ndarray, separators: int) -> list[Level]:
    """The grammar's levels. Names below ``separators`` stand once each, first and last
    among them, and are never compressed."""
    levels = [Level(symbols.astype(np.int64))]
    free = int(symbols.max()) + 1

    def rise(keep: np.ndarray, named: np.ndarray, block: bool) -> None:
        """Put a level on top whose symbols begin where ``keep``."""
        low = levels[-1]
        first = np.flatnonzero(keep)
        low.block, low.parent = block, (np.cumsum(keep) - 1).astype(np.int32)
        low.first = np.append(first, len(keep)).astype(np.int32)
        levels.append(Level(named))

    for turn in count():                            # sides are dealt anew every turn, so every pair gets parted
        s = levels[-1].symbols
        if np.diff(np.flatnonzero(s < separators)).max(initial=1) - 1 <= TOP:
            return levels
        new = np.append(True, s[1:] != s[:-1])
        if not new.all():
            first = np.flatnonzero(new)
            named, size = s[first], np.diff(np.append(first, len(s)))
            many = size > 1
            named[many], free = _named(named[many] << 32 | size[many], free)
            rise(new, named, True)
            s = named
        right, plain = _sides(s, turn), s >= separators
        both = plain[:-1] & plain[1:] & (right[:-1] != right[1:])
        up, down = both & right[1:], both & right[:-1]
        pair = up if np.count_nonzero(up) >= np.count_nonzero(down) else down      # either way round
        if pair.any():
            keep = np.append(True, ~pair)
            named = s[keep]
            joined = np.append(pair, False)[keep]
            named[joined], free = _named(s[:-1][pair] << 32 | s[1:][pair], free)
            rise(keep, named, False)


def extend(levels: list[Level], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """For all pairs of places: how many words agree from there on, to the right
    (``step`` 1) or to the left (-1). A pair's two places must differ."""
    at_a, at_b = a.astype(np.int64), b.astype(np.int64)
    top = len(levels) - 1
    stop = np.full(len(a), top)
    near, far = (0, 1) if step > 0 else (1, 0)       # a symbol's first or last child

    def child(low: Level, up: np.ndarray, end: int) -> np.ndarray:
        return low.first[up + end] - end

    def shared(low: Level, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How much is left of the blocks at x and y: the lesser, and whether as much."""
        left, other = ((child(low, low.parent[z], far) - z) * step + 1 for z in (x, y))
        return np.minimum(left, other), left == other

    on = np.arange(len(a))
    for k, low in enumerate(levels[:-1]):
        x, y = at_a[on], at_b[on]
        same = low.symbols[x] == low.symbols[y]
        stop[on[~same]] = k
        on, x, y = on[same], x[same], y[same]
        if not len(on):
            break
        # inside a symbol of the next level: on to where it ends on both sides
        inside = (x != child(low, low.parent[x], near)) | (y != child(low, low.parent[y], near))
        if low.block:
            move, level = shared(low, x, y)
            move, level = np.where(inside, move, 0), level | ~inside
        else:
            move, level = inside.astype(np.int64), np.ones(len(on), dtype=bool)
        x, y = x + step * move, y + step * move
        stop[on[~level]] = k
        at_a[on], at_b[on] = np.where(level, low.parent[x], x), np.where(level, low.parent[y], y)
        on = on[level]
    last = levels[-1].symbols
    while len(on):
        on = on[last[at_a[on]] == last[at_b[on]]]
        at_a[on] += step
        at_b[on] += step
    for k in range(top - 1, -1, -1):
        on, low = np.flatnonzero(stop > k), levels[k]
        x, y = child(low, at_a[on], near), child(low, at_b[on], near)
        same = low.symbols[x] == low.symbols[y]
        move = np.where(same, shared(low, x, y)[0], 0) if low.block else same.astype(np.int64)
        at_a[on], at_b[on] = x + step * move, y + step * move
    return (at_a - a) * step


def _ragged(size: np.ndarray) -> np.ndarray:
    """0, 1, ... of every run, one run after the other."""
    stop = np.cumsum(size)
    return np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size, size)


def _grid(begin: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods to try, of documents that begin there and have n words: for
    every period p up to n / 4 the multiples of 3p, some hundred thousand at a time."""
    periods = np.where(n >= LEAST_WORDS, n // LEAST_PERIODS, 0)
    upto, at = np.cumsum(periods), 0
    total = int(upto[-1]) if len(upto) else 0
    while at < total:
        stop = min(total, at + TOGETHER)
        place = np.arange(at, stop)
        doc = np.searchsorted(upto, place, side="right")
        p = place - (upto[doc] - periods[doc]) + 1
        size = (n[doc] - 1 - p) // (3 * p) + 1
        cuts = np.searchsorted(np.cumsum(size), np.arange(TOGETHER, int(size.sum()) + TOGETHER, TOGETHER), side="right")
        for i, j in zip(np.append(0, cuts), np.append(cuts, len(size))):
            if i < j:
                of = p[i:j].repeat(size[i:j])
                yield begin[doc[i:j]].repeat(size[i:j]) + 3 * of * _ragged(size[i:j]), of
        at = stop


def find_runs(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of documents whose words' numbers lie one after the other, ``n`` words each:
    document, start (word of the document), length and smallest period, in this order."""
    docs = len(n)
    upto = np.append(0, np.cumsum(n))
    place = np.arange(len(words)) + np.repeat(np.arange(docs), n) + 1       # behind its document's separator
    text = np.empty(len(words) + docs + 1, dtype=np.int64)
    text[upto + np.arange(docs + 1)] = np.arange(docs + 1)
    text[place] = words.astype(np.int64) + docs + 1
    levels = recompress(text, docs + 1)
    begin = upto[:-1] + np.arange(docs) + 1
    found = [np.empty((3, 0), dtype=np.int64)]
    for at, p in _grid(begin, n):
        hit = text[at] == text[at + p]
        at, p = at[hit], p[hit]
        right, left = extend(levels, at, at + p, 1), extend(levels, at - 1, at + p - 1, -1)
        long = left + right + p >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
        found.append(np.stack([(at - left)[long], (left + right + p)[long], p[long]]))
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[:len(start)]
    start, length, period = start[new], length[new], period[new]
    doc = np.searchsorted(begin, start, side="right") - 1
    start = start - begin[doc]
    order = np.lexsort((period, start, doc))
    return doc[order], start[order], length[order], period[order]


_RUNS = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (stretches without ASCII white space) and how many each text has."""
    cut = pc.ascii_split_whitespace(texts)
    flat, size = cut.flatten(), pc.list_value_length(cut).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    n = np.bincount(np.repeat(np.arange(len(texts)), size)[full], minlength=len(texts))
    return flat.filter(pa.array(full)), n


def runs_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Number of words, runs, and the text without what runs repeat, of every text."""
    flat, n = words_of(texts)
    doc, start, length, period = find_runs(flat.dictionary_encode().indices.to_numpy(), n)
    upto = np.append(0, np.cumsum(n))
    # a word goes if a run holds it behind that run's first period
    drop = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(drop, upto[doc] + start + period, 1)
    np.add.at(drop, upto[doc] + start + length, -1)
    keep = np.cumsum(drop)[:-1] == 0
    kept = np.append(0, np.cumsum(keep))[upto]
    text = pc.binary_join(pa.LargeListArray.from_arrays(kept, flat.filter(pa.array(keep))), " ")
    held = np.append(0, np.cumsum(np.bincount(doc, minlength=len(n))))
    runs = pa.ListArray.from_arrays(pa.array(held, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUNS)))
    return n, runs, text


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start then period;
    words are numbered from 0), collapsed (the words that no run repeats, joined by a
    space). A run has smallest period q, at least max(6, 4 q) words, and ends on both
    sides where the next word would break the period."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches, "text"):
            n, runs, text = runs_of(t["text"].combine_chunks())
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(n, pa.int64()), runs, text],
                                             ["doc_id", "n_words", "runs", "collapsed"])

    return whole_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
