"""Best-fit packing by bin completion with branch and bound.

Documents become runs of token ids; only a document longer than a sequence is
cut. What has to be packed is then known from a histogram: how many pieces
there are of each length, at most ``size`` numbers whatever the corpus. The
search works on that histogram. It completes one sequence at a time around the
longest piece left: the undominated fillings of the remaining room are
enumerated depth first, without those that waste more than the incumbent allows,
and are tried the fullest first (where there are more than ``LISTED`` steps'
worth, a few greedy ones are tried first and the others as they are found). A
filling is repeated as often as the pieces last, and then any smaller number of
times. A branch is pruned once its sequences, with the lower bound of what is
left, are no fewer than the incumbent's, which starts as the best-fit-decreasing
packing; the search ends at the lower bound of the whole, when all is tried, or
after ``nodes`` nodes (a filling tried, or ``TICK`` steps of an enumeration), and
the incumbent holds.

The plan says: the pieces of length l with ranks [a, b) go to sequences
s + rank - a at offset o. Pieces get consecutive ranks within their length from
two levels (a bounded bucket, and sums over buckets), so no length, however
common, is sorted in one task.

Defined results: null or empty text still holds the end id, so every row gives
at least one piece; repeated rows give repeated pieces; a null doc_id stays
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import math
import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memory, forgetting, slices, small_batches, stored, whole_text

#: Entries of a generation of a worker's memory of words.
MEMO = 300_000
#: Nodes of the search; the incumbent at the end is a full packing in any case.
NODES = 6_000
#: Greedy fillings tried first where the undominated ones are too many to sort.
WIDTH = 6
#: Steps of an enumeration before it goes on as it is used, and steps that count as a node.
LISTED, TICK = 400, 50
#: Pieces that a numbering task sorts.
BUCKET_ROWS = 20_000


#: Letters that stay one letter when lower-cased: ASCII and U+00C0-U+00FF, in UTF-8.
_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
_LETTERS = re.compile(_LETTER + rb"+")


def _one_word(w: bytes) -> bool:
    return w.isalpha() or bool(_LETTERS.fullmatch(w))


# ------------------------------------------------------------- token ids

class Words:
    """Ids of white-space separated words. The tokenizer drops white space
    before it splits, so no token crosses it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.memory = Memory(MEMO)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word. Words of plain letters are encoded as one text: each is one
        unit for the tokenizer, whose last token (and no other) is an end-of-word token."""
        found = {}
        plain, rest = [], []
        for w in words:
            (plain if _one_word(w) else rest).append(w)
        for at in range(0, len(plain), 5_000):
            part = plain[at:at + 5_000]
            ids = np.array(self._ids([b" ".join(part).decode()])[0], dtype="<u4")
            ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not end words as this operator expects")
            raw = ids.tobytes()
            found.update(zip(part, [raw[i:j] for i, j in zip([0, *ends], ends)]))
        for at in range(0, len(rest), 5_000):
            part = rest[at:at + 5_000]
            found.update((w, np.array(i, dtype="<u4").tobytes()) for w, i in zip(part, self._ids([w.decode() for w in part])))
        return found

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_texts(self, texts: list[bytes], end_id: int) -> list[bytes]:
        """Little-endian 32-bit ids of every text with the end id behind. The tokenizer
        lower-cases everything but its special strings, so A-Z may be lower-cased first."""
        cut = [(t if b"<|" in t else t.lower()).split() for t in texts]            # ASCII white space only
        new = self.memory.need(chain.from_iterable(cut))
        known = self.memory.young
        # a stop or comma after a letter is a unit of its own
        ended = [w for w in new if w[-1:] in (b".", b",") and _one_word(w[:-1])]
        whole = set(new).difference(ended)
        known.update(self._encode([*whole, *self.memory.need(x for w in ended for x in (w[:-1], w[-1:]) if x not in whole)]))
        known.update([(w, known[w[:-1]] + known[w[-1:]]) for w in ended])
        end = np.array([end_id], dtype="<u4").tobytes()
        out = [b"".join(map(known.__getitem__, ws)) + end for ws in cut]
        self.memory.turn()
        return out


def pieces(docs: DataFrame, tokenizer_path: str, size: int, end_id: int = 0,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(tokenizer_path)
        for t in slices(batches, "text"):
            texts = t["text"].cast(pa.large_binary()).to_pylist()
            out = [(d, k, k * size, min(size, len(ids) // 4 - k * size), zlib.crc32(ids[4 * k * size:4 * (k + 1) * size]))
                   for d, ids in zip(t["doc_id"].to_pylist(), words.encode_texts(texts, end_id))
                   for k in range(-(-len(ids) // (4 * size)))]
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return whole_text(docs, id_col, text_col).mapInArrow(
        forgetting(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


# ------------------------------------------------------------- the search

def lower_bound(count: np.ndarray, size: int) -> int:
    """Fewest sequences that could hold the histogram: total length, or for a
    cut k the pieces too long to share with those above size - k, plus what the
    middle ones cannot fit into their room."""
    lengths = np.arange(size + 1)
    total = int((count * lengths).sum())
    upto, mass = np.cumsum(count), np.cumsum(count * lengths)
    k = np.arange(1, size // 2 + 1)
    big = upto[size] - upto[size - k]                               # longer than size - k
    mid = upto[size - k] - upto[size // 2]                          # longer than a half
    mid_mass = mass[size - k] - mass[size // 2]
    small = mass[size // 2] - mass[k - 1]
    bounds = big + mid + np.maximum(0, -(-(small - (mid * size - mid_mass)) // size))
    return max(-(-total // size), int(bounds.max(initial=0)))


def _pair(have: np.ndarray, room: int) -> tuple[int, int] | None:
    """The fullest pair that fits the room, the longest piece first."""
    can = np.flatnonzero(have[:room]) if room > 1 else np.empty(0, dtype=np.int64)
    can = can[can > 0]
    if not len(can):
        return None
    partner = np.searchsorted(can, room - can, side="right") - 1    # longest that fits beside each
    partner = np.minimum(partner, np.arange(len(can)))              # counted once, partner not longer
    alone = (partner == np.arange(len(can))) & (have[can] < 2)
    partner = np.where(alone, partner - 1, partner)
    total = np.where(partner >= 0, can + can[partner], -1)
    at = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(can[at]), int(can[partner[at]])) if total[at] > 0 else None


def _greedy(have: np.ndarray, room: int, skip: int) -> tuple[int, ...]:
    """Longest pieces first until one or two close the room exactly; ``skip``: start at the n-th longest."""
    have, out = have.copy(), []
    while room > 0:
        can = np.flatnonzero(have[:room + 1])
        can = can[can > 0]
        if not len(can):
            break
        if have[room]:
            out.append(room)
            break
        two = _pair(have, room)
        if two and sum(two) == room:
            out += two
            break
        take = int(can[max(0, len(can) - 1 - skip)])
        skip = 0
        again = max(1, min(int(have[take]), (room - 2 * take) // take))   # long runs of short pieces at once
        out += [take] * again
        have[take] -= again
        room -= take * again
    return tuple(out)


def undominated(have: np.ndarray, room: int, allowed: int) -> Iterator[tuple[int, ...] | None]:
    """All undominated fillings that leave at most ``allowed`` of the room, longest pieces first; None after every TICK steps.
    A filling is dominated if a piece not in it fits into what it leaves, with the place of none, one, two or all of
    its pieces that are together not longer."""
    # arrays: a search holds these of every node that it stands in
    some = np.flatnonzero(have[1:room + 1]) + 1
    asc, lens, number = array("i", some.tolist()), array("i", some[::-1].tolist()), array("q", have[:room + 1].tolist())
    mass = array("q", [0, *np.cumsum(some * have[some]).tolist()][::-1])       # of the pieces from a place of lens on
    steps = 0

    def free(low: int, high: int, used: dict[int, int]) -> bool:
        for x in asc[bisect_left(asc, low):bisect_right(asc, high)]:
            if number[x] > used.get(x, 0):
                return True
        return False

    def dominated(used: dict[int, int], rest: int) -> bool:
        if free(1, rest, used) or any(free(x + 1, x + rest, used) for x in used):
            return True
        held = list(used)
        pairs = {x + y for i, x in enumerate(held) for y in held[i + (used[x] < 2):]}
        if sum(used.values()) > 2:
            pairs.add(room - rest)
        return any(free(x, x + rest, used) for x in pairs)

    def go(at: int, rest: int, used: dict[int, int], allowed: int) -> Iterator[tuple[int, ...] | None]:
        nonlocal steps
        k = max(at, len(lens) - bisect_right(asc, rest))
        if k == len(lens):
            if rest <= allowed and not dominated(used, rest):
                yield tuple(x for x, n in used.items() for _ in range(n))
            return
        while k < len(lens) and rest - mass[k] <= allowed:
            x = lens[k]
            most = min(number[x], rest // x)
            for n in range(most, 0, -1):
                steps += 1
                if steps % TICK == 0:
                    yield None
                # a piece of this length that stays out may not fit into what is left
                yield from go(k + 1, rest - n * x, {**used, x: n}, min(allowed, x - 1) if n < number[x] else allowed)
            allowed = min(allowed, x - 1)
            k += 1

    return go(0, room, {}, allowed)


def fillings(have: np.ndarray, room: int, allowed: int, width: int = WIDTH) -> Iterator[tuple[int, ...] | None]:
    """Undominated ways to fill the room beside the longest piece with at most ``allowed`` left; None after every TICK steps
    beyond the first. The fullest first, where they can be listed; else greedy ones and then all others."""
    if room == 0 or not have[1:room + 1].any():
        if room <= allowed:
            yield ()
        return
    if have[room]:
        yield (room,)                    # one exact piece dominates all else
        return
    every, listed, ticks = undominated(have, room, allowed), [], 0
    for f in every:
        if f is not None:
            listed.append(f)
        elif (ticks := ticks + 1) * TICK >= LISTED:
            break
    else:
        yield from sorted(listed, key=lambda f: (-sum(f), len(f), [-x for x in f]))
        return
    found = {(int(np.flatnonzero(have[:room + 1])[-1]),)}
    if two := _pair(have, room):
        found.add(two)
    for skip in range(width):
        if got := _greedy(have, room, skip):
            found.add(tuple(sorted(got, reverse=True)))
    found = sorted((f for f in found if room - sum(f) <= allowed), key=lambda f: (-sum(f), len(f), [-x for x in f]))[:width]
    yield from found
    yield from (f for f in chain(sorted(listed, key=lambda f: -sum(f)), every) if f not in found)


def _times(most: int) -> Iterator[int]:
    """most, its halves, and then every smaller number."""
    halves = [most >> i for i in range(most.bit_length())]
    yield from halves
    yield from (t for t in range(most - 1, 0, -1) if t not in halves)


def best_fit(count: np.ndarray, size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over the histogram: (times, lengths) of the sequences."""
    by_room: dict[int, dict[tuple[int, ...], int]] = {}
    room_has = np.zeros(size + 1, dtype=bool)
    for length in range(size, 0, -1):
        left = int(count[length])
        while left:
            fits = np.flatnonzero(room_has[length:])
            if len(fits):
                room, each = length + int(fits[0]), 1
                held, times = by_room[room].popitem()
                used = min(times, left)
                if times > used:
                    by_room[room][held] = times - used
                if not by_room[room]:
                    del by_room[room]
                    room_has[room] = False
            else:                                # new sequences of this length alone
                each = min(size // length, left)
                used = left // each
                held, room = (length,) * (each - 1), size - length * (each - 1)
            taken = held + (length,)
            left -= used * each
            rest = room - length
            by_room.setdefault(rest, {})
            by_room[rest][taken] = by_room[rest].get(taken, 0) + used
            room_has[rest] = True
    return [(times, held) for group in by_room.values() for held, times in group.items()]


def complete(count: np.ndarray, size: int, nodes: int = NODES) -> list[tuple[int, tuple[int, ...]]]:
    """Bin completion: (times, lengths) of the sequences, in all as few as the search finds."""
    total = int((count * np.arange(size + 1)).sum())
    if total == 0:
        return []
    bound = lower_bound(count, size)
    best = best_fit(count, size)
    fewest = sum(t for t, _ in best)
    have, path, waste, used = count.astype(np.int64).copy(), [], 0, 0
    #: of every node: what is to be tried, waste and sequences before it, its longest piece, fillings that are done with it
    stack: list[tuple[Iterator, int, int, int, frozenset]] = []

    def options(longest: int, done: frozenset, allowed: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        rest = have.copy()
        rest[longest] -= 1
        every = fillings(rest, size - longest, allowed)
        ahead = [next(every, ...), next(every, ...)]
        only = ahead[1] is ... and ahead[0] is not None          # no other filling is as good, any number of times
        for f in chain(ahead, every):
            if f is ...:
                return
            if f is None:
                yield 0, ()
            elif f not in done:
                bin_ = (longest, *f)
                need = np.unique(bin_, return_counts=True)
                most = int((have[need[0]] // need[1]).min())
                for t in (most,) if only else _times(most):
                    yield t, bin_

    def push(done: frozenset) -> None:
        longest = int(np.flatnonzero(have)[-1])
        if not (stack and stack[-1][3] == longest):
            done = frozenset()
        stack.append((options(longest, done, (fewest - 1) * size - total - waste), waste, used, longest, done))

    push(frozenset())
    while stack and fewest > bound and nodes > 0:
        tried, waste, used, _, done = stack[-1]
        if len(path) == len(stack):             # the last try of this node is undone
            times, bin_ = path.pop()
            if times:
                np.add.at(have, np.array(bin_), times)
        step = next(tried, None)
        if step is None:
            stack.pop()
            continue
        nodes -= 1
        times, bin_ = step
        waste += times * (size - sum(bin_))
        used += times
        if not times or waste > (fewest - 1) * size - total:    # cannot beat the incumbent
            path.append((0, bin_))
            continue
        np.subtract.at(have, np.array(bin_), times)
        path.append(step)
        if not have.any():
            fewest, best = used, [s for s in path if s[0]]
        elif used + lower_bound(have, size) < fewest:
            push(done | {bin_[1:]})
    return best


def slots(bins: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) of every place in the plan."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for times, lengths in bins:
        offset = 0
        for length in lengths:
            a = used.get(length, 0)
            used[length] = a + times
            out.append((length, a, a + times, sequence, offset))
            offset += length
        sequence += times
    return out


# ----------------------------------------------------------- the operator

def pack(docs: DataFrame, tokenizer_path: str, size: int, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, size, end_id, id_col, text_col))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= size rows
    count = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        count[length] = n
    plan = slots(complete(count, size, nodes))
    gc.collect()                                     # the search's generators stand in cycles
    Memory.forget()

    buckets = max(1, math.ceil(int(count.sum()) / BUCKET_ROWS))
    placed = cut.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    in_bucket = Window.partitionBy("length", "__b")
    before = (placed.groupBy("length", "__b").agg(F.count("*").alias("__n"))
              .withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__b")) - F.col("__n")))
    ranked = (placed.withColumn("__r", F.row_number().over(in_bucket.orderBy("doc_id", "piece")) - 1)
              .join(before.drop("__n"), ["length", "__b"])
              .withColumn("__rank", F.col("__r") + F.col("__before")))
    # at most size**2 places in theory, a few thousand in practice, whatever the corpus
    # (as Arrow: rows of Python objects would go through Python workers)
    places = np.array(plan, dtype=np.int64).reshape(-1, 5).T
    table = F.broadcast(spark.createDataFrame(pa.table(list(places), names=["length", "__from", "__to", "__seq", "offset"])))
    return (ranked.join(table, (ranked["length"] == table["length"]) & (ranked["__rank"] >= table["__from"])
                        & (ranked["__rank"] < table["__to"]))
            .select("doc_id", "piece", "start", ranked["length"], "ids_crc32",
                    (F.col("__seq") + F.col("__rank") - F.col("__from")).alias("sequence_id"), "offset"))
