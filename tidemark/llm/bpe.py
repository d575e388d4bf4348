"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The vocabulary of a slice of the corpus (some megabytes of whole texts) is
encoded at once: the distinct words that are not known yet lie in one flat
token sequence, an inverted index leads from a token pair's rank to the
positions where the pair stands, and every merge present is applied in rank
order over all words, touching only the merged tokens' neighbours. Words do
not influence each other, so how the corpus is cut into slices cannot change
an id. Words are remembered per Python worker in a bounded memory.

Texts are first cut where a space follows a non-space. No alternative of the
split pattern matches across such a place and none looks behind, so segments
can be split and remembered on their own.

Defined results: null and empty text give no tokens; ids and decoded bytes are
those of the whole text, however long; repeated rows give repeated rows; a
null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memory, slices, small_batches, whole_text

#: Characters of a slice: a merge then has many positions to work on at once.
SLICE = 8_000_000
#: Entries of a generation of a worker's memory.
MEMO = 300_000

_SPACE_AFTER_SPACE = re.compile(r"\s ")
#: Letters only, whichever Unicode version: the split pattern takes it whole.
_ONE_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


def segments(text: str) -> list[str]:
    """Pieces of the text that the split pattern can be applied to one by one."""
    if "\0" in text or _SPACE_AFTER_SPACE.search(text):
        return _BEFORE_SPACE.split(text)
    return text.replace(" ", "\0 ").split("\0")


class Codec:
    """Ranks and pattern of one vocabulary, with one worker's memory of words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        tokens = sorted(ranks, key=ranks.get)
        if [ranks[t] for t in tokens] != list(range(len(tokens))):
            raise ValueError("ranks must be 0, 1, 2, ...")
        # every pair of tokens that makes a token, as one sorted integer key
        made = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items()
                      for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pair_keys = np.array([k for k, _ in made], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in made], dtype=np.int64)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.width = np.array([len(t) for t in tokens], dtype=np.int64)
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.place = np.cumsum(self.width) - self.width
        self.decimal = [str(i) for i in range(len(tokens))]
        self.words = Memory(MEMO)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or -1."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of every word, all words merged together in rank order."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        stops = np.cumsum(sizes)
        token = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(token)
        left, right = np.arange(-1, n - 1), np.arange(1, n + 1)
        left[stops - sizes], right[stops - 1] = -1, -1      # no pair crosses a word's end
        index: dict[int, list[np.ndarray]] = {}             # rank of a pair -> its left positions
        queue: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self._rank(token[at], token[right[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for r, i, j in zip(rank[bounds[:-1]].tolist(), bounds, bounds[1:]):
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(queue, r)

        enter(np.flatnonzero(right >= 0))
        while queue:
            rank = heapq.heappop(queue)
            lists = index.pop(rank)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            p = p[(token[p] >= 0) & (right[p] >= 0)]
            p = p[self._rank(token[p], token[right[p]]) == rank]      # neighbours may have changed since
            q = right[p]
            if len(p) > 1 and (clash := q[:-1] == p[1:]).any():         # aaa: the left pair goes first
                take, last = [], -1
                for x, y in zip(p.tolist(), q.tolist()):
                    if x != last:
                        take.append(x)
                        last = y
                p = np.array(take, dtype=np.int64)
                q = right[p]
            if not len(p):
                continue
            token[p], token[q] = rank, -1
            after = right[q]
            right[p], right[q] = after, -1
            on = after >= 0
            left[after[on]] = p[on]
            before = left[p]
            enter(np.unique(np.concatenate([before[before >= 0], p[on]])))
        alive = token >= 0
        ids = token[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive)[stops - 1] * 4
        return [ids[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        cut = [[s for s in segments(t) if s] for t in texts]
        known = self.words.young
        split = {s: [s] if _ONE_WORD.fullmatch(s) else self.pattern.findall(s)
                 for s in self.words.need(chain.from_iterable(cut))}
        new = self.words.need(chain.from_iterable(split.values()))
        if new:
            known.update(zip(new, self.replay([w.encode() for w in new])))
        known.update([(s, b"".join([known[w] for w in ws])) for s, ws in split.items()])
        out = [np.frombuffer(b"".join(map(known.__getitem__, ss)), dtype="<u4") for ss in cut]
        self.words.turn()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered from the vocabulary."""
        width = self.width[ids]
        stop = np.cumsum(width)
        if not len(ids):
            return b""
        return self.blob[np.arange(stop[-1]) + np.repeat(self.place[ids] - (stop - width), width)].tobytes()

    def spell(self, ids: np.ndarray) -> str:
        return " ".join(map(self.decimal.__getitem__, ids.tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    if (ranks_path, pattern) not in _CODECS:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODECS[ranks_path, pattern] = Codec(ranks, pattern)
    return _CODECS[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by one space), decoded (bytes of
    the ids). ``ranks_path`` is read on the executors, where the vocabulary is
    installed like any library file."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for t in slices(batches, "text", SLICE):
            ids = c.encode_texts(t["text"].to_pylist())
            out = pa.table({"doc_id": t["doc_id"], "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                            "ids": pa.array(map(c.spell, ids), pa.string()),
                            "decoded": pa.array(map(c.decode, ids), pa.binary())})
            yield from out.combine_chunks().to_batches()

    return whole_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded binary")
