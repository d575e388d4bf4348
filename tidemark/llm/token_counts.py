"""Exact token counts, huge documents by overlap resynchronisation.

A text of up to ``chunk`` bytes is cut at stable places (a space after a
non-space, across which the byte-level pattern never matches) and the pieces'
counts are remembered per worker. A larger one is encoded in overlapping
chunks. Each encoding yields the byte offset where every token ends. Two
neighbouring encodings are spliced at an offset where both end a token AND
that is a stable place (the split pattern cannot match across it: a visible
character before it, another kind of character or white space behind it):
what stands left of it cannot depend on what follows, and what stands right
of it cannot depend on what went before. Where the overlap holds no such place
it is widened twofold, in the end to the whole of the first chunk, which then
doubles to the right: a text without any such place is still exact, and the
work stays in proportion to its length.

Defined results: null text is empty, with 0 bytes and 0 tokens; special
strings inside a text become their one special token, as the library does by
default; repeated rows and null ids stay; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import segments
from .common import Memory, slices, small_batches, whole_text

#: Bytes of a chunk and of the first overlap between two.
CHUNK, OVERLAP = 32_768, 256
#: Entries of a generation of a worker's memory of piece counts.
MEMO = 600_000
_PLAIN = re.compile(r" [^\s<>|]+")


def _char_start(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _kind(c: str) -> str:
    """L(etter), N(umber), O(ther), Z for white space; '' for characters whose kind two
    Unicode versions a long time apart do not agree on (the tokenizer has its own)."""
    if c.isspace():
        return "Z"
    now, then = unicodedata.category(c)[0], unicodedata.ucd_3_2_0.category(c)[0]
    return "" if now != then or now in "CZM" else now if now in "LN" else "O"


def _last_stable(data: bytes, at: np.ndarray, special: tuple[bytes, ...] = ()) -> int | None:
    """The last of the offsets across which the split pattern cannot match: a visible
    character stands before it and one of another kind (or white space) behind it, no
    apostrophe of a contraction reaches over it, and no special string either."""
    for p in at[::-1].tolist():
        if not 0 < p < len(data) or data[p] & 0xC0 == 0x80:
            continue
        before, here = data[_char_start(data, p - 1):p].decode(), _kind(data[p:p + 4].decode(errors="ignore")[0])
        kind = _kind(before)
        if not here or kind in ("", "Z", here) or (before == "'" and here == "L"):
            continue
        if not any(s in data[max(0, p - len(s) + 1):p + len(s) - 1] for s in special):
            return p
    return None


def count_spliced(data: bytes, ends_of: Callable[[bytes], np.ndarray],
                  chunk: int = CHUNK, overlap: int = OVERLAP, special: tuple[bytes, ...] = ()) -> int:
    """Tokens of ``data``; ``ends_of`` gives the byte offsets of token ends, ``special``
    the strings that are one token wherever they stand."""
    size, start, total = len(data), 0, 0
    stop = _char_start(data, min(size, chunk)) or size
    ends = ends_of(data[:stop])
    while stop < size:
        width = overlap
        while True:
            begin = _char_start(data, stop - width)
            if begin <= start:          # the overlap has taken in the whole chunk: go on to the right, twice as far
                stop = start + 2 * max(stop - start, chunk)
                stop = _char_start(data, stop) if stop < size else size
                ends = start + ends_of(data[start:stop])
                width = overlap
                if stop == size:
                    return total + len(ends)
                continue
            beyond = begin + max(chunk, 2 * width)
            beyond = _char_start(data, beyond) if beyond < size else size
            after = begin + ends_of(data[begin:beyond])
            cut = _last_stable(data, np.intersect1d(ends[(ends > begin) & (ends < stop)], after, assume_unique=True), special)
            if cut is not None:
                break
            width *= 2
        total += int(np.count_nonzero(ends <= cut))
        start, stop, ends = cut, beyond, after[after > cut]
    return total + len(ends)


class Counter:
    """A tokenizer file with one worker's memory of piece counts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.counts = Memory(MEMO)
        special = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.width[i] = special.get(i, len(token))     # one character stands for one byte

    def ends_of(self, data: bytes) -> np.ndarray:
        ids = self.tokenizer.encode_batch_fast([data.decode()], add_special_tokens=False)[0].ids
        ends = np.cumsum(self.width[ids])
        if len(data) != (ends[-1] if len(ends) else 0):
            raise ValueError("the tokenizer is not byte-level: its tokens do not add up to the text")
        return ends

    def _count_pieces(self, pieces: list[str]) -> dict[str, int]:
        """Tokens of each piece. Pieces that begin with their only space are encoded as one
        text: every place where they meet is stable, so token ends fall to pieces by offset."""
        found = {}
        plain = [s for s in pieces if _PLAIN.fullmatch(s)]
        rest = [s for s in pieces if not _PLAIN.fullmatch(s)]
        for at in range(0, len(plain), 2_000):
            part = [s.encode() for s in plain[at:at + 2_000]]
            stops = np.cumsum([len(s) for s in part])
            upto = np.searchsorted(self.ends_of(b"".join(part)), stops, side="right")
            found.update(zip(plain[at:at + 2_000], np.diff(upto, prepend=0).tolist()))
        for at in range(0, len(rest), 2_000):
            got = self.tokenizer.encode_batch_fast(rest[at:at + 2_000], add_special_tokens=False)
            found.update(zip(rest[at:at + 2_000], map(len, got)))
        return found

    def count_texts(self, texts: list[str], chunk: int, overlap: int) -> list[tuple[int, int]]:
        sizes = [len(t.encode()) for t in texts]
        cut = [segments(t) if n <= chunk else None for t, n in zip(texts, sizes)]
        new = self.counts.need(s for ss in cut if ss for s in ss)
        known = self.counts.young
        known.update(self._count_pieces(new))
        out = [(n, count_spliced(t.encode(), self.ends_of, chunk, overlap, self.special) if ss is None
                else sum(map(known.__getitem__, ss))) for t, n, ss in zip(texts, sizes, cut)]
        self.counts.turn()
        return out


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id",
                 text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _COUNTERS:
            _COUNTERS[tokenizer_path] = Counter(tokenizer_path)
        c = _COUNTERS[tokenizer_path]
        for t in slices(batches, "text"):
            got = c.count_texts(t["text"].to_pylist(), chunk, overlap)
            out = pa.table({"doc_id": t["doc_id"], "n_bytes": pa.array([g[0] for g in got], pa.int64()),
                            "n_tokens": pa.array([g[1] for g in got], pa.int64()),
                            "over_limit": pa.array([g[1] > limit for g in got], pa.bool_())})
            yield from out.combine_chunks().to_batches()

    return whole_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
