"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A is a byte-level tokenizer of the tokenizers library, B a sentencepiece model
with byte fallback; both read space + text. Their character spans are coarse
cuts: where a span of whole characters ends, a token ends. Tokens that hold a
part of a character (A) or one byte of it (B's fallback) share that character's
span, so their ends are refined with the bytes the tokens decode to, and all
tokens' bytes are compared with the text's. Offsets where A and B both end cut
the tokens into groups; within a group every A token is linked to every B token.

Neither tokenizer can join what stands on both sides of certain places (before
a space or line end after another character; after a Latin letter before other
visible ASCII; around a lone line end). For B this is read from its vocabulary:
no piece may hold such a place, else texts are taken whole. Texts are cut there,
every distinct unit is aligned once, and a bounded memory keeps it per worker.

Corpus-wide counts of id pairs: a slice of texts carries every pair once, with
its number of documents; a grouped sum over all slices counts them. Counts go
back to the slices that hold the pair: a pair that many slices hold by broadcast
(there are fewer than HOT_SHARE such), others by a shuffled join; each slice then
meets its documents in a cogroup of bounded size.

Defined results: null and empty texts, and texts that either tokenizer changes
(U+2581 in a text is a space to B), have no tokens: zeros and '' in ``groups``.
Special tokens' strings are plain text. Repeated rows count as documents of
their own; null ids stay; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, join_by_key, slices, small_batches, stored, whole_text

#: Bytes of text in a slice; entries of a generation of a worker's memory.
SLICE, MEMO = 2_000_000, 100_000
#: Units that are encoded as one text, and its characters.
UNITS, JOINED = 2_000, 65_536
#: Tokens of a group from which its links are counted by distinct ids.
WIDE = 64

_LATIN = "A-Za-zÀ-ÖØ-öø-ſ"
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_PREFIX = re.compile(f"[{_LATIN}]+(?=[!-@\\[-`{{-~])")
_INNER = re.compile(r"\s")
#: Units that can be joined with others: no white space but one leading space.
_EVEN = re.compile(r" ?[^\s▁]+")
_CROSSING = re.compile(f"[^▁]▁|\n|[{_LATIN}][!-@\\[-`{{-~]")

#: Texts that a plain split at every space and line end would cut elsewhere too.
_UNEVEN = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}][ \n]|\x00"


def segments(texts: pa.Array, cut: bool) -> pa.ListArray:
    """Cut space + text before every space or line end that follows another character;
    null and empty texts have no segments. ``cut`` False: texts stay whole."""
    full = pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type))
    full = pc.if_else(pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0), full, None)
    if not cut:
        return pa.array([[t] if t else [] for t in full.to_pylist()], pa.list_(texts.type))
    uneven = pc.fill_null(pc.match_substring_regex(full, _UNEVEN), False)
    marked = pc.replace_substring(pc.replace_substring(full, " ", "\0 "), "\n", "\0\n")
    even = pc.split_pattern(pc.utf8_slice_codeunits(marked, 1), "\0")
    if not pc.any(uneven).as_py():
        return even
    odd = pa.array([_CUT.split(t) if u else None for t, u in zip(full.to_pylist(), uneven.to_pylist())],
                   pa.list_(texts.type))
    return pa.array([o if u else e for o, u, e in zip(odd.to_pylist(), uneven.to_pylist(), even.to_pylist())],
                    pa.list_(texts.type))


def units(segment: str) -> list[str]:
    """A segment's units: `` word``, ``word``, ``\\n``, the rest behind a word."""
    if segment[1:].isalpha() and segment[0] == " ":
        return [segment]
    body = segment[1:]
    if not body or _INNER.search(body):
        return [segment]
    word = _PREFIX.match(body)
    stop = word.end() if word else 0
    if segment[0] == "\n":
        return ["\n", *([body[:stop], body[stop:]] if stop else [body])]
    return [segment[:stop + 1], body[stop:]] if stop else [segment]


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible
    Latin-1 characters for themselves, the others numbered from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bytes:
    """The bytes of every token of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.width = np.array([len(t) for t in tokens], dtype=np.int64)
        self.place = np.cumsum(self.width) - self.width
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def ends(self, ids: np.ndarray, spans: np.ndarray, raw: np.ndarray) -> np.ndarray | None:
        """Byte offset where every token ends; ``spans`` are byte offsets of whole
        characters. None if the tokens' bytes are not ``raw``."""
        width = self.width[ids]
        ends = np.cumsum(width)
        if (ends[-1] if len(ends) else 0) != len(raw):
            return None
        if (self.blob[np.arange(len(raw)) + np.repeat(self.place[ids] - (ends - width), width)] != raw).any():
            return None
        # a span as long as its token is a coarse cut; tokens between two cuts end where their bytes do
        coarse = spans[:, 1] - spans[:, 0] == width
        if (spans[coarse, 1] != ends[coarse]).any():
            return None
        return np.where(coarse, spans[:, 1], ends)


class Aligner:
    """Two tokenizer files with one worker's memory of aligned units."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        special = self.a.get_added_tokens_decoder()
        self.size_a, self.size_b = max(names) + 1, self.b.get_piece_size()
        self.bytes_a = Bytes([special[i].content.encode() if i in special
                              else bytes(alphabet[c] for c in names.get(i, "")) for i in range(self.size_a)])
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        plain = [not (self.b.is_byte(i) or self.b.is_unknown(i) or self.b.is_control(i)) for i in range(self.size_b)]
        self.bytes_b = Bytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                              for i, p in enumerate(pieces)])
        self.cuttable = not any(ok and _CROSSING.search(p) for ok, p in zip(plain, pieces))
        # a token in a group: its id, told apart by side and by being the last of its side
        self.spelled = pa.array([f"{i}{s}" for n, ss in ((self.size_a, ",|"), (self.size_b, ",;")) for s in ss for i in range(n)])
        self.known = Memory(MEMO)

    def align(self, text: str) -> tuple[np.ndarray, ...] | None:
        """(A ids, their byte ends, B ids, their byte ends) of a text that begins
        with a space; None if either's bytes differ from the text's."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        got = self.a.encode_batch([text], add_special_tokens=False)[0]
        ids_a = np.array(got.ids, dtype=np.int64)
        ends_a = self.bytes_a.ends(ids_a, chars[_pairs(got.offsets)], raw)
        got = self.b.encode(text[1:], return_type="offset_mapping")
        ids_b, spans = np.array(got["ids"], dtype=np.int64), _pairs(got["offsets"])
        spans[1:] += 1                              # B adds the space itself: its first token begins there
        if len(spans):
            spans[0, 1] += 1
        if ends_a is None or not len(ids_b) or spans.max() >= len(chars):
            return None
        ends_b = self.bytes_b.ends(ids_b, chars[spans], raw)
        return None if ends_b is None else (ids_a, ends_a, ids_b, ends_b)

    def _cut(self, got: tuple[np.ndarray, ...], bounds: np.ndarray) -> list[bytes]:
        """The units that lie between the byte offsets (begin, end) of ``bounds``: the
        tokens (32-bit places in ``spelled``) of one group after the other, A's first."""
        ids_a, ends_a, ids_b, ends_b = got
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        of_a, of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        upto_a = np.append(0, np.cumsum(np.bincount(of_a, minlength=len(common))))
        upto_b = np.append(0, np.cumsum(np.bincount(of_b, minlength=len(common))))
        words = np.empty(len(ids_a) + len(ids_b), dtype=np.int32)
        last_a = np.arange(1, len(ids_a) + 1) == upto_a[of_a + 1]
        last_b = np.arange(1, len(ids_b) + 1) == upto_b[of_b + 1]
        words[np.arange(len(ids_a)) + upto_b[of_a]] = ids_a + np.where(last_a, self.size_a, 0)
        words[np.arange(len(ids_b)) + upto_a[of_b + 1]] = ids_b + 2 * self.size_a + np.where(last_b, self.size_b, 0)
        flat, upto = words.tobytes(), 4 * (upto_a + upto_b)
        first, beyond = (upto[np.searchsorted(common, bounds[:, k], "right")].tolist() for k in (0, 1))
        return [flat[i:j] for i, j in zip(first, beyond)]

    def _joined(self, found: list[str], sep: str) -> list[bytes]:
        """Align units as one text, behind a letter, parted by ``sep``; b'' if changed."""
        sizes = np.array([len(u.encode()) for u in found], dtype=np.int64)
        ends = 2 + np.cumsum(sizes + len(sep))
        got = self.align(" x" + "".join([sep + u for u in found]))
        if got is not None:
            return self._cut(got, np.column_stack([ends - sizes, ends]))
        return [b""] if len(found) == 1 else [self._joined([u], sep)[0] for u in found]

    def align_units(self, found: list[str]) -> dict[str, bytes]:
        """Units that begin with a space are put side by side, others parted by line
        ends; a unit with white space inside, or of white space alone, stands alone."""
        out: dict[str, bytes] = {}
        alone = [u for u in found if not _EVEN.fullmatch(u)]
        odd = set(alone)
        for sep, part in (("", [u for u in found if u[0] == " " and u not in odd]),
                          ("\n", [u for u in found if u[0] != " " and u not in odd])):
            held, n = [], 0
            for u in part:
                held.append(u)
                n += len(u)
                if len(held) >= UNITS or n >= JOINED:
                    out.update(zip(held, self._joined(held, sep)))
                    held, n = [], 0
            if held:
                out.update(zip(held, self._joined(held, sep)))
        for u in alone:
            out[u] = self._joined([u], "" if u[0] in " \n" else "\n")[0]
        return out

    def align_segments(self, found: list[str]) -> list[bytes]:
        """The tokens of distinct segments, group by group; b'' if either tokenizer
        changes one. A unit that is in memory is not encoded again."""
        made = [units(s) if self.cuttable else [s] for s in found]
        new = self.known.need(chain.from_iterable(made))
        known = self.known.young
        known.update(self.align_units(new))
        out = [known[us[0]] if len(us) == 1 else _whole([known[u] for u in us]) for us in made]
        self.known.turn()
        return out

    def links(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of segments, whose tokens lie one after the other in ``words`` up to ``bounds``:
        numbers of A tokens, B tokens, groups and links; the segment, the pair and the
        weight of every link. A pair of a wide group counts once with its product."""
        is_a = words < 2 * self.size_a
        end = words >= 2 * self.size_a + self.size_b               # the last B token of a group
        ids_a = np.where(words >= self.size_a, words - self.size_a, words)[is_a].astype(np.int64)
        ids_b = (words[~is_a] - 2 * self.size_a) % self.size_b
        group = np.cumsum(end) - end
        n_groups = int(group[-1]) + 1 if len(group) else 0
        n_a, n_b = np.bincount(group[is_a], minlength=n_groups), np.bincount(group[~is_a], minlength=n_groups)
        upto_a, upto_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        upto = np.append(0, np.cumsum(end))[bounds]                # groups before each segment's end
        total = lambda x: np.diff(np.append(0, np.cumsum(x))[upto], prepend=0)
        numbers = total(n_a), total(n_b), np.diff(upto, prepend=0), total(n_a * n_b)
        owner = np.repeat(np.arange(len(bounds)), numbers[2])      # segment of each group
        wide = np.flatnonzero(n_a + n_b > WIDE)
        of = group[is_a]
        many = n_b[of]
        many[np.isin(of, wide)] = 0
        stop = np.cumsum(many)
        meets = np.arange(stop[-1] if len(stop) else 0) + np.repeat(upto_b[of] - (stop - many), many)
        segment = [np.repeat(owner[of], many)]
        pair = [np.repeat(ids_a * self.size_b, many) + ids_b[meets]]
        weight = [np.ones(len(meets), dtype=np.int64)]
        for g in wide.tolist():
            xs, nx = np.unique(ids_a[upto_a[g]:upto_a[g + 1]], return_counts=True)
            ys, ny = np.unique(ids_b[upto_b[g]:upto_b[g + 1]], return_counts=True)
            pair.append((xs[:, None] * self.size_b + ys).ravel())
            weight.append((nx[:, None] * ny).ravel())
            segment.append(np.full(len(pair[-1]), owner[g]))
        segment, pair, weight = map(np.concatenate, (segment, pair, weight))
        if len(wide):
            order = np.argsort(segment, kind="stable")
            segment, pair, weight = segment[order], pair[order], weight[order]
        return *numbers, segment, pair, weight

    def slice(self, texts: pa.Array) -> tuple:
        """n_a, n_b, n_groups, n_links of the texts; digests of their groups; for all
        texts' distinct pairs the place in the slice's list, how often each is linked
        and where a text's begin; the slice's sorted pairs and how many texts hold each."""
        cut = segments(texts, self.cuttable)
        sizes = pc.fill_null(pc.list_value_length(cut), 0).to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        flat = coded.indices.to_numpy().astype(np.int64)
        recs = self.align_segments(coded.dictionary.to_pylist())
        bad = np.array([not r for r in recs], dtype=bool)
        if bad.any():                               # a text with a changed segment has no tokens
            text = np.repeat(np.arange(len(texts)), sizes)
            keep = ~np.isin(text, text[bad[flat]])
            flat, sizes = flat[keep], np.bincount(text[keep], minlength=len(texts))
        words = np.frombuffer(b"".join(recs), dtype=np.int32)
        bounds = np.cumsum(np.array([len(r) // 4 for r in recs], dtype=np.int64))
        *numbers, segment, pair, weight = self.links(words, bounds)
        stops = np.append(0, np.cumsum(sizes))
        sums = [np.diff(np.append(0, np.cumsum(x[flat]))[stops]) for x in numbers]
        # the groups as text: every text's tokens, spelled and joined
        begin = np.append(0, bounds)[:-1]
        upto = np.append(0, np.cumsum((bounds - begin)[flat]))
        spelled = self.spelled.take(pa.array(words[_ragged(begin[flat], (bounds - begin)[flat])]))
        groups = pc.binary_join(pa.LargeListArray.from_arrays(upto[stops], spelled), "")
        digests = [hashlib.sha256(memoryview(g.as_buffer())[:-1]).hexdigest() if n else ""
                   for g, n in zip(groups, sizes.tolist())]
        # distinct pairs of every text
        size = np.bincount(segment, minlength=len(recs))
        place = np.cumsum(size) - size
        take = _ragged(place[flat], size[flat])
        space = self.size_a * self.size_b
        key = np.repeat(np.repeat(np.arange(len(texts)), sizes), size[flat]) * space + pair[take]
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[take][order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, dtype=np.int64)
        key, weight = key[start], np.add.reduceat(weight, start) if len(start) else weight
        held, where, docs = np.unique(key % space, return_inverse=True, return_counts=True)
        return sums, digests, where, weight, np.searchsorted(key, np.arange(len(texts) + 1) * space), held, docs


def _whole(parts: list[bytes]) -> bytes:
    return b"".join(parts) if all(parts) else b""


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of all runs, one run after the other."""
    stop = np.cumsum(size)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - size), size)


def _pairs(spans: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(spans), dtype=np.int64, count=2 * len(spans)).reshape(-1, 2)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


_ROW = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, slice long, "
        "place array<int>, times array<long>, pair array<long>, docs array<long>")


def _sliced(docs: DataFrame, path_a: str, path_b: str, size: int) -> DataFrame:
    """One row per document; a slice's first row also carries the slice's pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for t in slices(batches, "text", size):
            sums, digests, where, weight, upto, held, docs_of = al.slice(t["text"].combine_chunks())
            n = len(digests)
            once = np.append(0, np.full(n, len(held)))
            lists = lambda stops, x, kind: pa.ListArray.from_arrays(
                pa.array(stops, pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks(), *(pa.array(s, pa.int64()) for s in sums),
                 pa.array(digests, pa.string()), pa.array(np.full(n, number)), lists(upto, where, pa.int32()),
                 lists(upto, weight, pa.int64()), lists(once, held, pa.int64()), lists(once, docs_of, pa.int64())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slice", "place", "times", "pair", "docs"])
            number += 1

    return whole_text(docs).mapInArrow(run, _ROW)


def _weigh(left: pa.Table, right: pa.Table) -> pa.Table:
    """One slice: its documents' sums over the counts of its pairs."""
    right = right.sort_by("pair")
    count, best = right["n"].to_numpy(), right["best"].to_numpy().astype(np.int64)
    lists = left["place"].combine_chunks()
    stops = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
    place, times = lists.flatten().to_numpy(), left["times"].combine_chunks().flatten().to_numpy()
    total = lambda x: np.diff(np.append(0, np.cumsum(x))[stops])
    return pa.table({**{c: left[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
                     "n_best": pa.array(total(times * best[place])), "count_sum": pa.array(total(times * count[place])),
                     "groups_sha256": left["groups_sha256"]})


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """pair, n (documents that hold it linked), rows (slices that do), best (n is the
    highest of its A id)."""
    counts = stored(rows.where(F.size("pair") > 0)
                    .select(F.explode(F.arrays_zip("pair", "docs")).alias("p")).select("p.*")
                    .groupBy("pair").agg(F.sum("docs").alias("n"), F.count("*").alias("rows")))
    a = F.expr(f"pair div {size_b}")
    # one row per A id: no more than its vocabulary holds
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    return counts.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "n", "rows", (F.col("n") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, size: int = SLICE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest
    of their A id, ties included), count_sum (counts summed over links),
    groups_sha256 (of ``a,a|b;a|b,b``; '' without tokens). The tokenizer files are
    read where the libraries are installed: on the driver and the executors."""
    import sentencepiece
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    small_batches(docs.sparkSession)
    rows = stored(_sliced(docs, path_a, path_b, size))
    table = pair_counts(rows, size_b)
    total = table.agg(F.sum("rows")).first()[0] or 0
    held = rows.where(F.size("pair") > 0).select("slice", F.explode("pair").alias("pair"))
    back = join_by_key(held, table, "pair", "rows", total).select(F.col("slice").alias("of"), "pair", "n", "best")
    return (rows.drop("pair", "docs").groupBy("slice").cogroup(back.groupBy("of"))
            .applyInArrow(_weigh, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                  "count_sum long, groups_sha256 string"))
