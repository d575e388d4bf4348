"""BPE, token counts and packing against the public libraries."""

import base64
import hashlib
import itertools
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, token_counts

ODD = [None, "", " ", "  ", "\n", "a ", " a", "  a  b\n\n c ", "<|endoftext|> x<|endoftext|>", "it's we'll  don't THEY'RE",
       "\x00 \x1c a\x85b c\xa0 \t d", "é è\n é é x", "x" * 5_000, " ".join(f"ab{i}" for i in range(3_000)), "日本語 テキスト",
       "a\r\n b", "aaaaaaaaaaaaaaaaaaaaaaaa aaaa", "²³ ½ Ⅷ ª", "🙂🙂 ok", "İstanbul ΣΑΣ", "tie", "tie"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, "clash", "clash") for i, t in enumerate(ODD)],
                                 "doc_id long, text string, ids string, n_tokens string")


def test_bpe_equals_library_and_round_trips(spark, docs):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_tokens"], r["ids"], bytes(r["decoded"]))
                 for r in bpe.encode(docs, path, P.PATTERN).collect())
    want = [(i if i != 3 else -1, lib.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(ODD)]
    assert got == sorted((i, len(x), " ".join(map(str, x)), b) for i, x, b in want)


def test_merge_replay_of_random_words():
    c = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(5)
    words = list({"".join(rng.choice(list("aabetinorh se"), rng.integers(1, 30))) for _ in range(500)})
    got = [np.frombuffer(x, "<u4").tolist() for x in c.replay([w.encode() for w in words])]
    assert got == [lib.encode_ordinary(w) for w in words]


@pytest.mark.parametrize("chunk, overlap", [(32_768, 256), (64, 8), (300, 4), (1_000, 16)])
def test_counts_equal_library(spark, docs, chunk, overlap):
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"])
                 for r in token_counts.count_tokens(docs, path, 1024, chunk=chunk, overlap=overlap).collect())
    want = [(i if i != 3 else -1, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids))
            for i, t in enumerate(ODD)]
    assert got == sorted((i, b, n, n > 1024) for i, b, n in want)


CHINESE = "今天天气很好，我们去公园散步。他说：“这本书有２３４页！”然后回家了；"


@pytest.mark.parametrize("text", [CHINESE * 40, "don't we'll 's'n'x''s " * 60, "a<|endoftext|>b,<|endoftext|>" * 50, "日" * 2_000,
                                  "x1y2,z" * 300, "é'd 'é'" * 200, "\u0301a\u0301," * 200, "a\u00a0b\u3000c\x85d" * 100, "🙂🙂a🙂" * 150])
@pytest.mark.parametrize("chunk, overlap", [(64, 4), (97, 8), (300, 16)])
def test_splices_anywhere_the_pattern_splits(text, chunk, overlap):
    c = token_counts.Counter(P.path("byte_bpe_50k.json"))
    want = len(c.tokenizer.encode(text, add_special_tokens=False).ids)
    assert token_counts.count_spliced(text.encode(), c.ends_of, chunk, overlap, c.special) == want


def test_long_texts_without_spaces_take_work_in_proportion():
    c = token_counts.Counter(P.path("byte_bpe_50k.json"))
    for text in (CHINESE * 30_000, "日" * 400_000):
        read = 0

        def ends_of(data):
            nonlocal read
            read += len(data)
            return c.ends_of(data)

        data = text.encode()
        assert token_counts.count_spliced(data, ends_of, special=c.special) == len(c.tokenizer.encode(text, add_special_tokens=False).ids)
        assert read < 10 * len(data)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []
    assert token_counts.count_tokens(none, P.path("byte_bpe_50k.json"), 9).collect() == []
    assert packing.pack(none, P.path("word_bpe_49k.json"), 64).collect() == []


def test_packing_holds_every_piece_once(spark, docs):
    lib, size = Tokenizer.from_file(P.path("word_bpe_49k.json")), 64
    rows = packing.pack(docs, P.path("word_bpe_49k.json"), size).collect()
    want = Counter()
    for i, t in enumerate(ODD):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for k in range(0, len(ids), size):
            want[(i if i != 3 else None, k // size, k, len(ids[k:k + size]), zlib.crc32(ids[k:k + size].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    seq = defaultdict(list)
    for r in rows:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in seq.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    assert len(seq) <= -(-sum(r["length"] for r in rows) // size) + 1


def _fewest(lengths, size):
    """Exact by trying every place for every piece."""
    best = len(lengths)

    def go(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for j in range(len(room)):
            if room[j] >= lengths[i] and room[j] not in room[:j]:
                go(i + 1, [*room[:j], room[j] - lengths[i], *room[j + 1:]])
        go(i + 1, [*room, size - lengths[i]])

    go(0, [])
    return best


def test_bin_completion_finds_the_optimum():
    rng = np.random.default_rng(11)
    for _ in range(60):
        size = int(rng.integers(8, 40))
        lengths = sorted(rng.integers(1, size + 1, int(rng.integers(1, 10))).tolist(), reverse=True)
        count = np.bincount(lengths, minlength=size + 1)
        bins = packing.complete(count, size, 5_000)
        assert Counter(x for t, b in bins for x in b for _ in range(t)) == Counter(lengths)
        assert all(sum(b) <= size for _, b in bins)
        assert packing.lower_bound(count, size) <= _fewest(lengths, size) == sum(t for t, _ in bins)


@pytest.mark.parametrize("times", [1, 1_000])
def test_hot_lengths_take_the_undominated_filling(times):
    count = np.zeros(2_049, dtype=np.int64)
    count[[1100, 500, 300]] = np.array([12, 12, 36]) * times
    bins = packing.complete(count, 2_048)
    assert sum(t for t, _ in bins) == 15 * times
    assert Counter({x: sum(t * b.count(x) for t, b in bins) for x in (1100, 500, 300)}) == Counter({1100: 12 * times, 500: 12 * times, 300: 36 * times})


def test_few_hot_lengths_reach_the_optimum():
    rng = np.random.default_rng(3)
    for _ in range(60):
        size = int(rng.integers(10, 60))
        kinds = rng.integers(2, size * 2 // 3, 3)
        lengths = sorted(rng.choice(kinds, int(rng.integers(6, 12))).tolist(), reverse=True)
        bins = packing.complete(np.bincount(lengths, minlength=size + 1), size, 100_000)
        assert Counter(x for t, b in bins for x in b for _ in range(t)) == Counter(lengths)
        assert sum(t for t, _ in bins) == _fewest(lengths, size)


def test_every_filling_is_dominated_by_a_listed_one():
    rng = np.random.default_rng(5)

    def fits(a, room):
        """Whether the pieces of a fit into places of these lengths, by trying all."""
        return not a or any(a[0] <= x and fits(a[1:], [*room[:i], x - a[0], *room[i + 1:]]) for i, x in enumerate(room))

    for _ in range(40):
        room = int(rng.integers(3, 25))
        have = np.bincount(rng.integers(1, room + 1, int(rng.integers(1, 7))), minlength=room + 1)
        listed = [f for f in packing.undominated(have, room, room) if f is not None]
        assert len(listed) == len(set(listed))
        pieces = [x for x in range(1, room + 1) for _ in range(have[x])]
        for n in range(1, len(pieces) + 1):
            for f in set(itertools.combinations(pieces, n)):
                if sum(f) <= room:
                    assert any(fits(sorted(f, reverse=True), list(g)) or sum(f) == 0 for g in listed)


def test_a_node_of_the_search_is_small():
    """The driver holds one for each sequence of the path, thousands of them."""
    have = np.arange(1_000, 3_049, dtype=np.int64)
    have[0] = 0
    tracemalloc.start()
    try:
        held = [packing.undominated(have, 2_047, 5) for _ in range(50)]
        assert all(next(g, ...) is not ... for g in held)
        assert tracemalloc.get_traced_memory()[0] < 50 * 80_000
    finally:
        tracemalloc.stop()


def test_hashes_of_the_queries(spark):
    """The digest columns derive from the operator's own output."""
    from tidemark.llm import queries as Q
    sf = "/root/testdata/sf0.001"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in Q.QUERIES["op9_byte_bpe"](spark, sf).collect():
        ids = lib.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
