"""Token alignment against a brute-force walk over whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "\n", "a ", " a", "  a  b\n\n c ", "<|endoftext|> x<s></s> <unk>", "it's we'll  don't THEY'RE.",
       "\x00 \x1c a\x85b c\xa0 \t d", "é èè\n é é x", "x" * 5_000, " ".join(f"ab{i}" for i in range(3_000)), "日本語 テキスト",
       "a\r\n b", "aaaaaaaaaaaaaaaaaaaaaaaa aaaa", "²³ ½ Ⅷ ª", "🙂🙂 ok 🙂\n🙂x", "İstanbul ΣΑΣ", "a▁b c", "tie tie", "tie tie",
       "Mr. x\nNext.\nLine,\n\nEnd\n", "\n x", "\nx", "é x́.", "𓀀𓀁 \U0010fffe", "()()((" * 400]


def alphabet():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Walk:
    """Groups and links of a whole text, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.letters = alphabet()

    def __call__(self, text):
        if not text:
            return []
        e = self.a.encode(" " + text, add_special_tokens=False)
        xs = [(i, bytes(self.letters[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        ys = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
              for i, p in ((i, self.b.id_to_piece(i)) for i in self.b.encode(text))]
        whole = (" " + text).encode()
        if b"".join(b for _, b in xs) != whole or b"".join(b for _, b in ys) != whole:
            return []
        groups, i, j, at, bt = [([], [])], 0, 0, 0, 0
        while i < len(xs) or j < len(ys):
            if at <= bt and i < len(xs):
                groups[-1][0].append(xs[i][0])
                at += len(xs[i][1])
                i += 1
            else:
                groups[-1][1].append(ys[j][0])
                bt += len(ys[j][1])
                j += 1
            if at == bt and i + j < len(xs) + len(ys):
                groups.append(([], []))
        return groups


WALK = Walk()


def brute(texts):
    held, rows = Counter(), []
    for t in texts:
        groups = WALK(t)
        links = Counter((a, b) for xs, ys in groups for a in xs for b in ys)
        held.update(links.keys())
        rows.append((groups, links))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for groups, links in rows:
        s = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in links.items()),
                    hashlib.sha256(s.encode()).hexdigest() if s else ""))
    return out


def rows_of(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in df.collect())


@pytest.mark.parametrize("size", [4_000_000, 50])
def test_equals_brute_force(spark, size):
    docs = spark.createDataFrame([(i if i != 3 else None, t, "clash", 1) for i, t in enumerate(ODD)],
                                 "doc_id long, text string, pair string, slice int").repartition(3)
    want = [(i if i != 3 else -1, *x) for i, x in enumerate(brute(ODD))]
    assert rows_of(align.align_documents(docs, A, B, size)) == sorted(want)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows])))
    assert rows_of(align.align_documents(docs, A, B)) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é.,'\n\t 　日🙂1x́▁\x00\x1c-"), max_size=40), max_size=4))
def test_units_make_the_whole(texts):
    al = align.aligner(A, B)
    spelled = al.spelled.to_pylist()
    for t, ss in zip(texts, align.segments(pa.array(texts, pa.string()), al.cuttable).to_pylist()):
        parts = al.align_segments(ss or [])
        got = "".join(spelled[w] for p in parts for w in np.frombuffer(p, np.int32)) if all(parts) else ""
        assert got == "".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) + ";" for x, y in WALK(t))


def test_wide_groups_count_by_distinct_ids(monkeypatch):
    text = "x" * 3_000 + " a日本語🙂 b"
    al = align.aligner(A, B)
    want = None
    for wide in (10**9, 0):
        monkeypatch.setattr(align, "WIDE", wide)
        _, _, _, weight, _, held, _ = al.slice(pa.array([text]))
        got = dict(zip(held.tolist(), weight.tolist()))
        assert want is None or got == want
        want = got


def test_empty_table(spark):
    assert align.align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
