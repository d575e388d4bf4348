import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash as S
from tidemark.llm.components import components


def brute_fingerprint(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(pairs, nodes):
    at = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            at[a] = at[b] = min(at[a], at[b])
    return at


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 5])
def test_links_equal_brute_force(spark, bits):
    rng = np.random.default_rng(3)
    fps = {0, -1, 1, 3, 7, 15, 31, 5}
    for base in rng.integers(-2**63, 2**63 - 1, 30, dtype=np.int64).tolist():
        fps.add(base)
        for _ in range(10):
            x = np.int64(base)
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= np.int64(np.uint64(1) << np.uint64(b))
            fps.add(int(x))
    fps = np.array(sorted(fps), dtype=np.int64)
    got = sorted((r["u"], r["v"]) for r in S.links(spark.createDataFrame([(int(f),) for f in fps], "fp long"), bits).collect())
    i, j = np.where(np.triu(np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= bits, 1))
    assert got == [(int(fps[a]), int(fps[b])) for a, b in zip(i, j)]


def test_components_of_paths_stars_and_cycles(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 240)] + [(7, 8), (8, 9), (9, 7), (3, 3), (8, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    want = brute_components([p for p in pairs if p[0] != p[1]], nodes)
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_whole_table_equals_brute_force(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base), " ".join([*base[:299], "other"]), " ".join([*base[:150], "x", *base[150:]]), None, "", " \t\n",
             "one two", "ONE two", "a b c", "a b c d", " ".join(base).upper(), "é É", "tie tie tie tie tie tie", "long " * 60_000]
    rows = [(i * 3 if i != 8 else None, t, "x", "y") for i, t in enumerate(texts)] + [(0, texts[0], "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp string")
    got = S.near_duplicates(df, 4, 4).collect()
    fps = [(i, brute_fingerprint(t, 4)) for i, t, *_ in rows]
    n = len(fps)
    comp = brute_components([(a, b) for a in range(n) for b in range(a) if (fps[a][1] ^ fps[b][1]).bit_count() <= 4], range(n))
    least = {c: min((fps[k][0] for k in range(n) if comp[k] == c and fps[k][0] is not None), default=None) for c in comp.values()}
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["fingerprint"], r["component_id"]) for r in got) == sorted(
        (fps[k][0] if fps[k][0] is not None else -1, f"{fps[k][1]:016x}", least[comp[k]]) for k in range(n))
    kept = S.drop_near_copies(df, 4, 4)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {x for x in least.values()}
    assert kept.count() == len(set(comp.values()))


@pytest.mark.parametrize("ids", [[3, None, 7, None, None, 9], [None] * 6, [5, 5, 5, 5, 5, 5], [2, 1, 2, 1, 2, 1]])
def test_one_row_of_each_component_whatever_the_ids(spark, ids):
    """Three components; ids that are missing, repeat, or repeat across components."""
    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"b{i}" for i in range(400))
    texts = [a, a + " end", b, a, b, "alone here"]
    df = spark.createDataFrame([(i, t, "k", "f") for i, t in zip(ids, texts)], "doc_id long, text string, key string, fp string")
    comp = {r["fingerprint"]: r["component_id"] for r in S.near_duplicates(df, 4, 4).collect()}
    kept = S.drop_near_copies(df, 4, 4)
    rows = kept.collect()
    assert kept.columns == df.columns and {r["key"] for r in rows} == {"k"}
    assert sorted(r["text"][0] + r["text"][1] for r in rows) == ["a0", "al", "b0"] and len(comp) <= 4
    for r, members in ((r, [i for i, t in zip(ids, texts) if t[:2] == r["text"][:2]]) for r in rows):
        assert r["doc_id"] == min((i for i in members if i is not None), default=None)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df, 4, 4).collect() == [] and S.drop_near_copies(df, 4, 4).collect() == []


def broadcasts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastExchange")


def test_components_take_no_broadcast_without_hubs_and_stop_at_stars(spark, monkeypatch):
    """Every broadcast, an empty one too, takes a thread and memory of the driver."""
    from tidemark.llm import common, components as C
    tables = []

    def seen(df):
        tables.append(broadcasts(df))
        return common.stored(df)

    monkeypatch.setattr(C, "stored", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = [(5, k) for k in range(200, 240)] + [(7, 8), (9, 7)]
        assert len(components(spark.createDataFrame(pairs, "u long, v long")).collect()) == 44
        assert tables == [0]                         # stars already: no round
        pairs += [(i, i + 1) for i in range(300, 330)]
        assert len(components(spark.createDataFrame(pairs, "u long, v long")).collect()) == 75
        assert len(tables) > 2 and not any(tables)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cells_are_not_broadcast_however_small_spark_takes_them(spark):
    """Spark sizes the cells as the fingerprints they are exploded from: 1 in 50 of what the driver would hold."""
    from tidemark.llm import common
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        reps = common.stored(spark.range(400).selectExpr("xxhash64(id DIV 2) ^ (id % 2) AS fp"))
        got = S.links(reps, 4)
        assert broadcasts(got) == 0
        assert got.count() == len(got.collect()) == 200
        assert broadcasts(got) == 0                  # as planned anew from what was shuffled
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_pipelines_stage_broadcasts_no_cells(spark, monkeypatch):
    from tidemark.llm import common, components as C
    tables = []

    def seen(df):
        tables.append(broadcasts(df))
        return common.stored(df)

    monkeypatch.setattr(C, "stored", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        base = [f"w{i}" for i in range(300)]
        texts = [" ".join(base), " ".join([*base[:299], "other"]), "alone here"]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert sorted(r["doc_id"] for r in S.drop_near_copies(df, 4, 4).collect()) == [0, 2]
        assert tables[0] == 0                        # the links
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("floor", [0, 100])
def test_hubs_and_copies_give_the_same_by_broadcast_and_without(spark, monkeypatch, floor):
    from tidemark.llm import common
    monkeypatch.setattr(common, "HOT_ROWS", floor)
    pairs = [(i, i + 1) for i in range(100, 130)] + [(5, k) for k in range(200, 420)] + [(219, 500), (500, 501), (3, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 131)}, **{i: 5 for i in [5, 500, 501, *range(200, 420)]}}
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k:]]) for k in (0, 150, 300)] + [" ".join(base)] * 4 + ["alone here"] * 3
    df = spark.createDataFrame([(i or None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    fps = [brute_fingerprint(t, 4) for t in texts]
    n = len(fps)
    comp = brute_components([(a, b) for a in range(n) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4], range(n))
    least = {c: min((k for k in range(1, n) if comp[k] == c), default=None) for c in comp.values()}
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in S.near_duplicates(df, 4, 4).collect()) == [
        (k, least[comp[k]] or 0) for k in range(n)]
    assert sorted(r["doc_id"] or 0 for r in S.drop_near_copies(df, 4, 4).collect()) == sorted(x or 0 for x in least.values())
