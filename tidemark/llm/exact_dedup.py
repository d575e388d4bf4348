"""Exact deduplication with static binary-fuse filters.

The table is dealt by a hash of doc_id into immutable batches. The digests of
every earlier batch form a snapshot: an exact digest table in buckets and, per
bucket, one 3-wise binary-fuse filter of 8-bit fingerprints (about 9 bits a
key, no false negatives). A new batch goes through four steps:

1. rows of the batch with equal digests are grouped (map-side combined);
2. its distinct digests are screened by the snapshots' filters, bucket by
   bucket, so that most never meet a snapshot;
3. filter positives join the snapshot's exact digest bucket;
4. whatever is suspected (several rows in one batch, or in a snapshot) is
   grouped by its digest AND its normalised bytes; that grouping decides.

Texts are screened for step 4 where they lie, by broadcast filters of the
suspected digests: only suspected texts (and one other in 256) are shuffled.
Past ``SCREEN_KEYS`` suspects the filters would be too large to broadcast;
then all texts meet the digests in a shuffled join.

A digest collision therefore cannot merge two texts: a digest that covers
several texts is joined back by text.

Defined results: null text counts as empty, empty texts are one group; of rows
that repeat the same doc_id and text all have ``kept`` (they are the same
document); a null doc_id is kept only if its group has no other; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_by_key, small_batches, stored, union_all, whole_text

#: Digests of a snapshot that share a filter.
BUCKET_KEYS = 50_000
#: Suspected digests whose filters may be broadcast (about 9 bits each: 35 MB), and those of one filter.
SCREEN_KEYS = 30_000_000
SCREEN_BUCKET = 500_000
BATCHES = 2


@F.arrow_udf(T.StringType())
def sha256_lower(text: pa.Array) -> pa.Array:
    """SHA-256 in hex of the text with A-Z lower-cased; null counts as empty."""
    low = pc.ascii_lower(pc.fill_null(text, "")).cast(pa.large_binary())
    return pa.array([hashlib.sha256(x).hexdigest() for x in low.to_pylist()], pa.string())


# ------------------------------------------------------- binary-fuse filter

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.astype(np.uint64) + np.uint64(seed)
    for shift, mul in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(mul)
    return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, seg_len: int, n_seg: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in neighbouring segments, and the 8-bit fingerprint."""
    first = ((h >> np.uint64(32)) * np.uint64(seg_len * n_seg)) >> np.uint64(32)
    mask = np.uint64(seg_len - 1)
    second = (first + np.uint64(seg_len)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * seg_len)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64), ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, slots) over distinct 64-bit keys. All
    slots that hold one key are peeled at once, round after round; values are
    assigned in the reverse order of the rounds."""
    n = max(len(keys), 2)
    seg_len = min(1 << max(int(math.floor(math.log(n) / math.log(3.33) + 2.25)), 2), 1 << 18)
    size = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)) * n
    n_seg = max(math.ceil(size / seg_len) - 2, 1)
    slots = (n_seg + 2) * seg_len
    for seed in range(1, 200):
        places, prints = _places(_mix(keys, seed), seg_len, n_seg)
        ids = np.arange(len(keys))
        count = np.bincount(places.ravel(), minlength=slots)
        held = np.bincount(places.ravel(), weights=np.tile(ids, 3), minlength=slots).astype(np.int64)
        rounds, left = [], len(keys)
        while left:
            slot = np.flatnonzero(count == 1)
            key, first = np.unique(held[slot], return_index=True)
            if not len(key):
                break
            rounds.append((key, slot[first]))
            left -= len(key)
            np.subtract.at(count, places[:, key].ravel(), 1)
            np.subtract.at(held, places[:, key].ravel(), np.tile(key, 3))
        if not left:
            table = np.zeros(slots, dtype=np.uint8)
            for key, slot in reversed(rounds):
                a, b, c = table[places[:, key]]
                table[slot] = prints[key] ^ a ^ b ^ c   # the own slot is still 0
            return seed, seg_len, n_seg, table.tobytes()
    raise RuntimeError("binary-fuse construction failed; keys must be distinct")


def maybe_in(keys: np.ndarray, seed: int, seg_len: int, n_seg: int, table: bytes) -> np.ndarray:
    places, prints = _places(_mix(keys, seed), seg_len, n_seg)
    a, b, c = np.frombuffer(table, dtype=np.uint8)[places]
    return (a ^ b ^ c) == prints


def _build(group: pa.Table) -> pa.Table:
    keys = np.unique(group["key"].to_numpy().astype(np.int64))
    seed, seg_len, n_seg, table = build_filter(keys)
    return pa.table({"bucket": pa.array([group["bucket"][0].as_py()], pa.int64()),
                     "seed": pa.array([seed], pa.int64()), "seg_len": pa.array([seg_len], pa.int64()),
                     "n_seg": pa.array([n_seg], pa.int64()), "slots": pa.array([table], pa.binary())})


def _screen(new: pa.Table, filters: pa.Table) -> pa.Table:
    keys = new["key"].to_numpy().astype(np.int64)
    hit = np.zeros(len(keys), dtype=bool)
    for f in filters.to_pylist():
        hit |= maybe_in(keys, f["seed"], f["seg_len"], f["n_seg"], f["slots"])
    return new.select(["sha"]).filter(pa.array(hit))


# ------------------------------------------------------------ the operator

def _keyed(digests: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64("sha")
    return digests.select("sha", key.alias("key"), F.pmod(key, F.lit(buckets)).alias("bucket"))


def snapshot_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One static filter per digest bucket of an immutable snapshot."""
    return stored(_keyed(digests, buckets).groupBy("bucket").applyInArrow(
        _build, "bucket long, seed long, seg_len long, n_seg long, slots binary"))


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Digests that the filters let through (all true members are)."""
    return (_keyed(digests, buckets).groupBy("bucket").cogroup(filters.groupBy("bucket"))
            .applyInArrow(_screen, "sha string"))


def _filters(digests: DataFrame, most: int) -> tuple[int, dict] | None:
    """(number of buckets, filters by bucket) of distinct digests; none for more than ``most``."""
    n = digests.count()
    if n > most:
        return None
    buckets = max(1, math.ceil(n / SCREEN_BUCKET))
    return buckets, {r["bucket"]: (r["seed"], r["seg_len"], r["n_seg"], bytes(r["slots"]))
                     for r in snapshot_filters(digests, buckets).collect()}


def _hits(keys: np.ndarray, filters: tuple[int, dict] | None) -> np.ndarray:
    if filters is None:
        return np.ones(len(keys), dtype=bool)
    hit, bucket = np.zeros(len(keys), dtype=bool), keys % filters[0]        # floored, as pmod is
    for b in np.unique(bucket):
        if b in filters[1]:
            at = bucket == b
            hit[at] = maybe_in(keys[at], *filters[1][b])
    return hit


def screen_in_place(spark: SparkSession, digests: DataFrame, most: int) -> Callable[[Column], Column]:
    """A column function, digest -> may it be one of ``digests``? True for all of these.
    For more than ``most`` digests it is true for every row."""
    shared = spark.sparkContext.broadcast(_filters(digests, most))

    @F.arrow_udf(T.BooleanType())
    def run(key: pa.Array) -> pa.Array:
        return pa.array(_hits(key.to_numpy(zero_copy_only=False).astype(np.int64), shared.value))

    return lambda sha: run(F.xxhash64(sha))


def digest_and_screen(spark: SparkSession, digest, of_text: DataFrame, of_row: DataFrame | None,
                      most: int) -> Callable[[Column, Column], Column]:
    """A column function, (text, id) -> struct(sha, near, stands, low), in one pass through one
    worker: the text's digest; whether it may be one of ``of_text``; whether digest and id,
    as ``_mark`` joins them, may be one of ``of_row``; without ``of_row`` the normalised text of
    near ones. Not to be repeated: a filter on it would else run it anew, in a further worker,
    for what is read of the rows that stay."""
    import xxhash
    shared = spark.sparkContext.broadcast((_filters(of_text, most), of_row and _filters(of_row, most)))
    sha_of, with_row = digest.func, of_row is not None

    def keys(marks: list[str]) -> np.ndarray:               # as xxhash64() has them
        return np.array([xxhash.xxh64_intdigest(m, 42) for m in marks], dtype=np.uint64).view(np.int64)

    @F.arrow_udf("struct<sha: string, near: boolean, stands: boolean, low: string>")
    def run(text: pa.Array, key: pa.Array) -> pa.Array:
        sha, (texts, rows) = sha_of(text), shared.value
        names = sha.to_pylist()
        near = _hits(keys(names), texts)
        stands, low = near, pa.nulls(len(text), pa.string())
        if with_row:
            stands = _hits(keys([n + k for n, k in zip(names, key.to_pylist())]), rows)
        else:
            low = pc.ascii_lower(pc.if_else(pa.array(near), pc.fill_null(text, ""), low))
        return pa.StructArray.from_arrays([sha, pa.array(near), pa.array(stands), low], ["sha", "near", "stands", "low"])

    once = run.asNondeterministic()
    return lambda text, key: once(text, F.coalesce(key.cast("string"), F.lit("")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 batches: int = BATCHES, digest: Callable[[Column], Column] = sha256_lower,
                 screen_keys: int = SCREEN_KEYS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    small_batches(docs.sparkSession)
    texts = whole_text(docs, id_col, text_col)
    rows = stored(texts.select("doc_id", digest(F.col("text")).alias("sha"),
                               F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch")))
    total = rows.count()
    buckets = max(1, math.ceil(total / batches / BUCKET_KEYS))

    grouped = stored(rows.groupBy("batch", "sha").agg(F.count("*").alias("n")))
    suspects, snapshots = [grouped.where("n > 1").select("sha")], []
    for b in range(batches):
        new = grouped.where(F.col("batch") == b).select("sha")
        for old, filters in snapshots:
            suspects.append(screen(new, filters, buckets).join(old, "sha", "left_semi"))
        if b + 1 < batches:
            snapshots.append((new, snapshot_filters(new, buckets)))
    suspects = stored(grouped.join(union_all(suspects).distinct(), "sha", "left_semi")
                      .groupBy("sha").agg(F.sum("n").alias("n")))
    most = suspects.agg(F.max("n")).first()[0] or 0

    # byte check: the normalised text itself is part of the grouping key
    # (rows of a very common text meet its digest by broadcast and are combined where they lie)
    def suspected(shas: DataFrame) -> DataFrame:
        screen_of = digest_and_screen(docs.sparkSession, digest, shas.select("sha"), None, screen_keys)
        near = texts.select("doc_id", screen_of(F.col("text"), F.lit("")).alias("s")).where("s.near").select(
            "doc_id", F.col("s.low").alias("text"), "s.sha")
        return join_by_key(near, shas, "sha", "n", total, most).drop("n")

    classes = stored(suspected(suspects).groupBy("sha", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    of_sha = stored(classes.groupBy("sha").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts")))
    alone = rows.join(of_sha.select("sha"), "sha", "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    same = join_by_key(rows.select("doc_id", "sha"), of_sha.where("texts = 1"), "sha", "group_size", total, most).select(
        "doc_id", "keep_id", "group_size", "sha")
    parts = [alone, same]
    collided = of_sha.where("texts > 1").select("sha", F.col("group_size").alias("n"))
    if not collided.isEmpty():
        parts.append(suspected(collided).join(classes, ["sha", "text"]).select("doc_id", "keep_id", "group_size", "sha"))
    return union_all(parts).select("doc_id", "keep_id", "group_size",
                                   F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                                   F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows with all their columns; of wholly repeated (id, text) rows one. Among
    rows without id a text is kept if no row with an id has it. Columns of any name stay.
    Rows whose text is alone stay where they lie; only those that may stand for a group
    are shuffled."""
    spark = docs.sparkSession
    found = stored(exact_groups(docs, id_col, text_col).select("doc_id", "text_sha256", "group_size", "kept"))
    many = stored(found.where("group_size > 1").select(F.col("text_sha256").alias("sha")).distinct())
    likely = screen_in_place(spark, many, SCREEN_KEYS)
    keep = stored(found.where(F.col("kept") & likely(F.col("text_sha256")))
                  .select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("of")).distinct())
    small_batches(spark)
    screen_of = digest_and_screen(spark, sha256_lower, many, keep.select(_mark("of", "id").alias("sha")), SCREEN_KEYS)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("key"),
                       screen_of(docs[text_col].cast("string"), docs[id_col].cast("long")).alias("s"))
    alone = rows.where("NOT s.near").select("row")
    some = (rows.where("s.near AND s.stands").select("row", "key", "s.sha")
            .join(keep, (F.col("sha") == F.col("of")) & F.col("key").eqNullSafe(F.col("id")), "left_semi")
            .dropDuplicates(["sha", "key"]).select("row"))
    return alone.unionByName(some).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _mark(sha: str, key: str) -> Column:
    return F.concat(F.col(sha), F.coalesce(F.col(key).cast("string"), F.lit("")))
