"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the bit counts of the
segments place it in the grid {0, 1, 2}^32. One changed bit moves one count by
one, so the Manhattan distance of two places is a lower bound of the Hamming
distance of the fingerprints. Written in unary (0, 1, 3), the counts are again
64 bits, and the Manhattan distance is the bit count of an exclusive or.

Range join under distance ``bits``: if two places are within ``bits``, then in
one of the two halves of the coordinates they are within bits // 2. Each place
enters, for each half, the grid cell of its 16 counts and the cells one step
away, so two places within two steps of each other meet in a cell between
them. A pair is emitted in one cell only, the one that its two fingerprints
define, after the Manhattan bound and the exact Hamming check. The halves allow
two steps each, so ``bits`` is at most 5.

Only distinct fingerprints are joined: equal ones are one node with its number
of rows. Links become classes by large-star / small-star rounds.

Defined results: null text is empty; a text without words has fingerprint zero
and links like any other; fewer words than a shingle give one shingle of all;
repeated rows stay, with equal results; component_id is null if no row of the
component has a doc_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, forgetting, join_by_key, small_batches, stored, union_all, whole_text
from .components import stars, with_roots
from .exact_dedup import SCREEN_KEYS, screen_in_place

SEED = 42
#: Shingles whose bits are summed at once.
STEP = 16_384
_EVEN = 0x5555555555555555


def fingerprint(text: bytes, shingle: int) -> bytes:
    """Eight bytes, the highest bits first."""
    import xxhash
    words = text.lower().split()                     # both ASCII only
    n = len(words) - shingle + 1
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_digest(joined, SEED)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(stops[:n - 1] + 1).tolist()]
    stops = stops[shingle - 1:].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        raw = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts[at:at + STEP], stops[at:at + STEP])])
        ones += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary()).to_pylist()
            raw = b"".join([fingerprint(t, shingle) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.frombuffer(raw, dtype=">i8").astype(np.int64))], ["doc_id", "fp"])

    return whole_text(docs, id_col, text_col).mapInArrow(forgetting(run), "doc_id long, fp long")


def _unary(fp: str) -> str:
    """The counts of the 32 segments in unary: min and max of each bit pair."""
    a, b = f"({fp} & {_EVEN}L)", f"(shiftrightunsigned({fp}, 1) & {_EVEN}L)"
    return f"(({a} | {b}) | shiftleft({a} & {b}, 1))"


_HALF = "4294967295L"


def _cells(reps: DataFrame) -> DataFrame:
    """(cell, fp, u): per half the own cell and all cells one step away; u: the counts in unary."""
    halves = (reps.selectExpr("fp", f"{_unary('fp')} AS u").select("fp", "u", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
              .selectExpr("fp", "u", "half", f"shiftrightunsigned(u, 32 * half) & {_HALF} AS h"))
    steps = """flatten(transform(sequence(0, 30, 2), i -> CASE shiftright(h, i) & 3L
        WHEN 0 THEN array(h | shiftleft(1L, i))
        WHEN 1 THEN array(h ^ shiftleft(1L, i), h | shiftleft(2L, i))
        ELSE array(h ^ shiftleft(2L, i)) END))"""
    return halves.selectExpr("fp", "u", f"explode(concat(array(h), {steps})) AS c", "half").selectExpr(
        "c | shiftleft(CAST(half AS long), 32) AS cell", "fp", "u")


def links(reps: DataFrame, bits: int) -> DataFrame:
    """(u, v): all pairs of distinct fingerprints with at most ``bits`` differing bits, each once."""
    if not 0 <= bits <= 5:
        raise ValueError("the two halves cover up to 5 bits")
    cells = _cells(reps)
    # x, y: the two places in the half that the shared cell is of; they are at most two steps apart
    shift = "CAST(32 * shiftright(a.cell, 32) AS int)"
    x, y = (f"(shiftrightunsigned({t}.u, {shift}) & {_HALF})" for t in ("a", "b"))
    low = f"(({x} ^ {y}) & -({x} ^ {y}))"
    # the one cell that emits the pair: up to one step apart, the lower counts; two steps in one
    # segment, the count between; else the second segment's count from the one, the first's from the other
    cell = f"""CASE WHEN bit_count({x} ^ {y}) <= 1 THEN {x} & {y}
        WHEN bit_count({low} & {_EVEN}L) = 1 AND ({x} ^ {y}) = 3L * {low} THEN ({x} & {y}) | {low}
        ELSE {y} ^ {low} END"""
    # both sides are shuffled: Spark sizes cells as if the explode made one row of each, some fifty times too low
    return cells.alias("a").join(cells.alias("b").hint("merge"), F.expr(f"""a.cell = b.cell AND a.fp < b.fp
        AND bit_count(a.u ^ b.u) <= {bits} AND bit_count(a.fp ^ b.fp) <= {bits}
        AND (a.cell <= {_HALF} OR bit_count((a.u ^ b.u) & {_HALF}) > 2)
        AND (a.cell & {_HALF}) = ({cell})""")).selectExpr("a.fp AS u", "b.fp AS v")


def as_hex(fp: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _classes(docs: DataFrame, shingle: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, root, component_id), one row per input row; root: the component's own fingerprint."""
    rows = stored(fingerprints(docs, shingle, id_col, text_col))
    reps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    total, copies = reps.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    edges, most = stars(links(reps, bits))
    linked = stored(with_roots(edges)).withColumnRenamed("node", "fp")
    if few(most + 1, total):
        labels = reps.join(linked, "fp", "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))
        labels = stored(labels.select("fp", "n", "root", F.min("first").over(Window.partitionBy("root")).alias("component_id")))
        return join_by_key(rows, labels, "fp", "n", total, copies).select("doc_id", "fp", "root", "component_id")
    of_root = linked.join(reps, "fp").groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("m"))
    named = join_by_key(linked, of_root, "root", "m", total).select("fp", "root", "least")
    labels = stored(reps.join(named, "fp", "left").select(
        "fp", "n", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")))
    return join_by_key(rows, labels, "fp", "n", total, copies).select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int, bits: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id, one row per input row."""
    return _classes(docs, shingle, bits, id_col, text_col).select(
        "doc_id", as_hex("fp").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int, bits: int,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of exactly one row per component: a row of its smallest doc_id. A row
    without id is chosen only if the component has no other; among rows with the same id
    (or none) it is one of the least fingerprint. Ids may repeat, also across components;
    columns may have any name. Rows that are surely chosen stay where they lie."""
    spark = docs.sparkSession
    found = stored(_classes(docs, shingle, bits, id_col, text_col).select("doc_id", "fp", "root"))
    chosen = stored(found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("no"), "doc_id", "fp")).alias("c"))
                    .select(F.col("c.doc_id").alias("id"), F.col("c.fp").alias("of")))
    # an id that repeats, or none, does not name a row: there the fingerprint decides
    named = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).select(F.col("doc_id").alias("id"), "n")
    many = stored(named.where("n > 1").select("id"))
    doubt = stored(named.join(chosen, "id", "left_anti").select("id").unionByName(many).distinct())
    likely = screen_in_place(spark, doubt.select(F.col("id").alias("sha")), SCREEN_KEYS)
    sure = stored(chosen.where(likely(F.col("id"))).join(many, "id", "left_anti").select("id"))
    back = screen_in_place(spark, sure.select(F.col("id").alias("sha")), SCREEN_KEYS)

    cols = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in cols]).alias("row"), docs[id_col].cast("long").alias("key"),
                       docs[text_col].cast("string").alias("txt"))
    in_doubt = rows.where(F.col("key").isNotNull() & likely(F.col("key")))
    parts = [rows.where(F.col("key").isNotNull() & ~likely(F.col("key"))),
             in_doubt.where(back(F.col("key"))).join(sure, F.col("key") == F.col("id"), "left_semi")]
    open_ids = stored(chosen.where("id IS NULL").unionByName(chosen.join(many, "id", "left_semi")))
    if not open_ids.isEmpty():
        open_rows = rows.where("key IS NULL").unionByName(in_doubt.join(many, F.col("key") == F.col("id"), "left_semi"))
        parts.append(open_rows.withColumn("own", _fp_of(shingle)(F.coalesce("txt", F.lit(""))))
                     .join(open_ids, F.col("key").eqNullSafe(F.col("id")) & (F.col("own") == F.col("of")), "left_semi")
                     .dropDuplicates(["key", "own"]))
    return union_all([p.select("row") for p in parts]).select(*[F.col("row").getField(c).alias(c) for c in cols])


def _fp_of(shingle: int):
    @F.arrow_udf(T.LongType())
    def run(text: pa.Array) -> pa.Array:
        raw = b"".join([fingerprint(t, shingle) for t in text.cast(pa.large_binary()).to_pylist()])
        return pa.array(np.frombuffer(raw, dtype=">i8").astype(np.int64))

    return run
