"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored  # noqa: F401

#: A key is hot if it holds more than one row in so many; there can be no more
#: hot keys than this, which is the proven bound of what ``join_by_key`` broadcasts.
HOT_SHARE = 10_000
#: So many rows of a key are not hot, however small the table.
HOT_ROWS = 100
#: Rows of an Arrow batch; whole texts travel in them.
BATCH_ROWS = 1_000


def whole_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the two columns an operator reads, null text as ''.
    Other columns, whatever their names, are left behind here."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def few(most: int, total: int) -> bool:
    """No key is hot, if none of ``total`` rows' keys has more than ``most`` of them."""
    return most <= max(total // HOT_SHARE, HOT_ROWS)


def join_by_key(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, most: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (unique by ``key``; column ``n``
    says how many rows have the key). Keys with over total / HOT_SHARE rows go
    by broadcast: there are fewer than HOT_SHARE of them whatever the input.
    Keys of the shuffled join are then all small. ``most``: no key has more rows, if
    the caller knows; where that makes none hot, the shuffled join alone is planned,
    since every broadcast, an empty one too, takes a thread and memory of the driver."""
    if most is not None and few(most, total):
        return rows.join(table, key)
    limit = max(total // HOT_SHARE, 1)
    hot = F.broadcast(table.where(F.col(n) > limit))
    cold = table.where(F.col(n) <= limit)
    return (rows.join(hot, key)
            .unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)))


def sample_by_hash(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, those with the lowest hashes of ``key``; of a repeated key one,
    null keys never. Keys are chosen first, alone, among those under a bound that leaves
    a small multiple of n; only then do the rows' other columns move."""
    share = min(1.0, (2 * n + 1_000) / max(rows.count(), 1))
    h = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    picked = (rows.select(key).where(F.col(key).isNotNull() & (h < int(share * (1 << 30)))).distinct()
              .orderBy(h, key).limit(n))
    return rows.join(F.broadcast(picked), key).dropDuplicates([key])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Memory:
    """A bounded dict for one Python worker, in two generations: ``young`` holds what
    the slice at hand needs; once it has ``limit`` entries it becomes the older
    generation, from which what is seen again comes back. A worker serves one operator
    after another, so only the memory in use keeps its entries."""

    in_use: Memory | None = None

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def need(self, keys) -> list:
        """The distinct keys that are not known; all others are in ``young`` afterwards."""
        if Memory.in_use is not self:
            if Memory.in_use is not None:
                Memory.in_use.young, Memory.in_use.old = {}, {}
            Memory.in_use = self
        young, old, new = self.young, self.old, []
        for k in set(keys).difference(young):
            v = old.get(k)
            if v is None:
                new.append(k)
            else:
                young[k] = v
        return new

    def turn(self) -> None:
        """To be called when a slice is done."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young


    @staticmethod
    def forget() -> None:
        """Empty the memory in use and give the pages back to the system."""
        if Memory.in_use is not None:
            Memory.in_use.young, Memory.in_use.old = {}, {}
            Memory.in_use = None
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):           # only where the C library has it
            pass


def forgetting(run):
    """A task's generator that leaves no memory behind in the worker, which may idle beside
    other operators' workers from then on."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            Memory.forget()

    return wrapped


def slices(batches, column: str, size: int = 2_000_000):
    """Arrow batches joined to tables whose texts have about ``size`` characters."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column(column).nbytes
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)
