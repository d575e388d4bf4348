"""Language of web pages by Bayesian evidence fusion.

The log posterior of a language is the sum of

* the text's tempered log likelihood under character trigrams (hashed, one table
  per language, fitted on the bounded sample ``TRAIN_DOCS`` of documents with a
  known language);
* log P(declared markup language | language), from soft counts over all pages;
* the log prior of the page's host, smoothed over its domain, that over its address
  suffix, and that over all pages: prior = (soft count + KAPPA * prior above) /
  (pages + KAPPA). A page's own soft count is taken out of its host's, domain's and
  suffix's, so its text is not counted twice.

Soft counts are grouped sums of the text-only posteriors over all pages (combined
before the shuffle). Hosts join by key; hosts with very many pages by broadcast of a
bounded number of rows. The declared language is a subtag of two or three letters,
so its table has at most 26**2 + 26**3 + 1 rows.

Defined results: empty or null html has no text evidence, a missing or malformed
address the empty host; without any labelled document ``lang`` is null; repeated rows
stay and each counts; null ids stay; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, sample_by_hash, slices, small_batches, stored
from .html_text import main_text

TRAIN_DOCS, TRAIN_CHARS, LEAST_DOCS = 4_000, 20_000, 3
BUCKETS = 1 << 15
#: Trigrams that a text counts for at most; neighbouring ones overlap.
EVIDENCE = 40
KAPPA = 5.0

_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})(?![A-Za-z])", re.I)


def trigrams(text: str) -> np.ndarray:
    """Hashed character trigrams of the lower-cased text, words apart by one space."""
    text = f" {' '.join(re.findall(r'[^\W\d_]+', text.lower()))} "
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, dtype=np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:]
    return ((h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(40)).astype(np.int64) % BUCKETS


def fit(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each trigram bucket per language)."""
    names = sorted(x for x, n in Counter(langs).items() if n >= LEAST_DOCS)
    table = np.full((len(names), BUCKETS), 0.5)
    for t, x in zip(texts, langs):
        if x in names:
            table[names.index(x)] += np.bincount(trigrams(t), minlength=BUCKETS)
    return names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32) if names else table.astype(np.float32)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    sample = (docs.select(docs["doc_id"].cast("long").alias("i"), docs["text"].cast("string").alias("t"), docs["lang"].cast("string").alias("l"))
              .where(F.length("t").between(1, TRAIN_CHARS) & (F.length("l") > 0)))
    sample = sample_by_hash(sample, "i", TRAIN_DOCS).collect()
    return fit([r["t"] for r in sample], [r["l"] for r in sample])


def text_evidence(pages: DataFrame, names: list[str], table: np.ndarray, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, host, domain, suffix, declared, ll (tempered log likelihood per language)."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(table)       # languages x BUCKETS numbers
    n = len(names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches, "html"):
            declared, found = [], []
            for page in t["html"].to_pylist():
                m = _LANG.search(page)
                declared.append(m[1].lower() if m else "")
                h = trigrams(main_text(page))
                ll = shared.value[:, h].mean(axis=1, dtype=np.float64) * min(len(h), EVIDENCE) if len(h) else np.zeros(n)
                found.append((ll - ll.max()).tolist() if n else [])
            out = pa.table({"page_id": t["page_id"], "url": t["url"], "declared": pa.array(declared, pa.string()),
                            "ll": pa.array(found, pa.list_(pa.float64()))})
            yield from out.combine_chunks().to_batches()

    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return (pages.select(pages[id_col].cast("long").alias("page_id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"),
                         F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
            .mapInArrow(run, "page_id long, url string, declared string, ll array<double>")
            .select("page_id", host.alias("host"), "declared", "ll")
            .withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
            .withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1)))


_SOFTMAX = "transform({x}, v -> exp(v - array_max({x})) / aggregate({x}, 0D, (s, w) -> s + exp(w - array_max({x}))))"


def _sums(df: DataFrame, keys: list[str], n: int, out: str) -> DataFrame:
    """Per key: soft counts per language, and pages."""
    return df.groupBy(*keys).agg(*[F.sum(F.col("p")[i]).alias(f"__{i}") for i in range(n)], F.count("*").alias(f"{out}_n")).select(
        *keys, F.array(*[F.col(f"__{i}") for i in range(n)]).alias(out), f"{out}_n")


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host of every page."""
    names, table = train(docs)
    rows = text_evidence(pages, names, table, id_col, url_col, html_col)
    if not names:
        none = F.lit(None).cast("string")
        return rows.select("page_id", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), "declared", "host")
    n = len(names)
    rows = stored(rows.withColumn("p", F.expr(_SOFTMAX.format(x="ll"))))
    total = rows.count()
    over_all = rows.agg(*[F.sum(F.col("p")[i]) for i in range(n)]).first()
    globally = [((x or 0.0) + 1.0) / (total + n) for x in over_all]

    # P(declared | language): soft counts of the pair, smoothed over the declared values
    said = _sums(rows, ["declared"], n, "d")                      # bounded: two or three letters
    kinds = 26 ** 2 + 26 ** 3 + 1
    declared = said.select("declared", F.array(*[F.log((F.col("d")[i] + 0.5) / (float(over_all[i] or 0.0) + 0.5 * kinds))
                                                 for i in range(n)]).alias("said"))

    # one row per host with its own sums and those of its domain and suffix
    hosts = stored(_sums(rows, ["host", "domain", "suffix"], n, "h"))
    many = hosts.count()
    above = hosts
    for level, name in (("domain", "m"), ("suffix", "s")):
        sums = hosts.groupBy(level).agg(*[F.sum(F.col("h")[i]).alias(f"__{i}") for i in range(n)], F.sum("h_n").alias(f"{name}_n"),
                                        F.count("*").alias("__hosts")).select(
            level, F.array(*[F.col(f"__{i}") for i in range(n)]).alias(name), f"{name}_n", "__hosts")
        above = join_by_key(above, sums, level, "__hosts", many).drop("__hosts")
    above = stored(above.drop("domain", "suffix"))

    joined = join_by_key(rows.drop("domain", "suffix"), above, "host", "h_n", total).join(F.broadcast(declared), "declared")
    prior = F.array(*[F.lit(float(g)) for g in globally])
    for name in ("s", "m", "h"):                                  # suffix, domain, host: each without the page itself
        joined = joined.withColumn("prior", prior).withColumn("prior", F.expr(
            f"transform(prior, (q, i) -> (greatest({name}[i] - p[i], 0D) + {KAPPA}D * q) / ({name}_n - 1 + {KAPPA}D))"))
        prior = F.col("prior")
    fused = joined.withColumn("z", F.expr("transform(ll, (v, i) -> v + said[i] + ln(prior[i]))")).withColumn("post", F.expr(_SOFTMAX.format(x="z")))
    called = F.array(*[F.lit(x) for x in names])

    def best(of: str):
        return called[(F.array_position(of, F.array_max(of)) - 1).cast("int")]

    return fused.select("page_id", best("post").alias("lang"), F.round(F.array_max("post"), 6).alias("confidence"),
                        best("ll").alias("text_lang"), "declared", "host")
