"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import (align, bpe, chat, exact_dedup, html_text, language_id, packing, periodic, secrets, simhash, token_counts,
               topk_search, toxicity)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
STAGES: list = []


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


_NORM = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
         "'abcdefghijklmnopqrstuvwxyz')")


@register("op5_exact_dedup", f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_NORM} AS t FROM documents)
WINDOW w AS (PARTITION BY t)""")
def op5(spark, sf_dir):
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, installed beside Python's libraries on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op4_token_counts")
def op4(spark, sf_dir):
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                     vocabulary("byte_bpe_50k.json"), limit=1024)


@register("op9_byte_bpe")
def op9(spark, sf_dir):
    import public_tokenizers
    got = bpe.encode(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                     vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op6_best_fit_packing")
def op6(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                        vocabulary("word_bpe_49k.json"), size=2048, end_id=0)


SHINGLE, BITS = 4, 4


@register("op10_simhash_near_dedup")
def op10(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), SHINGLE, BITS)


@register("op1_toxicity")
def op1(spark, sf_dir):
    return toxicity.score_documents(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                    read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]))


@register("op7_html_extraction")
def op7(spark, sf_dir):
    return html_text.extract(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


@register("op3_topk_search", """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op3(spark, sf_dir):
    return topk_search.top_k(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), F.col("id") % 50 == 0, k=5)


@register("op8_secret_scan")
def op8(spark, sf_dir):
    return secrets.scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


@register("op2_language_id")
def op2(spark, sf_dir):
    return language_id.identify(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]),
                                read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))


def repeat_tails(docs):
    """Every tenth document (by the checksum of its id) with its words from some place on
    replaced by repeats of the first of them; the others, and null ids, as they are."""
    h = F.crc32(docs["doc_id"].cast("string"))
    w = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.expr(
        r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")).alias("w"))
    w = w.withColumn("n", F.size("w")).withColumn("a", F.expr("(h div 10) % n"))
    w = w.withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    tail = "slice(flatten(array_repeat(slice(w, int(a + 1), int(p)), int((n - a + p - 1) div p))), 1, int(n - a))"
    return w.select("doc_id", F.when(F.col("n") > 0, F.expr(f"array_join(concat(slice(w, 1, int(a)), {tail}), ' ')"))
                    .otherwise(F.col("text")).alias("text"))


@register("op11_periodic_runs")
def op11(spark, sf_dir):
    docs = repeat_tails(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    got = periodic.periodic_runs(docs)
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS s, -r.period AS p)))")
    line = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return (got.withColumn("b", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"),
                    (-F.col("b.p")).alias("period"), F.expr("1000 * b.length div -b.p").alias("exponent_milli"),
                    F.sha2(F.expr(line), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


@register("op12_token_alignment")
def op12(spark, sf_dir):
    return align.align_documents(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                 vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@register("op13_chat_format")
def op13(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    done = chat.read_back(chat.format_chat(rows.unionByName(extra)))
    return done.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


# ------------------------------------------------------------ the pipeline

def stage_toxicity(spark, docs, sf_dir):
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]))


def stage_exact_dedup(spark, docs, sf_dir):
    return exact_dedup.drop_exact_copies(docs)


def stage_simhash(spark, docs, sf_dir):
    return simhash.drop_near_copies(docs, SHINGLE, BITS)


def stage_secrets(spark, docs, sf_dir):
    return secrets.redact(docs)


def stage_packing(spark, docs, sf_dir):
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), size=2048, end_id=0)


STAGES += [("toxicity", stage_toxicity), ("exact_dedup", stage_exact_dedup), ("simhash_near_dedup", stage_simhash),
           ("secret_scan", stage_secrets), ("best_fit_packing", stage_packing)]
