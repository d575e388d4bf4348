"""The corpus pipeline: run(spark, sf_dir) applies STAGES to ``documents``.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor
kept and returns a DataFrame, which is written as Parquet and read again as
the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from tidemark.llm import queries as Q
from tidemark.llm.common import stored

STAGES = Q.STAGES

#: The stages hold a trained tagger, a trained forest and a search; SQL cannot express them.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
