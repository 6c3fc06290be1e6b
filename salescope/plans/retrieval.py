"""Fact index: build once, search many times (V2 + S15 + V4).

The index is one Parquet table ``(fact_id, text, idx, val)``: text and vector share a
row, so they can never drift apart.  A rebuild overwrites the whole table.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.operators import facts as facts_op
from salescope.operators import vectors
from salescope.operators.grid import nonblank_texts
from salescope.sources.partitioning import dimension_join
from salescope.sources.landing import read_vector_table, write_vector_table


def build_text_index(texts: DataFrame, path: str, id_col: str = "id", text: str = "text",
                     dim: int = vectors.DEFAULT_DIM, hash_fn: str = "md5") -> None:
    """Non-blank texts on one line each (C2), stripped, with their hashed vectors, written to ``path`` (V2)."""
    clean = nonblank_texts(texts.select(id_col, F.replace(F.col(text), F.lit("\n"), F.lit(" ")).alias(text)), text)
    write_vector_table(vectors.sparse_embed(clean, id_col, text, dim, hash_fn, keep=(text,)), path)


def build_fact_index(sales: DataFrame, path: str, dim: int = vectors.DEFAULT_DIM) -> None:
    """Facts of a sales table (X1) indexed for retrieval."""
    f = facts_op.facts(sales).select(F.col("fact_id").alias("id"), "text")
    build_text_index(f, path, "id", "text", dim)


def search_index(spark: SparkSession, path: str, questions: DataFrame, k: int = 5,
                 qid: str = "qid", question: str = "question",
                 dim: int = vectors.DEFAULT_DIM, hash_fn: str = "md5") -> DataFrame:
    """k nearest indexed texts per question: ``qid, rank, id, d2, text``."""
    index = read_vector_table(spark, path)
    q = vectors.sparse_embed(questions, qid, question, dim, hash_fn)
    hits = vectors.search_sparse(q, index.select("id", "idx", "val"), k, qid, "id")
    # at most questions x k hits: broadcast only while that bound is under the cap
    joined = dimension_join(index.select("id", "text"), hits, "id", bound_rows=questions.count() * k)
    return joined.select(qid, "rank", "id", "d2", "text")


def build_dense_index(texts: DataFrame, path: str, load_model: Callable[[], Any], dim: int, id_col: str = "id", text: str = "text") -> None:
    """Non-blank texts on one line each with a model's vectors (U2), written to ``path`` as (id, text, vec) (V2)."""
    encode = vectors.encoder_udf(load_model, dim)
    clean = nonblank_texts(texts.select(id_col, F.replace(F.col(text), F.lit("\n"), F.lit(" ")).alias(text)), text)
    write_vector_table(clean.select(id_col, text, encode(F.col(text)).alias("vec")), path)


def search_dense_index(spark: SparkSession, path: str, questions: DataFrame, load_model: Callable[[], Any], dim: int, k: int = 5,
                       qid: str = "qid", question: str = "question", id_col: str = "id") -> DataFrame:
    """k nearest indexed texts per question, encoded by the same model: ``qid, rank, id, d2, text`` (V3)."""
    index = read_vector_table(spark, path)
    asked = questions.where(F.col(question).isNotNull())
    q = asked.select(qid, vectors.encoder_udf(load_model, dim)(F.col(question)).alias("vec"))
    hits = vectors.knn_dense(q, index.select(id_col, "vec"), k, qid, id_col)
    joined = dimension_join(index.select(id_col, "text"), hits, id_col, bound_rows=asked.count() * k)
    return joined.select(qid, "rank", id_col, "d2", "text")
