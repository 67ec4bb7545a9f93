"""Inverted index: tokens, postings, term and document frequencies (IDX1-IDX3, AGG8-AGG10, TOP4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrank.functions import text as txt


def tokenize(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, pos, word)`` of every indexed word, ``pos`` counting them from 0; null texts have none."""
    return df.select(F.col(key), F.posexplode(txt.tokens(F.col(text))).alias("pos", "word"))


def postings(tokens: DataFrame, key: str) -> DataFrame:
    """``(word, key, tf, positions)``, positions ascending (IDX1, AGG9)."""
    return tokens.groupBy("word", key).agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, word, tf)`` without positions: combined before the shuffle (IDX3)."""
    words = df.select(F.col(key), F.explode(txt.tokens(F.col(text))).alias("word"))
    return words.groupBy(key, "word").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def idf(counts: DataFrame, n_docs: int | Column) -> DataFrame:
    """``(word, df, idf)`` from one row per word and record, ``idf`` the natural logarithm of N / df (IDX3, AGG10, MTH1)."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return counts.groupBy("word").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(n / F.col("df")))


def idf_of(counts: DataFrame, total: DataFrame) -> DataFrame:
    """``(word, df, n, idf)`` with ``n`` from the one row of ``total(n)``, so that no count runs before the plan (IDX3, AGG10, MTH1)."""
    df = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(total.select("n"))).withColumn("idf", F.log(F.col("n") / F.col("df")))  # one row


def posting_lists(posts: DataFrame, key: str) -> DataFrame:
    """``(word, postings)``: the compatible text form, most frequent record first, commas between (IDX1, TOP4, TXT7).

    One row per word is what that form is; work on postings themselves needs no such row.
    """
    entry = F.struct((-F.col("tf")).alias("order"), F.col(key).cast("string").alias("k"), txt.posting_text(F.col(key).cast("string"), F.col("positions")).alias("t"))
    return posts.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), ",").alias("postings"))


def simple_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(word, key)`` of every token of any characters, each pair once (IDX2)."""
    return df.select(F.explode(F.array_distinct(txt.raw_tokens(F.col(text)))).alias("word"), F.col(key)).distinct()
