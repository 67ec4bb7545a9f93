"""Ranked search, suggestions and decorated results (SRH1, SRH2, SUG1, SUG2, RES1, JSN1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webrank.functions import htmltext
from webrank.functions.text import query_words, replace_last_word

PAGE = 10


def scores(counts: DataFrame, idf: DataFrame, ranks: DataFrame | None, words: list[str], key: str = "url", prior: str = "sqrt") -> DataFrame:
    """``(key, score)`` of every record that holds one of ``words``, rounded to 6 places.

    The text score sums (0.5 + 0.5 tf / greatest tf of the query's words in the record) * idf (AGG11, MTH3); the prior adds
    sqrt(1 + rank), or the rank itself if ``prior`` is ``linear`` (MTH4), 0 for a record without one. Words without postings
    are ignored (FIL5). The words are filtered before any join, so only their postings are moved (JOI4).
    """
    held = counts.where(F.col("word").isin(words)).join(idf.where(F.col("word").isin(words)).select("word", "idf"), "word")
    greatest = F.max("tf").over(Window.partitionBy(key))
    text = held.select(key, ((0.5 + 0.5 * F.col("tf") / greatest) * F.col("idf")).alias("s")).groupBy(key).agg(F.sum("s").alias("text"))
    if ranks is None:
        rank = F.lit(0.0)
    else:
        text = text.join(ranks.select(key, "rank"), key, "left")
        rank = F.coalesce("rank", F.lit(0.0))
    bonus = F.sqrt(1 + rank) if prior == "sqrt" else rank
    return text.select(key, F.round(F.col("text") + bonus, 6).alias("score"))


def page(scored: DataFrame, number: int = 1, size: int = PAGE, key: str = "url") -> DataFrame:
    """``(position, key, score)`` of the ``number``-th page, best first, equal scores by key (TOP2).

    Only the best ``number * size`` rows of each task are moved.
    """
    best = scored.orderBy(F.col("score").desc(), key).limit(number * size)
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), key))
    return best.withColumn("position", place).where(F.col("position") > (number - 1) * size).select("position", key, "score")


def suggest(idf: DataFrame, query: str, n_docs: int | None = None, limit: int = 10) -> DataFrame:
    """``(suggestion, weight)`` from ``idf(word, df)``, whose column ``n`` counts the records if ``n_docs`` is not given: the query with its last word completed, by df * log10(N / df) (SUG1, MTH2, TOP3, FIL4)."""
    last = query.split(" ")[-1].lower() if query.strip() else ""
    weight = F.round(F.col("df") * F.log10((F.col("n") if n_docs is None else F.lit(n_docs)) / F.col("df")), 6)
    found = idf.where(F.col("word").startswith(last)).select("word", weight.alias("weight"))
    best = found.orderBy(F.col("weight").desc(), "word").limit(limit)
    return best.select(replace_last_word(F.lit(query), F.col("word")).alias("suggestion"), "weight")


def suggest_stored(index: DataFrame, n_rows: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """One row with the completed queries in order, commas between; no row where nothing fits or there is no index (SUG2).

    The last word is completed as it is written. ``index(word, df)`` counts postings, ``n_rows(n)`` is the number of stored
    pages; words come by falling df * log10(n / df), equal ones by name.
    """
    last = query.split(" ")[-1]
    weight = F.round(F.col("df") * F.log10(F.col("n") / F.col("df")), 6)
    found = index.select("word", "df").where(F.col("word").startswith(last)).join(F.broadcast(n_rows.select("n"))).select("word", weight.alias("weight"))  # one row
    best = found.orderBy(F.col("weight").desc(), "word").limit(limit)
    text = replace_last_word(F.lit(query), F.col("word"))
    entry = F.struct((-F.col("weight")).alias("o"), F.col("word"), text.alias("s"))
    listed = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["s"]), ",").alias("suggestions"))
    return listed.where("suggestions <> ''")


def decorate(results: DataFrame, pages: DataFrame, query: str) -> DataFrame:
    """``results`` with the ``title`` and ``description`` of their page from ``pages(url, html)`` (RES1)."""
    both = results.join(pages.select("url", "html"), "url", "left")
    words = query_words(F.lit(query))
    return both.select(*results.columns, htmltext.title(F.col("html"), F.col("url")).alias("title"), htmltext.description(F.coalesce("html", F.lit("")), words).alias("description"))


def results_json(results: DataFrame) -> DataFrame:
    """One row with ``{"results":[{"url":..,"title":..,"description":..},..]}`` in order of position (JSN1)."""
    entry = F.struct("position", F.to_json(F.struct("url", "title", "description")).alias("j"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["j"]), ",")
    return results.agg(F.concat(F.lit('{"results":['), joined, F.lit("]}")).alias("json"))


def suggestions_json(found: DataFrame) -> DataFrame:
    """One row with ``{"suggestions":[..]}``, heaviest first (JSN1)."""
    entry = F.struct((-F.col("weight")).alias("o"), F.col("suggestion").alias("s"))
    texts = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["s"])
    return found.agg(F.to_json(F.struct(texts.alias("suggestions"))).alias("json"))


def url_list(found: DataFrame) -> DataFrame:
    """One row with the URLs of a result page in order, commas between; none if there are no results (SRH2)."""
    entry = F.struct("position", "url")
    listed = found.agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["url"]), ",").alias("urls"))
    return listed.where("urls <> ''")


