"""Queries of the core operators and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webrank.operators.treeagg import hot_values, tree_aggregate
from webrank.plans import collections_catalogue, web_catalogue
from webrank.plans.session import load

Query = Callable[[SparkSession, str], DataFrame]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Robots texts with at least 3% of the rows of ``hosts`` and words with at least 2% of the rows of ``df``."""
    robots = hot_values(load(spark, sf, "hosts"), "robots", 0.03)
    words = hot_values(load(spark, sf, "df"), "word", 0.02)
    return robots.select(F.lit("hosts.robots").alias("field"), F.col("robots").alias("hot_value")).unionByName(
        words.select(F.lit("df.word").alias("field"), F.col("word").alias("hot_value"))
    )


def p5_robots_delay(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, hosts and mean delay per robots text, of the rows as stored; the null text is a value of its own."""
    hosts = load(spark, sf, "hosts").select("host", "robots", "crawl_delay")
    delay = F.col("crawl_delay").cast("decimal(20,6)")
    per_host = tree_aggregate(hosts, ["robots", "host"], {"n": ("count", F.lit(1)), "d": ("sum", delay), "nd": ("count", delay)})
    per_text = tree_aggregate(
        per_host, ["robots"], {"n_rows": ("sum", F.col("n")), "n_hosts": ("count", F.col("host")), "d": ("sum", F.col("d").cast("decimal(38,6)")), "nd": ("sum", F.col("nd"))}
    )
    mean = F.when(F.col("nd") > 0, F.col("d").cast("double") / F.col("nd"))
    return per_text.select("robots", "n_rows", "n_hosts", F.round(mean, 6).alias("mean_delay"))


def p5_word_df(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency per word, summed over the index segments."""
    return tree_aggregate(load(spark, sf, "df").select("word", "df"), ["word"], {"df": ("sum", F.col("df")), "segments": ("count", F.lit(1))})


P5_SQL = {
    "p5_found": """
        SELECT 'hosts.robots' AS field, robots AS hot_value FROM hosts WHERE robots IS NOT NULL
        GROUP BY robots HAVING count(*) >= 0.03 * (SELECT count(*) FROM hosts)
        UNION ALL
        SELECT 'df.word', word FROM df WHERE word IS NOT NULL
        GROUP BY word HAVING count(*) >= 0.02 * (SELECT count(*) FROM df)""",
    "p5_robots_delay": """
        SELECT robots, count(*) AS n_rows, count(DISTINCT host) AS n_hosts,
               round(CAST(sum(CAST(crawl_delay AS DECIMAL(20,6))) AS DOUBLE) / count(crawl_delay), 6) AS mean_delay
        FROM hosts GROUP BY robots""",
    "p5_word_df": "SELECT word, CAST(sum(df) AS BIGINT) AS df, count(*) AS segments FROM df GROUP BY word",
}


def queries() -> dict[str, Query]:
    """All core queries by name."""
    return collections_catalogue.R.queries | web_catalogue.R.queries | {"p5_found": p5_found, "p5_robots_delay": p5_robots_delay, "p5_word_df": p5_word_df}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return collections_catalogue.R.sql | web_catalogue.R.sql | P5_SQL
