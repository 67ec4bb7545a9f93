"""Planning a crawl over pages at hand: frontier, robots rules, delays and per-host schedules (CRW1-CRW7, JOI5, JOI6, DAT1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrank.functions import htmltext
from webrank.operators.ranged import running_counts
from webrank.plans.session import materialize

DEFAULT_DELAY = 1.0


def frontier(seeds: DataFrame, edges: DataFrame, rounds: int, cap: int | None = None, back_pressure: int | None = None) -> DataFrame:
    """``(url, depth)`` of all pages reached from ``seeds(url)`` over ``edges(src, dst)`` in at most ``rounds`` rounds.

    Each round keeps the new targets not yet visited (left-anti join, JOI5). After ``cap`` pages no links are followed
    (CRW2), nor from a round of more than ``back_pressure`` pages (CRW6). Rounds are written out, so plans stay short.
    """
    visited = materialize(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)))
    last, total = visited, visited.count()
    size = total
    for depth in range(1, rounds + 1):
        if not size or (cap is not None and total > cap) or (back_pressure is not None and size > back_pressure):
            break
        found = last.select(F.col("url").alias("src")).join(edges, "src").select(F.col("dst").alias("url")).where("url is not null").distinct()
        last = materialize(found.join(visited, "url", "left_anti").withColumn("depth", F.lit(depth)))
        size = last.count()
        total += size
        visited = visited.unionByName(last)
    return visited


def robots_rules(robots: DataFrame, key: str = "host", text: str = "robots") -> DataFrame:
    """``(key, pos, agent, kind, value)``: every Allow, Disallow and Crawl-delay line with the agent it stands under.

    A line's agent is that of the nearest User-agent line above it. Comments and spaces around are dropped.
    """
    lines = robots.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("pos", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    field = F.lower(F.trim(F.substring_index(line, ":", 1)))
    value = F.trim(F.expr("substring(l, instr(l, ':') + 1)"))
    parsed = lines.withColumn("l", line).where("l like '%:%'").select(key, "pos", field.alias("kind"), value.alias("value"), "l")
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.last(F.when(F.col("kind") == "user-agent", F.lower("value")), ignorenulls=True).over(order)
    return parsed.withColumn("agent", agent).where(F.col("kind").isin("allow", "disallow", "crawl-delay")).select(key, "pos", "agent", "kind", "value")


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str, strict: bool = True, key: str = "host") -> DataFrame:
    """``urls(key, path, ...)`` with ``allowed``: rules for ``agent`` come before those for ``*``, the first whose value starts
    the path decides, none means allowed (CRW3). An empty Disallow blocks nothing, or everything if not ``strict``."""
    paths = rules.where(F.col("kind").isin("allow", "disallow") & F.col("agent").isin(agent.lower(), "*"))
    if strict:
        paths = paths.where("value <> ''")
    order = F.struct((F.col("agent") == "*").cast("int").alias("any"), "pos")
    listed = paths.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("kind"), F.col("value")))).alias("rules"))
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["value"])), F.lit(0))["kind"]
    return urls.join(listed, key, "left").withColumn("allowed", F.coalesce(first != "disallow", F.lit(True))).drop("rules")


def crawl_delay(rules: DataFrame, key: str = "host") -> DataFrame:
    """``(key, delay)``: seconds of the last Crawl-delay line that is a number, whatever its agent (CRW4)."""
    numbers = rules.where(F.col("kind") == "crawl-delay").withColumn("d", F.col("value").try_cast("double"))
    return numbers.where("d is not null").groupBy(key).agg(F.max_by("d", "pos").alias("delay"))


def rate_schedule(urls: DataFrame, hosts: DataFrame, order: str, start: Column) -> DataFrame:
    """``urls(host, ...)`` with ``due``, the earliest time of each fetch: the n-th of a host waits n delays (CRW5, JOI6, DAT1).

    ``hosts(host, delay, last_access)``: a host not listed has the default delay; the first fetch waits for ``start`` and for
    a delay after the last access, whichever is later. ``order`` must be unique within a host; a host of any size is spread
    over range partitions.
    """
    counted = running_counts(urls.withColumn("__one", F.lit(1)), ["host"], [order], "__one", "n").drop("__one")
    both = counted.join(hosts, "host", "left")
    delay = F.coalesce("delay", F.lit(DEFAULT_DELAY))
    first = F.greatest(start, F.coalesce(F.timestamp_seconds(F.unix_micros(F.col("last_access").cast("timestamp")) / 1e6 + delay), start))
    due = F.timestamp_micros((F.unix_micros(first) + F.round(F.col("n") * delay * 1e6)).cast("bigint"))
    return both.withColumn("due", due).drop("delay", "last_access", "n")


def clean_page(pages: DataFrame, version: str = "final") -> DataFrame:
    """``pages(url, html)`` cleaned: ``page`` and its length in ``cache_length`` (CRW7).

    ``final`` drops navigation too, asks for English, UTF-8 and a minimum length, and keeps at most 40,000 characters;
    ``jobs`` removes fewer elements and asks for English anywhere.
    """
    if version == "jobs":
        kept = pages.where(htmltext.is_english(F.col("html"), anywhere=True))
        text = htmltext.collapse(htmltext.strip_tags(htmltext.remove_elements(F.col("html"), htmltext.EARLY_ELEMENTS)))
    else:
        body = htmltext.remove_elements(F.col("html"))
        kept = pages.where(htmltext.is_english(F.col("html")) & htmltext.is_utf8(F.col("html")) & htmltext.long_enough(body))
        text = htmltext.truncate(htmltext.collapse(htmltext.strip_tags(htmltext.drop_dotted_anchors(body))))
    return kept.select("url", text.alias("page")).withColumn("cache_length", F.length("page"))
