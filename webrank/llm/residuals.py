"""How characteristic a term is of a record: adjusted residuals of correspondence analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrank.operators.skew import counted_join
from webrank.plans.session import materialize


def residual(observed: Column, record_total: Column, term_total: Column, grand: Column) -> Column:
    """(observed - expected) / sqrt(expected) over sqrt((1 - record share) * (1 - term share)); null without variance.

    For given margins it grows with ``observed``, so a condition on a count is one on its residual.
    """
    expected = record_total * term_total / grand
    spread = expected * (1 - record_total / grand) * (1 - term_total / grand)
    return F.when(spread > 0, (observed - expected) / F.sqrt(spread))


def adjusted_residuals(df: DataFrame, record: str, term: str, count: str) -> DataFrame:
    """``(record, term, observed, record_total, term_total, term_records, n_records, grand_total, expected, residual)`` of each pair.

    ``expected`` is record_total * term_total / grand_total. Where a record or a term makes up the whole table, the variance is 0
    and the residual null. Rows repeated in full count once, other rows of a pair are added up; rows with a null or with a
    count of 0 or less are left out. Margins are pre-aggregated before their shuffle; those of the commonest terms and
    records are broadcast, a counted and bounded number of them. An empty table gives an empty result.
    """
    rows = df.select(F.col(record).alias("r"), F.col(term).alias("t"), F.col(count).cast("bigint").alias("o"))
    rows = materialize(rows.where("r is not null and t is not null and o > 0").distinct().groupBy("r", "t").agg(F.sum("o").alias("o")))
    by_record = materialize(rows.groupBy("r").agg(F.sum("o").alias("rt"), F.count(F.lit(1)).alias("rn")))
    by_term = materialize(rows.groupBy("t").agg(F.sum("o").alias("tt"), F.count(F.lit(1)).alias("tn")))
    whole = by_record.agg(F.sum("rt").cast("double").alias("g"), F.count(F.lit(1)).alias("nr"))
    out = counted_join(counted_join(rows, by_record, ["r"], "rn"), by_term, ["t"], "tn").join(F.broadcast(whole))  # one row
    return out.select(
        F.col("r").alias(record),
        F.col("t").alias(term),
        F.col("o").alias("observed"),
        F.col("rt").alias("record_total"),
        F.col("tt").alias("term_total"),
        F.col("tn").alias("term_records"),
        F.col("nr").alias("n_records"),
        F.col("g").alias("grand_total"),
        (F.col("rt") * F.col("tt") / F.col("g")).alias("expected"),
        residual(F.col("o"), F.col("rt"), F.col("tt"), F.col("g")).alias("residual"),
    )


def characteristic(scored: DataFrame, least: Column) -> DataFrame:
    """The rows of :func:`adjusted_residuals` whose residual is at least that of a count of ``least`` with the same margins.

    A row whose count is not below ``least`` is never left out: rounding is allowed for.
    """
    bound = residual(least, F.col("record_total"), F.col("term_total"), F.col("grand_total"))
    return scored.where(F.col("residual") >= bound - 1e-9 * (1 + F.abs(bound)))
