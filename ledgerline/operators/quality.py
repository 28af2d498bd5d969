"""The batch quality audit: nine rules, health score, verdict.

Input is a cleaned batch DataFrame (``batch_id``, ``row_num`` and the eight
canonical columns); many batches are audited together, grouped by
``batch_id``.  Rules D1-D6 and D8-D9 are per-row predicates evaluated in one
projection and exploded into one row per (row, rule).  The duplicate rule
(D7) is an aggregate over the eight columns (map-side combine, so a heavily
repeated row collapses before the shuffle) joined back to the rows it
covers; AQE's skew join splits a hot key on the row side.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import blank
from ..functions.constants import (ACCEPT_SCORE, BLANK_CHECK_COLUMNS, DQ_RULES, EXTREME_EXPENSES,
                                   EXTREME_REVENUE, ISSUE_ROWS_SHOWN, REVIEW_SCORE)
from ..functions.headers import CANONICAL
from .positions import smallest_k

RULE_ORDER = {r: i for i, (r, _, _) in enumerate(DQ_RULES, start=1)}
SEVERITY = {r: s for r, s, _ in DQ_RULES}
MESSAGE = {r: m for r, _, m in DQ_RULES}
FAILING = [r for r, s, _ in DQ_RULES if s in ("Critical", "Warning")]

ISSUE_COLUMNS = ["batch_id", "row_num", "rule", "severity", "amount", "date", "columns", "msg"]


def _as_of(as_of: str | _dt.date) -> Column:
    return F.lit(str(as_of)).cast("date")


def _money_text(c: Column) -> Column:
    return F.format_string("%.2f", c)


def _msg(rule: str, value: Column | None = None) -> Column:
    text = MESSAGE[rule]
    if value is None:
        return F.lit(text)
    head, tail = text.split("{}")
    return F.concat(F.lit(head), value, F.lit(tail))


def row_predicates(clean: DataFrame, as_of: str | _dt.date) -> dict[str, Column]:
    rev, exp, date = F.col("revenue"), F.col("expenses"), F.col("date")
    blanks = F.array_compact(F.array(*[F.when(blank(F.col(c)), F.lit(c)) for c in BLANK_CHECK_COLUMNS]))
    return {
        "missing_date": date.isNull(),
        "future_dates": date.isNotNull() & (date > _as_of(as_of)),
        "negative_revenue": rev.isNotNull() & (rev < 0),
        "negative_expenses": exp.isNotNull() & (exp < 0),
        "null_amounts": (F.coalesce(rev, F.lit(0.0)) == 0) & (F.coalesce(exp, F.lit(0.0)) == 0),
        "blank_fields": F.size(blanks) > 0,
        "extreme_revenue": rev.isNotNull() & (rev > EXTREME_REVENUE),
        "extreme_expenses": exp.isNotNull() & (exp > EXTREME_EXPENSES),
        "_blank_cols": blanks,
    }


def _entry(rule: str, cond: Column, amount: Column | None = None, date: Column | None = None,
           cols: Column | None = None, msg: Column | None = None) -> Column:
    return F.when(cond, F.struct(
        F.lit(rule).alias("rule"),
        F.lit(SEVERITY[rule]).alias("severity"),
        (amount if amount is not None else F.lit(None)).cast("double").alias("amount"),
        (date if date is not None else F.lit(None)).cast("date").alias("date"),
        (cols if cols is not None else F.lit(None)).cast("string").alias("columns"),
        (msg if msg is not None else _msg(rule)).alias("msg"),
    ))


def duplicate_rows(clean: DataFrame) -> DataFrame:
    """Rows equal (NULLs equal) to an earlier row of the same batch in all
    eight columns: (batch_id, row_num, first_row_num)."""
    keys = ["batch_id", *CANONICAL]
    groups = (clean.groupBy(*keys)
              .agg(F.min("row_num").alias("first_row_num"), F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") > 1).drop("_n"))
    g = groups.select(*[F.col(k).alias(f"_d_{k}") for k in keys], "first_row_num")
    cond = [F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in keys]
    return (clean.select(*keys, "row_num").join(g, cond, "inner")
            .where(F.col("row_num") != F.col("first_row_num"))
            .select("batch_id", "row_num", "first_row_num"))


def issues(clean: DataFrame, as_of: str | _dt.date) -> DataFrame:
    """One row per (batch, row, rule) that fires."""
    p = row_predicates(clean, as_of)
    rev, exp, date = F.col("revenue"), F.col("expenses"), F.col("date")
    entries = F.array_compact(F.array(
        _entry("missing_date", p["missing_date"]),
        _entry("future_dates", p["future_dates"], date=date,
               msg=_msg("future_dates", F.date_format(date, "yyyy-MM-dd"))),
        _entry("negative_revenue", p["negative_revenue"], amount=rev, msg=_msg("negative_revenue", _money_text(rev))),
        _entry("negative_expenses", p["negative_expenses"], amount=exp,
               msg=_msg("negative_expenses", _money_text(exp))),
        _entry("null_amounts", p["null_amounts"]),
        _entry("blank_fields", p["blank_fields"], cols=F.array_join(p["_blank_cols"], ", "),
               msg=_msg("blank_fields", F.array_join(p["_blank_cols"], ", "))),
        _entry("extreme_revenue", p["extreme_revenue"], amount=rev, msg=_msg("extreme_revenue", _money_text(rev))),
        _entry("extreme_expenses", p["extreme_expenses"], amount=exp,
               msg=_msg("extreme_expenses", _money_text(exp))),
    ))
    per_row = (clean.select("batch_id", "row_num", F.explode(entries).alias("i"))
               .select("batch_id", "row_num", "i.*"))
    dups = duplicate_rows(clean).select(
        "batch_id", "row_num", F.lit("overlapping_rows").alias("rule"), F.lit(SEVERITY["overlapping_rows"])
        .alias("severity"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("date").alias("date"),
        F.lit(None).cast("string").alias("columns"), _msg("overlapping_rows").alias("msg"))
    return per_row.unionByName(dups).select(*ISSUE_COLUMNS)


def failed_rows(clean: DataFrame, as_of: str | _dt.date) -> DataFrame:
    """Per row: failed = any Critical or Warning rule fires."""
    p = row_predicates(clean, as_of)
    failed = F.lit(False)
    for r in FAILING:
        failed = failed | p[r]
    return clean.select("batch_id", "row_num", failed.alias("failed"))


def rule_counts(iss: DataFrame) -> DataFrame:
    """Rules with at least one entry, per batch."""
    return iss.groupBy("batch_id", "rule", "severity").agg(F.count(F.lit(1)).alias("issue_count"))


def verdict_of(score: Column) -> Column:
    return (F.when(score >= ACCEPT_SCORE, F.lit("Accepted"))
            .when(score >= REVIEW_SCORE, F.lit("Needs Review"))
            .otherwise(F.lit("Rejected")))


def verdicts(clean: DataFrame, as_of: str | _dt.date) -> DataFrame:
    """Per batch: rows, failed rows, health = 1 - failed/rows, status and the
    gate effect (Accepted and Needs Review merge the whole batch)."""
    f = failed_rows(clean, as_of)
    agg = f.groupBy("batch_id").agg(F.count(F.lit(1)).alias("row_count"),
                                    F.count_if(F.col("failed")).alias("failed_rows"))
    score = F.when(F.col("row_count") > 0,
                   F.lit(1.0) - F.col("failed_rows").cast("double") / F.col("row_count").cast("double")
                   ).otherwise(F.lit(1.0))
    out = agg.withColumn("health_score", score + F.lit(0.0)).withColumn("status", verdict_of(F.col("health_score")))
    merged = F.col("status").isin("Accepted", "Needs Review")
    return out.select(
        "batch_id", "row_count", "failed_rows", "health_score", "status",
        F.when(merged, F.col("row_count")).otherwise(F.lit(0)).cast("bigint").alias("accepted_rows"),
        F.when(merged, F.lit(0)).otherwise(F.col("row_count")).cast("bigint").alias("rejected_rows"),
        merged.alias("success"),
    )


def _first_rows(iss: DataFrame) -> DataFrame:
    """Per (batch, rule): count, first message, the first rows (<= 10, exact,
    skew-safe top-k) as a sorted array."""
    counts = iss.groupBy("batch_id", "rule", "severity").agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.min_by("msg", "row_num").alias("first_msg"))
    top = (smallest_k(iss.select("batch_id", "rule", "row_num"), ["batch_id", "rule"], "row_num", ISSUE_ROWS_SHOWN)
           .groupBy("batch_id", "rule").agg(F.array_sort(F.collect_list("row_num")).alias("rows")))
    return counts.join(top, ["batch_id", "rule"], "inner")


def issue_summary(iss: DataFrame) -> DataFrame:
    """Per batch and rule: severity, count, first message and the affected rows
    ("Row 1, Row 2, ... and n more rows...")."""
    fr = _first_rows(iss)
    listed = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("Row "), r.cast("string"))), ", ")
    more = F.when(F.col("issue_count") > ISSUE_ROWS_SHOWN, F.concat(
        F.lit(" and "), (F.col("issue_count") - ISSUE_ROWS_SHOWN).cast("string"), F.lit(" more rows...")
    )).otherwise(F.lit(""))
    return fr.select("batch_id", "rule", "severity", "issue_count", "first_msg",
                     F.concat(listed, more).alias("affected"))


def issues_json(iss: DataFrame) -> DataFrame:
    """Per batch: JSON text ``{"rule": count, ...}`` with rules in report order;
    the entries themselves are stored, all of them, as the ``dq_issues`` table."""
    fr = rule_counts(iss)
    order = F.lit(0)
    for rule, i in RULE_ORDER.items():
        order = F.when(F.col("rule") == rule, F.lit(i)).otherwise(order)
    text = F.concat(F.lit('"'), F.col("rule"), F.lit('": '), F.col("issue_count").cast("string"))
    per_batch = fr.select("batch_id", F.struct(order.alias("o"), text.alias("t")).alias("e")).groupBy("batch_id").agg(
        F.array_sort(F.collect_list("e")).alias("es"))  # <= 9 entries per batch
    return per_batch.select("batch_id", F.concat(
        F.lit("{"), F.array_join(F.transform("es", lambda e: e["t"]), ", "), F.lit("}")).alias("issues_json"))
