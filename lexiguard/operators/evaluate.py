"""Evaluation on golden sets: recalls, pass rates, gates, agreement and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least must-catch recall, the same at severity 5, must-pass rate, evasion recall.
GATES = {"must_catch": 0.95, "must_catch_sev5": 1.0, "must_pass": 0.98, "evasion": 0.85}


def deferral(gate_status: Column, rely_on: Column, buckets: tuple[str, ...] = ("pending_lexicon", "composite_future")) -> Column:
    return F.when(gate_status.isin(*buckets), gate_status).when(rely_on == "term_variant_row", "deferred_variants")


def caught(golden: DataFrame, matches: DataFrame) -> DataFrame:
    """golden (id, expected, …) with ok: whether all expected surfaces were matched."""
    found = matches.groupBy("id").agg(F.collect_set("surface").alias("found"))
    return golden.join(found, "id", "left").withColumn("ok", F.size(F.array_except("expected", F.coalesce("found", F.array().cast("array<string>")))) == 0).drop("found")


def _share(ok: Column, of: Column) -> Column:
    """Share of rows that are ok among those of the condition; 1 without any."""
    n = F.sum(F.when(of, 1).otherwise(0))
    return F.when(n == 0, 1.0).otherwise(F.sum(F.when(of & ok, 1.0).otherwise(0.0)) / n)


def recalls(scored: DataFrame) -> DataFrame:
    """One row: recall, recall at severity 5, numbers of deferred rows. scored: ok, severity, bucket (null if not deferred)."""
    due = F.col("bucket").isNull()
    return scored.agg(_share(F.col("ok"), due).alias("recall"), _share(F.col("ok"), due & (F.col("severity") == 5)).alias("recall_sev5"), F.sum(F.when(due, 0).otherwise(1)).cast("long").alias("n_deferred"))


def pass_rates(scored: DataFrame, by: str = "slot") -> DataFrame:
    """Pass rates by slot and, with a null slot, over all."""
    return scored.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)).alias("rate"))


def recall_by_kind(scored: DataFrame) -> DataFrame:
    """(evasion_kind, n, rate) by kind ('?' where it is unknown) and, with a null kind, over all; deferred rows do not count. scored: ok, evasion_kind, bucket."""
    due = scored.where("bucket IS NULL").withColumn("evasion_kind", F.coalesce("evasion_kind", F.lit("?")))
    return pass_rates(due, "evasion_kind")


def must_pass(checked: DataFrame) -> DataFrame:
    """(slot, n, rate, review_hits) by slot and, with a null slot, over all; deferred rows do not count. checked: slot, grade, recommendation, bucket.

    Ambiguous sentences fail if a revision is recommended, others if anything was matched.
    """
    ok = F.when(F.col("grade") == "ambiguous", F.col("recommendation") != "revise_recommended").otherwise(F.col("recommendation") == "none")
    hit = (F.col("grade") == "ambiguous") & (F.col("recommendation") == "review_recommended")
    return checked.where("bucket IS NULL").rollup("slot").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("rate"), F.sum(F.when(hit, 1).otherwise(0)).cast("long").alias("review_hits"))


def golden_report(scored: DataFrame) -> DataFrame:
    """(line, value): recall with counts, the number of deferred rows, and what each missed row expected. scored: id, expected, ok, bucket."""
    due = F.col("bucket").isNull()
    n, hit = F.count(F.when(due, 1)), F.count(F.when(due & F.col("ok"), 1))
    share = F.format_string("%.1f%% (%d/%d)", F.when(n == 0, 100.0).otherwise(hit * 100.0 / n), hit, n)
    totals = scored.agg(share.alias("a"), F.count(F.when(~due, 1)).cast("string").alias("b"))
    lines = totals.select(F.explode(F.array(F.struct(F.lit("recall").alias("line"), F.col("a").alias("value")), F.struct(F.lit("deferred").alias("line"), F.col("b").alias("value")))).alias("x")).select("x.*")
    missed = scored.where(due & ~F.col("ok")).select(F.concat(F.lit("missed "), F.col("id").cast("string")).alias("line"), F.array_join("expected", ", ").alias("value"))
    return lines.unionByName(missed)


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small report's rows as a Markdown table; a longer one ends in a note."""
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n| {' | '.join('---' for _ in rows.columns)} |\n"
    shown = rows.limit(most + 1).collect()
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    body = "".join(f"| {' | '.join(map(cell, r))} |\n" for r in shown[:most])
    return head + body + ("\nOnly the first rows are shown.\n" if len(shown) > most else "")


def passes(grade: Column, recommendation: Column) -> Column:
    """Ambiguous sentences may be reviewed, strict and marketing ones at most observed."""
    return F.when(grade == "ambiguous", recommendation != "revise_recommended").otherwise(recommendation.isin("none", "monitor"))


def gates(values: DataFrame) -> DataFrame:
    """values (one row with the gates' names) to rows (gate, value, least, passed)."""
    rows = F.array(*(F.struct(F.lit(k).alias("gate"), F.col(k).alias("value"), F.lit(v).alias("least"), (F.col(k) >= v).alias("passed")) for k, v in GATES.items() if k in values.columns))
    return values.select(F.explode(rows).alias("g")).select("g.*")


def p95(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def cohen_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters beyond chance; 1 where both always give the same single mark."""
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0.0)).alias("same"))
    left, right = cells.groupBy(F.col(a).alias("m")).agg(F.sum("n").alias("x")), cells.groupBy(F.col(b).alias("m")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "m").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    return total.join(chance).select(F.when(F.col("total") * F.col("total") == F.coalesce("xy", F.lit(0.0)), 1.0).otherwise((F.col("same") / F.col("total") - F.coalesce("xy", F.lit(0.0)) / (F.col("total") * F.col("total"))) / (1 - F.coalesce("xy", F.lit(0.0)) / (F.col("total") * F.col("total")))).alias("kappa"))
