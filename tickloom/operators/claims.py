"""Claims: numbers and statements in prose against recomputed metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import flat
from ..schema import CLAIM_TOLERANCE


def _literal(phrase):
    """A regular expression for the phrase in a column, not inside a longer number."""
    quoted = F.concat(F.lit("\\Q"), phrase, F.lit("\\E"))
    before = F.when(phrase.rlike(r"^[0-9]"), F.lit("(?<![0-9.])")).otherwise(F.lit(""))
    after = F.when(phrase.rlike(r"[0-9]$"), F.lit("(?![0-9])")).otherwise(F.lit(""))
    return F.concat(before, quoted, after)


def check_values(claims: DataFrame, metrics: DataFrame, texts: DataFrame, tolerance: float = CLAIM_TOLERANCE) -> DataFrame:
    """(surface, label, got, want, drifted, missing): a claim (surface, label, metric, want, phrase) fails
    if the metric is further than the tolerance from want, or is not there, or its phrase is not in
    the surface's text.  White space in texts is flattened first."""
    body = texts.select("surface", flat(F.col("text")).alias("text"))
    joined = claims.join(metrics.select("metric", F.col("value").alias("got")), "metric", "left").join(body, "surface", "left")
    drifted = F.coalesce(F.abs(F.col("got") - F.col("want")) > tolerance, F.lit(True))
    missing = ~F.coalesce(F.regexp_like("text", _literal(F.col("phrase"))), F.lit(False))
    return joined.select("surface", "label", "got", "want", drifted.alias("drifted"), missing.alias("missing"))


def check_directions(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """(surface, label, holds, said, agrees): a statement must be in the text exactly when its predicate holds;
    it is found as in check_values()."""
    body = texts.select("surface", flat(F.col("text")).alias("text"))
    said = F.coalesce(F.regexp_like("text", _literal(F.col("phrase"))), F.lit(False))
    return claims.join(body, "surface", "left").select("surface", "label", "holds", said.alias("said"), (said == F.col("holds")).alias("agrees"))


def compare_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells (row, col, value) that only one of two tables has, with multiplicity; side says which."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def tally(results: DataFrame, failed) -> DataFrame:
    """Checks and failures by surface."""
    return results.groupBy("surface").agg(F.count("*").alias("checks"), F.count_if(failed).alias("failures"))


def gate(tallies: DataFrame) -> int:
    """0 if no surface has failures, else 1: what a command that checks should exit with."""
    return int(tallies.where("failures > 0").limit(1).count() > 0)


def html_table(rows: DataFrame, header: list[str], key: str, cells: str = "html") -> DataFrame:
    """One HTML table from row markup in key order; a report is small by nature."""
    head = "".join(f"<th>{h}</th>" for h in header)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, cells))), lambda x: x[cells]), "")
    return rows.agg(F.concat(F.lit(f"<table><tr>{head}</tr>"), body, F.lit("</table>")).alias("html"))


def html_page(title: str, tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row: a whole page with a heading and the (one-row) html of each table."""
    out = None
    for at, (heading, table) in enumerate(tables):
        one = table.select(F.lit(at).alias("at"), F.concat(F.lit(f"<h2>{heading}</h2>"), "html").alias("part"))
        out = one if out is None else out.union(one)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "")
    return out.agg(F.concat(F.lit(f"<!doctype html><html><head><title>{title}</title></head><body><h1>{title}</h1>"), body, F.lit("</body></html>")).alias("html"))
