"""Suites of cases as rows: selectors in order, the engine of a plan, results of every case, and reports of suites and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import merge_engine
from .review import roll_up


def selectors(suites: DataFrame, manifest: str = "manifest") -> DataFrame:
    """``suites`` (kind, grammar, variant, roles) with ``rank`` in their manifest, by kind, grammar and variant, and ``descriptor``, the definition as JSON.

    Rows that repeat a selector get one rank each; ``first`` marks the one that a selector stands for.
    """
    order = ("kind", "grammar", "variant")
    place = F.row_number().over(Window.partitionBy(manifest).orderBy(*order, "pos"))
    nth = F.row_number().over(Window.partitionBy(manifest, *order).orderBy("pos"))
    subject = F.struct("grammar", F.when(F.col("variant") != "", F.col("variant")).alias("variant"))
    return suites.withColumns({"rank": place, "first": nth == 1, "descriptor": F.to_json(F.struct("kind", subject.alias("subject"), "roles"))})


def with_engine(contexts: DataFrame, engine: str, default: Column) -> DataFrame:
    """``contexts`` with the engine of a plan: its own if it names one, else the default, which is normalised if it is not empty."""
    own = F.coalesce(F.col(engine), F.lit(""))
    planned = F.when(F.coalesce(default, F.lit("")) != "", merge_engine(default)).otherwise("")
    return contexts.withColumn(engine, F.when(own == "", planned).otherwise(own))


def run_cases(cases: DataFrame, executions: DataFrame, key: str) -> DataFrame:
    """``cases`` (with status and messages of their selection) with ``outcome`` and ``said``.

    A case that selection skips does not run; one that was to run and did not is skipped too.
    """
    ran = executions.select(key, F.col("outcome").alias("_outcome"), F.col("said").alias("_said"))
    both = cases.join(ran, key, "left")
    skipped = F.col("status") == "skipped"
    outcome = F.when(skipped, "skipped").otherwise(F.coalesce("_outcome", F.lit("skipped")))
    return both.withColumns({"outcome": outcome, "said": F.when(skipped, F.col("messages")).otherwise(F.coalesce("_said", F.lit("not run")))}).drop("_outcome", "_said")


def suite_reports(results: DataFrame, suite: str, order: str, case: str) -> DataFrame:
    """One row a suite: its cases in order as (case, outcome, said), and how many passed, failed and were skipped."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, case, "outcome", "said"))), lambda x: F.struct(x[case].alias("case"), x["outcome"].alias("outcome"), x["said"].alias("said")))
    rows = results.groupBy(suite).agg(listed.alias("results"))
    return rows.join(roll_up(results, [suite]), suite)


def report_envelope(reports: DataFrame, manifest: list[str]) -> DataFrame:
    """Totals over the suites of each manifest."""
    return reports.groupBy(*manifest).agg(F.count(F.lit(1)).alias("suites"), *[F.sum(c).alias(c) for c in ("total", "passed", "failed", "skipped")])


def adapter_capabilities(required: DataFrame, registered: DataFrame, run: str) -> DataFrame:
    """(run, required, registered, missing, ready): families that a run's entries need and those it has adapters for, sorted.

    A run that needs nothing is ready; one without adapters has an empty list.
    """
    marked = required.select(run, "family", F.lit(True).alias("need")).unionByName(registered.select(run, "family", F.lit(False).alias("need")))
    flags = marked.groupBy(run, "family").agg(F.bool_or("need").alias("need"), F.bool_or(~F.col("need")).alias("have"))
    sort = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("family"))))
    per = flags.groupBy(run).agg(sort(F.col("need")).alias("required"), sort(F.col("have")).alias("registered"), sort(F.col("need") & ~F.col("have")).alias("missing"))
    return per.withColumn("ready", F.size("missing") == 0)


def batch_operations(profiles: DataFrame, batch: str, order: str) -> DataFrame:
    """(batch, operation_count, operation_kinds, operation_profiles): the operations of a batch in order, with their reports (kind, report)."""
    rows = F.array_sort(F.collect_list(F.struct(order, "kind", "report")))
    per = profiles.groupBy(batch).agg(rows.alias("rows"))
    return per.select(batch, F.size("rows").alias("operation_count"), F.transform("rows", lambda r: r["kind"]).alias("operation_kinds"), F.transform("rows", lambda r: r["report"]).alias("operation_profiles"))


#: The backend and parser that a language's report names, and what secondary metrics say.
BACKENDS = {"json": ("native-json", "standard-json"), "go": ("go-parser", "go/parser")}
SAID = {
    "merged": "canonical JSON has no trivia-preserving source fragments yet",
    "conflict": "unresolved conflict did not produce a merged source-fragment retention measurement",
    "measured": "source-fragment retention measured by exact source-line reuse",
}


def render_report(language: Column, strategy: Column, policy: Column, backend: Column, parser: Column) -> Column:
    """(strategy, backend, parser) of a rendering: the policy where no strategy is given, the language's backend where none is named."""
    named = F.coalesce(backend, F.lit("")) != ""

    def of_language(i: int) -> Column:
        out = F.lit("")
        for name, values in BACKENDS.items():
            out = F.when(language == name, values[i]).otherwise(out)
        return out

    chosen = F.coalesce(F.nullif(strategy, F.lit("")), policy)
    return F.struct(chosen.alias("strategy"), F.when(named, backend).otherwise(of_language(0)).alias("backend"), F.when(named, parser).otherwise(of_language(1)).alias("parser"))


def secondary_metrics(merged: Column, retention: Column) -> Column:
    """(retention, diagnostic) of a rendering: measured, or 1 for a merge and 0 for a conflict; none is weighted."""
    value = F.coalesce(retention, F.when(merged, 1.0).otherwise(0.0))
    said = F.when(retention.isNotNull(), SAID["measured"]).when(merged, SAID["merged"]).otherwise(SAID["conflict"])
    return F.struct(value.alias("retention"), F.lit(False).alias("weighted"), said.alias("diagnostic"))


def comment_conflict(category: Column, path: Column, message: Column) -> Column:
    return F.struct(F.lit("comment-conflict-1").alias("conflict_id"), category.alias("category"), F.when(path == "", "/").otherwise(path).alias("path"), message.alias("message"))


def non_empty_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"(?U)^\s*$"))


def crc32_of(text: Column) -> Column:
    """A checksum of up to eight hexadecimal digits, read from the front; 0 where there is none."""
    return F.coalesce(F.conv(F.nullif(F.regexp_extract(text, r"^\s*(?:0[xX])?([0-9A-Fa-f]{1,8})", 1), F.lit("")), 16, 10).cast("bigint"), F.lit(0))
