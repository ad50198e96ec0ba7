"""Template planning: one row a template file, widened stage by stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: How a target path is classified as (file type, family, dialect); the first rule that holds.
EXACT_PATHS = {".git-hooks/commit-msg": ("ruby", "ruby", "ruby"), ".git-hooks/prepare-commit-msg": ("bash", "bash", "bash")}
BASENAMES = {
    "Gemfile": ("gemfile", "ruby", "ruby"),
    "Appraisal.root.gemfile": ("gemfile", "ruby", "ruby"),
    "Appraisals": ("appraisals", "ruby", "ruby"),
    "Rakefile": ("ruby", "ruby", "ruby"),
    ".simplecov": ("ruby", "ruby", "ruby"),
    ".envrc": ("bash", "bash", "bash"),
    ".tool-versions": ("tool_versions", "text", "tool_versions"),
    "CITATION.cff": ("yaml", "yaml", "yaml"),
}
SUFFIXES = [
    (r"\.gemspec$", ("gemspec", "ruby", "ruby")),
    (r"\.gemfile$", ("gemfile", "ruby", "ruby")),
    (r"\.(rb|rake)$", ("ruby", "ruby", "ruby")),
    (r"\.ya?ml$", ("yaml", "yaml", "yaml")),
    (r"\.(md|markdown)$", ("markdown", "markdown", "markdown")),
    (r"\.(sh|bash)$", ("bash", "bash", "bash")),
    (r"(^|/)\.env(\.[^/]*)?$", ("dotenv", "dotenv", "dotenv")),
    (r"\.jsonc$", ("json", "json", "jsonc")),
    (r"\.json$", ("json", "json", "json")),
    (r"\.toml$", ("toml", "toml", "toml")),
    (r"\.rbs$", ("rbs", "rbs", "rbs")),
]
#: The logical path that is omitted, the one that is renamed, and the one named after the project.
OMITTED, RENAMED, PROJECT_SPEC = ".kettle-jem.yml", (".env.local", ".env.local.example"), "gem.gemspec"


def logical_path(path: Column) -> Column:
    """The source path without its template ending."""
    return F.when(path.endswith(".no-osc.example"), F.regexp_replace(path, r"\.no-osc\.example$", "")).otherwise(F.regexp_replace(path, r"\.example$", ""))


def classified(path: Column) -> Column:
    """Struct (file_type, family, dialect) of a target path."""
    clean = F.regexp_replace(path, r"^\./", "")
    base, low = F.regexp_extract(clean, "([^/]*)$", 1), F.lower(clean)
    rules = [(clean == p, k) for p, k in EXACT_PATHS.items()] + [(base == b, k) for b, k in BASENAMES.items()] + [(low.rlike(s), k) for s, k in SUFFIXES]
    kind = lambda k: F.struct(*[F.lit(v).alias(n) for v, n in zip(k, ("file_type", "family", "dialect"), strict=True)])
    out = None
    for test, k in rules:
        out = F.when(test, kind(k)) if out is None else out.when(test, kind(k))
    return out.otherwise(kind(("text", "text", "text")))


def destination_path(path: Column, project: str | None) -> Column:
    """Where a logical path goes; null omits it."""
    name = (project or "").strip()
    spec = F.lit(f"{name}.gemspec") if name else path
    return F.when(path == OMITTED, F.lit(None)).when(path == RENAMED[0], RENAMED[1]).when(path == PROJECT_SPEC, spec).otherwise(path)


def plan(templates: DataFrame, overrides: DataFrame, project: str | None, default: str = "merge") -> DataFrame:
    """+ logical_path, destination_path, file_type, family, dialect, strategy, action.  ``overrides``: path, strategy; its first row by pos counts."""
    first = overrides.groupBy(F.regexp_replace("path", r"^\./", "").alias("_path")).agg(F.min_by("strategy", "pos").alias("_strategy"))
    rows = templates.withColumn("logical_path", logical_path(F.col("template_source_path")))
    rows = rows.withColumn("destination_path", destination_path(F.col("logical_path"), project))
    target = F.coalesce("destination_path", "logical_path")
    rows = rows.withColumn("_kind", classified(target)).select("*", "_kind.*").drop("_kind").withColumn("_path", F.regexp_replace(target, r"^\./", ""))
    rows = rows.join(first, "_path", "left").withColumn("strategy", F.coalesce("_strategy", F.lit(default))).drop("_path", "_strategy")
    return rows.withColumn("action", F.when(F.col("destination_path").isNull(), "omit").otherwise(F.col("strategy")))


def with_state(rows: DataFrame, destination: DataFrame) -> DataFrame:
    """+ destination_content, destination_exists and write_action (omit, keep, update or create)."""
    known = destination.select(F.col("path").alias("destination_path"), F.col("content").alias("destination_content"), F.lit(True).alias("_there"))
    rows = rows.join(known, "destination_path", "left").withColumn("destination_exists", F.coalesce("_there", F.lit(False))).drop("_there")
    keep = (F.col("strategy") == "keep_destination")
    return rows.withColumn("write_action", F.when(F.col("destination_path").isNull(), "omit").when(keep, "keep").when(F.col("destination_exists"), "update").otherwise("create"))


def with_tokens(rows: DataFrame, replacements: dict[str, str], content: str = "template_content") -> DataFrame:
    """+ token_keys, unresolved and blocked: a target whose strategy resolves tokens and that has unresolved ones."""
    required = F.col("destination_path").isNotNull() & ~F.col("strategy").isin("keep_destination", "raw_copy")
    rows = rows.withColumns({"token_keys": T.token_keys(F.col(content)), "unresolved": T.unresolved_keys(F.col(content), replacements), "resolution_required": required})
    return rows.withColumn("blocked", F.col("resolution_required") & (F.size("unresolved") > 0))


def prepared(rows: DataFrame, replacements: dict[str, str], content: str = "template_content") -> DataFrame:
    """+ preparation (blocked, resolve_tokens or pass_through) and prepared_content, null when blocked."""
    resolve = F.col("resolution_required") & (F.size("token_keys") > 0)
    preparation = F.when(F.col("blocked"), "blocked").when(resolve, "resolve_tokens").otherwise("pass_through")
    rows = rows.withColumn("preparation", preparation)
    return rows.withColumn("prepared_content", F.when(F.col("preparation") == "resolve_tokens", T.resolve_tokens(F.col(content), replacements)).when(F.col("preparation") == "pass_through", F.col(content)))


def executable(rows: DataFrame) -> DataFrame:
    """+ execution (the first rule that holds) and ready."""
    execution = (
        F.when(F.col("blocked"), "blocked")
        .when(F.col("destination_path").isNull(), "omit")
        .when(F.col("write_action") == "keep", "keep")
        .when(F.col("strategy") == "raw_copy", "raw_copy")
        .when(F.col("strategy") == "accept_template", "write_prepared")
        .otherwise("merge_prepared")
    )
    return rows.withColumn("execution", execution).withColumn("ready", ~F.col("execution").isin("blocked", "omit", "keep"))


def pending(rows: DataFrame) -> DataFrame:
    """Rows that keep a tree from having converged: blocked, or ready with other content than prepared."""
    return rows.filter(F.col("blocked") | (F.col("ready") & ~F.col("destination_content").eqNullSafe(F.col("prepared_content"))))


def run_status(rows: DataFrame) -> DataFrame:
    """+ status of an applied row: omitted, blocked, kept, updated, else created."""
    same = F.col("destination_content").eqNullSafe(F.col("prepared_content"))
    status = F.when(F.col("execution") == "omit", "omitted").when(F.col("execution") == "blocked", "blocked").when((F.col("execution") == "keep") | same, "kept").when(F.col("destination_exists"), "updated").otherwise("created")
    return rows.withColumn("status", status)
