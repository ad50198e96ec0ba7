"""Queries over trees of files made of pages: files grouped into projects, facts of each, and the files that recipes keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import projects
from ..sources.tables import table


def _files(spark, sf_dir):
    """A hundred pages are a workspace: manifest, readme, changelog, an inner project in every other, sources, and files of no project."""
    k = F.col("page_id")
    b, r, html = F.floor(k / 100).cast("string"), k % 100, F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    at = lambda *parts: F.concat(F.lit("w"), b, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    even = F.floor(k / 100) % 2 == 0
    path = (
        F.when(r == 0, at("/go.mod")).when(r == 1, at("/README.md")).when(r == 2, at("/CHANGELOG.md")).when(r == 3, F.when(even, at("/sub/go.mod")).otherwise(at("/sub/none.txt"))).when(r == 4, at("/internal/generated/packageinfo.go"))
        .when(r % 3 == 0, at("/x", r, ".go")).when(r % 3 == 1, at("/sub/deep/y", r, ".go")).otherwise(F.concat(F.lit("other/z"), k.cast("string"), F.lit(".txt")))
    )
    content = (
        F.when(r == 0, F.concat(F.lit("// "), html, F.lit("\nmodule github.com/org/w"), b, F.lit("/v2\n\ngo 1."), b, F.lit("\n")))
        .when(r == 1, F.concat(F.lit("# Old\n\n"), html, F.lit("\n")))
        .when(r == 2, F.concat(F.lit("# Changelog\n\n## [0.1.0]\n\n- "), html, F.lit("\n")))
        .when((r == 3) & even, F.when(F.floor(k / 100) % 4 == 2, "go 1.2\n").otherwise(F.concat(F.lit("module  local/sub"), b, F.lit("\r\n"))))
        .when(r == 4, F.concat(F.lit("package generated\n\n// "), html, F.lit("\n")))
        .otherwise(html)
    )
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), content.alias("content"))


def project_files(spark, sf_dir):
    """The project of each file, and its path in it."""
    return projects.with_projects(_files(spark, sf_dir)).select("page_id", "project", "relative")


def project_facts(spark, sf_dir):
    facts, _ = projects.project_facts(projects.with_projects(_files(spark, sf_dir)))
    return facts.select("project", "name", "slug", "source_url", "go_version", "ecosystem", "n_files", "n_sources", "n_bytes", F.col("readme").isNotNull().alias("has_readme"))


def project_faults(spark, sf_dir):
    """Manifests without a module."""
    return projects.project_facts(projects.with_projects(_files(spark, sf_dir)))[1]


def project_nesting(spark, sf_dir):
    return projects.nested_counts(projects.with_projects(_files(spark, sf_dir)))


def project_plans(spark, sf_dir):
    """What recipes write for each project."""
    facts, _ = projects.project_facts(projects.with_projects(_files(spark, sf_dir)))
    return projects.planned_files(facts, "tool").select("project", "relative", "changed", "content")


FILES_SQL = """
WITH f AS (SELECT page_id, page_id // 100 AS b, page_id % 100 AS r, (page_id // 100) % 2 = 0 AS even, md5(coalesce(html, '')) AS h FROM pages),
p AS (SELECT *, CASE WHEN even AND (r = 3 OR (r > 4 AND r % 3 = 1)) THEN 'w' || b || '/sub' ELSE 'w' || b END AS project,
  CASE WHEN r = 0 THEN 'go.mod' WHEN r = 1 THEN 'README.md' WHEN r = 2 THEN 'CHANGELOG.md' WHEN r = 3 THEN CASE WHEN even THEN 'go.mod' ELSE 'sub/none.txt' END WHEN r = 4 THEN 'internal/generated/packageinfo.go' WHEN r % 3 = 0 THEN 'x' || r || '.go'
    WHEN even THEN 'deep/y' || r || '.go' ELSE 'sub/deep/y' || r || '.go' END AS relative,
  CASE WHEN r = 0 THEN '// ' || h || chr(10) || 'module github.com/org/w' || b || '/v2' || chr(10) || chr(10) || 'go 1.' || b || chr(10) WHEN r = 1 THEN '# Old' || chr(10) || chr(10) || h || chr(10) WHEN r = 2 THEN '# Changelog' || chr(10) || chr(10) || '## [0.1.0]' || chr(10) || chr(10) || '- ' || h || chr(10)
    WHEN r = 3 AND even THEN CASE WHEN b % 4 = 2 THEN 'go 1.2' || chr(10) ELSE 'module  local/sub' || b || chr(13) || chr(10) END WHEN r = 4 THEN 'package generated' || chr(10) || chr(10) || '// ' || h || chr(10) ELSE h END AS content
  FROM f WHERE r < 5 OR r % 3 < 2),
g AS (SELECT project, min(b) AS b, project LIKE '%/sub' AS inside, count(*) AS n_files, count(*) FILTER (relative LIKE '%.go') AS n_sources, sum(strlen(content))::BIGINT AS n_bytes, max(content) FILTER (relative = 'README.md') AS readme, max(content) FILTER (relative = 'CHANGELOG.md') AS log, max(content) FILTER (relative LIKE 'internal/%') AS made FROM p GROUP BY project),
n AS (SELECT *, CASE WHEN inside THEN 'local/sub' || b ELSE 'github.com/org/w' || b || '/v2' END AS name, CASE WHEN inside THEN '' ELSE 'https://github.com/org/w' || b END AS url FROM g WHERE NOT (inside AND b % 4 = 2))
"""
QUERIES = {f.__name__: f for f in (project_files, project_facts, project_faults, project_nesting, project_plans)}
ORACLE_SQL = {
    "project_files": FILES_SQL + "SELECT page_id, project, relative FROM p",
    "project_facts": FILES_SQL
    + "SELECT project, name, CASE WHEN inside THEN 'sub' || b ELSE 'v2' END AS slug, url AS source_url, CASE WHEN inside THEN '' ELSE '1.' || b END AS go_version, 'gomod' AS ecosystem, n_files, n_sources, n_bytes, readme IS NOT NULL AS has_readme FROM n",
    "project_faults": FILES_SQL + "SELECT project, 'manifest has no module directive' AS message FROM g WHERE inside AND b % 4 = 2",
    "project_nesting": FILES_SQL + "SELECT 'w' || b AS project, count(*) AS inner FROM g WHERE inside GROUP BY b".replace("AS inner", 'AS "inner"'),
    "project_plans": FILES_SQL
    + """, w AS (SELECT *, '<!-- tool:metadata:start -->' || chr(10) || '| Field | Value |' || chr(10) || '|---|---|' || chr(10) || '| Package | ' || name || ' |' || chr(10) || CASE WHEN url <> '' THEN '| Homepage | ' || url || ' |' || chr(10) || '| Source | ' || url || ' |' || chr(10) ELSE '' END || '<!-- tool:metadata:end -->' AS block,
      '// <<tool:generated>> do not edit below this line' || chr(10) || 'const PackageName = "' || name || '"' || chr(10) || 'const PackageEcosystem = "gomod"' || chr(10) || '// <</tool:generated>>' || chr(10) AS generated,
      chr(10) || '## [Unreleased]' || chr(10) || chr(10) || '### Added' || chr(10) || chr(10) || '### Changed' || chr(10) || chr(10) || '### Fixed' || chr(10) AS todo FROM n)
    SELECT project, 'README.md' AS relative, true AS changed, CASE WHEN readme IS NULL THEN '# ' || name ELSE '# ' || name || rtrim(substr(readme, 6), chr(10)) END || chr(10) || chr(10) || block || chr(10) AS content FROM w
    UNION ALL SELECT project, 'CHANGELOG.md', true, '# Changelog' || chr(10) || todo || CASE WHEN log IS NULL THEN '' ELSE substr(log, 13) END FROM w
    UNION ALL SELECT project, 'internal/generated/packageinfo.go', true, CASE WHEN made IS NULL THEN generated ELSE rtrim(made, chr(10)) || chr(10) || generated END FROM w""",
}
