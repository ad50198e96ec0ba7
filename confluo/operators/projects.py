"""Facts of many projects from one scan of their files: each file goes to its nearest manifest above it, each kind of file is read once, a project is a row.

``files``: path (slashes, relative) and content.  A manifest makes its folder a project;
folders within may be projects too, and a file belongs to the innermost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.managed import changelog, markdown_block, repository_url, text_block, titled

#: The manifest, its two directives, and the ecosystem of its projects.
MANIFEST, MODULE, VERSION, ECOSYSTEM = "go.mod", r"(?m)^\s*module\s+(\S+)\s*$", r"(?m)^\s*go\s+(\S+)\s*$", "gomod"
#: Files that recipes keep up to date.
README, CHANGELOG, GENERATED = "README.md", "CHANGELOG.md", "internal/generated/packageinfo.go"


def folder_of(path: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def folders_above(path: Column) -> Column:
    """All folders that hold a path, the innermost first, the empty one last."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.size(steps) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


def with_projects(files: DataFrame, manifest: str = MANIFEST) -> DataFrame:
    """``files`` with ``project``, the folder of the innermost manifest above, and ``relative``, the path from there; files of no project are left out.

    A join on each folder above a path; only paths take part, contents are joined last.
    """
    name = F.element_at(F.split("path", "/"), -1)
    roots = files.filter(name == manifest).select(folder_of(F.col("path")).alias("project")).distinct()
    paths = files.select("path").distinct()
    above = paths.select("path", F.posexplode(folders_above(F.col("path"))).alias("up", "project")).join(roots, "project")
    inner = above.groupBy("path").agg(F.min_by("project", "up").alias("project"))
    relative = F.when(F.col("project") == "", F.col("path")).otherwise(F.expr("substring(path, length(project) + 2)"))
    return files.join(inner, "path").withColumn("relative", relative)


def project_facts(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row a project: name, slug, source_url, go_version, what files it has; and projects whose manifest says no module.

    A project without readme, changelog or generated file has null there.
    """
    name = F.element_at(F.split("relative", "/"), -1)
    content = F.coalesce("content", F.lit(""))
    own = lambda relative: F.max(F.when(F.col("relative") == relative, content))
    per = placed.groupBy("project").agg(
        own(MANIFEST).alias("manifest"), own(README).alias("readme"), own(CHANGELOG).alias("changelog"), own(GENERATED).alias("generated"), F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.endswith(name, F.lit(".go"))).alias("n_sources"), F.sum(F.octet_length(content)).cast("long").alias("n_bytes"),
    )
    module = F.regexp_extract("manifest", MODULE, 1)
    read = per.withColumns({"name": module, "go_version": F.regexp_extract("manifest", VERSION, 1)})
    facts = read.filter("name <> ''").withColumns({"slug": F.element_at(F.split("name", "/"), -1), "source_url": repository_url(F.col("name")), "ecosystem": F.lit(ECOSYSTEM)})
    return facts.drop("manifest"), read.filter("name = ''").select("project", F.lit("manifest has no module directive").alias("message"))


def nested_counts(placed: DataFrame) -> DataFrame:
    """(project, inner): how many projects lie right within each project, those without any left out."""
    projects = placed.select("project").distinct()
    above = projects.filter("project <> ''").select("project", F.posexplode(folders_above(F.col("project"))).alias("up", "outer")).join(projects.select(F.col("project").alias("outer")), "outer")
    nearest = above.withColumn("nth", F.row_number().over(Window.partitionBy("project").orderBy("up"))).filter("nth = 1")
    return nearest.groupBy(F.col("outer").alias("project")).agg(F.count(F.lit(1)).alias("inner"))


def planned_files(facts: DataFrame, tool: str = "confluo") -> DataFrame:
    """(project, relative, changed, content) of the files that recipes keep: readme with metadata, changelog, generated block."""
    row = lambda label, value: F.when(value != "", F.concat(F.lit(f"| {label} | "), value, F.lit(" |\n"))).otherwise("")
    name, url = F.col("name"), F.col("source_url")
    table = F.concat(F.lit("| Field | Value |\n|---|---|\n"), row("Package", name), row("Homepage", url), row("Source", url))
    block = F.concat(F.lit(f"<!-- {tool}:metadata:start -->\n"), table, F.lit(f"<!-- {tool}:metadata:end -->"))
    readme = markdown_block(titled(F.coalesce("readme", F.lit("")), name), f"{tool}:metadata", block)
    opens, closes = f"// <<{tool}:generated>> do not edit below this line", f"// <</{tool}:generated>>"
    constants = F.concat(F.lit(f'{opens}\nconst PackageName = "'), name, F.lit(f'"\nconst PackageEcosystem = "{ECOSYSTEM}"\n{closes}\n'))
    made = {README: ("readme", readme), CHANGELOG: ("changelog", changelog(F.coalesce("changelog", F.lit("")))), GENERATED: ("generated", text_block(F.coalesce("generated", F.lit("")), opens, closes, constants))}
    rows = F.array(*[F.struct(F.lit(path).alias("relative"), (~new.eqNullSafe(F.coalesce(old, F.lit("")))).alias("changed"), new.alias("content")) for path, (old, new) in made.items()])
    return facts.select("project", F.explode(rows).alias("f")).select("project", "f.*")
