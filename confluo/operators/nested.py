"""Nested merges and their review: child operations of fences, resolution of child outputs, decisions, contexts, suites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import markdown


def child_operations(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, operation_id, address, family, dialect, path, start, end): fences of a known family, numbered within a text."""
    found = docs.select(key, F.posexplode(markdown.owners(F.col(text))).alias("place", "o")).select(key, "place", "o.*").filter("kind = 'code_fence'")
    nth = F.row_number().over(Window.partitionBy(key).orderBy("place")) - 1
    fences = found.withColumn("path", F.concat(F.lit("/code_fence/"), nth.cast("string"))).withColumn("family", L.fence_family(F.col("info"))).filter("info != '' AND family != ''")
    number = F.row_number().over(Window.partitionBy(key).orderBy("place")) - 1
    return fences.select(
        key, F.concat(F.lit("markdown-fence-"), number.cast("string")).alias("operation_id"), F.concat(F.lit("document[0] > fenced_code_block["), "path", F.lit("]")).alias("address"),
        "family", L.fence_dialect(F.col("info"), F.col("family")).alias("dialect"), "path", "start", "end",
    )


def resolve_outputs(operations: DataFrame, outputs: DataFrame, key: str, prefix: str, default_family: str) -> tuple[DataFrame, DataFrame]:
    """Apply-plan entries, and per text the first output whose address no operation has.

    ``outputs``: key, idx, address, output.  A text with such an output has no entries.
    """
    known = operations.select(key, "address", "operation_id", "family", "start", "end")
    both = outputs.join(known, [key, "address"], "left")
    missing = both.filter("operation_id IS NULL").groupBy(key).agg(F.min_by("address", "idx").alias("address"))
    failed = missing.select(key, F.concat(F.lit("missing delegated child surface "), "address", F.lit(".")).alias("message"))
    family = F.coalesce(F.nullif("family", F.lit("")), F.lit(default_family))
    entries = both.join(missing.select(key), key, "left_anti").select(key, F.concat(F.lit(f"{prefix}:"), F.col("idx").cast("string")).alias("request_id"), family.alias("family"), "operation_id", "address", "output", "start", "end")
    return entries, failed


def apply_outputs(docs: DataFrame, entries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, merged): the fences' bodies replaced by the outputs, the last fence first; one line end at the end.

    Entries of one text are few and short beside it; texts without any stay as they are.
    """
    per = entries.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "output")), asc=False).alias("parts"))
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")

    def replaced(acc: Column, p: Column) -> Column:
        body = F.when(p["output"] == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(p["output"], "\n$", ""), "\n"))
        return F.concat(F.slice(acc, 1, p["start"] + 1), body, F.slice(acc, p["end"] + 1, F.size(acc)))

    joined = docs.select(key, text).join(per, key, "left")
    done = F.aggregate(F.coalesce("parts", F.array().cast("array<struct<start:int,end:int,output:string>>")), lines, replaced)
    return joined.select(key, F.concat(F.regexp_replace(F.array_join(done, "\n"), "\n+$", ""), F.lit("\n")).alias("merged"))


APPLY = "apply_delegated_child_group"


def request_id(group: Column) -> Column:
    return F.concat(F.lit("projected_child_group:"), group)


def review_state(groups: DataFrame, decisions: DataFrame, family: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply plan, open requests and rejected decisions of delegated groups.

    ``groups``: group; ``decisions``: request_id, action, pos.  Only apply decisions
    count; of several for a group the first is the plan's; one without a group is rejected.
    """
    named = groups.select("group", request_id(F.col("group")).alias("request_id"))
    apply = decisions.filter(F.col("action") == APPLY)
    first = apply.groupBy("request_id").agg(F.min("pos").alias("pos"))
    plan = named.join(first, "request_id").select("request_id", "group", F.lit(family).alias("family"), "pos")
    message = F.concat(F.lit("delegated child group "), "group", F.lit(f" is ready to apply for {family}."))
    requests = named.join(first, "request_id", "left_anti").select("request_id", "group", message.alias("message"), F.lit(True).alias("blocking"), F.lit(APPLY).alias("default_action"))
    said = F.concat(F.lit("review decision "), "request_id", F.lit(" does not match any current delegated child review request."))
    rejected = apply.join(named.select("request_id"), "request_id", "left_anti").select("request_id", "pos", F.lit("replay_rejected").alias("category"), F.lit("request_not_found").alias("reason"), said.alias("message"))
    return plan, requests, rejected


def family_contexts(families: DataFrame, contexts: DataFrame, profiles: DataFrame, explicit: bool) -> DataFrame:
    """Per family where its context comes from (explicit, default or none), severity and category of what is said about it.

    With ``explicit`` a default profile does not stand in for a context.
    """
    rows = families.join(contexts.select("family", F.lit(True).alias("_c")), "family", "left").join(profiles.select("family", F.lit(True).alias("_p")), "family", "left")
    has, may = F.col("_c").isNotNull(), F.col("_p").isNotNull() & F.lit(not explicit)
    return rows.select(
        "family", F.when(has, "explicit").when(may, "default").otherwise("none").alias("context"), F.when(has, "").when(may, "warning").otherwise("error").alias("severity"),
        F.when(has, "").when(may, "assumed_default").otherwise("configuration_error").alias("category"),
    )


def reviewed_contexts(families: DataFrame, contexts: DataFrame, profiles: DataFrame, decisions: DataFrame) -> DataFrame:
    """As family_contexts with explicit contexts required, but a family's first usable decision may supply one.

    ``decisions``: family, pos, action, provided (family of the given context, or null).
    A decision that gives no context, or one of another family, ends the search with an
    error; families left without a context ask for review.
    """
    profile = profiles.select("family", F.lit(True).alias("_p")).distinct()
    accepts, gives = F.col("action") == "accept_default_context", F.col("action") == "provide_explicit_context"
    kind = F.when(accepts, "accepted").when(gives & F.col("provided").isNull(), "missing_required_payload").when(gives & (F.col("provided") != F.col("family")), "family_mismatch").when(gives, "provided")
    first = decisions.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy("family").agg(F.min_by("kind", "pos").alias("kind"))
    rows = families.join(contexts.select("family", F.lit(True).alias("_c")).distinct(), "family", "left").join(profile, "family", "left").join(first, "family", "left")
    has, may = F.col("_c").isNotNull(), F.col("_p").isNotNull()
    used = F.when(has, "explicit").when(~may, "none").when(F.col("kind") == "accepted", "default").when(F.col("kind") == "provided", "provided").otherwise("none")
    reason = F.when(has | ~may, "").otherwise(F.when(F.col("kind").isin("missing_required_payload", "family_mismatch"), F.col("kind")).otherwise(""))
    rows = rows.withColumns({"context": used, "reason": reason})
    asked = ~has & may & (F.col("context") == "none")
    return rows.select("family", "context", "reason", F.when(asked, F.concat(F.lit("family_context:"), "family")).otherwise("").alias("request_id"))


def replay_compatible(rows: DataFrame, a: str, b: str) -> Column:
    """Whether two replay contexts (surface, explicit, families in order) fit; a missing candidate does not."""
    x, y = F.col(a), F.col(b)
    return F.coalesce(y.isNotNull() & (x["surface"] == y["surface"]) & (x["explicit"] == y["explicit"]) & (x["families"] == y["families"]), F.lit(False))


def suite_plans(suites: DataFrame, entries: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Planned cases (suite, family, role, entry) and the message for each suite with missing roles.

    ``suites``: suite, family, roles (in order); ``entries``: family, role, pos, entry;
    ``contexts``: family, context.  A family's first entry of a role is its case;
    suites whose family has no context are left out.
    """
    first = entries.groupBy("family", "role").agg(F.min_by("entry", "pos").alias("entry"))
    usable = suites.join(contexts.filter("context != 'none'").select("family"), "family", "left_semi")
    cases = usable.select("suite", "family", F.posexplode("roles").alias("at", "role")).join(first, ["family", "role"], "left")
    gaps = F.transform(F.array_sort(F.collect_list(F.when(F.col("entry").isNull(), F.struct("at", "role")))), lambda x: x["role"])
    missing = cases.groupBy("suite").agg(F.array_join(gaps, ", ").alias("roles"), F.count_if(F.col("entry").isNull()).alias("n")).filter("n > 0")
    said = missing.select("suite", F.concat(F.lit("suite "), F.col("suite").cast("string"), F.lit(" declares missing roles: "), "roles", F.lit(".")).alias("message"))
    return cases.join(missing.select("suite"), "suite", "left_anti").select("suite", "family", "role", "entry"), said
