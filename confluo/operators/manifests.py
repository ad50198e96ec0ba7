"""Review of conformance manifests with replayed decisions, for all manifests at once.

Tables, each with ``manifest``: suites (pos, suite, family, roles), entries (family, role,
pos, entry), contexts and profiles (family), options (explicit: defaults need a
decision), replays (surface, families, explicit: the state in which decisions were
made) and decisions (pos, request_id, action, provided: the family of a given context).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt, settled

#: The surface of manifests, the actions of decisions, the reasons and categories of what is said.
SURFACE = "conformance_manifest"
ACCEPT, PROVIDE = "accept_default_context", "provide_explicit_context"
OUTCOMES = ("passed", "failed", "skipped")


def request_id(family: Column) -> Column:
    return F.concat(F.lit("family_context:"), family)


def families_of(suites: DataFrame) -> DataFrame:
    """(manifest, family, place): families by the first suite that names them."""
    return suites.groupBy("manifest", "family").agg(F.min("pos").alias("place"))


def replay_contexts(suites: DataFrame, options: DataFrame) -> DataFrame:
    """(manifest, surface, families, explicit): the state in which a review takes place."""
    per = families_of(suites).groupBy("manifest").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "family"))), lambda x: x["family"]).alias("families"))
    return options.join(dealt(per), "manifest", "left").select("manifest", F.lit(SURFACE).alias("surface"), F.coalesce("families", F.array().cast("array<string>")).alias("families"), "explicit")


def open_requests(suites: DataFrame, contexts: DataFrame, profiles: DataFrame, options: DataFrame) -> DataFrame:
    """(manifest, family, place, request_id): families that have a default but no context, where contexts must be explicit."""
    asked = families_of(suites).join(dealt(options.filter("explicit").select("manifest")), "manifest", "left_semi")
    return asked.join(dealt(contexts.select("manifest", "family")), ["manifest", "family"], "left_anti").join(dealt(profiles.select("manifest", "family")), ["manifest", "family"], "left_semi").withColumn("request_id", request_id(F.col("family")))


def usable(decisions: DataFrame, requests: DataFrame) -> DataFrame:
    """Of each request the first decision that settles it or is wrong: (manifest, family, pos, action, kind).

    ``kind`` is accepted or provided, or what is wrong: missing_required_payload, family_mismatch.
    """
    both = decisions.join(dealt(requests.select("manifest", "request_id", "family")), ["manifest", "request_id"])
    gives = F.col("action") == PROVIDE
    kind = (
        F.when(F.col("action") == ACCEPT, "accepted").when(gives & F.col("provided").isNull(), "missing_required_payload").when(gives & (F.col("provided") != F.col("family")), "family_mismatch").when(gives, "provided")
    )
    read = both.withColumn("kind", kind).filter("kind IS NOT NULL")
    best = F.min(F.struct("pos", "action", "kind", "provided")).alias("d")
    return read.groupBy("manifest", "family").agg(best).select("manifest", "family", "d.*")


def judged_decisions(suites, contexts, profiles, options, replays, decisions) -> tuple[DataFrame, DataFrame]:
    """Decisions that count, and what is said about the others (manifest, pos, request_id, reason).

    Without a replayed state, or with one that does not fit, no decision of a manifest
    counts, and that is said once (no pos).  A decision without a request is rejected alone.
    """
    now = replay_contexts(suites, options)
    then = replays.select("manifest", F.struct("surface", "families", "explicit").alias("then"))
    state = now.join(dealt(then), "manifest", "left")
    fits = F.col("then").isNotNull() & (F.col("then.surface") == F.col("surface")) & (F.col("then.explicit") == F.col("explicit")) & (F.col("then.families") == F.col("families"))
    state = state.select("manifest", F.when(F.col("then").isNull(), "no_replay_context").when(~F.coalesce(fits, F.lit(False)), "replay_context_mismatch").alias("wrong"))
    asked = open_requests(suites, contexts, profiles, options).select("manifest", "request_id", F.lit(True).alias("known"))
    rows = decisions.join(dealt(state), "manifest").join(dealt(asked), ["manifest", "request_id"], "left")
    good = rows.filter("wrong IS NULL AND known").select(*decisions.columns)
    whole = rows.filter("wrong IS NOT NULL").select("manifest", F.lit(None).cast("bigint").alias("pos"), F.lit("").alias("request_id"), F.col("wrong").alias("reason")).distinct()
    alone = rows.filter("wrong IS NULL AND known IS NULL").select("manifest", F.col("pos").cast("bigint").alias("pos"), "request_id", F.lit("request_not_found").alias("reason"))
    return good, whole.unionByName(alone)


def review(suites, entries, contexts, profiles, options, replays, decisions, outcomes) -> dict[str, DataFrame]:
    """One review: requests, applied decisions, diagnostics, suite reports and the summary of each manifest.

    ``outcomes`` (manifest, family, role, outcome) stands for the runs of cases; a case
    without one is skipped.
    """
    good, rejected = judged_decisions(suites, contexts, profiles, options, replays, decisions)
    asked = open_requests(suites, contexts, profiles, options)
    first = usable(good, asked).withColumnRenamed("kind", "decided")
    settles = F.col("decided").isin("accepted", "provided")
    base = families_of(suites).join(dealt(options.select("manifest", "explicit")), "manifest")
    for name, df in (("_context", contexts), ("_profile", profiles)):
        base = base.join(dealt(df.select("manifest", "family").distinct().withColumn(name, F.lit(True))), ["manifest", "family"], "left")
    resolved = base.join(dealt(first.drop("provided")), ["manifest", "family"], "left")
    has, may = F.col("_context").isNotNull(), F.col("_profile").isNotNull()
    context = F.when(has, "explicit").when(may & (~F.col("explicit") | F.coalesce(F.col("decided") == "accepted", F.lit(False))), "default").when(may & F.coalesce(F.col("decided") == "provided", F.lit(False)), "provided").otherwise("none")
    resolved = resolved.withColumn("context", context)
    none = F.col("context") == "none"
    category = F.when(F.col("context") == "default", "assumed_default").when(none, "configuration_error")
    reason = F.when(F.col("context") == "default", "").when(~may, "no_default").when(F.coalesce(~settles, F.lit(False)), F.col("decided")).otherwise("missing_explicit_context")
    said = resolved.withColumn("category", category).filter("category IS NOT NULL").select("manifest", F.lit("family").alias("about"), F.col("family").alias("subject"), "category", reason.alias("reason"))
    requests = resolved.filter(none & may & F.col("explicit")).select("manifest", "family", request_id(F.col("family")).alias("request_id"))
    applied = resolved.filter(~has & settles).select("manifest", "pos", request_id(F.col("family")).alias("request_id"), "action")
    plan = suites.join(dealt(resolved.filter(~none).select("manifest", "family", "context")), ["manifest", "family"])
    cases = plan.select("manifest", "suite", "family", F.posexplode("roles").alias("at", "role"))
    found = entries.groupBy("manifest", "family", "role").agg(F.min_by("entry", "pos").alias("entry"))
    ran = outcomes.select("manifest", "family", "role", "outcome")
    cases = cases.join(dealt(found), ["manifest", "family", "role"], "left").join(dealt(ran), ["manifest", "family", "role"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("skipped")))
    gaps = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("entry").isNull(), F.struct("at", "role")))), lambda x: x["role"]), ", ")
    per = cases.groupBy("manifest", "suite").agg(gaps.alias("missing"), F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    reports = per.filter("missing = ''").drop("missing")
    holes = per.filter("missing <> ''").select("manifest", F.lit("suite").alias("about"), F.col("suite").cast("string").alias("subject"), F.lit("configuration_error").alias("category"), F.concat(F.lit("missing roles: "), "missing").alias("reason"))
    replayed = rejected.select("manifest", F.lit("decision").alias("about"), F.col("request_id").alias("subject"), F.lit("replay_rejected").alias("category"), "reason")
    summary = options.select("manifest").join(dealt(reports.groupBy("manifest").agg(F.count(F.lit(1)).alias("suites"), *[F.sum(c).alias(c) for c in ("total", *OUTCOMES)])), "manifest", "left").fillna(0)
    return {"requests": requests, "applied": applied, "diagnostics": reduce(DataFrame.unionByName, [replayed, said, holes]), "reports": reports, "summary": summary}


def state_hash(requests: DataFrame) -> DataFrame:
    """(manifest, state): the open requests of a manifest in order, digested; a manifest without any has no row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "request_id"))), lambda x: x["request_id"])
    return requests.groupBy("manifest").agg(F.md5(F.array_join(ordered, ",").cast("binary")).alias("state"))


def replay_to_fixed_point(requests: DataFrame, decisions: DataFrame, rounds: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Open requests, applied decisions (with their round) and rejected ones, after replaying until nothing changes.

    ``requests`` as of open_requests; ``decisions`` also have ``state``, the digest of the
    open requests they were made for.  In a round the decisions of the present state that
    settle a request are applied; the requests left make the next state.  What never met
    its state is stale; what met it without a request, or was wrong or second there, says so.
    As many rounds as the longest chain of states; a manifest at rest costs nothing more.
    """
    left = settled(requests.select("manifest", "family", "place", "request_id"), "requests")
    waiting, used, met = settled(decisions, "decisions"), [], []
    for n in range(rounds):
        here = waiting.join(dealt(state_hash(left)), ["manifest", "state"], "left_semi")
        first = usable(here, left)
        done = settled(first.filter("kind IN ('accepted', 'provided')").withColumns({"round": F.lit(n), "request_id": request_id(F.col("family"))}), "applied")
        met.append(settled(here.join(dealt(left.select("manifest", "request_id", F.lit(True).alias("known"))), ["manifest", "request_id"], "left").select("manifest", "pos", "known"), "met"))
        if done.isEmpty():
            break
        used.append(done)
        # of a manifest without a settled request nothing can change any more
        left = settled(left.join(dealt(done.select("manifest", "request_id")), ["manifest", "request_id"], "left_anti"), "requests")
        waiting = settled(waiting.join(dealt(done.select("manifest").distinct()), "manifest", "left_semi").join(dealt(done.select("manifest", "pos")), ["manifest", "pos"], "left_anti"), "decisions")
    columns = "manifest", "pos", "request_id", "action", "round"
    applied = reduce(DataFrame.unionByName, used).select(*columns) if used else decisions.select("manifest", "pos", "request_id", "action", F.lit(0).alias("round")).limit(0)
    seen = reduce(DataFrame.unionByName, met).groupBy("manifest", "pos").agg(F.max("known").alias("known"), F.lit(True).alias("met"))
    rest = decisions.join(dealt(applied.select("manifest", "pos")), ["manifest", "pos"], "left_anti").join(dealt(seen), ["manifest", "pos"], "left")
    reason = F.when(F.col("met").isNull(), "stale_context").when(F.col("known").isNull(), "request_not_found").otherwise("not_settled")
    return left, applied, rest.select("manifest", "pos", "request_id", reason.alias("reason"))
