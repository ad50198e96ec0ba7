"""Profiles of language backends against their own rules and a backend's inventory: one row for each thing that is wrong.

``profiles``: profile, roles, signatures (name, selector, extractor), groups, parents
(selector, child_group), atomics, attachments (selector, strategy); ``inventories``:
profile, inventory (exhaustive, partial, or empty), kinds, fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The roles of nodes, and what an extractor is or begins with.
ROLES = ("structural", "token", "trivia", "comment", "delimiter", "separator", "virtual", "error", "opaque")
EXTRACTOR = r"^(text$|field:|kind:|custom:)"


def _once(name: Column, before: Column, what: str) -> Column:
    """What is wrong with a name among those before it, an array: it is empty, or it is there already."""
    return F.when(name == "", f"{what} name is required").when(F.array_contains(before, name), F.concat(F.lit(f"duplicate {what} name "), name))


def own_violations() -> Column:
    """Array of messages about a profile by itself, in the order of its sections."""
    names = F.transform("signatures", lambda s: s["name"])
    signature = lambda s, i: F.array(
        _once(s["name"], F.slice(names, F.lit(1), i), "signature"), F.when(s["selector"] == "", "signature selector is required"), F.when(~s["extractor"].rlike(EXTRACTOR), F.concat(F.lit("unsupported signature extractor "), s["extractor"]))
    )
    parent = lambda p: F.array(
        F.when(p["selector"] == "", "commutative parent selector is required"),
        F.when(~F.array_contains("groups", p["child_group"]), F.concat(F.lit("commutative parent "), p["selector"], F.lit(" references unknown child group "), p["child_group"])),
    )
    parts = [
        F.transform(F.array_except("roles", F.array(*[F.lit(r) for r in ROLES])), lambda r: F.concat(F.lit("invalid node role "), r)),
        F.flatten(F.transform("signatures", signature)),
        F.transform("groups", lambda g, i: _once(g, F.slice("groups", F.lit(1), i), "child group")),
        F.flatten(F.transform("parents", parent)),
        F.transform("atomics", lambda a: F.when(a == "", "atomic node selector is required")),
        F.flatten(F.transform("attachments", lambda a: F.array(F.when(a["selector"] == "", "comment attachment selector is required"), F.when(a["strategy"] == "", "comment attachment strategy is required")))),
    ]
    return F.array_compact(F.concat(*parts))


def inventory_violations() -> Column:
    """Array of messages about selectors and fields that the inventory does not hold; an inventory without kinds or fields knows all."""
    missing = lambda known, x: (x != "") & (F.size(known) > 0) & ~F.array_contains(known, x)
    kinds, fields = F.col("kinds"), F.col("fields")
    selector = lambda what, x: F.when(missing(kinds, x), F.concat(F.lit(f"unknown {what} selector "), x))
    field = lambda s: F.regexp_extract(s["extractor"], "^field:(.*)$", 1)
    named = lambda s: F.when(s["extractor"].startswith("field:") & (F.size(fields) > 0) & ~F.array_contains(fields, field(s)), F.concat(F.lit("unknown signature field "), field(s)))
    parts = [
        F.transform("atomics", lambda a: selector("atomic node", a)),
        F.flatten(F.transform("signatures", lambda s: F.array(selector("signature", s["selector"]), named(s)))),
        F.transform("parents", lambda p: selector("commutative parent", p["selector"])),
        F.transform("attachments", lambda a: selector("comment attachment", a["selector"])),
    ]
    return F.array_compact(F.concat(*parts))


def validate_profiles(profiles: DataFrame, inventories: DataFrame) -> DataFrame:
    """(profile, rank, severity, message) in order; what an inventory lacks is an error if it is exhaustive, else a warning.

    A profile without inventory, or with an empty one, is only held against itself.
    """
    rows = profiles.join(inventories, "profile", "left")
    known = F.coalesce(F.col("inventory"), F.lit("")) != ""
    second = F.when(F.col("inventory") == "exhaustive", "error").otherwise("warning")
    said = lambda messages, severity: F.transform(messages, lambda m: F.struct(severity.alias("severity"), m.alias("message")))
    both = F.concat(said(own_violations(), F.lit("error")), F.when(known, said(inventory_violations(), second)).otherwise(F.array().cast("array<struct<severity:string,message:string>>")))
    return rows.select("profile", F.posexplode(both).alias("rank", "d")).select("profile", "rank", "d.severity", "d.message")


def resolve_policy(profiles: DataFrame, policies: DataFrame, scopes: DataFrame) -> DataFrame:
    """(profile, policy_scope, and the gates of ``policies``): each gate from the most specific scope that states it.

    ``profiles``: profile, family; ``policies``: scope, and gate columns, null where a
    scope inherits; ``scopes``: kind (profile, family, or all) and rank, the least first.
    A scope is named by the profile, the family, or ``*``.
    """
    gates = [c for c in policies.columns if c != "scope"]
    named = profiles.select("profile", F.explode(F.array(F.struct(F.lit("profile").alias("kind"), F.col("profile").cast("string").alias("scope")), F.struct(F.lit("family").alias("kind"), F.col("family").alias("scope")), F.struct(F.lit("all").alias("kind"), F.lit("*").alias("scope")))).alias("s")).select("profile", "s.*")
    rows = named.join(scopes, "kind").join(policies, "scope")
    first = [F.min_by(F.col(g), F.when(F.col(g).isNotNull(), F.col("rank"))).alias(g) for g in gates]
    return rows.groupBy("profile").agg(F.min_by("kind", "rank").alias("policy_scope"), *first)


def unknown_profiles(profiles: DataFrame, resolved: DataFrame) -> DataFrame:
    """Profiles that no scope of the policy covers."""
    return profiles.join(resolved.select("profile"), "profile", "left_anti").select("profile")

