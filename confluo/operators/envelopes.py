"""Envelopes: payloads written under a kind and a version, and read back by whoever expects a kind; all kinds in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 1
#: The kinds of envelopes, and the member that holds the payload of each.
PAYLOADS = {
    "conformance_manifest_review_state": "state",
    "review_replay_bundle": "replay_bundle",
    "reviewed_nested_execution": "execution",
    "structured_edit_application": "application",
    "structured_edit_request": "request",
    "structured_edit_provider_execution_request": "execution_request",
    "structured_edit_provider_execution_plan": "execution_plan",
    "structured_edit_provider_execution_handoff": "execution_handoff",
    "structured_edit_provider_execution_invocation": "execution_invocation",
    "structured_edit_provider_batch_execution_invocation": "batch_execution_invocation",
    "structured_edit_provider_batch_execution_handoff": "batch_execution_handoff",
    "structured_edit_provider_batch_execution_plan": "batch_execution_plan",
    "structured_edit_provider_execution_application": "provider_execution_application",
    "structured_edit_provider_execution_dispatch": "provider_execution_dispatch",
    "structured_edit_provider_execution_outcome": "provider_execution_outcome",
    "structured_edit_provider_execution_run_result": "execution_run_result",
    "structured_edit_provider_batch_execution_run_result": "batch_execution_run_result",
    "structured_edit_provider_execution_receipt": "execution_receipt",
    "structured_edit_provider_batch_execution_receipt": "batch_execution_receipt",
    "structured_edit_provider_execution_receipt_replay_request": "receipt_replay_request",
    "structured_edit_provider_batch_execution_receipt_replay_request": "batch_receipt_replay_request",
    "structured_edit_provider_execution_receipt_replay_application": "receipt_replay_application",
    "structured_edit_provider_batch_execution_receipt_replay_application": "batch_receipt_replay_application",
    "structured_edit_provider_execution_receipt_replay_session": "receipt_replay_session",
    "structured_edit_provider_batch_execution_receipt_replay_session": "batch_receipt_replay_session",
    "structured_edit_provider_execution_receipt_replay_workflow": "receipt_replay_workflow",
    "structured_edit_provider_batch_execution_receipt_replay_workflow": "batch_receipt_replay_workflow",
    "structured_edit_provider_execution_receipt_replay_workflow_result": "receipt_replay_workflow_result",
    "structured_edit_provider_batch_execution_receipt_replay_workflow_result": "batch_receipt_replay_workflow_result",
    "structured_edit_provider_execution_receipt_replay_workflow_review_request": "receipt_replay_workflow_review_request",
    "structured_edit_provider_execution_receipt_replay_workflow_apply_request": "receipt_replay_workflow_apply_request",
    "structured_edit_provider_execution_receipt_replay_workflow_apply_session": "receipt_replay_workflow_apply_session",
    "structured_edit_provider_execution_receipt_replay_workflow_apply_result": "receipt_replay_workflow_apply_result",
    "structured_edit_provider_execution_receipt_replay_workflow_apply_decision": "receipt_replay_workflow_apply_decision",
    "structured_edit_provider_execution_receipt_replay_workflow_apply_decision_outcome": "receipt_replay_workflow_apply_decision_outcome",
    "structured_edit_provider_execution_receipt_replay_workflow_apply_decision_settlement": "receipt_replay_workflow_apply_decision_settlement",
    "structured_edit_provider_execution_receipt_replay_workflow_apply_decision_confirmation": "receipt_replay_workflow_apply_decision_confirmation",
    "structured_edit_provider_execution_receipt_replay_workflow_apply_decision_closure_report": "receipt_replay_workflow_apply_decision_closure_report",
    "structured_edit_provider_batch_execution_receipt_replay_workflow_apply_decision": "batch_receipt_replay_workflow_apply_decision",
    "structured_edit_provider_batch_execution_receipt_replay_workflow_apply_decision_outcome": "batch_receipt_replay_workflow_apply_decision_outcome",
    "structured_edit_provider_batch_execution_receipt_replay_workflow_apply_decision_settlement": "batch_receipt_replay_workflow_apply_decision_settlement",
    "structured_edit_provider_batch_execution_receipt_replay_workflow_apply_decision_confirmation": "batch_receipt_replay_workflow_apply_decision_confirmation",
    "structured_edit_provider_batch_execution_receipt_replay_workflow_apply_decision_closure_report": "batch_receipt_replay_workflow_apply_decision_closure_report",
    "structured_edit_provider_batch_execution_receipt_replay_workflow_apply_request": "batch_receipt_replay_workflow_apply_request",
    "structured_edit_provider_batch_execution_receipt_replay_workflow_apply_session": "batch_receipt_replay_workflow_apply_session",
    "structured_edit_provider_batch_execution_receipt_replay_workflow_apply_result": "batch_receipt_replay_workflow_apply_result",
    "structured_edit_provider_batch_execution_receipt_replay_workflow_review_request": "batch_receipt_replay_workflow_review_request",
    "structured_edit_provider_batch_execution_outcome": "batch_outcome",
    "structured_edit_provider_execution_provenance": "provenance",
    "structured_edit_provider_batch_execution_provenance": "batch_provenance",
    "structured_edit_provider_execution_replay_bundle": "replay_bundle",
    "structured_edit_provider_batch_execution_replay_bundle": "batch_replay_bundle",
    "structured_edit_provider_executor_profile": "executor_profile",
    "structured_edit_provider_executor_registry": "executor_registry",
    "structured_edit_provider_executor_selection_policy": "selection_policy",
    "structured_edit_provider_executor_resolution": "executor_resolution",
    "structured_edit_execution_report": "report",
    "structured_edit_provider_batch_execution_request": "batch_execution_request",
    "structured_edit_provider_batch_execution_dispatch": "batch_dispatch",
    "structured_edit_provider_batch_execution_report": "batch_report",
    "structured_edit_batch_report": "batch_report",
    "template_directory_session_status": "status",
    "template_directory_session_diagnostics": "diagnostics",
    "template_directory_session_outcome": "outcome",
    "template_directory_session_request": "request",
    "template_directory_session_runner_request": "request",
    "template_directory_session_runner_payload": "payload",
    "template_directory_session_entrypoint": "entrypoint",
    "template_directory_session_inspection": "inspection",
    "template_directory_session_command": "command",
    "template_directory_session_command_payload": "payload",
    "template_directory_session_invocation": "invocation",
}
#: Members that an envelope may have beside its payload.
BESIDE = {"structured_edit_request": ("profile_id", "minimum_profile_status", "promotion_policy_id")}


def member_of(kind: Column) -> Column:
    """The member that holds the payload of a kind; null for other kinds."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in PAYLOADS.items() for x in pair]), kind)


def exported(kind: Column, payload: Column, beside: dict[str, Column] | None = None, version: Column | int = VERSION) -> Column:
    """The envelope as JSON text, the payload (JSON text, null as it is) last; null for unknown kinds.

    ``beside`` has further members, texts, which are left out where they are null or empty.
    """
    more = [F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f'"{name}":'), _quoted(value), F.lit(","))).otherwise("") for name, value in (beside or {}).items()]
    number = (F.lit(version) if isinstance(version, int) else version).cast("string")
    return F.concat(F.lit('{"kind":"'), kind, F.lit('","version":'), number, F.lit(","), *more, F.lit('"'), member_of(kind), F.lit('":'), F.coalesce(payload, F.lit("null")), F.lit("}"))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def imported(rows: DataFrame, keys: list[str], wanted: str, text: str) -> DataFrame:
    """``keys``, ok, category, message and payload (JSON text) of the envelopes in ``text``, each opened as the kind in ``wanted``.

    The kind is looked at before the version.  A text that is no JSON has no kind, and an
    envelope without kind or version has an empty one and zero; a payload that is missing is null.
    """
    v = rows.select(*keys, F.col(wanted).alias("_wanted"), F.try_parse_json(F.col(text)).alias("_v"))
    read = v.withColumns({"_kind": F.coalesce(F.try_variant_get("_v", "$.kind", "string"), F.lit("")), "_version": F.coalesce(F.try_variant_get("_v", "$.version", "bigint"), F.lit(0))})
    category = F.when(F.col("_kind") != F.col("_wanted"), "kind_mismatch").when(F.col("_version") != VERSION, "unsupported_version")
    message = F.when(F.col("_kind") != F.col("_wanted"), F.concat(F.lit("expected "), "_wanted", F.lit(" envelope kind."))).when(
        F.col("_version") != VERSION, F.concat(F.lit("unsupported "), "_wanted", F.lit(" envelope version "), F.col("_version").cast("string"), F.lit("."))
    )
    payload = F.to_json(F.try_variant_get("_v", F.concat(F.lit("$."), member_of(F.col("_wanted"))), "variant"))
    return read.select(*keys, category.isNull().alias("ok"), category.alias("category"), message.alias("message"), F.when(category.isNull(), payload).alias("payload"))


def known_kinds(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, n): how many rows have each kind; kinds that none has are there with zero, and so is what is no kind."""
    every = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in PAYLOADS])).alias("kind"))
    counted = rows.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counted, "kind", "full_outer").select("kind", F.coalesce("n", F.lit(0)).alias("n"))
