"""Explicit schemas of the stored tables, as ordered column to type maps."""

from __future__ import annotations


def ddl(columns: dict[str, str]) -> str:
    """The map as a schema string for readers and ``createDataFrame``."""
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


#: One pass/fail row per check and generation.
SCORES = {
    "run_id": "string", "model": "string", "item": "string", "dimension": "string",
    "sub": "string", "generation": "bigint", "correct": "boolean", "weight": "double",
}

#: The columns a stored per-model score file carries.
SCORE_FILE = {
    "item": "string", "dimension": "string", "sub": "string", "correct": "boolean", "weight": "double",
}

CASES = {
    "id": "string", "type": "string", "source": "string", "brief": "string", "prompt": "string",
    "features": "array<struct<id:string,label:string>>", "setup_prompt": "string",
    "turns": "array<struct<id:string,kind:string,content:string,expect:string>>",
}

KEYS = {
    "id": "string", "type": "string",
    "labels": "map<string,string>", "weights": "map<string,double>", "notes": "map<string,string>",
    "landmines": "array<struct<id:string,desc:string,aliases:array<string>>>",
    "false_alarms": "array<struct<id:string,desc:string,aliases:array<string>>>",
    "initial_expected": "array<string>",
    "turns": "array<struct<id:string,pass_if_in:array<string>,strict_hold:boolean,weight:double>>",
}

RESPONSES = {
    "run_id": "string", "model": "string", "item": "string", "generation": "bigint",
    "turn_id": "string", "text": "string",
}

USAGE = "struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint,cached_input_tokens:bigint>"

#: The columns of the log of taken-in result lines that say what counts.
RESULT_LOG = {
    "run_id": "string", "model": "string", "item": "string", "generation": "bigint", "turn_id": "string",
    "text": "string", "provider": "string", "served_model": "string", "run_mode": "string",
    "request_id": "string", "finish_reason": "string", "usage": USAGE, "cost_usd": "double", "error": "string",
    "outcome": "string", "written_at": "bigint", "file_time": "timestamp", "file_name": "string",
    "block": "bigint", "line": "bigint", "batch_id": "bigint",
}

TRACE = {
    "text": "string", "provider": "string", "model": "string", "run_mode": "string",
    "request_id": "string", "finish_reason": "string", "usage": USAGE, "cost_usd": "double",
    "structured_output": "string", "parse_ok": "boolean", "error": "string",
}

MODELS = {
    "name": "string", "provider": "string", "id": "string", "label": "string", "released": "string",
    "price_in": "double", "price_out": "double", "price_cached_in": "double", "batch_discount": "double",
    "batch_supported": "boolean", "structured_outputs": "boolean", "api": "string",
    "migration_target": "string", "price_verified": "string", "price_source": "string",
    "superseded_by": "string",
}

PAIRS = {
    "a": "string", "b": "string", "delta": "double", "lo": "double", "hi": "double",
    "holm_p": "double", "n_items": "bigint", "winner": "string",
}

MANIFEST = {
    "custom_id": "string", "run_id": "string", "stage": "int", "item": "string", "generation": "bigint",
    "turn_id": "string", "schema": "string", "provider": "string", "model": "string", "model_id": "string",
    "price_in": "double", "price_out": "double", "price_cached_in": "double", "batch_discount": "double",
}

#: The boolean verdicts of a judge record, in field order (fixed values).
AUDIT_FLAGS = (
    "key_valid",
    "ambiguous",
    "missing_acceptable_answer",
    "overstrict",
    "understrict",
    "fairness_risk",
    "source_mismatch",
)

#: The allowed recommended actions of a judge record (fixed values).
AUDIT_ACTIONS = ("keep", "review_key", "edit_key", "pull_item", "needs_human")

JUDGMENT = {
    "audit_id": "string",
    "judge_model": "string",
    **{flag: "boolean" for flag in AUDIT_FLAGS},
    "recommended_action": "string",
    "rationale": "string",
}
