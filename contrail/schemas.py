"""Table schemas and closed value lists. The value lists are fixed values."""

from __future__ import annotations

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
PATH_ITEM_FIELDS = ("summary", "description", "servers", "parameters", "$ref")
STATES = ("EXACT", "PARTIAL", "UNRESOLVED")
CATEGORIES = (
    "endpoint_removed", "http_method_removed", "required_parameter_added", "security_requirement_changed", "request_property_removed",
    "response_property_removed", "request_type_changed", "response_type_changed", "enum_restricted", "nullable_removed",
)
STRATEGIES = ("NO_AI", "DETERMINISTIC", "SMALL", "MEDIUM", "STRONG")
PARTITIONS = ("TRAIN", "VALIDATION", "TEST")
EXCLUDED_DIRS = (".git", ".hg", ".venv", "venv", "node_modules", "__pycache__", "build", "dist", ".tox")

SPEC_DOCS = "api_id string, version_no int, format string, text string"
OPERATIONS = "api_id string, version_no int, path string, method string, op_id string, security array<array<struct<scheme:string,scopes:array<string>>>>"
PARAMETERS = "api_id string, version_no int, path string, method string, name string, location string, required boolean, level string, ordinal string"
NODES = (
    "api_id string, version_no int, path string, method string, context string, code string, media_type string, node_path string, parent_path string, "
    "types array<string>, nullable boolean, enum_json array<string>, required boolean, support_status string, ref string"
)
SOURCE_FILES = "repo_id string, path string, content string"
SYMBOLS = "symbol_id string, repo_id string, file string, qualified_name string, kind string, line int, end_line int"
CALL_SITES = (
    "call_id string, repo_id string, file string, symbol_id string, symbol string, line int, library string, invocation_kind string, method string, host string, path string, "
    "url_state string, request_fields array<string>, request_state string, query_parameters array<string>, headers array<string>, response_fields array<string>, response_state string"
)
CALL_EDGES = "edge_id string, repo_id string, caller_id string, callee_id string, line int, column int, state string"
CHANGES = "change_id string, category string, path string, method string, location string, severity string, classification string, certainty string"
FEEDBACK = "record_id string, ts timestamp, patch_id string, strategy string, model_id string, validation_status string, user_action string"
ATTEMPTS = "patch_id string, attempt_number int, status string, strategy string, budget int, ts timestamp"
AUDIT_LOG = "log_id string, event_index int, event_type string, previous_event_hash string, artifact_digests map<string,string>, configuration_digest string, event_hash string"
