"""Explicit schemas, type names and default limits of the graph data model."""

from __future__ import annotations

NODES = (
    "id string, type string, name string, path string, lang string, metadata string, line int, "
    "content_hash string, ast_hash string, created_at timestamp, updated_at timestamp"
)
EDGES = "id string, source string, target string, type string, metadata string, weight double"
FILE_STATE = "path string, lang string, content_hash string, ast_hash string, merkle_hash string, dirty boolean, last_parsed timestamp, detail_level string"
FLAKE_INPUTS = "name string, url string, rev string, nar_hash string, type string, inputs map<string,array<string>>"
PACKAGES = "attribute string, name string, version string, store_path string, meta map<string,string>, used_by array<string>, first_seen timestamp, last_updated timestamp"
OPTION_VALUES = "key string, expr string, value_json string, status string, error string, computed_at timestamp, source_rev string"
CALLS = "session string, ts bigint, tool string, args map<string,string>, status string, latency_ms double, out_chars bigint, error string"

SCHEMA_VERSION = 1

# Edge types that count as dependencies.
DEPENDENCY_TYPES = ["imports", "requires", "python_imports", "references", "uses_package", "sets", "configures", "generates"]

# Edge types whose targets several files may own together.
SHARED_TYPES = ["uses_package", "references", "sources", "binds_key"]

# Budgets of the verbs and their defaults.
MAX_OBSERVE_DEPTH = 20
MAX_HOP_DEPTH = 10
MAX_HOP_VOLUME = 100
MAX_CLOSURE_DEPTH = 10
OBSERVE_LIMIT = 20
KEY_SYMBOLS = 20
EVIDENCE_LIMIT = 100
HEALTH_SAMPLES = 10
