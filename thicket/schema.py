"""Row types of the data model, as DDL, and the label of edges that come from nearness alone."""

from __future__ import annotations

PROXIMITY = "contextual proximity"
DEFAULT_TENANT = "default"

DOCUMENT = "source string, text string"
CHUNK = "chunk_id string, source string, chunk_index int, text string"
TOKEN_CHUNK = "chunk_index int, text string, estimated_tokens int, parent_id string"
RELATION = "node_1 string, node_1_type string, node_2 string, node_2_type string, edge string"
MANUAL = "node1 string, node2 string, relation string, type1 string, type2 string"
NODE = "id string, label string, community bigint, degree bigint, entity_type string, tenant string"
EDGE = "source string, target string, relation string, weight double, tenant string"
EDGE_CHUNK = "source string, target string, chunk_id string, tenant string"
LEDGER = "source string, hash string, chunks_processed bigint, relations_count bigint, ts bigint"
LEDGER_COLUMNS = ["source", "hash", "chunks_processed", "relations_count", "ts"]
