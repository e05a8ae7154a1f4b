"""Schemas of the engine's tables and its fixed enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------
BLOCK_TYPES = {1: "FILE", 2: "SCAN", 3: "DATABASE", 4: "AUDIO", 5: "VIDEO", 6: "IMAGE", 7: "MEMORY"}
#: Types that filters don't name.
METADATA_BLOCK, QUESTION_BLOCK, SUMMARY_BLOCK = 8, 16, 17
DOC_STATUS = ("pending", "processing", "ready", "stale", "error", "deleting", "deleted")
# ---------------------------------------------------------------------------------------

DDL = {
    "documents": "doc_id string, namespace_id string, source_type string, source_path string, content_hash string, status string, processing_level int, cdc_schema string, cdc_position string, cdc_last_sync string, metadata_json string, created_at string, deleted_at bigint",
    "blocks": "block_id bigint, doc_id string, chunk_index int, block_type int, content_text string, metadata_json string, enriched_score double, semantic_score double, flags_ext int",
    "parents": "parent_id string, doc_id string, parent_text string, token_count int, page_start int, page_end int, byte_offset_start bigint, byte_offset_end bigint",
    "children": "child_id string, parent_id string, doc_id string, child_text string, token_count int, parent_offset int, chunk_index int",
    "embeddings": "block_id bigint, embedding array<float>",
    "sparse_postings": "ns string, term int, child_id string, weight float",
    "operation_log": "id bigint, timestamp bigint, user_id string, action string, resource_type string, namespace_id string, resource_id string, summary string, trace_id string, session_id string",
    "agent_trace": "id bigint, session_id string, trace_id string, agent_id string, method string, params string, result_summary string, duration_ms bigint, source string, status string, error_code string, namespace_id string, created_at bigint",
    "interaction_log": "id bigint, session_id string, namespace_name string, user_id string, role string, content string, query_type string, status string, latency_ms bigint, metadata_json string, created_at string",
    "files": "file_hash string, size_bytes bigint, ref_count bigint, deleted_at bigint",
    "content_refs": "file_hash string, namespace_id string, doc_id string",
    "search_result": "namespace_id string, child_id string, score double, content string, sources string",
    "memory_result": "block_id bigint, content string, memory_type string, score double",
}


def block_type_name(code: Column) -> Column:
    name = F.lit("UNKNOWN")
    for n, text in BLOCK_TYPES.items():
        name = F.when(code == n, text).otherwise(name)
    return name


def block_type_code(name: str) -> int:
    try:
        return {v: k for k, v in BLOCK_TYPES.items()}[name.upper()]
    except KeyError as e:
        raise ValueError(f"no such block type: {name}") from e
