"""Schemas of the stored tables; never inferred."""

from __future__ import annotations

TABLES = {
    "metadata": "key string, value string",
    "files": "file_id long, path string, language string, hash string, size long, last_modified long, indexed_at long, content string",
    "symbols": "symbol_id long, file_id long, name string, kind string, start_line long, end_line long, start_byte long, end_byte long, signature string, doc_comment string, parent string",
    "chunks": "chunk_id long, file_id long, content string, start_line long, end_line long, start_byte long, end_byte long, symbols array<string>, embedding array<float>",
    "dependencies": "dep_id long, source_file_id long, target_path string, import_name string, kind string",
    "observations": "language string, distance float, query_hash long, ts long",
    "calibrations": "language string, max_distance double, min_similarity double, confidence string, sample_count long, p50 double, p90 double, p95 double, mean double, std double, calibrated_at long",
}
#: Columns that name a row for upserts.
KEYS = {"metadata": ["key"], "files": ["path"], "observations": ["query_hash", "language"], "calibrations": ["language"]}
CHILDREN = {"symbols": "file_id", "chunks": "file_id", "dependencies": "source_file_id"}
