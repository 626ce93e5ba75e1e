"""Tables of a store: columns, types and natural keys."""

from __future__ import annotations

SCHEMAS = {
    "documents": "document_id string, extension string, status string",
    "paths": "path_seq long, document_id string, path string, file_size long, modified_at timestamp",
    "texts": "document_id string, extractor string, extracted_text string, cleaned_text string, content_hash string, light_keyword_count int",
    "chunks": "document_id string, extractor string, chunk_index int, content string, content_hash string, character_count int, chunker_version string",
    "keywords": "document_id string, extractor string, model_name string, rank int, value string, score double",
    "summaries": "document_id string, extractor string, model_name string, endpoint string, prompt_version string, summary string, work_key string",
    "embeddings": "document_id string, extractor string, chunk_index int, model_name string, dimensions int, vector array<float>",
}
KEYS = {
    "documents": ["document_id"],
    "paths": ["path"],
    "texts": ["document_id", "extractor"],
    "chunks": ["document_id", "extractor", "chunk_index"],
    "keywords": ["document_id", "extractor", "model_name", "rank"],
    "summaries": ["document_id", "extractor", "model_name", "prompt_version"],
    "embeddings": ["document_id", "extractor", "chunk_index", "model_name"],
}
DERIVED = ("chunks", "keywords", "summaries", "embeddings")
EXTRACTOR = "plain"
