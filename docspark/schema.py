"""Declared schemas of the corpus tables."""

CATALOG = (
    "doc_id string, filename string, file_size_bytes bigint, page_count int, summary string, "
    "tags array<string>, classifications map<string,array<string>>, key_findings array<string>, "
    "entities struct<Companies:array<string>,Dates:array<string>,Project_Names:array<string>>, "
    "doc_type string, status string, error_message string, upload_date timestamp"
)
DOC_TEXT = "doc_id string, filename string, text string, tags string, summary string"
PAGES = "doc_id string, page int, text string"
CHUNKS = "chunk_id string, doc_id string, chunk_no int, page int, text string"
VECTORS = "chunk_id string, doc_id string, page int, embedding array<float>, model_version string"
POSTINGS = "doc_id string, term string, positions array<int>, tf bigint"
DIMENSIONS = "dimension_id string, display_name string, is_multi_label boolean, dim_order int"
CATEGORIES = "dimension_id string, name string"
PROGRESS = "doc_id string, ts timestamp, step string, pct int, detail string"

JSON_COLUMNS = {
    "tags": "array<string>",
    "classifications": "map<string,array<string>>",
    "key_findings": "array<string>",
    "entities": "struct<Companies:array<string>,Dates:array<string>,Project_Names:array<string>>",
}
