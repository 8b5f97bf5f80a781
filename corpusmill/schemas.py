"""Table schemas (DDL strings) shared by readers, writers and streams."""

SILVER = (
    "doc_id string, source_id string, filename string, content_type string, text string, "
    "char_count int, user_id string, source_uri string, uploaded_at timestamp, "
    "metadata map<string,string>"
)

CHUNKS = (
    "chunk_id string, doc_id string, source_id string, ordinal int, content string, char_count int, "
    "layer_version int, geological_age string, ingested_at timestamp, metadata map<string,string>"
)

VECTORS = (
    "chunk_id string, doc_id string, source_id string, ordinal int, content string, "
    "layer_version int, geological_age string, ingested_at timestamp, metadata map<string,string>, "
    "model_id string, embed_dim int, embedding array<float>"
)
VECTOR_KEY = ("chunk_id", "model_id", "embed_dim", "layer_version")

MARKERS = (
    "source_id string, layer_version int, doc_id string, "
    "markers array<struct<kind:string,text:string,value:string>>, counts map<string,int>, "
    "created_at timestamp"
)
MARKER_KEY = ("source_id", "layer_version")

LEDGER = "key string, status string, ref string, claimed_at timestamp, processed_at timestamp"

PROMPT_CACHE = "key string, value string, put_at timestamp, last_used timestamp"

METRICS = (
    "ts timestamp, event string, stage string, request_id string, latency double, errors int, "
    "rows_ingested double, rows_dropped double"
)

MESSAGES = "message_id string, body string"

SPECIMEN_CSV = "Species string, Age_MYA double"
