"""Table layouts, as Spark DDL, and the fixed values of the data model."""

CONTRACTS = "contract_id STRING, contract_type STRING, metadata STRING, created_at TIMESTAMP_NTZ"

VERSIONS = (
    "contract_id STRING, version_number INT, workflow_state STRING, "
    "is_current BOOLEAN, etag STRING, created_at TIMESTAMP_NTZ"
)

SPATIAL = (
    "STRUCT<page: INT, x_min: DOUBLE, y_min: DOUBLE, x_max: DOUBLE, y_max: DOUBLE, "
    "page_width: DOUBLE, page_height: DOUBLE>"
)

PARAMETERS = (
    "parameter_id LONG, contract_id STRING, version_number INT, parameter_key STRING, "
    "param_group_id STRING, param_structure_type STRING, original_extract STRING, "
    "user_override STRING, spatial_json STRING, combined_score DOUBLE, vector_embed ARRAY<FLOAT>"
)

DOCUMENTS = "contract_id STRING, text STRING"
PIECES = "contract_id STRING, page INT, pos INT, piece STRING"
REPLIES = "contract_id STRING, version_number INT, chunk_no INT, response STRING"
OVERRIDES = "seq LONG, parameter_id LONG, user_override STRING"
COMMANDS = (
    "seq LONG, ts TIMESTAMP, contract_id STRING, command STRING, if_match STRING, payload STRING"
)
QUERIES = "query_id LONG, query_vec ARRAY<FLOAT>"
PAGE_SIZES = "contract_id STRING, page INT, width DOUBLE, height DOUBLE"

TABLES = {
    "contracts": CONTRACTS,
    "contract_versions": VERSIONS,
    "contract_parameters_extracted": PARAMETERS,
    "documents": DOCUMENTS,
    "pieces": PIECES,
    "replies": REPLIES,
    "overrides": OVERRIDES,
    "commands": COMMANDS,
    "queries": QUERIES,
    "page_sizes": PAGE_SIZES,
}

# Column lists of the views.
VERSION_VIEW = ["contract_id", "version_number", "workflow_state", "is_current", "etag"]
SHORT_PARAMETER_VIEW = [
    "parameter_id", "parameter_key", "original_extract", "user_override", "combined_score",
]
FULL_PARAMETER_VIEW = [
    *SHORT_PARAMETER_VIEW, "param_group_id", "param_structure_type", "spatial_json",
]

# Workflow states, declared column lengths, thresholds and default keys.
DRAFT = "STAGED_DRAFT"
PENDING = "PENDING_APPROVAL"
ACTIVE = "PRODUCTION_ACTIVE"
ACCEPT_THRESHOLD = 0.99
TEXT_WEIGHT = 0.6
CHUNK_CHARS = 3000
EMBED_BATCH = 16
VECTOR_WIDTH = 384
SEARCH_K = 5
PAGE_GAP = 16
MIN_BOX = 6
MAX_LENGTHS = {
    "contracts": {"contract_id": 50, "contract_type": 100},
    "contract_versions": {"contract_id": 50, "workflow_state": 30, "etag": 64},
    "contract_parameters_extracted": {
        "contract_id": 50, "parameter_key": 200, "param_group_id": 50, "param_structure_type": 20,
    },
}
REQUIRED = {
    "contracts": ["contract_id", "created_at"],
    "contract_versions": [
        "contract_id", "version_number", "workflow_state", "is_current", "etag", "created_at",
    ],
    "contract_parameters_extracted": [
        "parameter_id", "contract_id", "version_number", "parameter_key", "param_structure_type",
    ],
}
DEFAULT_KEYS = [
    "Governing Law",
    "Limitation of Liability",
    "Effective Date",
    "Payment Terms",
    "Confidentiality Requirements",
]
