"""Limits and thresholds. Every operator takes these as keyword defaults."""

# ---------------------------------------------------------------------------
# Thresholds the results depend on.
# ---------------------------------------------------------------------------
OCR_CONFIDENCE_THRESHOLD = 0.70

MIN_FILE_SIZE_BYTES = 1_000
MAX_FILE_SIZE_BYTES = 25 * 1024 * 1024
MIN_DIMENSION_PX = 500
BLUR_VARIANCE_THRESHOLD = 80.0
MIN_BRIGHTNESS = 50.0
MAX_BRIGHTNESS = 245.0
MAX_SKEW_DEGREES = 5.0
MIN_TEXT_CHARS_PER_PAGE = 40
REJECT_QUALITY_THRESHOLD = 0.5

FUZZY_MATCH_CUTOFF = 0.80
EXACT_CODING_CONFIDENCE = 0.97
UNIT_MISMATCH_PENALTY = 0.25
MIN_CODING_CONFIDENCE = 0.05

STABLE_BAND_PCT = 5.0
PERSISTENCE_COUNT = 3
GAP_TOLERANCE = 1.5
DEFAULT_INTERVAL_DAYS = 180

MAX_QUERIES = 6
SEARCH_TOP_K = 8
MAX_KNOWLEDGE = 10
MIN_KNOWLEDGE_RELEVANCE = 0.5
CORROBORATION_STEP = 0.03
CORROBORATION_CAP = 0.12
HISTORY_TOP_K = 5
HISTORY_MIN_SCORE = 0.75

MAX_INSIGHTS = 8
MIN_INSIGHT_CONFIDENCE = 0.55
MIN_EVIDENCE_RELEVANCE = 0.5
AUTO_VERIFY_MIN_CONFIDENCE = 0.75
ALWAYS_REVIEW_SEVERITIES = ("high", "critical")

TOKEN_TTL_SECONDS = 3600

# ---------------------------------------------------------------------------
# Scale settings (ours).
# ---------------------------------------------------------------------------
# A series, document or category larger than this many rows is cut into chunks.
HOT_GROUP_ROWS = 2_000_000
# Rows per block of a blocked vector search and per page of nested output.
VECTOR_BLOCK_ROWS = 4096
PAGE_ROWS = 1000
