"""Fixed values that results depend on."""

# Words that are not indexed.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can",
    "do", "does", "for", "from", "had", "has", "have", "how", "i", "if",
    "in", "into", "is", "it", "its", "of", "on", "or", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "were",
    "what", "when", "where", "which", "who", "will", "with", "you", "your",
)

# Ranking.
K1, B = 1.2, 0.6
TITLE_WEIGHT, HEADING_WEIGHT, BODY_WEIGHT = 3, 1, 1  # a heading's words also stand in the body; the id counts as a title
REPETITION_POWER = 0.75
MIN_PREFIX, MAX_EXPANDED_DF, MAX_SEEN, MAX_EXPANSIONS, EXPANSION_WEIGHT = 5, 8, 51, 3, 0.6
TITLE_EXACT, TITLE_PART, ID_EXACT = 1.8, 1.35, 3.0
MIN_RATIO, SUBSTRING_RATIO, SUGGESTIONS = 0.3, 0.9, 3

# Limits.
SUMMARY_CHARS, SNIPPET_CHARS, INLINE_BYTES = 160, 240, 300
MAX_ID, MAX_SECTION, MAX_QUERY, MAX_URL = 256, 256, 1000, 1024
MIN_K, MAX_K, DEFAULT_K = 1, 20, 5
SMALL_DOC, MAX_SECTION_TEXT, MAX_SECTIONS_LISTED, TOC_PREAMBLE = 8192, 40_000, 60, 2000
STALE_DAYS = 7
MAX_REASON = 120
MIN_GUIDES, MIN_OPERATIONS = 300, 400
CHUNK_BYTES = 900 * 1024
BODY_DEPTH, OPTIONAL_NAMES, PARAM_CHARS, CARD_LINE_CHARS, SEARCH_LINE_CHARS = 2, 20, 110, 220, 300
SCHEMA_VERSION = 2
