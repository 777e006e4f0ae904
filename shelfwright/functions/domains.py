"""Fixed values of the media-library domain."""

# Modes, stages, extensions, tag sets and word lists whose members decide results.
MODES = ("convert", "enrich", "metadata", "organize")
LEVELS = ("simple", "normal", "ai", "full")
STAGES = ("validate", "concat", "convert", "asin", "metadata", "organize", "archive", "cleanup")
MODE_STAGES = {
    "convert": STAGES,
    "enrich": ("asin", "metadata", "organize", "cleanup"),
    "metadata": ("asin", "metadata", "cleanup"),
    "organize": ("asin", "metadata", "organize"),
}
PRE_COMPLETED = {"convert": (), "enrich": STAGES[:3], "metadata": STAGES[:3], "organize": STAGES[:3]}
AUDIO = ("mp3", "m4a", "m4b", "flac", "ogg", "wma")
CONVERTIBLE = ("mp3", "m4a", "flac", "ogg", "wma")
LEFTOVER_SOURCES = ("mp3", "flac", "ogg", "wma", "wav", "aac")
MANDATORY_TAGS = ("artist", "album_artist", "album", "title", "genre", "sort_album")
RECOMMENDED_TAGS = ("composer", "date", "comment", "description")
SUSPICIOUS = ("unknown", "unknown artist", "various artists", "untitled", "")
SUSPICIOUS_CHECKED = ("artist", "album_artist", "title", "album")
FRANCHISES = ("dragonlance", "forgotten realms", "star wars", "warhammer", "dungeons & dragons", "magic the gathering")
CONTAINERS = ("newbooks", "original", "incoming", "unsorted", "_unsorted", "to_fix", "audiobooks_to_fix", "downloads", "new")
LABELS = ("audiobook", "audio", "unabridged", "abridged")
GENERIC_NAMES = ("file", "mp3", "audiobook", "audio", "book", "track", "output", "part1", "part2", "part 1", "part 2", "disc1", "disc2")
STOP_WORDS = ("the", "a", "an", "of", "and", "in", "at", "to", "by", "for", "on", "with")
COLLECTION_WORDS = (
    "trilogy", "series", "saga", "collection", "volumes", "books", "chronicle", "chronicles", "standalones", "chaptered", "audiobook", "all chaptered", "stuff", "random", "newbooks", "output", "input", "incoming",
    "processing", "completed", "failed", "queue", "pipeline",
)
ROLE_WORDS = ("introduction", "narrator", "narrated", "read", "performed", "foreword", "afterword", "translated", "edited", "abridged", "unabridged", "producer", "director")
PLACEHOLDER_AUTHORS = ("unknown", "various", "various artists", "n/a", "none")
CONFLICT_PLACEHOLDERS = ("", "unknown", "_unsorted", "various")
PERMANENT_EXIT_CODES = (2, 3)
FUZZY, NEAR, CATALOG_SCORE, MAX_BITRATE, STABLE_SECONDS, MAX_RETRIES, CACHE_DAYS, CHAPTER_TOLERANCE = 85, 0.85, 65, 128, 120, 3, 30, 5
