"""Relations of a peer's state, as Spark DDL, and fixed values of the data model."""

ENTRIES = (
    "store string, uuid string, kind string, path string, hash string, size bigint, created bigint, updated bigint, peer string, "
    "deleted boolean, prev string, prev2 string, prev_path string, native string, mtime bigint, conflict_of string, reason string, base string, held string"
)
LOG = (
    "store string, segment bigint, op string, batch string, at_ms bigint, peer string, uuid string, type string, kind string, path string, "
    "hash string, size bigint, prev string, prev2 string, prev_path string"
)
FILES = "store string, path string, kind string, size bigint, mtime bigint, native string, content binary"
RENAMES = "store string, seq int, from_path string, to_path string"
MARKS = "store string, peer string, last_sync bigint, segment bigint, offset bigint, digest string"
HEADERS = (
    "store string, store_id string, peer string, state string, text array<string>, "
    "log struct<segment bigint, digest string, rows bigint, size bigint, snapshot string, archives array<bigint>>"
)
FEED = "native string, path string, removed boolean, size bigint, mtime bigint"
EDGES = "seq int, a string, b string"

# fixed values
CONTROL_DIR = ".vfs"
CHUNK_SIZE = 64 * 1024
STREAM_THRESHOLD = 4 * 1024 * 1024
ROTATE_AT = 256 * 1024
HELD_AT = 64 * 1024 * 1024
MAX_TEXT_MERGE = 1024 * 1024
MAX_LCS_CELLS = 4_000_000
BASE_CAP = 256
TEXT_EXTENSIONS = ("cue", "json", "log", "m3u", "md", "nfo", "srt", "txt", "xml")
ZERO_DIGEST = "0" * 64
EMPTY_STATE = "4f53cda18c2baa0c0354bb5f9a3ecbe5ed12ab4d8e11ba873c2f11161202b945"
