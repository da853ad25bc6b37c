"""Default values shared by the audit and the impact run."""

# Results depend on them, so they are part of the public contract.
DEFAULT_SEED = 42
TEST_SHARE = 0.25
EXACT_ATOL = 1e-8
NEAR_ATOL = 1e-3
NEAR_OFFSET = 5e-4
ENCODING_SMOOTHING = 1.0
LOGISTIC_C = 1.0
LOGISTIC_MAX_ITER = 2000
FOREST_TREES = 200
THRESHOLD = 0.5
PREVIEW_SIZE = 8
GROUP_RULE = "typed; missing values never overlap"
UNHASHABLE = "categorical feature values must be hashable"

# Fields of a CSV file that mean a missing value, besides the empty field.
MISSING_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Forest depth and bins: Spark's defaults are too shallow to memorise an entity.
FOREST_DEPTH = 15
FOREST_BINS = 256

# Strings longer than this many bytes travel through shuffles as (length, SHA-256).
KEY_BYTES = 64

# A lookup key with more than 1/SPREAD of the rows is salted, so there are fewer than SPREAD such keys.
SPREAD = 256
# Below this many rows a skewed key is no problem and the plain join is cheaper.
SALT_MIN_ROWS = 5_000_000
# Largest table that may carry a broadcast hint; larger ones join by shuffle.
BROADCAST_ROWS = 100_000

# Candidate pairs allowed per distinct vector before a narrower radius is tried first.
PAIRS_PER_VECTOR = 64
MIN_PAIR_BUDGET = 20_000_000
RADIUS_STEP = 16.0
MAX_LEVELS = 8
MAX_GRID_COLUMNS = 12
# A grid cell with more candidate pairs than CHUNK_ROWS squared is cut into chunks of this many vectors.
CHUNK_ROWS = 2048
# Tasks that share the pairs of cut cells, at most; beyond it a task holds more of them.
MAX_PAIR_TASKS = 10_000
# Chunks whose vectors would be repeated more often than this, per vector and in all, are dealt into blocks instead.
COPIES_PER_VECTOR = 1
MIN_COPIES = 100_000
# A block has at most so many vectors and bytes of values. The blocks of a cell with more than BLOCK_MEETINGS meetings meet in many tasks,
# each of which reads about BLOCK_SCAN_BYTES of either side.
BLOCK_ROWS = 16_384
BLOCK_BYTES = 8 << 20
BLOCK_MEETINGS = 16
BLOCK_SCAN_BYTES = 32 << 20

# Rows that one ordered window may hold when a hash-ranked split looks for its cut-off.
RANK_BUCKET_ROWS = 100_000
