"""Fixed values of the retrieval engine: they must equal the published ones for equal results."""

# Scanning.
SOURCE_SUFFIXES = (".c", ".h")
SKIPPED_DIRECTORIES = (".git", ".hg", ".svn", "build", "node_modules", ".codesearch")
#: Where the command line saves an index in a repository; no sources are read there either.
INDEX_DIRECTORY = ".sieveline"

# Scoring and fusion.
BM25_K1, BM25_B = 1.2, 0.75
RRF_K = 60
FUSION_DEPTH = 100
DENSE_WEIGHT = 5.0
GRAPH_SEEDS, GRAPH_WEIGHT = 3, 0.5
SEED_LIFT = 1e-9
METHODS = ("bm25", "dense", "hybrid", "hybrid_graph")
MAX_K = 50
FORMAT_VERSION = 1

# Evaluation.
RECALL_KS = (1, 5, 10)
MIN_QUERY_WORDS, MAX_QUERY_WORDS = 4, 64
CONFIDENCE, RESAMPLES = 0.95, 10_000
METHOD_LABELS = {"bm25": "BM25 (baseline)", "dense": "Dense", "hybrid": "Hybrid (RRF)", "hybrid_graph": "Hybrid + call graph"}

# Mining.
CODE_SHINGLE, COMMENT_SHINGLE = 5, 3
CODE_JACCARD, COMMENT_JACCARD = 0.5, 0.6
MIN_BODY_LINES = 3
VAL_FRACTION = 0.1
HARD_NEGATIVE_DEPTH = 10
NEGATIVE_MODES = ("random", "hard")

# Patterns.
WORD = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"
CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
CODE_TOKEN = r"(?U)[A-Za-z_]\w*|\d+|\S"
COMMENT_WORD = r"[a-z0-9_]+"

# Words that the tokenizer drops.
C_KEYWORDS = """auto break case char const continue default do double else enum extern float for goto if inline int long register
restrict return short signed sizeof static struct switch typedef union unsigned void volatile while bool true false null
define include ifdef ifndef endif""".split()
STOP_WORDS = """a an and are as at be by for from has have in is it its of on or that the this to was were will with which when where
if then than not no it's we you they there these those can""".split()

# Instructions in front of queries, by model.
QUERY_PREFIXES = {
    "BAAI/bge-small-en-v1.5": "Represent this sentence for searching relevant passages: ",
    "BAAI/bge-base-en-v1.5": "Represent this sentence for searching relevant passages: ",
}

# The repositories that results are published for, and those that training pairs are mined from.
PINNED = [
    ("lua", "https://github.com/lua/lua.git", "312b9efaa1061c2c4cad08554dbc1351c3270eef", "v5.4.9", "MIT", []),
    ("zlib", "https://github.com/madler/zlib.git", "da607da739fa6047df13e66a2af6b8bec7c2a498", "v1.3.2", "zlib", []),
    ("jq", "https://github.com/jqlang/jq.git", "34f7186b86743a083a589741b6cea95293524108", "jq-1.8.2", "MIT", []),
]
TRAINING = [
    ("sqlite", "https://github.com/sqlite/sqlite.git", "262de1bebb0647eb6fa6a2b0434111c7d831a14d", "version-3.47.2", "public domain", ["src"]),
    ("redis", "https://github.com/redis/redis.git", "a0a6f23d997b024689ba157916837f493a593a34", "7.4.2", "BSD-3-Clause", ["src"]),
    ("curl", "https://github.com/curl/curl.git", "75a2079d5c28debb2eaa848ca9430f1fe0d7844c", "curl-8_11_1", "curl", ["lib", "src"]),
]
