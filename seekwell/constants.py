"""Fixed values that decide results. They must not drift between releases."""

# Limits of the indexing and search contract.
LINES_PER_CHUNK = 50
LINE_OVERLAP = 10
TOKENS_PER_CHUNK = 8192
MAX_TOKENS_PER_REQUEST = 200_000
MAX_CHUNKS_PER_REQUEST = MAX_TOKENS_PER_REQUEST // TOKENS_PER_CHUNK  # 24
ROWS_PER_UPSERT = 100
MAX_FILE_BYTES = 1_000_000
SEARCH_DEPTH = 100
CLI_CUTOFF = 0.7
REQUEST_CUTOFF = 0.3
EMBEDDING_DIM = 384

# RFC 4122 name spaces (hex) for version-5 ids.
UUID_NS_DNS = "6ba7b8109dad11d180b400c04fd430c8"
UUID_NS_OID = "6ba7b8129dad11d180b400c04fd430c8"

# File extensions that are indexed (case-sensitive).
INDEXED_EXTENSIONS = (
    "rs", "py", "js", "ts", "jsx", "tsx", "java", "c", "cpp", "cc", "cxx",
    "h", "hpp", "go", "rb", "php", "swift", "kt", "scala", "r", "m", "mm",
    "cs", "vb", "fs", "ml", "clj", "ex", "exs", "erl", "hrl", "lua", "pl",
    "sh", "bash", "zsh", "fish", "ps1", "psm1", "psd1", "bat", "cmd",
    "md", "txt", "rst", "adoc", "tex", "org", "wiki",
    "yml", "yaml", "toml", "json", "xml", "html", "css", "scss", "sass", "less",
    "sql", "dockerfile", "makefile", "cmake", "gradle", "maven", "sbt",
    "vim", "el", "lisp", "scm", "rkt", "hs", "lhs", "purs", "elm", "nim",
)

# File names indexed whatever their extension.
INDEXED_FILE_NAMES = ("Makefile", "Dockerfile", "Jenkinsfile", "Vagrantfile")

# Patterns that are always ignored; the last is our own index.
DEFAULT_IGNORE_PATTERNS = (
    ".git", ".env", "*.log", "*.tmp", "target", "node_modules", ".seekwell",
)

# Pattern files read from the root of a folder, in this order.
IGNORE_FILE_NAMES = (".gitignore", ".seekwellignore")

# Scores are ranked at this many decimals, so that equal vectors tie exactly
# whatever the summation order, and shown at fewer.
RANK_DECIMALS = 9
SHOWN_DECIMALS = 6

# Upper bounds for what may be sent to every executor.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024

# Hits that one task may keep for all queries of a block.
MAX_KEPT_HITS = 512 * 1024
