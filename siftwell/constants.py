"""Limits and tables of the engine."""

from __future__ import annotations

EMBEDDING_DIM = 384
PARSER_VERSION = 3
SCHEMA_VERSION = 3
CHUNK_BYTES, OVERLAP_LINES = 1500, 3
MAX_FILE_BYTES = 1024 * 1024
MAX_EXPANDED_TOKENS = 10
RESULT_CAP, FTS_CAP = 1000, 10_000
MAX_QUERY_BYTES, MAX_REGEX_BYTES = 500, 1000
DEFAULT_MIN_SCORE = 0.35
DIGITS = 9  # of scores
DEFAULT_MAX_DISTANCE, DEFAULT_MIN_SIMILARITY = 1.2, 0.3
MIN_SAMPLES, AUTO_MIN_SAMPLES = 100, 50
GLOBAL_KEY = "_global"
BUFFER_ROWS, SAMPLE_RATE, MAX_AGE_SECONDS, BOOTSTRAP_ROWS = 50, 0.1, 30 * 86_400, 500
FILE_LIST_SECONDS = 30
LIMITS = {"cli": 10, "search": 20, "refs": 50, "tool_cap": 1000, "http_cap": 100}
EXPLAIN_DEFINITIONS, EXPLAIN_MENTIONS = 20, 100

# Names, extensions and kinds that results depend on.
EXCLUDED_DIRS = [
    "node_modules", "target", "dist", "build", "vendor", ".next", "__pycache__", "venv", ".venv", "coverage",
    ".nyc_output", ".git", ".hg", ".svn", "out", ".output", ".nuxt", ".cache", ".parcel-cache", ".turbo",
]
EXCLUDED_EXTENSIONS = [
    "json", "lock", "yaml", "yml", "md", "txt", "toml", "xml", "csv", "log", "env",
    "gitignore", "dockerignore", "editorconfig", "prettierrc", "eslintrc",
]
SYMBOL_KINDS = ["function", "method", "class", "struct", "enum", "interface", "trait", "module", "variable", "constant", "type"]
KIND_BOOST = {
    "function": 1.15, "method": 1.15, "class": 1.1, "struct": 1.1, "trait": 1.1, "interface": 1.1,
    "enum": 1.05, "type": 1.05, "module": 1.0, "constant": 0.95, "variable": 0.9,
}
EXTENSIONS = {
    "rust": ["rs"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx", "mjs", "cjs"], "python": ["py", "pyi"], "go": ["go"], "java": ["java"],
    "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp", "hxx", "hh"], "php": ["php", "phtml", "php3", "php4", "php5", "php7", "phps"], "ruby": ["rb", "rake", "gemspec"],
    "csharp": ["cs"], "kotlin": ["kt", "kts"], "scala": ["scala", "sc"], "html": ["html", "htm"], "json": ["json"], "yaml": ["yaml", "yml"],
    "toml": ["toml"], "bash": ["sh", "bash", "zsh"], "elixir": ["ex", "exs"],
}
PYTHON_STD = [
    "os", "sys", "re", "json", "pathlib", "collections", "itertools", "functools", "typing", "dataclasses",
    "abc", "io", "time", "datetime", "logging", "unittest", "argparse", "subprocess", "threading", "asyncio",
]
LANGUAGE_OF = {ext: name for name, exts in EXTENSIONS.items() for ext in exts}
