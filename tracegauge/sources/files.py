"""Source trees as tables: one row per file, read with Spark's ``binaryFile`` source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by extension, directories that are never read, parse limit.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".cjs": "javascript", ".md": "markdown", ".mdx": "markdown", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".json": "json",
    ".jsonl": "jsonl", ".txt": "text", ".jinja": "template", ".j2": "template", ".prompt": "template", ".sql": "sql", ".png": "image",
    ".jpg": "image", ".jpeg": "image", ".webp": "image", ".gif": "image",
}
CODE_LANGUAGES = ("python", "typescript", "javascript", "sql")
SKIP_DIRS = (
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "env", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    "dist", "build", ".next", "out", "target", ".tox", "site-packages", "vendor", ".idea", ".vscode",
)
MAX_PARSE_BYTES = 2 * 2**20
SNIFF_BYTES = 8192


def language(path: Column) -> Column:
    """Language by file name or extension; 'other' when unknown."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(path.rlike(r"(^|/)Dockerfile[^/]*$"), "dockerfile").otherwise(F.coalesce(F.try_element_at(table, ext), F.lit("other")))


def skipped(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in SKIP_DIRS]))


def inventory(files: DataFrame) -> DataFrame:
    """``path, content`` rows to path, language, bytes, sha256, binary and parseable flags."""
    f = files.where(~skipped(F.col("path")))
    size = F.length("content")
    # a NUL byte in the first 8 KiB marks a binary file
    nul = F.contains(F.hex(F.substring("content", 1, SNIFF_BYTES)), F.lit("00")) & F.exists(
        F.regexp_extract_all(F.hex(F.substring("content", 1, SNIFF_BYTES)), F.lit("(..)"), F.lit(1)), lambda b: b == "00"
    )
    return f.select(
        "path", language(F.col("path")).alias("lang"), size.cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"),
        nul.alias("binary"), (~nul & (size <= MAX_PARSE_BYTES)).alias("parseable"),
    )


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing of ``root``; paths are relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    bare = root.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + bare.replace(".", r"\.") + "/", "")
    return inventory(raw.select(rel.alias("path"), "content"))
