"""Which files to take: order under a cap, ignore patterns, secrets, binary content, first reason to leave out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.functions.scalar import basename, extension, glob_regex

#: Directories that come first under a cap; directories and files never taken; binary extensions; secrets.
FIRST_DIRS = ("src", "lib", "pkg", "cmd", "internal")
SKIPPED_DIRS = ("node_modules", "vendor", ".git", "build", "dist", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", ".venv", "venv", ".eggs", "target")
SKIPPED_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Cargo.lock", "go.sum", "composer.lock")
BINARY = (
    ".exe", ".dll", ".so", ".dylib", ".bin", ".out", ".o", ".obj", ".a", ".lib", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar",
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".tiff", ".tif", ".mp3", ".mp4", ".avi", ".mov", ".mkv", ".wav",
    ".flac", ".ogg", ".webm", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".pyc", ".pyo", ".class", ".wasm", ".db",
    ".sqlite", ".sqlite3", ".ttf", ".otf", ".woff", ".woff2", ".eot", ".jar", ".war", ".ear",
)
SECRETS = (
    "*.env", ".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "*.credentials", "*.keystore", "*.jks", "*.token", "*secret*",
    "id_rsa", "id_rsa.*", "id_ed25519", "id_ed25519.*", "id_dsa", "id_ecdsa", ".htpasswd", ".netrc", ".npmrc", ".pypirc",
    "credentials.json", "service-account*.json", "*.secrets",
)
MOST_BYTES = 500 * 1024


def prioritize(files: DataFrame, most: int, first: tuple[str, ...] = FIRST_DIRS) -> DataFrame:
    """The first ``most`` files by rank of their top directory, then path; adds ``rank``."""
    top = F.split("path", "/")[0]
    rank = reduce(lambda a, kv: a.when(top == kv[1], kv[0]), enumerate(first[1:], 1), F.when(top == first[0], 0)).otherwise(5)
    return files.withColumn("rank", rank).orderBy("rank", "path").limit(most)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Ignore rules in order, the last that matches wins: ``!`` takes back, a leading slash anchors, a trailing one means
    a directory."""
    out = F.lit(False)
    for line in patterns:
        negated, p = line.startswith("!"), line.lstrip("!")
        anchored = p.startswith("/") or "/" in p.rstrip("/")
        body = glob_regex(p.strip("/"))[1:-1]
        regex = ("^" if anchored else "(?:^|.*/)") + body + ("/.*$" if p.endswith("/") else "(?:/.*)?$")
        out = F.when(path.rlike(regex if anchored else "^" + regex), not negated).otherwise(out)
    return out


def secret(path: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(basename(path)).rlike(glob_regex(p)) for p in SECRETS])


def skipped_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_DIRS)))


def skipped_file(path: Column) -> Column:
    return basename(path).isin(*SKIPPED_FILES)


def binary_content(content: Column) -> Column:
    return F.contains(F.substring(content, 1, 8192), F.lit("\0"))


def exclusion(path: Column, content: Column, most: int = MOST_BYTES) -> Column:
    """First reason to leave a file out, or null."""
    return (
        F.when(path.contains("../"), "traversal")
        .when(secret(path), "secret")
        .when(F.octet_length(content) > most, "too_large")
        .when(extension(path).isin(*BINARY), "binary_extension")
        .when(binary_content(content), "binary_content")
    )


def safe_component(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9._-]+$") & ~name.isin(".", "..")
