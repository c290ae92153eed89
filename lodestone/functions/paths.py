"""Paths and URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which extension means which language, and what makes a document or a configuration.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp",
    ".cs": "csharp", ".sh": "shell",
}
DOC_EXTENSIONS = (".md", ".rst", ".txt", ".adoc")
CONFIG_EXTENSIONS = (".toml", ".cfg", ".ini", ".yaml", ".yml", ".json", ".env")
CONFIG_NAMES = ("dockerfile", "makefile", ".gitignore", ".dockerignore", "pyproject.toml")
# URL segments below a repository that only browsers use.
BROWSE_SEGMENTS = ("tree", "blob", "commits", "commit", "pull", "pulls", "issues", "releases", "wiki")
# Files that change together for bureaucratic reasons.
NOISE_PREFIXES = (".github/",)
NOISE_NAMES = ("uv.lock", "poetry.lock", "package-lock.json", "pyproject.toml", ".pre-commit-config.yaml")

ROOT = "(root)"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column, default: str | None = ROOT) -> Column:
    """Everything before the last slash; without one, the default (None: the path itself)."""
    cut = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(path.contains("/"), cut).otherwise(path if default is None else F.lit(default))


def extension(path: Column) -> Column:
    """Lower-cased last suffix of the name with its dot; empty without one, and for `.name`."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def first_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def last_two(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(table, extension(path))


def category(path: Column) -> Column:
    """test, doc, code, config or other; the first that fits. All parts of a path count, its name too."""
    name = F.lower(basename(path))
    parts = F.split(F.lower(path), "/")
    ext = extension(path)
    is_test = F.arrays_overlap(parts, F.array(F.lit("tests"), F.lit("test"))) | name.startswith("test_") | name.endswith("_test.py")
    is_doc = ext.isin(*DOC_EXTENSIONS) | F.arrays_overlap(parts, F.array(F.lit("docs"), F.lit("doc"))) | name.startswith("readme")
    is_config = ext.isin(*CONFIG_EXTENSIONS) | name.isin(*CONFIG_NAMES)
    return F.when(is_test, "test").when(is_doc, "doc").when(language(path).isNotNull(), "code").when(is_config, "config").otherwise("other")


_HOST = r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"


def normalise_repo_url(url: Column) -> Column:
    """Cut what a browser appends below owner/name; any other URL stays as it is."""
    segments = "|".join(BROWSE_SEGMENTS)
    return F.regexp_replace(url, rf"^({_HOST})/+([^/?#]+/[^/?#]*)/(?:{segments})(?=[/?#]|$)[^?#]*", "$1/$2")


def repo_slug(url: Column) -> Column:
    """struct(owner, name) of a repository URL, as a browser shows it or bare; `.git` is cut."""
    path = F.regexp_replace(F.regexp_replace(normalise_repo_url(url), f"^{_HOST}", ""), "[?#].*$", "")
    path = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), r"\.git$", "")
    return F.struct(F.substring_index(path, "/", 1).alias("owner"), F.regexp_replace(path, "^[^/]*/?", "").alias("name"))


def is_noise(path: Column) -> Column:
    start = F.lit(False)
    for p in NOISE_PREFIXES:
        start = start | path.startswith(p)
    return start | basename(path).isin(*NOISE_NAMES)


def under_tests(path: Column) -> Column:
    """Entrypoints' and communities' rule: below tests/."""
    return path.startswith("tests/")


def under_test_folders(path: Column) -> Column:
    """Impact's rule: below tests/ or test/."""
    return path.startswith("tests/") | path.startswith("test/")


def is_test_symbol(path: Column, name: Column) -> Column:
    """Dead code's rule: below tests/ or test/, or a name test_*."""
    return under_test_folders(path) | name.startswith("test_")


def is_test_file(path: Column) -> Column:
    """The finding scan's rule: below tests/ or test/, or a path test_*."""
    return under_test_folders(path) | path.startswith("test_")
