"""Column expressions on repository-relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The source languages, folders and limits a scan is defined by.
SOURCE_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx")
SKIPPED_FOLDERS = (".git", "venv", ".venv", "env", "__pycache__", "node_modules")
NOISE_FOLDERS = (
    "test", "tests", "__tests__", "__mocks__", "mocks", "spec", "specs", "e2e", "playwright", "cypress",
    "fixtures", "__fixtures__", "example", "examples", "sample", "samples", "demo", "demos", "docs",
    "stories", "storybook", ".storybook", "benchmark", "benchmarks", "bench", "dist", "build", "out",
    "coverage", "vendor", "third_party", "generated", "__generated__", "migrations", "scripts",
)
NOISE_FILE = (
    r"(?i)([.-](test|spec|stories|story|e2e|bench)\.[cm]?[jt]sx?$|^test_.*\.py$|_test\.py$|"
    r"^conftest\.py$|\.min\.js$|\.config\.[cm]?[jt]s$)"
)
GENERATED_FOLDERS = ("dist", "build", "vendor", "third_party", "coverage", "migrations")
GENERATED_SUFFIXES = (".min.js", ".bundle.js", ".d.ts", "_pb2.py")
DEPENDENCY_FILE = (
    r"(^|/)(package(-lock)?\.json|yarn\.lock|pnpm-lock\.yaml|requirements[^/]*\.txt|"
    r"pyproject\.toml|poetry\.lock|Pipfile(\.lock)?|setup\.(py|cfg))$"
)
MAX_PATH_CHARS = 240
MAX_BLOB_BYTES = 1_000_000
NOT_A_BLOB_MODES = ("120000", "160000")  # symbolic link, submodule
LANGUAGE_BY_EXTENSION = {
    ".c": "C", ".h": "C/C++", ".cc": "C++", ".cpp": "C++", ".cxx": "C++", ".hpp": "C++", ".java": "Java",
    ".kt": "Kotlin", ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".cs": "C#", ".swift": "Swift",
    ".m": "Objective-C", ".scala": "Scala", ".dart": "Dart", ".lua": "Lua", ".r": "R", ".jl": "Julia",
    ".ipynb": "Jupyter notebooks", ".vue": "Vue", ".svelte": "Svelte", ".ex": "Elixir", ".hs": "Haskell",
    ".sol": "Solidity", ".sh": "shell scripts", ".md": "Markdown", ".html": "HTML", ".css": "CSS",
}


def parts(path: Column) -> Column:
    return F.split(path, "/", -1)


def folders(path: Column) -> Column:
    """Folder names, outermost first (empty for a top-level file)."""
    p = parts(path)
    return F.slice(p, 1, F.size(p) - 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    """File name without its last extension (a leading dot is part of the name)."""
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1))


def has_source_extension(path: Column) -> Column:
    return path.rlike(r"\.(py|js|jsx|ts|tsx)$")


def is_source(path: Column) -> Column:
    return has_source_extension(path) & ~path.endswith(".d.ts")


def is_config_file(path: Column) -> Column:
    return basename(path).rlike(r"^(tsconfig|jsconfig).*\.json$")


def in_skipped_folder(path: Column) -> Column:
    inside = folders(path)
    return F.arrays_overlap(inside, F.array(*[F.lit(d) for d in SKIPPED_FOLDERS])) | F.exists(
        inside, lambda d: d.startswith("."))


def is_safe_relative(path: Column) -> Column:
    """Relative, bounded, free of drive letters and dot segments, outside skipped folders."""
    return (
        (F.length(path) > 0)
        & (F.length(path) <= MAX_PATH_CHARS)
        & ~path.rlike(r"^[/\\]")
        & ~path.contains(":")
        & ~F.exists(parts(path), lambda p: p.isin("", ".", ".."))
        & ~in_skipped_folder(path)
    )


def is_noise(path: Column) -> Column:
    lowered = F.transform(folders(path), F.lower)
    return F.arrays_overlap(lowered, F.array(*[F.lit(d) for d in NOISE_FOLDERS])) | basename(path).rlike(NOISE_FILE)


def in_group(path: Column, group: Column) -> Column:
    """``pkg/x`` covers everything below it; ``pkg/*`` (or ``*``) only the files directly inside."""
    direct = F.when(path.contains("/"), dirname(path) == F.regexp_replace(group, r"/?\*$", "")).otherwise(group == "*")
    return F.when(group.endswith("*"), direct & ((group != "*") | ~path.contains("/"))).otherwise(
        path.startswith(F.concat(group, F.lit("/"))))


def review_skip_reason(path: Column) -> Column:
    """Why a changed file is not reviewed; an empty string when it is."""
    generated = F.arrays_overlap(folders(path), F.array(*[F.lit(d) for d in GENERATED_FOLDERS]))
    for suffix in GENERATED_SUFFIXES:
        generated = generated | path.endswith(suffix)
    return (
        F.when(~has_source_extension(path), "not source code")
        .when(generated, "generated or vendored")
        .when(in_skipped_folder(path), "skipped folder")
        .otherwise("")
    )


def is_dependency_file(path: Column) -> Column:
    return path.rlike(DEPENDENCY_FILE)


def is_manifest(path: Column) -> Column:
    name = basename(path)
    return name.isin("pyproject.toml", "Pipfile", "package.json") | (
        name.startswith("requirements") & name.endswith(".txt"))


def is_bot(author: Column) -> Column:
    return author.contains("[bot]") | F.lower(author).isin("dependabot", "renovate")


def dotted_name(path: Column) -> Column:
    """``a/b/c.py`` -> ``a.b.c``; other paths unchanged."""
    return F.when(path.endswith(".py"), F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/", ".")).otherwise(path)


def unquoted(path: Column) -> Column:
    """A path as a diff names it, without the quotes and escapes it has when it holds quotes, backslashes, control characters
    or (by default) anything but ASCII: octal escapes are bytes, and the bytes are read as UTF-8."""
    letters = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D"}
    tokens = F.regexp_extract_all(F.substr(path, F.lit(2), F.length(path) - 2), F.lit(r"(?s)(\\[0-7]{3}|\\.|[^\\]+)"), F.lit(1))

    def in_hex(token: Column) -> Column:
        rest = F.substr(token, F.lit(2))
        named = F.coalesce(*[F.when(rest == letter, code) for letter, code in letters.items()], F.hex(rest))
        return F.when(~token.startswith("\\"), F.hex(token)).when(rest.rlike(r"^[0-7]{3}$"), F.lpad(F.conv(rest, 8, 16), 2, "0")).otherwise(named)

    plain = F.decode(F.unhex(F.array_join(F.transform(tokens, in_hex), "")), "UTF-8")
    return F.when(path.rlike(r'(?s)^".*"$') & (F.length(path) >= 2), plain).otherwise(path)
