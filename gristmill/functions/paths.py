"""Path functions: languages, what is worth indexing or reviewing, priors. All are column expressions over path strings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension and by file name.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin",
    "kts": "kotlin", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "hpp": "cpp", "hh": "cpp", "swift": "swift", "scala": "scala", "sh": "shell", "bash": "shell", "zsh": "shell",
    "sql": "sql", "md": "markdown", "mdx": "markdown", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml",
    "html": "html", "htm": "html", "css": "css", "scss": "css", "vue": "vue", "svelte": "svelte", "tf": "terraform",
    "tfvars": "terraform", "proto": "protobuf", "graphql": "graphql", "gql": "graphql", "dart": "dart", "ex": "elixir",
    "exs": "elixir", "erl": "erlang", "hs": "haskell", "lua": "lua", "r": "r", "m": "objective-c", "pl": "perl", "txt": "text",
}
NAMED_LANGUAGES = {"dockerfile": "dockerfile", "containerfile": "dockerfile", "makefile": "makefile", "gnumakefile": "makefile"}
# Names that a fenced block is marked with, by extension.
FENCES = {
    "ts": "typescript", "tsx": "tsx", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "jsx",
    "mjs": "javascript", "cjs": "javascript", "py": "python", "rb": "ruby", "go": "go", "rs": "rust", "java": "java",
    "kt": "kotlin", "swift": "swift", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp",
    "php": "php", "scala": "scala", "sh": "bash", "bash": "bash", "zsh": "bash", "sql": "sql", "html": "html", "css": "css",
    "scss": "scss", "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "md": "markdown", "vue": "vue",
    "ex": "elixir", "exs": "elixir", "dart": "dart", "lua": "lua", "r": "r",
}
# What the index skips.
INDEX_SKIP_DIRS = ["node_modules", "vendor", "dist", "build", ".git", "target", "__pycache__", ".next", ".venv", "venv", "coverage", ".idea", ".vscode", "generated", "gen", "__generated__"]
INDEX_SKIP_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "go.sum", "poetry.lock", "Pipfile.lock", "composer.lock", "Gemfile.lock"]
INDEX_BINARY = ["png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "woff", "woff2", "ttf", "eot", "zip", "gz", "tar", "tgz", "jar", "class", "pyc", "so", "dylib", "dll", "exe", "pdf", "mp4", "mp3", "wasm", "lock"]
MAX_FILE_BYTES = 512 * 1024
# What reviews skip.
REVIEW_LOCKFILES = ["package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock", "composer.lock", "gemfile.lock", "poetry.lock", "pdm.lock", "cargo.lock", "go.sum", "mix.lock", "packages.lock.json", "pipfile.lock", "flake.lock"]
REVIEW_SKIP_DIRS = ["node_modules", "vendor", "dist", "build", ".next", "out", "target", "coverage", ".venv", "generated", "gen", "__generated__"]
REVIEW_BINARY = [
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "avif", "tiff", "svgz", "pdf", "zip", "gz", "tgz", "bz2", "xz", "7z", "rar", "jar", "war",
    "woff", "woff2", "ttf", "otf", "eot", "mp3", "mp4", "mov", "avi", "webm", "wav", "ogg", "flac", "so", "dylib", "dll", "exe", "bin", "wasm",
    "class", "o", "a", "pyc", "pyo", "db", "sqlite", "sqlite3", "parquet",
]
# Patterns of generated names and of paths with a lower prior.
GENERATED_NAME = r"(\.generated|\.gen|_generated|\.pb)\.[^.]+$"
GENERATED_HEADER = r"(?i)^\s*((//|#|;|--)\s*)?(code\s+generated\b.*\bdo not edit\b.*|@generated\b.*)$"
CHANGELOG_PATH = r"(?i)(^|/)(changelog|changes|history|release[-_]?notes|news)(\.(md|markdown|txt|rst|adoc))?$"
TEST_PATH = r"(?i)(^|/)(tests?|__tests__|spec|specs|fixtures?|testdata)/|\.(test|spec)\.[a-z]+$|_test\.[a-z]+$"
DOC_PATH = r"(?i)(^|/)(docs?|documentation)/|\.(md|markdown|rst|adoc|txt)$"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension; empty if there is none or the name begins with its only dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    """Base name without its last extension."""
    base = basename(path)
    return F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)).otherwise(base)


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def language(path: Column) -> Column:
    """Language of a path by its name or extension; null if unknown."""
    name = F.lower(basename(path))
    prefixed = F.when(name.startswith("dockerfile."), "dockerfile").when(name.startswith("makefile."), "makefile")
    return F.coalesce(_lookup(NAMED_LANGUAGES, name), prefixed, _lookup(LANGUAGES, extension(path)))


def fence(path: Column) -> Column:
    return F.coalesce(_lookup(FENCES, extension(path)), F.lit(""))


def index_worthy(path: Column, size: Column) -> Column:
    """Whether a file is worth cutting into chunks."""
    name, low = basename(path), F.lower(basename(path))
    skipped = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, INDEX_SKIP_DIRS))) | name.isin(INDEX_SKIP_FILES)
    made = low.endswith(".min.js") | low.endswith(".min.css") | low.endswith(".map") | low.rlike(GENERATED_NAME)
    return (size <= MAX_FILE_BYTES) & ~skipped & ~made & ~extension(path).isin(INDEX_BINARY) & language(path).isNotNull()


def glob_pattern(glob: str) -> str:
    """Regular expression of a path glob: ``**`` spans folders, ``*`` and ``?`` don't, ``{a,b}`` names alternatives."""
    out, k, depth = "", 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(.*/)?", k + 3
            continue
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "{":
            depth, out = depth + 1, out + "("
        elif c == "}" and depth:
            depth, out = depth - 1, out + ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in r"\.+^$()[]{}|" else c)
        k += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return reduce(or_, [path.rlike(glob_pattern(g)) for g in globs], F.lit(False))


def reviewable(path: Column, ignored: list[str] = ()) -> Column:
    """Whether a changed path gets a review; unlike the index, unknown languages do."""
    low = F.lower(path)
    name = basename(low)
    dirs = reduce(or_, [(low == d) | low.startswith(f"{d}/") | low.contains(f"/{d}/") for d in REVIEW_SKIP_DIRS])
    made = name.endswith(".snap") | name.endswith(".map") | name.rlike(r"\.min\.(js|css|mjs|cjs)$") | name.rlike(r"[.-]bundle\.js$") | name.rlike(GENERATED_NAME)
    return (path != "") & ~matches_any(path, list(ignored)) & ~name.isin(REVIEW_LOCKFILES) & ~dirs & ~made & ~extension(low).isin(REVIEW_BINARY)


def generated_header(text: Column) -> Column:
    """Whether one of the first five lines says that the file is generated."""
    return F.exists(F.slice(F.split(text, "\n", -1), 1, 5), lambda line: line.rlike(GENERATED_HEADER))


def prior(path: Column) -> Column:
    return F.when(path.rlike(CHANGELOG_PATH), F.lit(0.6)).when(path.rlike(TEST_PATH), F.lit(0.7)).when(path.rlike(DOC_PATH), F.lit(0.8)).otherwise(F.lit(1.0))


def path_weight(path: Column, tokens: Column) -> Column:
    """Prior of a path, raised by a quarter for each of up to three query tokens that it contains."""
    hits = F.size(F.filter(tokens, lambda t: (F.length(t) >= 3) & F.contains(F.lower(path), t)))
    return prior(path) * (F.lit(1.0) + F.least(hits, F.lit(3)) * F.lit(0.25))


def normalised(path: Column) -> Column:
    """``path`` without empty and ``.`` segments; ``..`` takes the one before it."""
    fold = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold), "/")


def ancestors(path: Column) -> Column:
    """Folders above ``path``, the nearest first, the root (an empty string) last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
