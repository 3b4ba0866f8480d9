"""What kind of file a path is: language, kind, role, ignored or not, minified or not. All of it are columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Extensions by language, and further ones that are indexed.
LANGUAGES = {
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "python": (".py", ".pyi"),
    "java": (".java",),
    "vue": (".vue",),
}
INDEXABLE = (
    ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php", ".swift", ".kt", ".scala", ".vue",
    ".svelte", ".md", ".mdx", ".txt", ".json", ".yaml", ".yml", ".toml",
)
CONFIG_EXTENSIONS = (".json", ".yaml", ".yml", ".toml", ".ini", ".conf")
CONFIG_NAMES = ("tsconfig", "jest.config", "vitest.config", "webpack", "rollup", "babel", "eslint", "prettier")
DOC_EXTENSIONS = (".md", ".mdx", ".txt", ".rst")
DOC_NAMES = ("readme.", "changelog.", "contributing.", "license.")
# Folders and globs that are never indexed.
IGNORED_FOLDERS = (
    "node_modules", "bower_components", ".pnpm-store", "vendor", ".npm", ".opencode", ".tmp", "dist", "build", "out", ".next", "target", "bin", "obj",
    ".git", ".svn", ".hg", ".vscode", ".vscode-test", ".idea", ".turbo", ".output", "desktop", ".sst", ".cache", ".webkit-cache", "__pycache__",
    ".pytest_cache", "mypy_cache", ".history", ".gradle",
)
IGNORED_GLOBS = (
    "**/*.swp", "**/*.swo", "**/*.pyc", "**/.DS_Store", "**/Thumbs.db", "**/logs/**", "**/tmp/**", "**/temp/**", "**/*.log", "**/coverage/**",
    "**/.nyc_output/**", "**/*.min.js", "**/*.min.mjs", "**/*.min.cjs", "**/*.min.css", "**/*.map",
)
# Roles by path, the first that fits.
ROLES = (
    ("build-artifact", r"(^|/)(dist|build|out|coverage|\.next|target|bin|obj)(/|$)"),
    ("generated", r"(^|/)(_generated|generated|gen)(/|$)|\.(generated|gen)\.[^./]+$"),
    ("test", r"(^|/)(__tests__|tests?|specs?)(/|$)|\.(test|spec)\.[^./]+$"),
    ("fixture", r"(^|/)(__fixtures__|fixtures?|mocks?|testdata)(/|$)"),
    ("migration", r"(^|/)(migrations?|prisma/migrations)(/|$)"),
)
CONTRACT = r"\.d\.[cm]?tsx?$|(^|/)(types?|contracts?|schemas?)(/|$)"
# How much a role counts for a purpose.
PURPOSES = {
    "understand": {"implementation": 0.08, "contract": 0.05, "test": -0.02, "generated": -0.15, "build-artifact": -0.2},
    "implement": {"implementation": 0.1, "contract": 0.03, "test": 0.01, "generated": -0.18, "build-artifact": -0.2},
    "review": {"implementation": 0.05, "test": 0.06, "contract": 0.02, "generated": -0.12, "build-artifact": -0.2},
    "test": {"test": 0.1, "fixture": 0.06, "implementation": 0.03, "generated": -0.15, "build-artifact": -0.2},
}
MAX_BYTES = 500 * 1024


def canonical(path: Column) -> Column:
    """Forward slashes, no ./ in front, none doubled."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/"), r"^(\./)+", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(canonical(path), "/"), -1)


def extension(path: Column) -> Column:
    """With its dot, lower case; empty for names without one and for names that begin with their only dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """The language of an extension, or null."""
    ext = extension(path)
    chain = reduce(lambda c, kv: c.when(ext.isin(*kv[1]), F.lit(kv[0])), list(LANGUAGES.items())[1:], F.when(ext.isin(*LANGUAGES["typescript"]), F.lit("typescript")))
    return chain.otherwise(F.lit(None).cast("string"))


def is_indexable(path: Column) -> Column:
    return language(path).isNotNull() | extension(path).isin(*INDEXABLE)


def file_kind(path: Column) -> Column:
    """config, doc or code."""
    ext, name = extension(path), F.lower(basename(path))
    config = ext.isin(*CONFIG_EXTENSIONS) | name.isin("package.json", "package-lock.json") | reduce(lambda a, b: a | b, (F.startswith(name, F.lit(n)) for n in CONFIG_NAMES))
    doc = ext.isin(*DOC_EXTENSIONS) | name.isin("changelog", "readme") | reduce(lambda a, b: a | b, (F.startswith(name, F.lit(n)) for n in DOC_NAMES))
    return F.when(config, F.lit("config")).when(doc, F.lit("doc")).otherwise(F.lit("code"))


def should_index(path: Column, include_docs: bool = False, include_config: bool = False) -> Column:
    kinds = ["code", *(["doc"] if include_docs else []), *(["config"] if include_config else [])]
    return is_indexable(path) & file_kind(path).isin(*kinds)


def file_role(path: Column, kind: Column | None = None) -> Column:
    low, kind = F.lower(canonical(path)), file_kind(path) if kind is None else kind
    chain = F.when(low.rlike(ROLES[0][1]), F.lit(ROLES[0][0]))
    for role, pattern in ROLES[1:]:
        chain = chain.when(low.rlike(pattern), F.lit(role))
    return chain.when(kind == "config", F.lit("configuration")).when(kind == "doc", F.lit("documentation")).when(low.rlike(CONTRACT), F.lit("contract")).otherwise(F.lit("implementation"))


def role_boost(role: Column, purpose: str = "understand", preferred: str | None = None) -> Column:
    """What a role adds to a score for a purpose, and 0.08 for the preferred role."""
    chain = F.lit(0.0)
    for name, weight in PURPOSES[purpose].items():
        chain = F.when(role == name, F.lit(weight)).otherwise(chain)
    return chain + (F.when(role == preferred, F.lit(0.08)).otherwise(F.lit(0.0)) if preferred else F.lit(0.0))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob; one without slash speaks of the base name, and dots are nothing special."""
    glob = glob.replace("\\", "/")
    if "/" not in glob:
        return "(^|/)" + _glob(glob) + "$"
    return "^" + _glob(glob.removeprefix("./")) + "$"


def glob_part(glob: str) -> str:
    """As glob_pattern, without its ends."""
    return _glob(glob)


def _glob(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{" and (end := glob.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(_glob(p) for p in glob[i + 1 : end].split(",")) + ")", end + 1
            continue
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            out, i = out + glob[i : end + 1].replace("[!", "[^"), end + 1
            continue
        out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return out


def matches_any(path: Column, globs: tuple[str, ...] | list[str]) -> Column:
    return reduce(lambda a, b: a | b, (canonical(path).rlike(glob_pattern(g)) for g in globs), F.lit(False))


def is_ignored(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether a path lies in an ignored folder or fits an ignored or excluded glob; what fits include never is."""
    folders = F.arrays_overlap(F.split(canonical(path), "/"), F.array(*map(F.lit, IGNORED_FOLDERS)))
    return (folders | matches_any(path, [*IGNORED_GLOBS, *exclude])) & ~matches_any(path, include)


def is_minified(path: Column, content: Column, long_lines: bool = True) -> Column:
    """A .min. name, or 50,000 characters and more in few or, unless long_lines is off, in very long lines."""
    lengths = F.transform(F.split(content, "\n"), F.length)
    average = F.ceil(F.length(content) / F.size(lengths))
    few, long = F.size(lengths) <= 5, (F.array_max(lengths) >= 20_000) | ((average >= 2_000) & F.exists(lengths, lambda n: n >= 10_000))
    return path.rlike(r"(?i)\.min\.(js|mjs|cjs|css)$") | ((F.length(content) >= 50_000) & (few | long if long_lines else few))


def is_readable(path: Column, content: Column) -> Column:
    """Not blank, not over MAX_BYTES, not minified."""
    return (F.octet_length(content) <= MAX_BYTES) & (F.trim(F.regexp_replace(content, r"\s+", " ")) != "") & ~is_minified(path, content)


def language_share(files: DataFrame, path: str = "path") -> DataFrame:
    """language, n, share (percent of files that have a language) in order of n."""
    counted = files.withColumn("language", language(F.col(path))).filter("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
