"""Predicates: a small algebra of conditions in groups all, any and none, compiled to one Column."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import classify

_NAME = re.compile(r"[A-Za-z_]\w*")
# Semantic kinds with their aliases.
SEMANTIC_KINDS = {
    "convexQuery": (), "convexMutation": (), "convexAction": (), "convexInternalQuery": ("convexPrivateQuery",), "convexInternalMutation": ("convexPrivateMutation",),
    "convexInternalAction": ("convexPrivateAction",), "convexHttpAction": (), "routeHandler": (), "reactComponent": (), "reactHook": (), "wrappedFunction": (),
}


@dataclass(frozen=True)
class Condition:
    """column, operator and value; operators are those of ``OPERATORS``."""

    column: str
    operator: str
    value: Any


OPERATORS = {
    "equals": lambda c, v: c == v,
    "not_equals": lambda c, v: c != v,
    "contains": lambda c, v: F.contains(c, F.lit(v)),
    "starts_with": lambda c, v: F.startswith(c, F.lit(v)),
    "ends_with": lambda c, v: F.endswith(c, F.lit(v)),
    "greater_than": lambda c, v: c > v,
    "less_than": lambda c, v: c < v,
    "at_least": lambda c, v: c >= v,
    "at_most": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
}
_LIKE = {"contains": "%{}%", "starts_with": "{}%", "ends_with": "%{}"}
_KINDS = {"equals": (str, int, float, bool), "not_equals": (str, int, float, bool), "contains": (str,), "starts_with": (str,), "ends_with": (str,), "in": (list, tuple, set), "not_in": (list, tuple, set)}


@dataclass
class Predicate:
    """(every condition of all) and (some of any) and (none of none); more groups of any are all demanded."""

    all: list[Condition] = field(default_factory=list)
    any: list[list[Condition]] = field(default_factory=list)
    none: list[Condition] = field(default_factory=list)

    def column(self, df: DataFrame, compat: bool = False) -> Column:
        """The predicate over df. Conditions on unknown columns or with values of the wrong type are left out, an empty
        ``in`` too; with compat, text operators are LIKE patterns in which % and _ keep their meaning."""
        parts = [c for x in self.all if (c := one(df, x, compat)) is not None]
        for group in self.any:
            own = [c for x in group if (c := one(df, x, compat)) is not None]
            if own:
                parts.append(reduce(lambda a, b: a | b, own))
        refused = [c for x in self.none if (c := one(df, x, compat)) is not None]
        if refused:
            parts.append(~reduce(lambda a, b: a | b, refused))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def where(self, df: DataFrame, compat: bool = False) -> DataFrame:
        return df.filter(self.column(df, compat))


def one(df: DataFrame, x: Condition, compat: bool = False) -> Column | None:
    """A condition as a Column, or None if it is left out."""
    allowed = _KINDS.get(x.operator, (int, float))
    if not _NAME.fullmatch(x.column) or x.column not in df.columns or x.operator not in OPERATORS or not isinstance(x.value, allowed):
        return None
    if isinstance(x.value, (list, tuple, set)):
        values = [v for v in x.value if isinstance(v, (str, int, float)) and not isinstance(v, bool)]
        return OPERATORS[x.operator](F.col(x.column), values) if values else None
    if compat and x.operator in _LIKE:
        return F.col(x.column).like(_LIKE[x.operator].format(x.value))
    return OPERATORS[x.operator](F.col(x.column), x.value)


# What parameters of a search may be. Names, ranges and defaults are those that callers use.
SYMBOL_TYPES = ("function", "class", "method", "type", "variable", "enum", "module")
FILE_ROLES = ("implementation", "test", "generated", "contract", "configuration", "documentation", "migration", "fixture", "build-artifact")
CHOICES = {
    "hybridMode": ("adaptive", "parallel"), "symbolType": SYMBOL_TYPES, "purpose": ("understand", "implement", "review", "test"), "preferRole": FILE_ROLES,
    "includeRole": FILE_ROLES, "excludeRole": FILE_ROLES, "resultDetail": ("minimal", "compact", "content", "diagnostic", "full"),
}
RANGES = {
    "minScore": (0.0, 1.0, float), "minComplexity": (0, None, float), "maxComplexity": (0, None, float), "maxTokens": (1, 1_000_000, int),
    "embeddingTimeoutMs": (1, 300_000, int), "latencyBudgetMs": (1, 300_000, int), "limit": (1, 500, int), "maxPerFile": (0, None, int), "maxPerSymbol": (0, None, int),
}
FLAGS = ("exact", "hybrid", "rerank", "isExported", "isAsync", "isStatic", "isAbstract", "hasDocumentation", "explainFilters", "strictParent", "strictImports", "shake", "gitChanged")
TEXTS = ("pattern", "include", "exclude", "symbol", "name", "variant", "decorator", "language", "parentScope", "imports", "semanticKind", "gitBase")
DEFAULTS = {"hybrid": True, "rerank": False, "shake": True, "limit": 10, "maxPerFile": 2, "maxPerSymbol": 2}


def checked(given: dict[str, Any]) -> dict[str, Any]:
    """Parameters of a search with defaults; ValueError names every one that is unknown, of the wrong kind or out of range."""
    faults, out = [], dict(DEFAULTS)
    for key, v in given.items():
        if v is None:
            continue
        if key == "query" or key in TEXTS:
            good = isinstance(v, str) and (key not in ("query", "language") or v.strip() != "")
            v = v.strip() if good and key == "query" else v
        elif key in FLAGS:
            good = isinstance(v, bool)
        elif key in CHOICES:
            good = v in CHOICES[key]
        elif key in RANGES:
            low, high, kind = RANGES[key]
            good = isinstance(v, (int, float) if kind is float else int) and not isinstance(v, bool) and v >= low and (high is None or v <= high)
        else:
            good = False
        if good:
            out[key] = v
        else:
            faults.append(key)
    if not str(out.get("query", "")):
        faults.append("query")
    if faults:
        raise ValueError(f"invalid parameters: {', '.join(sorted(set(faults)))}")
    return out


def equality(values: dict[str, Any]) -> Predicate:
    """A plain map of column to value."""
    return Predicate(all=[Condition(k, "equals", v) for k, v in values.items()])


def faults(rows: DataFrame, parameters: dict[str, str]) -> Column:
    """The parameters of each row that checked() would name, in order: ``parameters`` has the column of each; null is not given."""
    found = []
    for key, column in sorted(parameters.items()):
        c, kind = F.col(column), rows.schema[column].dataType.simpleString()
        if key == "query" or key in TEXTS:
            good = F.trim(c) != "" if kind == "string" and key in ("query", "language") else F.lit(kind == "string")
        elif key in FLAGS:
            good = F.lit(kind == "boolean")
        elif key in CHOICES:
            good = c.isin(*CHOICES[key]) if kind == "string" else F.lit(False)
        elif key in RANGES:
            low, high, of = RANGES[key]
            numeric = kind in ("tinyint", "smallint", "int", "bigint") or (of is float and kind in ("float", "double"))
            good = (c >= low) & (c <= high if high is not None else F.lit(True)) if numeric else F.lit(False)
        else:
            good = F.lit(False)
        bad = c.isNotNull() & ~good
        found.append(F.when(bad | c.isNull() if key == "query" else bad, F.lit(key)))
    return F.array_compact(F.array(*found, *([] if "query" in parameters else [F.lit("query")])))


def expand_kinds(text: str) -> list[str]:
    """Kinds by name or alias without regard to case; a star at the end makes it a beginning; unknown text stays itself."""
    low = text.strip().lower()
    if not low:
        return []
    fits = (lambda n: n.lower().startswith(low[:-1])) if low.endswith("*") else (lambda n: n.lower() == low)
    found = [k for k, aliases in SEMANTIC_KINDS.items() if any(map(fits, (k, *aliases)))]
    return found or ([] if low.endswith("*") else [text.strip()])


def expand_imports(text: str) -> list[str]:
    """A module name without quotes, also without its @ and as its last segment."""
    plain = text.strip().strip("'\"")
    names = [plain, plain.removeprefix("@"), plain.rsplit("/", 1)[-1]]
    return [n for n in dict.fromkeys(names) if n]


def structured(**p: Any) -> Predicate:
    """A predicate from search parameters. Several kinds are alternatives, several imports too, and both are demanded;
    a comma list of languages means any of them."""
    names = {"symbol_type": "symbolType", "is_exported": "isExported", "has_documentation": "hasDocumentation", "variant": "variant", "is_async": "isAsync", "is_static": "isStatic", "is_abstract": "isAbstract"}
    out = Predicate(all=[Condition(c, "equals", p[k]) for k, c in names.items() if p.get(k) is not None])
    if p.get("min_complexity") is not None:
        out.all.append(Condition("complexity", "at_least", p["min_complexity"]))
    if p.get("max_complexity") is not None:
        out.all.append(Condition("complexity", "at_most", p["max_complexity"]))
    for key, column in {"decorator": "decorators", "parent_scope": "parentScope", "symbol": "symbolName", "name": "symbolName"}.items():
        if p.get(key):
            out.all.append(Condition(column, "contains", p[key]))
    if p.get("language"):
        out.all.append(Condition("language", "in", [v.strip() for v in p["language"].split(",") if v.strip()]))
    if p.get("include_role"):
        out.all.append(Condition("fileRole", "equals", p["include_role"]))
    if p.get("exclude_role"):
        out.none.append(Condition("fileRole", "equals", p["exclude_role"]))
    if p.get("semantic_kind"):
        out.any.append([Condition("semanticKind", "equals", k) for k in expand_kinds(p["semantic_kind"])])
    if p.get("imports"):
        out.any.append([Condition("imports", "contains", n) for n in expand_imports(p["imports"])])
    return out


def in_scope(path: Column, include: list[str] | None = None, exclude: list[str] | None = None, under: str = "") -> Column:
    """Globs on the whole path or on the path below ``under``; without include everything is. ``under`` ignores case."""
    path = classify.canonical(path)
    prefix = under.strip("/").lower()
    below = path if not prefix else F.substring(path, F.lit(len(prefix) + 2), F.length(path))
    out = F.lit(True) if not prefix else F.startswith(F.lower(path), F.lit(prefix + "/"))
    if include:
        out = out & (classify.matches_any(path, include) | classify.matches_any(below, include))
    if exclude:
        out = out & ~(classify.matches_any(path, exclude) | classify.matches_any(below, exclude))
    return out


def strict_imports(imports: Column, modules: list[str]) -> Column:
    """Whether a whole module name is among the imports (comma-joined string), quotes and case aside."""
    own = F.transform(F.split(F.coalesce(imports, F.lit("")), ","), lambda i: F.lower(F.regexp_replace(F.trim(i), "['\"]", "")))
    return F.arrays_overlap(own, F.array(*(F.lit(m.strip().strip("'\"").lower()) for m in modules)))


def changed_only(df: DataFrame, changed: DataFrame, path: str = "file") -> DataFrame:
    """Rows of files that are among changed(path)."""
    return df.join(changed.select(classify.canonical(F.col("path")).alias("__path")).distinct(), classify.canonical(F.col(path)) == F.col("__path"), "left_semi")


def suggest(value: str, allowed: list[str]) -> str | None:
    """The nearest allowed word by edit distance, if at most half of value is wrong; None if value is allowed or nothing is near."""
    if value in allowed:
        return None

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    best = min(((distance(value.lower(), a.lower()), a) for a in allowed), default=None)
    return best[1] if best and best[0] <= -(-len(value) // 2) else None


def nearest_names(values: DataFrame, allowed: DataFrame, value: str = "value", name: str = "name", chunk: int = 1024) -> DataFrame:
    """value, suggestion, distance: the nearest of allowed by Levenshtein distance, ties by name, over all of allowed.

    Names go in arrays of about ``chunk``, each a key of an equi-join, and an array tells its nearest name, so there is
    one row for a value and array and not one for each pair. Without names there are no rows.
    """
    chunks = max(1, -(-allowed.count() // chunk))
    packed = allowed.groupBy(F.pmod(F.xxhash64(name), F.lit(chunks)).cast("int").alias("__c")).agg(F.collect_list(name).alias("__names"))
    rows = values.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(packed, "__c")
    near = F.array_min(F.transform("__names", lambda n: F.struct(F.levenshtein(F.lower(value), F.lower(n)).alias("distance"), n.alias("suggestion"))))
    return rows.groupBy(value).agg(F.min(near).alias("best")).select(value, "best.suggestion", "best.distance")
