"""Text columns: identifiers, query tokens, lexical relevance, code normal form and set similarities."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no intent in a query.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "into", "this", "that", "auth", "query", "data", "logic", "code", "flow", "impl", "service", "services",
    "store", "stores", "class", "function", "method", "module", "file", "type", "types", "use", "define", "get", "set", "has", "is", "handle",
)
# Path segments that name no domain.
GENERIC_SEGMENTS = ("src", "lib", "app", "packages", "package", "backend", "frontend")
# Domain labels by path segment and by import, the first that fits.
DOMAINS = (
    ("middleware / guards", ("middleware", "middlewares", "guard", "guards"), ()),
    ("stores / state", ("store", "stores", "state"), ("pinia", "vuex", "redux", "zustand")),
    ("services / api", ("service", "services", "api", "client", "clients"), ("axios", "fetch", "ky")),
    ("types / contracts", ("type", "types", "model", "models", "dto", "dtos", "schema", "schemas", "entity", "entities", "contract", "contracts"), ()),
    ("composables / hooks", ("composable", "composables", "hook", "hooks"), ()),
    ("endpoints / routing", ("route", "routes", "router", "controller", "controllers", "endpoint", "endpoints"), ()),
    ("persistence / data", ("repository", "repositories", "dao", "daos", "persistence", "database", "db"), ()),
    ("ui / pages", ("component", "components", "page", "pages", "view", "views", "screen", "screens"), ()),
)
# Words that normal forms of code keep, by language.
RESERVED = {
    "javascript": (
        "abstract", "any", "as", "asserts", "async", "await", "bigint", "boolean", "break", "case", "catch", "class", "const", "continue",
        "debugger", "declare", "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally", "for", "from", "function",
        "get", "if", "implements", "import", "in", "infer", "instanceof", "interface", "is", "keyof", "let", "module", "namespace", "never",
        "new", "null", "number", "object", "of", "package", "private", "protected", "public", "readonly", "require", "return", "set", "static",
        "string", "super", "switch", "symbol", "this", "throw", "true", "try", "type", "typeof", "undefined", "unknown", "var", "void", "while",
        "with", "yield", "$NUM", "$STR", "$ID",
    ),
    "python": (
        "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else", "except",
        "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try",
        "while", "with", "yield", "self", "cls", "int", "str", "float", "bool", "list", "dict", "set", "tuple", "type", "object", "print", "len",
        "range", "enumerate", "zip", "map", "filter", "sorted", "reversed", "any", "all", "isinstance", "issubclass", "hasattr", "getattr",
        "setattr", "property", "staticmethod", "classmethod", "super", "$NUM", "$STR", "$ID",
    ),
    "java": (
        "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue", "default", "do", "double",
        "else", "enum", "extends", "false", "final", "finally", "float", "for", "goto", "if", "implements", "import", "instanceof", "int",
        "interface", "long", "native", "new", "null", "package", "private", "protected", "public", "record", "return", "short", "static",
        "strictfp", "super", "switch", "synchronized", "this", "throw", "throws", "transient", "true", "try", "var", "void", "volatile",
        "while", "$NUM", "$STR", "$ID",
    ),
}
#: White space of code: ASCII's and the Unicode blanks.
_BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def identifier_tokens(text: Column) -> Column:
    """Lower-case words of identifiers: cut at camel-case humps and at everything but letters and digits."""
    parts = F.split(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), "[^A-Za-z0-9]+")
    return F.filter(parts, lambda t: t != "")


def query_tokens(query: str) -> list[str]:
    """Tokens of a query on the driver, without stop words; repeats stay."""
    cut = re.split(r"[^A-Za-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query))
    return [t.lower() for t in cut if t and t.lower() not in STOP_WORDS]


def tokens_without_stop_words(text: Column) -> Column:
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(identifier_tokens(text), lambda t: ~F.array_contains(stop, t))


def whole_word(token: str, ignore_case: bool = False) -> str:
    """A pattern for a token between characters that aren't ASCII letters, digits or underscore."""
    return ("(?i)" if ignore_case else "") + f"(?<![A-Za-z0-9_]){re.escape(token)}(?![A-Za-z0-9_])"


def lexical_relevance(tokens: list[str], content: Column, symbol: Column, path: Column) -> Column:
    """How well a row answers the tokens: 0.7 of the share that is found anywhere and 0.3 of a capped frequency,
    in which a whole word counts up to 4 times, a symbol that contains the token 3 and a path 1."""
    if not tokens:
        return F.lit(0.0)
    low, sym, file = F.lower(content), F.lower(F.coalesce(symbol, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    covered, weight = F.lit(0), F.lit(0)
    for t in tokens:
        seen = F.coalesce(F.regexp_count(low, F.lit(whole_word(t))), F.lit(0))
        in_symbol, in_path = F.contains(sym, F.lit(t)).cast("int"), F.contains(file, F.lit(t)).cast("int")
        covered = covered + ((seen > 0) | (in_symbol > 0) | (in_path > 0)).cast("int")
        weight = weight + F.least(seen, F.lit(4)) + in_symbol * 3 + in_path
    density = F.least(F.lit(1.0), weight / F.lit(float(max(3, 3 * len(tokens)))))
    return F.least(F.lit(1.0), covered / F.lit(float(len(tokens))) * 0.7 + density * 0.3)


def looks_like_identifier(query: str) -> bool:
    """A single name of 3 to 120 characters with an inner capital, an underscore, a dash, a dot or a verb in front."""
    q = query.strip()
    if not 3 <= len(q) <= 120 or not re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$.:#-]*", q) or not re.search("[A-Za-z]", q):
        return False
    return bool(re.search("[A-Z]", q[1:]) or re.search("[_.-]", q) or re.match("(use|define|get|set|is|has)[A-Z_]", q))


def looks_like_simple_identifier(query: str) -> bool:
    return 2 <= len(q := query.strip()) <= 120 and re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", q) is not None


def identifier_like(text: Column) -> tuple[Column, Column]:
    """looks_like_identifier and looks_like_simple_identifier of a column; false for null."""
    q = F.trim(text)
    name = F.length(q).between(3, 120) & q.rlike(r"\A[A-Za-z_$][A-Za-z0-9_$.:#-]*\z") & q.rlike("[A-Za-z]")
    marked = q.rlike("(?s)^.+[A-Z]") | q.rlike("[_.-]") | q.rlike(r"\A(use|define|get|set|is|has)[A-Z_]")
    simple = F.length(q).between(2, 120) & q.rlike(r"\A[A-Za-z_$][A-Za-z0-9_$]*\z")
    return F.coalesce(name & marked, F.lit(False)), F.coalesce(simple, F.lit(False))


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern matches without regard to case; a pattern that isn't valid counts as plain text."""
    try:
        re.compile(pattern)
    except re.error:
        return F.contains(F.lower(text), F.lit(pattern.lower()))
    return text.rlike(f"(?i){pattern}")


def normal_code(code: Column, language: str = "javascript") -> Column:
    """Code without comments, white space collapsed; a number becomes $NUM, a string's body $STR, and every name that the
    language doesn't reserve $ID. $NUM and $STR are names behind a dollar themselves, so they end as $$ID: a number and a
    name stay different."""
    reserved = "|".join(map(re.escape, RESERVED.get(language, RESERVED["javascript"])))
    w, any_line = "[A-Za-z0-9_]", r"[^\n\r\u2028\u2029]*"
    keep = rf"(?!(?:{reserved})(?!\$*{w}))"
    # a name begins and ends at a word's edge, so a dollar begins one only behind a word's character, and never ends one
    name = rf"(?<!{w}){keep}[A-Za-z_](?:[A-Za-z0-9_$]*{w})?|(?<={w}){keep}\$[A-Za-z0-9_$]*{w}"
    steps = (
        (rf"(?<!{w})[0-9]+[.]?[0-9]*(?:(?<={w})(?!{w})|(?<!{w})(?={w}))", r"\$NUM"),
        (r'"[^"]*"', r'"\$STR"'),
        ("'[^']*'", r"'\$STR'"),
        ("`[^`]*`", r"`\$STR`"),
        (r"(?s)/\*.*?\*/", ""),
        (f"//{any_line}", ""),
        (f"#{any_line}", ""),
        (name, r"\$ID"),
        (f"{_BLANK}+", " "),
    )
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, code))


#: Small letters whose capitals are younger than the Unicode of DuckDB's upper().
_YOUNG = "\u019b\u0264\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))


def upper_by_letter(text: Column) -> Column:
    """Capitals of DuckDB's upper(), each letter for itself and by one letter: \u00df becomes \u1e9e, where Spark's upper() gives SS, and \ufb01 stays."""
    one = lambda c: (
        F.when(c == "\u00df", F.lit("\u1e9e"))
        .when(F.contains(F.lit(_YOUNG), c), c)
        .when(F.length(F.upper(c)) == 1, F.upper(c))
        .when(F.length(F.initcap(c)) == 1, F.initcap(c))
        .otherwise(c)
    )
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), one), "")


#: What code_tokens() cuts, in Python: white space is Java's, digits are ASCII.
CODE_TOKEN = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+|[^ \t\n\x0b\f\r]")


def code_tokens(text: Column) -> Column:
    """Names, runs of digits, single other characters."""
    return F.regexp_extract_all(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*|\d+|[^\s]"), 0)


def bigram_hashes(tokens: Column) -> Column:
    """Hashes of the distinct pairs of neighbouring tokens. tokens is a column of its own: cut in the same step, they would be cut for each use."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    return F.when(n > 0, F.array_distinct(pairs)).otherwise(F.array().cast("array<bigint>"))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring tokens."""
    tokens = code_tokens(text)
    # the tokens are an argument, or they would be cut anew for each pair
    of = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(t, i - 1), F.get(t, i)))
    pairs = F.get(F.transform(F.array(tokens), of), F.lit(0))
    return F.struct(F.size(tokens).alias("n"), F.when(F.size(tokens) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>")).alias("pairs"))


def bigram_similarity(a: Column, b: Column, text_a: Column, text_b: Column) -> Column:
    """Jaccard of two bigram structs times the root of the shorter over the longer; 1 for equal texts, null without tokens."""
    short, long = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    return F.when(short == 0, F.lit(None).cast("double")).when(text_a == text_b, F.lit(1.0)).otherwise(jaccard(a["pairs"], b["pairs"]) * F.sqrt(short / long))


def text_similarity(a: Column, b: Column) -> Column:
    return bigram_similarity(bigrams(a), bigrams(b), a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over the union of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def path_segments(path: Column) -> Column:
    """Segments of a path, without those that name no domain."""
    generic = F.array(*map(F.lit, GENERIC_SEGMENTS))
    return F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda s: (s != "") & (s != ".") & ~F.array_contains(generic, F.lower(s)))


def path_similarity(a: Column, b: Column) -> Column:
    """Leading segments that two paths share over the segments of the longer."""
    x, y = (F.filter(F.split(p, "/"), lambda s: s != "") for p in (a, b))
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
    lead = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    longest = F.greatest(F.size(x), F.size(y))
    return F.when(longest > 0, lead / longest).otherwise(F.lit(0.0))


def metadata_similarity(pairs: list[tuple[Column, Column]]) -> Column:
    """Mean agreement over the attributes that either side has; 0 if there are none."""
    has = [((F.coalesce(a, F.lit("")) != "") | (F.coalesce(b, F.lit("")) != "")).cast("int") for a, b in pairs]
    same = [((F.coalesce(a, F.lit("")) != "") & a.eqNullSafe(b)).cast("int") for a, b in pairs]
    n = reduce(lambda p, q: p + q, has)
    return F.when(n > 0, reduce(lambda p, q: p + q, same) / n).otherwise(F.lit(0.0))


def import_hints(imports: Column) -> Column:
    """Last segment of each import, lower case."""
    return F.transform(imports, lambda i: F.lower(F.element_at(F.split(i, "/"), -1)))


def domain_label(path: Column, hints: Column | None = None, symbol_type: Column | None = None) -> Column:
    """The first domain that a segment or an import speaks for; else by symbol type; else the directory's own name."""
    segments = F.transform(path_segments(path), F.lower)
    chain = None
    for label, names, imports in DOMAINS:
        fits = F.arrays_overlap(segments, F.array(*map(F.lit, names)))
        if imports and hints is not None:
            fits = fits | F.arrays_overlap(hints, F.array(*map(F.lit, imports)))
        chain = F.when(fits, F.lit(label)) if chain is None else chain.when(fits, F.lit(label))
    if symbol_type is not None:
        chain = chain.when(symbol_type.isin("type", "enum"), F.lit("types / contracts"))
    named = path_segments(path)
    own = F.coalesce(F.get(named, F.size(named) - 2), F.get(named, F.size(named) - 1))
    return chain.when(own.isNull(), F.lit("related code")).otherwise(F.concat(F.lit("domain / "), F.regexp_replace(own, "[-_]", " ")))


def common_prefix(names: Column) -> Column:
    """The longest beginning that all strings of an array share, without dashes and underscores at its end."""
    first = F.element_at(names, 1)
    lengths = F.filter(F.sequence(F.lit(0), F.length(first)), lambda n: F.forall(names, lambda v: F.startswith(v, F.substring(first, F.lit(1), n))))
    return F.regexp_replace(F.substring(first, F.lit(1), F.array_max(lengths)), "[_-]+$", "")
