"""Cutting files into chunks: prose, code by boundaries, Python by its syntax tree, brace languages by a small scanner.

Parsing needs the whole of a file and nothing else, so it runs as mapInPandas over rows of files; everything that can be
said about a chunk by its text is a column afterwards.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import statements

# Sizes in tokens of four characters; the smaller ones are for models with a short input.
CHARS, SAFETY = 4, 0.85
TARGETS = {"simple": 1800, "medium": 1200, "complex": 800, "max": 2200, "min": 50, "overlap": 96}
SMALL_TARGETS = {"simple": 1200, "medium": 850, "complex": 600, "max": 1600, "min": 50, "overlap": 96}
# Longest inputs of embedding models by name, then by provider.
MODEL_TOKENS = (("qwen3-embedding", 32768), ("qwen3_embedding", 32768), ("text-embedding-3", 8191), ("text-embedding-ada", 8191), ("cohere.embed", 8192), ("embed-v4", 8192))
PROVIDER_TOKENS = {"gemini": 2048, "ollama": 32768}
# Beginnings of lines at which code may be cut.
BOUNDARIES = (
    r"(export\s+)?(async\s+)?function\s+\w+", r"(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s+)?\(", r"(export\s+)?class\s+\w+", r"(export\s+)?interface\s+\w+",
    r"(export\s+)?type\s+\w+", r"(export\s+)?enum\s+\w+", r"(export\s+)?namespace\s+\w+", r"def\s+\w+", r"class\s+\w+", r"func\s+\w+", r"fn\s+\w+", r"impl\s+",
)
_BOUNDARY = re.compile("|".join(f"(?:{b})" for b in BOUNDARIES))


@dataclass(frozen=True)
class Limits:
    """Characters of a chunk; sizes are those of code that branches little, more and much."""

    max: int
    min: int
    overlap: int
    sizes: tuple[int, int, int] = ()

    def fitting(self, score: int) -> int:
        return (self.sizes[0] if score < 5 else self.sizes[1] if score < 15 else self.sizes[2]) if self.sizes else self.max


def limits(model: str = "", provider: str = "", max_tokens: int | None = None) -> Limits:
    known = max_tokens or next((n for name, n in MODEL_TOKENS if name in model.lower()), PROVIDER_TOKENS.get(provider, 8192))
    usable = max(1, int(known * SAFETY))
    t = SMALL_TARGETS if usable < TARGETS["max"] else TARGETS
    most = min(t["max"], usable)
    sizes = tuple(min(t[k], most) * CHARS for k in ("simple", "medium", "complex"))
    return Limits(most * CHARS, min(t["min"], most) * CHARS, max(1, min(t["overlap"], int(most * 0.15))) * CHARS, sizes)


@dataclass(frozen=True)
class Chunk:
    """A piece of a file: lines from 1, both ends inside."""

    content: str
    start: int
    end: int
    type: str = "code"
    symbol: str = ""
    symbol_type: str = ""
    variant: str = ""
    parent: str = ""
    depth: int = 0
    exported: bool = False
    is_async: bool = False
    is_static: bool = False
    is_abstract: bool = False
    documented: bool = False
    complexity: int = 0
    decorators: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    calls: tuple[str, ...] = ()
    score: int = 0  # branches as the language's definition counts them, from 0


@dataclass(frozen=True)
class Region:
    """Lines that can be folded: all behind the signature."""

    type: str
    name: str
    start: int
    end: int
    signature_end: int
    indentation: str = ""


@dataclass
class Parsed:
    chunks: list[Chunk] = field(default_factory=list)
    regions: list[Region] = field(default_factory=list)


def split_oversized(c: Chunk, lim: Limits) -> list[Chunk]:
    """Whole lines are packed as long as they fit; a line that is too long is sliced, with the overlap between slices."""
    if len(c.content) <= lim.max:
        return [c]
    out: list[Chunk] = []
    held: list[str] = []
    size, begin = 0, c.start

    def close(at: int) -> None:
        if held:
            out.append(replace(c, content="\n".join(held), start=begin, end=at - 1))
            held.clear()

    for n, line in enumerate(c.content.split("\n"), c.start):
        n = min(n, c.end)
        if held and size + 1 + len(line) > lim.max:
            close(n)
        if len(line) > lim.max:
            step = max(1, lim.max - lim.overlap)
            out += [replace(c, content=line[i : i + lim.max], start=n, end=n) for i in range(0, len(line), step)]
            continue
        if not held:
            begin, size = n, -1
        held.append(line)
        size += 1 + len(line)
    close(c.end + 1)
    return [x for x in out if x.content]


def text_chunks(content: str, lim: Limits) -> list[Chunk]:
    """Prose: a heading begins a chunk, and so does a blank line once half the size is reached; short rests are dropped."""
    lines = content.split("\n")
    out: list[Chunk] = []
    held: list[str] = []
    size, begin = 0, 0

    def close(end: int, nxt: int) -> None:
        nonlocal size, begin
        out.append(Chunk("\n".join(held), begin + 1, end, "text"))
        held.clear()
        size, begin = 0, nxt

    for i, line in enumerate(lines):
        blank = not line.strip()
        length = max(0, size - 1)
        if held and length >= lim.min and (re.match(r"#{1,6}\s", line) or (blank and length > lim.max / 2)):
            close(i, i)
        if held or not blank:
            held.append(line)
            size += len(line) + 1
        if size - 1 > lim.max:
            close(i + 1, i + 1)
    if held and size - 1 >= lim.min:
        close(len(lines), len(lines))
    return [p for c in out for p in split_oversized(c, lim)]


def boundary_chunks(content: str, lim: Limits) -> list[Chunk]:
    """Code of any language: cut before a declaration that stands outside of braces."""
    out: list[Chunk] = []
    held: list[str] = []
    depth = size = begin = 0
    lines = content.split("\n")
    inside = False
    for i, line in enumerate(lines):
        if held and not inside and _BOUNDARY.match(line.strip()):
            if size - 1 >= lim.min:
                out.append(Chunk("\n".join(held), begin + 1, i))
            held, size, begin = [], 0, i
        depth += line.count("{") - line.count("}")
        inside = depth > 0
        held.append(line)
        size += len(line) + 1
        if size - 1 > lim.max:
            out.append(Chunk("\n".join(held), begin + 1, i + 1))
            held, size, begin = [], 0, i + 1
    if held and size - 1 >= lim.min:
        out.append(Chunk("\n".join(held), begin + 1, len(lines)))
    return [p for c in out for p in split_oversized(c, lim)]


# Python


def _python_variant(node: ast.AST, bases: list[str], decorators: list[str]) -> str:
    if isinstance(node, ast.ClassDef):
        by_base = {"Enum": "enum", "IntEnum": "enum", "StrEnum": "enum", "Protocol": "protocol", "TypedDict": "typedDict", "NamedTuple": "namedTuple", "ABC": "abstract"}
        if any(d.split(".")[-1] == "dataclass" for d in decorators):
            return "dataclass"
        return next((by_base[b.split(".")[-1]] for b in bases if b.split(".")[-1] in by_base), "class")
    for d in decorators:
        if (name := d.split(".")[-1]) in ("property", "staticmethod", "classmethod"):
            return name
    return "async" if isinstance(node, ast.AsyncFunctionDef) else "function"


def python_complexity(node: ast.AST) -> int:
    """1 and one for every branch, loop, handler, condition of a comprehension and further operand of and/or."""
    total = 1
    for n in ast.walk(node):
        if isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.With, ast.AsyncWith, ast.Assert, ast.match_case)):
            total += 1
        elif isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
        elif isinstance(n, ast.comprehension):
            total += len(n.ifs)
    return total


def python_parsed(content: str, lim: Limits, least: int = 50) -> Parsed:
    """Functions and classes of a module and the members of its classes."""
    tree = ast.parse(content)
    lines = content.split("\n")
    out = Parsed()
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)

    def visit(node: ast.AST, parent: str, depth: int) -> None:
        for n in ast.iter_child_nodes(node):
            if not isinstance(n, kinds):
                continue
            decorators = [ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in n.decorator_list]
            is_class = isinstance(n, ast.ClassDef)
            bases = [ast.unparse(b) for b in n.bases] if is_class else []
            start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
            variant = _python_variant(n, bases, decorators)
            body = "\n".join(lines[start - 1 : n.end_lineno])
            if len(body) >= least:
                kind = "enum" if variant == "enum" else "type" if variant in ("protocol", "typedDict") else "class" if is_class else "method" if parent else "function"
                out.chunks.append(
                    Chunk(
                        body, start, n.end_lineno, "code", n.name, kind, variant, parent, depth, not n.name.startswith("_"), isinstance(n, ast.AsyncFunctionDef),
                        variant in ("staticmethod", "classmethod"), variant == "abstract" or any(d.endswith("abstractmethod") for d in decorators),
                        ast.get_docstring(n) is not None, python_complexity(n), tuple(f"@{d}" for d in decorators), score=statements.python_score(n),
                    )
                )
            if not is_class and n.end_lineno > max(n.lineno, n.body[0].lineno - 1):
                out.regions.append(Region("method" if parent else "function", n.name, start, n.end_lineno, max(n.lineno, n.body[0].lineno - 1), re.match(r"\s*", lines[n.lineno - 1])[0]))
            if is_class:
                visit(n, n.name, depth + 1)

    visit(tree, "", 0)
    out.chunks = [p for c in out.chunks for p in split_oversized(c, lim)]
    return out


# Brace languages


#: What may begin a string, a template, a regular expression or a comment, and what each goes on with; a line ends all but templates.
_OPENS = re.compile("[\"'`/]")
_INSIDE = {
    '"': re.compile(r'(?:[^"\\\n]++|\\(?:.|\Z))*+', re.DOTALL),
    "'": re.compile(r"(?:[^'\\\n]++|\\(?:.|\Z))*+", re.DOTALL),
    "`": re.compile(r"(?:[^`\\]++|\\(?:.|\Z))*+", re.DOTALL),
    "/": re.compile(r"(?:[^/\\\n\[]++|\\(?:.|\Z)|\[(?:[^\]\\\n]++|\\(?:.|\Z))*+(?:\]|(?=\n)|\Z))*+", re.DOTALL),
}


@lru_cache(maxsize=16)
def blanked(code: str) -> str:
    """Code of the same length in which strings, templates, regular expressions and comments are blanks; line breaks stay."""
    out: list[str] = []
    i, n, done, before = 0, len(code), 0, ""
    while m := _OPENS.search(code, i):
        at, c = m.start(), m[0]
        before = code[i:at].rstrip()[-1:] or before
        if code.startswith("//", at):
            begin, end = at, code.find("\n", at)
            i = end = n if end < 0 else end
        elif code.startswith("/*", at):
            begin, end = at, code.find("*/", at + 2)
            i = end = n if end < 0 else end + 2
        elif c != "/" or (before in "(,=:[!&|?{};\n" and "\n" not in code[at : code.find("/", at + 1) + 1]):
            begin, end = at + 1, _INSIDE[c].match(code, at + 1).end()
            before, i = c, end + 1
        else:
            before, i = c, at + 1
            continue
        out += code[done:begin], "\n".join(" " * len(t) for t in code[begin:end].split("\n"))
        done = end
    return "".join(out) + code[done:]


_BRACES, _PARENTHESES = re.compile("[{}]"), re.compile("[()]")


def matching(code: str, at: int) -> int:
    """The place of the brace that closes the one at ``at``; the end if none does."""
    depth = 0
    if at < len(code) and code[at] not in "{}":
        return at
    for m in _BRACES.finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(code) - 1


_MODIFIERS = r"(?P<mods>(?:(?:export|default|declare|public|private|protected|static|abstract|async|final|readonly|override|synchronized|native|sealed)\s+)*)"
_DECLARED = re.compile(
    rf"(?:^|(?<=[{{;}}]))[ \t]*(?P<deco>(?:@[\w.]+(?:\([^()\n]*\))?\s+)*){_MODIFIERS}(?:(?P<kind>class|interface|enum|namespace|module|record|@interface|function\*?|type)\s+(?P<name>[A-Za-z_$][\w$]*)"
    r"|(?:const|let|var)\s+(?P<var>[A-Za-z_$][\w$]*)(?:\s*:[^=\n]+)?\s*=)",
    re.MULTILINE,
)
_MEMBER = re.compile(
    rf"(?:^|(?<=[{{;}}]))[ \t]*(?P<deco>(?:@[\w.]+(?:\([^()\n]*\))?\s+)*){_MODIFIERS}(?:(?:get|set)\s+)?(?P<ret>[\w$<>\[\],.? ]+\s+)?(?P<name>[A-Za-z_$#][\w$]*)\s*(?:<[^>{{}}()]*>)?\((?P<args>[^{{}};]*)\)[^{{}};=]*\{{", re.MULTILINE
)
_NO_MEMBER = {"if", "for", "while", "switch", "catch", "return", "function", "new", "else", "do", "try", "super", "synchronized"}
_BRANCH = re.compile(r"\b(if|for|while|case|catch)\b|\?(?![.?:])")
_TYPES = {"class": "class", "interface": "type", "enum": "enum", "namespace": "module", "module": "module", "record": "class", "@interface": "type", "type": "type"}


def brace_complexity(code: str) -> int:
    """1 and one for every branch, loop, case, handler and conditional."""
    return 1 + len(_BRANCH.findall(blanked(code)))


#: Words that may stand right before a call.
_BEFORE_CALL = {"return", "await", "yield", "throw", "new", "else", "do", "in", "of", "case", "typeof", "delete", "void", "default", "and", "or", "not", "if", "instanceof"}


def call_targets(code: str, most: int = 200) -> list[str]:
    """Distinct names and member chains that are called; a name before a body, behind a type or behind ``function`` is declared, not called."""
    code, found = blanked(code), []
    for m in re.finditer(r"(?<![\w$.])([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(", code):
        if m[1].split(".")[-1] in _NO_MEMBER or m[1] in ("import", "typeof"):
            continue
        before = re.search(r"([A-Za-z_$][\w$]*|[>\]])[ \t]+$", code[max(0, m.start() - 80) : m.start()])
        if before and before[1] not in _BEFORE_CALL:
            continue
        depth, at = 0, len(code)
        for p in _PARENTHESES.finditer(code, m.end() - 1):
            depth += 1 if p[0] == "(" else -1
            if not depth:
                at = p.end()
                break
        if "." not in m[1] and re.match(r"\s*(?::[^;{}=()]+|throws[\s\w.,]+)?\{", code[at : at + 200]):
            continue
        found.append(m[1])
    return list(dict.fromkeys(found))[:most]


def import_list(code: str) -> dict[str, list[str]]:
    """Module -> names that it gives, of ES imports (over several lines too), require calls, Python and Java imports."""
    out: dict[str, list[str]] = {}
    for m in re.finditer(r"^\s*import\s+(?:type\s+)?(?:([\w$*{}\s,]+?)\s+from\s+)?['\"]([^'\"]+)['\"]", code, re.MULTILINE):
        out.setdefault(m[2], []).extend(re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"\b(as|type)\b", " ", m[1] or "")))
    for m in re.finditer(r"(?:const|let|var)\s+([\w${},\s:]+?)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", code):
        out.setdefault(m[2], []).extend(re.findall(r"[A-Za-z_$][\w$]*", m[1]))
    for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", code, re.MULTILINE):
        out.setdefault(m[1], []).append(m[1].rsplit(".", 1)[-1])
    return out


def used_imports(code: str, imports: dict[str, list[str]]) -> tuple[str, ...]:
    """Modules of which a name occurs in the code, or that give none."""
    return tuple(m for m, names in imports.items() if not names or any(re.search(rf"(?<![\w$]){re.escape(n)}(?![\w$])", code) for n in names))


#: A field of a Java class: modifiers, a type and names, with or without values.
_FIELD = re.compile(rf"(?P<deco>(?:@[\w.]+(?:\([^()\n]*\))?\s+)*){_MODIFIERS}(?P<type>[\w$][\w$.]*(?:\s*<[^;=()]*>)?(?:\s*\[\])*)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?:[=,\[][^;]*)?;")


def merged(chunks: list[Chunk], most: int = 200) -> list[Chunk]:
    """Small declarations of variables that aren't exported go to the front of the next chunk if that names them."""
    out: list[Chunk] = []
    for c in chunks:
        d = out[-1] if out else None
        if d and d.symbol and d.variant in ("const", "arrow") and not d.exported and not d.parent and len(d.content) <= most and d.symbol in c.content:
            out[-1] = replace(c, content=f"{d.content}\n\n{c.content}", start=min(d.start, c.start))
        else:
            out.append(c)
    return out


def brace_parsed(content: str, lim: Limits, first_line: int = 1, java: bool = False) -> Parsed:
    """Top-level declarations of TypeScript, JavaScript or Java, and the members of classes, interfaces and namespaces.

    But for Java, what is larger than its branches let it be is cut: functions, methods and namespaces by statements, classes
    before their first method; and small variables are merged with the chunk behind them."""
    code, out, imports = blanked(content), Parsed(), import_list(content)
    least = 20 if java else 1  # a fixed value
    line_of = lambda at: first_line + content.count("\n", 0, at)

    def add(m: re.Match, at: int, end: int, name: str, kind: str, variant: str, parent: str, depth: int) -> None:
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        body = content[begin : end + 1]
        words = set(m["mods"].split())
        documented = content[:begin].rstrip().endswith("*/")
        score = statements.score(code[begin : end + 1], "java" if java else "indexer")
        most, pieces = lim.fitting(score), [(body, line_of(begin), line_of(end))]
        if not java and len(body) > most and code[at] == "{":
            if kind in ("function", "method", "module"):
                pieces = [(t, x + first_line, y + first_line) for t, x, y in statements.dealt(content, code, begin, at, end, name, most)]
            elif kind == "class" and (first := next((x for x in _MEMBER.finditer(code, at + 1, end) if x["name"] not in _NO_MEMBER), None)):
                cut = first.start() + len(first[0]) - len(first[0].lstrip())
                cut = content.rfind("\n", 0, cut) + 1
                if cut > begin:
                    pieces = [(content[begin : cut - 1], line_of(begin), line_of(cut - 1))]
        branches = brace_complexity(body)
        for text, x, y in pieces if len(body) >= least else ():
            out.chunks.append(
                Chunk(
                    text, x, y, "code", name, kind, variant, parent, depth, bool({"export", "public"} & words), "async" in words or bool(re.match(r"[^{]*=\s*async\b", body)),
                    "static" in words, "abstract" in words, documented, branches, tuple(re.findall(r"@[\w.]+", m["deco"] or "")), used_imports(text, imports), tuple(call_targets(text)), score,
                )
            )
        if kind in ("function", "method") and line_of(end) > line_of(at):
            out.regions.append(Region("constructor" if name == "constructor" or name == parent else kind, name, line_of(begin), line_of(end), line_of(at), re.match(r"[ \t]*", m[0])[0]))

    def scan(a: int, b: int, parent: str, depth: int) -> None:
        at = a
        while m := _DECLARED.search(code, at, b):
            name, kind = m["name"] or m["var"], m["kind"] or "var"
            brace, semicolon = code.find("{", m.end(), b), code.find(";", m.end(), b)
            opened = brace >= 0 and (semicolon < 0 or brace < semicolon or kind.startswith("function"))
            end = matching(code, brace) if opened else (semicolon if semicolon >= 0 else b - 1)
            if kind == "var":
                arrow = re.match(r"\s*(?:async\s*)?(?:function\b|\(|[\w$]+\s*=>)", code[m.end() :]) is not None
                end = next((y - 1 for _, y in statements.statements(code, m.start("var"), b, 1)), end)
                add(m, brace if opened and brace < end else m.start(), end, name, "function" if arrow else "variable", "arrow" if arrow else "const", parent, depth)
            elif kind.startswith("function"):
                add(m, max(brace, m.start()), end, name, "function", "async" if "async" in m["mods"] else "function", parent, depth)
            else:
                add(m, max(brace, m.start()), end, name, _TYPES[kind], "abstract" if "abstract" in m["mods"] else kind.lstrip("@"), parent, depth)
                if opened and kind in ("namespace", "module"):
                    scan(brace + 1, end, name, depth + 1)
                elif opened and kind in ("class", "interface", "record", "enum"):
                    members(brace + 1, end, name, depth + 1)
            at = end + 1

    def members(a: int, b: int, parent: str, depth: int) -> None:
        at = a
        while m := _MEMBER.search(code, at, b):
            brace = m.end() - 1
            end = matching(code, brace)
            if m["name"] not in _NO_MEMBER and code[a : m.start()].count("{") == code[a : m.start()].count("}"):
                variant = next((w for w in ("static", "abstract", "async") if w in m["mods"].split()), "constructor" if m["name"] in ("constructor", parent) else "method")
                add(m, brace, end, m["name"], "method", variant, parent, depth)
            at = end + 1
        for x, y in statements.statements(code, a, b) if java else ():
            if (m := _FIELD.fullmatch(code, x, y)) and m["type"] not in ("return", "throw", "package", "import"):
                add(m, x, y - 1, m["name"], "variable", "field", parent, depth)

    scan(0, len(content), "", 0)
    out.chunks = sorted(out.chunks, key=lambda c: (c.start, -c.end)) if java else merged(out.chunks)
    out.chunks = [p for c in out.chunks for p in split_oversized(c, lim)]
    return out


def test_chunks(content: str, lim: Limits) -> list[Chunk]:
    """One chunk for every describe, it and test call, named by its titles from the outside in."""
    code = blanked(content)
    calls = []
    for m in re.finditer(r"(?<![\w$.])(?:describe|it|test)(?:\.\w+)?\s*\(\s*(['\"`])", code):
        title_end = code.find(m[1], m.end())
        brace = code.find("{", title_end)
        if title_end > 0 and brace > 0:
            calls.append((m.start(), matching(code, brace), content[m.end() : title_end]))
    out = []
    for a, b, title in calls:
        names = [t for x, y, t in calls if x <= a and y >= b]
        out.append(Chunk(content[a : b + 1], content.count("\n", 0, a) + 1, content.count("\n", 0, b) + 1, "code", " > ".join(names), "function", "test", names[-2] if len(names) > 1 else ""))
    return [p for c in out for p in split_oversized(c, lim)]


def vue_parsed(content: str, name: str, lim: Limits) -> Parsed:
    """A chunk of the component, then the symbols of its script blocks in lines of the file."""
    out = Parsed([Chunk(content, 1, content.count("\n") + 1, "code", name, "class", "component", exported=True, imports=tuple(import_list(content)))])
    for m in re.finditer(r"<script\b[^>]*>(.*?)</script>", content, re.DOTALL):
        inner = brace_parsed(m[1], lim, first_line=content.count("\n", 0, m.start(1)) + 1)
        out.chunks += [replace(c, parent=c.parent or name) for c in inner.chunks]
        out.regions += inner.regions
    out.chunks = [p for c in out.chunks for p in split_oversized(c, lim)]
    return out


#: Chunkers of further languages by extension: (content, path, limits) -> Parsed.
_PLUGINS: dict[str, object] = {}


def register(extensions: list[str], chunker, replace_known: bool = False) -> None:
    """Have files of these extensions cut by chunker; an extension that is taken already is an error unless replaced."""
    taken = [e for e in extensions if e in _PLUGINS]
    if taken and not replace_known:
        raise ValueError(f"extensions are taken: {taken}")
    _PLUGINS.update(dict.fromkeys(extensions, chunker))


def parse(path: str, content: str, lim: Limits | None = None, plugins: dict[str, object] | None = None) -> Parsed:
    """Chunks and regions of a file; what can't be parsed is cut by boundaries, and a short file is one chunk."""
    lim, plugins = lim or limits(), _PLUGINS if plugins is None else plugins
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ext in plugins:  # what a blank file has is its chunker's to say
        return plugins[ext](content, path, lim)
    if not content.strip():
        return Parsed()
    prose = ext in ("", ".md", ".mdx", ".txt", ".rst")
    out = Parsed()
    try:
        if ext in (".py", ".pyi"):
            out = python_parsed(content, lim)
        elif ext == ".vue":
            out = vue_parsed(content, name.rsplit(".", 1)[0], lim)
        elif re.search(r"\.(test|spec)\.[cm]?[jt]sx?$", name):
            out = Parsed(test_chunks(content, lim), brace_parsed(content, lim).regions)
        elif ext in (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".java"):
            out = brace_parsed(content, lim, java=ext == ".java")
    except (SyntaxError, ValueError, RecursionError):
        out = Parsed()
    if not out.chunks:
        whole = [Chunk(content, 1, content.count("\n") + 1, "text" if prose else "code")]
        out.chunks = (text_chunks if prose else boundary_chunks)(content, lim) if len(content) >= lim.min else whole
        out.chunks = out.chunks or [p for c in whole for p in split_oversized(c, lim)]
    return out


_SCHEMA = (
    "file string, chunk_index int, content string, start int, end int, type string, symbol string, symbol_type string, variant string, parent string, depth int, exported boolean, "
    "is_async boolean, is_static boolean, is_abstract boolean, documented boolean, complexity int, decorators array<string>, imports array<string>, calls array<string>, score int"
)
_REGIONS = "file string, type string, name string, start int, end int, signature_end int, indentation string"


#: Files and characters whose chunks are held at once, however large the batches are.
SOME_FILES, SOME_CHARS = 500, 4_000_000


def some_files(paths: pd.Series, texts: pd.Series) -> Iterator[tuple[pd.Series, pd.Series]]:
    """Pieces of a batch of few files and few characters; a larger file is alone."""
    begin = chars = 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if i - begin >= SOME_FILES or (i > begin and chars + size > SOME_CHARS):
            yield paths[begin:i], texts[begin:i]
            begin, chars = i, 0
        chars += size
    yield paths[begin:], texts[begin:]


def chunk_files(files: DataFrame, lim: Limits | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """One row a chunk of files(path, text); a null text has none, nor has a blank one unless a registered chunker gives it any."""
    lim, plugins = lim or limits(), dict(_PLUGINS)  # the driver's go along to the workers
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(frames: Iterator) -> Iterator:
        for p, t in ((p, t) for frame in frames for p, t in some_files(frame[path], frame[text])):
            rows = [(f, i, *vars(c).values()) for f, x in zip(p, t, strict=True) if x is not None for i, c in enumerate(parse(f or "", x, lim, plugins).chunks)]
            yield pd.DataFrame(rows, columns=names)

    return files.select(path, text).mapInPandas(run, _SCHEMA)


def scored(chunks: DataFrame, definition: str, content: str = "content") -> DataFrame:
    """chunks with score by another definition of statements.score: indexer, language or java; 0 for null."""
    statements.score("", definition)  # an unknown one is an error here, not in a task

    @F.pandas_udf("int")
    def branches(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: statements.score(blanked(t or ""), definition)).astype("int32")

    return chunks.withColumn("score", branches(content))


def fold_regions(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row a region that can be folded."""
    plugins = dict(_PLUGINS)

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            rows = [{"file": p, **asdict(r)} for p, t in zip(frame[path], frame[text], strict=True) if t is not None for r in parse(p or "", t, None, plugins).regions]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _REGIONS.split(", ")])

    return files.select(path, text).mapInPandas(run, _REGIONS)


def with_overlap(chunks: DataFrame, lim: Limits | None = None, file: str = "file", order: str = "chunk_index", content: str = "content") -> DataFrame:
    """chunks with overlapped: "..." and the end of the chunk before, as long as size, 15 percent and the limit allow."""
    lim = lim or limits()
    before = F.lag(content).over(Window.partitionBy(file).orderBy(order))
    own = F.floor(F.ceil(F.length(content) / F.lit(CHARS)) * F.lit(0.15)).cast("int") * CHARS
    size = F.greatest(F.lit(0), F.least(F.lit(lim.overlap), F.lit(lim.max - 5) - F.length(content), own)).cast("int")
    tail = F.when(F.length(before) <= size, before).otherwise(F.substring(before, F.length(before) - size + 1, size))
    return chunks.withColumn("overlapped", F.when(before.isNotNull() & (size > 0) & (before != ""), F.concat(F.lit("..."), tail, F.lit("\n\n"), F.col(content))).otherwise(F.col(content)))


def semantic_kind(path: Column, symbol: Column, symbol_type: Column, content: Column) -> Column:
    """What a chunk is in its framework, the first that fits; null if nothing does."""
    out = F.when(symbol.rlike("^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)$") & F.contains(content, F.lit("export")) & path.rlike(r"(^|/)route\.[cm]?[jt]sx?$"), "routeHandler")
    for wrapper, kind in (("internalMutation", "convexInternalMutation"), ("internalAction", "convexInternalAction"), ("internalQuery", "convexInternalQuery"), ("httpAction", "convexHttpAction"), ("mutation", "convexMutation"), ("action", "convexAction"), ("query", "convexQuery")):
        out = out.when(content.rlike(rf"^(?:export\s+)?(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*=\s*{wrapper}\s*\("), kind)
    callable_ = symbol_type.isin("function", "variable")
    out = out.when(symbol.rlike("^use[A-Z0-9]") & callable_, "reactHook")
    out = out.when(symbol.rlike("^[A-Z][A-Za-z0-9]*$") & callable_ & content.rlike(r"(return|=>)\s*\(?\s*<"), "reactComponent")
    return out.when(callable_ & content.rlike(r"^(?:export\s+)?(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*=\s*[A-Za-z_$][\w$]*\s*\("), "wrappedFunction")


# Tags by what a text mentions, and names before a parenthesis that are no calls.
TAGS = (
    ("async", r"async |await "),
    ("error-handling", r"throw |catch\s*\("),
    ("test", r"(?<![A-Za-z0-9_])(?:test|describe|it|expect)\("),
    ("http", r"(?i)(?<![A-Za-z0-9_])(?:fetch|http|api|request|response)(?![A-Za-z0-9_])"),
    ("filesystem", r"(?<![A-Za-z0-9_])(?:readFile|writeFile|readdir|unlink|mkdir|Bun\.file)(?![A-Za-z0-9_])"),
    ("database", r"(?i)(?<![A-Za-z0-9_])(?:query|database|sql|insert|update|delete|select)(?![A-Za-z0-9_])"),
)
NO_CALLS = ("if", "for", "while", "switch", "catch", "function", "async", "await", "return", "throw", "new", "typeof", "instanceof")


def keywords(content: Column, name: Column | None = None) -> Column:
    """A chunk's name, the parameters and the result of its documentation, tags by what it mentions, up to five calls and types and three modules that it imports itself."""
    doc = F.regexp_extract(content, r"(?s)/\*\*(.*?)\*/", 1)
    params = F.transform(F.regexp_extract_all(doc, F.lit(r"@param\s+(?:\{[^}]+\}\s+)?([A-Za-z0-9_]+)"), 1), lambda p: F.concat(F.lit("param:"), p))
    result = F.regexp_extract(doc, r"@returns?\s+(?:\{([^}]+)\})?", 1)
    called = F.array_distinct(F.regexp_extract_all(content, F.lit(r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1))
    calls = F.slice(F.filter(called, lambda c: ~c.isin(*NO_CALLS) & (F.length(c) > 2)), 1, 5)
    named = F.lit(None).cast("string") if name is None else F.when(name != "", name)
    single = F.array_compact(F.array(F.when(result != "", F.concat(F.lit("returns:"), result)), *(F.when(content.rlike(p), F.lit(t)) for t, p in TAGS)))
    found = F.regexp_extract_all(content, F.lit(r":\s*([A-Z][a-zA-Z0-9]*(?:<[^>]+>)?(?:\[\])?)"), 1)
    types = F.slice(F.filter(F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, r"<.*>|\[\]", ""))), lambda t: F.length(t) > 1), 1, 5)
    modules = F.slice(F.array_distinct(F.regexp_extract_all(content, F.lit(r"(?m)^\s*import\s[^'\"]*['\"]([^'\"]+)['\"]"), 1)), 1, 3)
    listed = lambda label, names: F.when(F.size(names) > 0, F.concat(F.lit(label), F.array_join(names, ",")))
    return F.concat(F.array_compact(F.array(named)), params, single, F.array_compact(F.array(listed("calls:", calls), listed("types:", types), listed("imports:", modules))))


def import_lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """file, module, line: ES imports that give names, over several lines too, as lines for with_header."""
    found = F.regexp_extract_all(text, F.lit(r"""(?m)^[ \t]*(import\s+[\w$*{}\s,]+?\sfrom\s*['"][^'"\n]+['"];?)"""), 1)
    line = F.regexp_replace(F.col("__line"), r"\s*\n\s*", " ")
    each = files.select(F.col(path).alias("file"), F.explode(found).alias("__line"))
    return each.select("file", F.regexp_extract("__line", r"""['"]([^'"]+)['"];?$""", 1).alias("module"), line.alias("line"))


def with_header(chunks: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """chunks with contextual: comment lines that tell file, type, name, exported and keywords, then the import lines of the
    modules that the chunk uses (imports: file, module, line; lines of one module in their own order), then the content."""
    words = keywords(F.col("content"), F.col("symbol"))
    head = F.concat(
        F.lit("// File: "), F.regexp_replace("file", r"\\", "/"), F.lit("\n// Type: "), "symbol_type", F.when(F.col("symbol") != "", F.concat(F.lit("\n// Name: "), "symbol")).otherwise(""),
        F.lit("\n// Exported: "), F.col("exported").cast("string"), F.when(F.size(words) > 0, F.concat(F.lit("\n// Keywords: "), F.array_join(words, ", "))).otherwise(""), F.lit("\n\n"),
    )
    if imports is None:
        return chunks.withColumn("contextual", F.concat(head, "content"))
    lines = imports.groupBy("file").agg(F.sort_array(F.collect_set(F.struct("module", "line"))).alias("__lines"))
    used = F.flatten(F.transform("imports", lambda m: F.transform(F.filter("__lines", lambda x: x["module"] == m), lambda x: x["line"])))
    own = F.when(F.size(used) > 0, F.concat(F.array_join(used, "\n"), F.lit("\n\n"))).otherwise("")
    return chunks.join(lines, "file", "left").withColumn("contextual", F.concat(head, F.coalesce(own, F.lit("")), "content")).drop("__lines")


def rows(chunks: DataFrame, files: DataFrame, file: str = "file") -> DataFrame:
    """Chunks as rows of the fact table: id, hash, raw lines, and what their file is."""
    from quarry.functions import classify

    raw = files.select(F.col("path").alias("__path"), F.split("text", "\n").alias("__lines"))
    joined = chunks.join(raw, chunks[file] == F.col("__path"))
    return joined.select(
        F.concat_ws(":", file, F.col("chunk_index").cast("string")).alias("id"),
        *chunks.columns,
        F.array_join(F.slice("__lines", F.col("start"), F.col("end") - F.col("start") + 1), "\n").alias("content_raw"),
        F.sha1(F.col("content")).alias("hash"),
        classify.language(F.col(file)).alias("language"),
        classify.file_kind(F.col(file)).alias("file_kind"),
        classify.file_role(F.col(file)).alias("file_role"),
        semantic_kind(F.col(file), F.col("symbol"), F.col("symbol_type"), F.col("content")).alias("semantic_kind"),
    )


def content_hash(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()
