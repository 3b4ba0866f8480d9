"""Statements of code with braces: where they lie, how much a piece of code branches, how a long body is dealt into pieces.

All of it works on code of the same length whose strings and comments are blanks (chunking.blanked), so a place in one is
a place in the other.
"""

from __future__ import annotations

import ast
import re

#: Statements that a closing brace ends, if nothing goes on behind it.
_BLOCK = re.compile(r"(?:(?:export|default|declare|async|abstract|public|private|protected|static|final)\s+)*(?:if|for|while|switch|try|do|function|class|interface|enum|namespace|module)\b|\{")
_HEADED = re.compile(r"(?:[\w$]+\s*:\s*)?(?:if|for|while)\b[^(]*\(")
_CLAUSE = re.compile(r"\s*(?:else|catch|finally)\b")
#: A bracket, a semicolon, the end of a line, or what stands between them without blanks.
_TOKENS = re.compile(r"[()\[\]{};\n]|[^\s()\[\]{};]+")
#: Characters that leave a statement open at the end of a line, or take it up at the beginning of the next.
_OPEN, _TAKES_UP = set("=+-*/%&|^<?:,.!~(["), set("=*/%&|^<>?:,.)](`[{")


def statements(code: str, a: int, b: int, most: int = 0) -> list[tuple[int, int]]:
    """(begin, end) of the statements (the first most of them) between a and b, ends outside; a semicolon, the brace of a block or the end of a line ends one.

    A line goes on if it ends in an operator, if the next one begins with one, and behind ``if (...)``, ``else`` and ``do``."""
    out: list[tuple[int, int]] = []
    begin, depth, last, groups, headed = -1, 0, -1, 0, False

    def close(end: int) -> None:
        nonlocal begin, groups, headed
        if begin >= 0 and code[begin:end].strip(" \t\n;"):
            out.append((begin, end))
        begin, groups, headed = -1, 0, False

    def ends_line(i: int) -> bool:
        so_far, nxt = code[begin : last + 1], re.compile(r"\s*").match(code, i, b).end()
        if headed or so_far.endswith("=>") or re.search(r"(?:^|[^\w$.])(?:else|do)$", so_far) or (nxt < b and _CLAUSE.match(code, nxt)):
            return False
        if re.match(r"do\b", so_far) and so_far.endswith("}") and code.startswith("while", nxt):
            return False
        counts = so_far.endswith(("++", "--")) or code.startswith(("++", "--"), nxt)
        if not counts and (so_far[-1] in _OPEN or (nxt < b and (code[nxt] in _TAKES_UP or code[nxt] in "+-"))):
            return bool(code[nxt : nxt + 1] == "{" and so_far.endswith("}"))  # a block behind a block is its own
        return True

    for token in _TOKENS.finditer(code, a, b):
        if most and len(out) >= most:
            return out
        i, c = token.start(), code[token.start()]
        if c == "\n":
            if begin >= 0 and not depth and ends_line(i):
                close(last + 1)
            continue
        if begin < 0:
            begin = i
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        last = token.end() - 1
        headed = False
        if depth:
            continue
        if c == ")":
            groups += 1
            headed = groups == 1 and _HEADED.match(code, begin, i) is not None
        elif c == ";":
            close(i + 1)
        elif c == "}" and _BLOCK.match(code, begin) and not _CLAUSE.match(code, i + 1, b) and not (code.startswith("do", begin) and re.compile(r"\s*while\b").match(code, i + 1, b)):
            close(i + 1)
    close(last + 1)
    return out


# What each definition adds for a word or an operator.
_WORDS = {"if": 1, "for": 1, "while": 1, "case": 1, "catch": 1, "switch": 2}
_WORD = re.compile(r"(?<![\w$.])(if|for|while|case|catch|switch)\b(?!\s*:)")
_LABELS = re.compile(r"(?:(?<![\w$.])(?:case\b[^:{};]*|default\s*):(?!:)\s*)+")
_LOGIC = re.compile(r"&&|\|\|")
_BINARY = re.compile(r"(?<=[\w$)\]\"'`}])\s*(?:&&|\|\||\?\?|>>>|<<|===|!==|==|!=|<=|>=|(?<=\s)(?:>>|[<>])(?=\s)|\*\*|\+(?!\+)|-(?!-)|[*/%&|^]|(?<=\s)instanceof(?=\s)|(?<=\s)in(?=\s))\s*(?=[\w$(\[\"'`!~{+-])")
_PREFIXED = re.compile(r"(?:\b(?:return|typeof|case|throw|void|delete|await|yield|in|of|else|do)|\b(?:const|let|var)\s+[\w$]+|\+\+|--)$")


def score(code: str, definition: str = "indexer") -> int:
    """Branches of blanked code by one of three definitions; each begins at 0 and takes a switch for two.

    indexer: if, for, while (a do is its own while), case, catch and switch. language: besides these one for every binary
    operator, and one more for && and ||; operators between types count as well, since types aren't told from values here.
    java: if, for, while, catch, switch, every run of labels, and && and ||."""
    if definition not in ("indexer", "language", "java"):
        raise ValueError(f"no definition of complexity: {definition}")
    words = _WORD.findall(code)
    logic = len(_LOGIC.findall(code))
    if definition == "java":
        return sum(_WORDS[w] for w in words if w != "case") + len(_LABELS.findall(code)) + logic
    total = sum(_WORDS[w] for w in words)
    if definition == "language":
        binary = [m for m in _BINARY.finditer(code) if not _PREFIXED.search(code[max(0, m.start() - 60) : m.start()])]
        total += len(binary) + logic
    return total


def python_score(node: ast.AST) -> int:
    """Branches of Python by the definition of the language: elif is part of its if, each and/or counts twice, and a condition of a list or dict comprehension once more."""
    nodes = list(ast.walk(node))
    elifs = {id(n.orelse[0]) for n in nodes if isinstance(n, ast.If) and len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) and n.orelse[0].col_offset == n.col_offset}
    one = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Match, ast.match_case, ast.IfExp, ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp)
    total = 0
    for n in nodes:
        total += isinstance(n, one) and id(n) not in elifs
        if isinstance(n, ast.BoolOp):
            total += 2 * (len(n.values) - 1)
        elif isinstance(n, (ast.ListComp, ast.DictComp)):
            total += sum(len(g.ifs) for g in n.generators)
    return total


OVERLAP = 3  # statements before a piece that it names


def _before(lines: list[str], earlier: list[tuple[int, int]]) -> str:
    """Comment lines with the beginnings of the last statements before a piece."""
    told = [t if len(t) <= 60 else t[:57] + "..." for t in (lines[x].strip() for x, _ in earlier[-OVERLAP:]) if t]
    return "// ... previous:\n" + "".join(f"//   {t}\n" for t in told) if told else ""


def _by_lines(lines: list[str], a: int, b: int, most: int) -> list[tuple[str, int, int]]:
    """Lines a to b packed up to most characters; a longer line is sliced."""
    out: list[tuple[str, int, int]] = []
    held = a
    size = -1
    for i in range(a, b + 1):
        if size >= 0 and size + 1 + len(lines[i]) > most:
            out.append(("\n".join(lines[held:i]), held, i - 1))
            size = -1
        if len(lines[i]) > most:
            out += [(lines[i][k : k + most], i, i) for k in range(0, len(lines[i]), most)]
            continue
        if size < 0:
            held = i
        size += 1 + len(lines[i])
    return out if size < 0 else [*out, ("\n".join(lines[held : b + 1]), held, b)]


def dealt(content: str, code: str, begin: int, opening: int, end: int, name: str, most: int) -> list[tuple[str, int, int]]:
    """Pieces (text, first and last line from 0) of the declaration between begin and end whose body opens at opening.

    Each has the lines of the signature, the beginnings of three statements before it and whole statements up to most
    characters (signature and statements are counted); all but the first and the last name the declaration. A statement that
    is too long alone is cut by lines. Without statements the declaration is cut by lines."""
    lines = content.split("\n")
    row = lambda at: content.count("\n", 0, at)
    first, final = row(begin), row(end)
    places: list[tuple[int, int]] = []
    for x, y in statements(code, opening + 1, end):
        if places and row(x) <= places[-1][1]:  # on a line of the one before
            places[-1] = (places[-1][0], max(places[-1][1], row(y - 1)))
        else:
            places.append((row(x), row(y - 1)))
    if not places:
        return _by_lines(lines, first, final, most)
    signature = "\n".join(lines[first : places[0][0]])
    out: list[tuple[str, int, int]] = []
    held: list[tuple[int, int]] = []
    earlier: list[tuple[int, int]] = []
    size = len(signature)

    def close(text: str, a: int, b: int, is_last: bool = False) -> None:
        head = f"// Context: {name}\n\n" if out and name and not is_last else ""
        out.append((f"{head}{signature}\n{_before(lines, earlier)}{text}", a, b))

    def flush(is_last: bool = False) -> None:
        nonlocal size
        if held:
            close("\n".join(lines[held[0][0] : held[-1][1] + 1]), held[0][0], held[-1][1], is_last)
            earlier.extend(held)
            held.clear()
        size = len(signature)

    for a, b in places:
        length = sum(len(t) + 1 for t in lines[a : b + 1]) - 1
        if held and size + length > most:
            flush()
        if len(signature) + length > most:
            for text, x, y in _by_lines(lines, a, b, max(1, most - len(signature))):
                close(text, x, y)
            earlier.append((a, b))
            continue
        held.append((a, b))
        size += length
    flush(is_last=True)
    if lines[final].strip() == "}":
        text, a, _ = out[-1]
        out[-1] = (f"{text}\n{lines[final]}", a, final)
    return out
