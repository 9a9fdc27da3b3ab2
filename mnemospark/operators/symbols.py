"""Symbols that source code declares: names, kinds, lines, parents, imports and references, for Python, Go, JavaScript and TypeScript.

Comments and strings are blanked first, in place, so that one pattern a language finds declarations by position; brackets are paired once for a whole file.
"""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_SYMBOLS, MOST_NAMES, SIGNATURE_LINES, SIGNATURE_CHARS = 200, 64, 12, 500
#: Words of the languages that are no references.
KEYWORDS = (
    "as", "async", "await", "break", "case", "catch", "class", "const", "continue",
    "def", "defer", "delete", "do", "else", "enum", "export", "extends", "false",
    "finally", "fn", "for", "from", "func", "function", "go", "if", "implements",
    "import", "in", "interface", "let", "map", "namespace", "new", "nil", "none",
    "package", "pass", "private", "protected", "public", "range", "return", "select",
    "static", "struct", "switch", "this", "throw", "true", "try", "type", "undefined",
    "var", "while", "with", "yield",
)
#: Words before a bracket that are no methods.
CONTROL = ("catch", "for", "if", "switch", "while", "with")
WORD = re.compile(r"\b[A-Za-z_$][\w$]*", re.A)
C_LIKE = re.compile(r"""/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|"(?:\\.|[^"\\\n])*(?:"|$)|'(?:\\.|[^'\\\n])*(?:'|$)|`(?:\\[\s\S]|[^`\\])*(?:`|\Z)""", re.M)
PYTHON = re.compile(r"""\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\#[^\n]*|"(?:\\.|[^"\\\n])*(?:"|$)|'(?:\\.|[^'\\\n])*(?:'|$)""", re.M)
PREFIX = r"(?:(?:export|declare|default|abstract)[ \t]+)*"
SCRIPT = re.compile(rf"^[ \t]*{PREFIX}(?:(?P<kind>class|interface|enum|namespace|type)[ \t]+(?P<a>[A-Za-z_$][\w$]*)|(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<b>[A-Za-z_$][\w$]*)|(?:const|let|var)[ \t]+(?P<c>[A-Za-z_$][\w$]*)[ \t]*(?::[^=\n]+)?=)", re.M | re.A)
METHOD = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set)[ \t]+)*(?P<name>[A-Za-z_$][\w$]*)[ \t]*(?:<[^>{}\n]*>)?[ \t]*\([^;{}\n]*\)[ \t]*(?::[^;{\n]+)?[ \t]*[{;]", re.M | re.A)
DEF = re.compile(r"^(?P<indent>[ \t]*)(?:async[ \t]+)?(?P<kind>class|def)[ \t]+(?P<name>[A-Za-z_]\w*)", re.M | re.A)
GO = re.compile(r"^[ \t]*(?:type[ \t]+(?P<type>[A-Za-z_]\w*)[ \t]+(?P<kind>struct|interface)\b|func[ \t]+(?:\([ \t]*\w+[ \t]+\*?(?P<owner>[A-Za-z_]\w*)[ \t]*\)[ \t]*)?(?P<name>[A-Za-z_]\w*)[ \t]*\()", re.M | re.A)
IMPORTS = {
    "python": re.compile(r"^[ \t]*(?:from[ \t]+([A-Za-z_][\w.]*)[ \t]+import|import[ \t]+([A-Za-z_][\w.]*))", re.M | re.A),
    "go": re.compile(r"""(?:^[ \t]*import[ \t]+|^[ \t]*)(?:[A-Za-z_.]+[ \t]+)?"([^"\n]+)"[ \t]*$""", re.M),
    "script": re.compile(r"""^[ \t]*import(?:[^'"\n]*\sfrom[ \t]*|[ \t]*)["']([^"'\n]+)["']|\brequire\([ \t]*["']([^"'\n]+)["']""", re.M),
}


def blanked(code: str, language: str) -> str | None:
    """The code with comments and strings made blanks; None where brackets or a block don't close."""
    def blank(m: re.Match) -> str:
        return re.sub(r"[^\n]", " ", m[0])

    pattern = PYTHON if language == "python" else C_LIKE
    for m in pattern.finditer(code):
        whole = m[0]
        if (whole[:2] == "/*" and not whole.endswith("*/")) or (whole[0] == "`" and (len(whole) < 2 or whole[-1] != "`")) or (whole[:3] in ('"""', "'''") and (len(whole) < 6 or not whole.endswith(whole[:3]))):
            return None
    return pattern.sub(blank, code)


def paired(code: str) -> dict[int, int] | None:
    """Where each opening brace closes; None if brackets are not nested."""
    ends, stack = {}, []
    for m in re.finditer(r"[()\[\]{}]", code):
        if m[0] in "([{":
            stack.append(m)
        elif not stack or stack[-1][0] + m[0] not in ("()", "[]", "{}"):
            return None
        else:
            ends[stack.pop().start()] = m.start()
    return None if stack else ends


def parse(code: str | None, language: str | None) -> list[dict]:
    """Symbols of a file, by line; none of a language without a pattern or of code whose brackets don't close."""
    language = (language or "").lower()
    if code is None or language not in ("python", "go", "javascript", "typescript"):
        return []
    code = code.replace("\r\n", "\n")
    clean = blanked(code, language)
    ends = paired(clean) if clean is not None else None
    if ends is None:
        return []
    lines, starts = code.split("\n"), [0, *(m.end() for m in re.finditer("\n", code))]
    line_of = lambda at: bisect.bisect_right(starts, at)
    braces = sorted(k for k in ends if clean[k] == "{")

    def block_end(at: int) -> int:
        """The line where what begins at ``at`` ends: that of its brace's partner, or of a semicolon at a line's end before any brace."""
        k = bisect.bisect_left(braces, at)
        stop = re.compile(r";[ \t]*$", re.M).search(clean, at)
        if k < len(braces) and (not stop or braces[k] < stop.start()):
            return line_of(ends[braces[k]])
        return line_of(stop.start()) if stop else line_of(at)

    found: list[dict] = []

    def add(name: str, kind: str, at: int, end: int, parent: str | None = None) -> None:
        found.append({"name": name, "kind": kind, "first": line_of(at), "last": end, "parent": parent})

    if language == "python":
        rows = clean.split("\n")
        indents = [len(r) - len(r.lstrip()) if r.strip() else None for r in rows]
        open_: list[tuple[int, str]] = []
        for m in DEF.finditer(clean):
            first, indent = line_of(m.start("kind")), len(m["indent"])
            end = first
            for k in range(first, len(rows)):
                if indents[k] is not None:
                    if indents[k] <= indent:
                        break
                    end = k + 1
            while open_ and open_[-1][0] >= indent:
                open_.pop()
            parent = open_[-1][1] if open_ else None
            add(m["name"], "class" if m["kind"] == "class" else "method" if parent else "function", m.start("kind"), end, parent)
            open_.append((indent, m["name"]))
    elif language == "go":
        for m in GO.finditer(clean):
            at = m.start("type") if m["type"] else m.start("name")
            add(m["type"] or m["name"], m["kind"] or ("method" if m["owner"] else "function"), at, block_end(at), m["owner"])
    else:
        for m in SCRIPT.finditer(clean):
            group = "a" if m["a"] else "b" if m["b"] else "c"
            add(m[group], m["kind"] or ("function" if m["b"] else "variable"), m.start(group), block_end(m.start(group)))
        for s in found:
            around = [p for p in found if p is not s and p["first"] <= s["first"] and p["last"] >= s["last"] and (p["first"], p["last"]) != (s["first"], s["last"])]
            s["parent"] = min(around, key=lambda p: (p["last"] - p["first"], -p["first"]))["name"] if around else None
        taken = {s["first"] for s in found}
        for owner in [s for s in found if s["kind"] in ("class", "interface")]:
            begin = next((b for b in braces if line_of(b) >= owner["first"]), None)
            if begin is None:
                continue
            inner = [(b, ends[b]) for b in braces if begin < b < ends[begin]]
            for m in METHOD.finditer(clean, begin + 1, ends[begin]):
                at = m.start("name")
                nested = any(a < at < z for a, z in inner)
                if not nested and m["name"] not in CONTROL and line_of(at) not in taken:
                    add(m["name"], "method", at, min(owner["last"], block_end(at)), owner["name"])
    imports = list(dict.fromkeys(next(filter(None, m.groups())) for m in IMPORTS.get(language, IMPORTS["script"]).finditer(code) if any(m.groups())))[:MOST_NAMES]
    parents: dict[str, dict] = {}
    for s in found:
        parents.setdefault(s["name"], s)
    out = []
    for s in found[:MOST_SYMBOLS]:
        path, up, seen = [s["name"]], s["parent"], {s["name"]}
        while up and up not in seen:
            path.append(up)
            seen.add(up)
            up = parents[up]["parent"] if up in parents else None
        parts: list[str] = []
        for line in lines[s["first"] - 1 : s["first"] - 1 + SIGNATURE_LINES]:
            parts += [line.strip()] if line.strip() else []
            if re.search(r":\s*$" if language == "python" else r"(?:\{|;|=>)\s*$", " ".join(parts)):
                break
        body = "\n".join(lines[s["first"] - 1 : s["last"]])
        names = dict.fromkeys(w for w in WORD.findall(body) if w != s["name"] and w.lower() not in KEYWORDS)
        out.append({**s, "qualified": ".".join(reversed(path)), "signature": " ".join(" ".join(parts).split())[:SIGNATURE_CHARS], "imports": imports, "references": list(dict.fromkeys([*imports, *names]))[:MOST_NAMES]})
    return out


SYMBOL = "array<struct<name: string, qualified: string, kind: string, signature: string, parent: string, first: int, last: int, imports: array<string>, references: array<string>>>"


def symbols(code: Column, language: Column, *parsers) -> Column:
    """Symbols of each file by the first of ``parsers`` (functions of code and language) that finds any, and by `parse` in the end.

    A parser that fails is passed over.
    """

    def one(body, kind):
        for p in (*parsers, parse):
            try:
                if found := p(body, kind):
                    return found
            except Exception:  # noqa: BLE001, S112 - a parser of a caller's may fail in any way; the next one is asked
                continue
        return []

    @F.pandas_udf(SYMBOL)
    def of(bodies: pd.Series, kinds: pd.Series) -> pd.Series:
        keys = ("name", "qualified", "kind", "signature", "parent", "first", "last", "imports", "references")
        return pd.Series([[{k: s.get(k) for k in keys} for s in one(b, k2)] for b, k2 in zip(bodies, kinds)])

    return of(code, language)
