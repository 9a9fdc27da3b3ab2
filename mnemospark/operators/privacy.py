"""Privacy of text: marks of a class in the text itself, what a provider may see, and what goes out in its place.

A stretch is marked by ``[ctx:CLASS]...[/ctx:CLASS]``, a whole text by ``[ctx:CLASS]`` at its start; a backslash before a mark makes it plain
text. The name before the colon is a parameter.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions import text as T

#: Privacy classes from open to closed.
CLASSES = ("normal", "internal", "sensitive", "local-only")
NAME = "ctx"
#: Keys of a payload whose strings are its structure, and keys below which all strings are content.
STRUCTURAL_KEYS = (
    "api",
    "id",
    "model",
    "name",
    "role",
    "stopreason",
    "stop_reason",
    "toolcallid",
    "tool_call_id",
    "type",
)
CONTENT_KEYS = (
    "arguments",
    "content",
    "contents",
    "context",
    "description",
    "input",
    "instructions",
    "messages",
    "metadata",
    "parts",
    "prompt",
    "requestmetadata",
    "system",
    "system_instruction",
    "systeminstruction",
    "systemprompt",
    "text",
    "thinking",
    "toolconfig",
    "tools",
)
#: How much of a nested value is walked before it counts as closed.
MOST_NODES, MOST_DEPTH = 10_000, 64
RESULT_SCHEMA = "history-result-v1"


def mark(name: str = NAME, slash: str = "") -> str:
    """A pattern of a mark whose first group is the class."""
    return rf"(?<!\\)\[{slash}{re.escape(name)}:({'|'.join(CLASSES)})\]"


def rank(klass: Column) -> Column:
    """0 for the most open class; null for what is no class."""
    return F.nullif(F.array_position(F.array(*map(F.lit, CLASSES)), F.lower(klass)), F.lit(0)) - 1


def class_of(at: Column) -> Column:
    return F.get(F.array(*map(F.lit, CLASSES)), at.cast("int"))


def highest(*classes: Column) -> Column:
    """The most closed of some classes; null ones don't count."""
    return class_of(F.greatest(*[rank(c) for c in classes])) if len(classes) > 1 else classes[0]


def marked_class(text: Column, name: str = NAME) -> Column:
    """The most closed class that any mark in ``text`` names, opening or closing; null without marks."""
    found = F.regexp_extract_all(text, F.lit("(?i)" + mark(name, "/?")), F.lit(1))
    return class_of(F.array_max(F.transform(found, rank)))


def structure_floor(text: Column, name: str = NAME) -> Column:
    """The least class that badly nested marks ask for: those within others, those closed by another class, and those left open."""
    marks = F.regexp_extract_all(text, F.lit("(?i)" + mark(name, "/?").replace(f"({'|'.join(CLASSES)})", f"(?:{'|'.join(CLASSES)})")), F.lit(0))
    items = F.transform(marks, lambda m: F.struct(F.startswith(m, F.lit("[/")).alias("closes"), rank(F.regexp_extract(m, r":([a-zA-Z-]+)\]", 1)).cast("int").alias("at")))
    start = F.struct(F.array().cast("array<int>").alias("stack"), F.lit(-1).alias("floor"))

    def step(acc: Column, x: Column) -> Column:
        stack, floor, empty = acc["stack"], acc["floor"], F.size(acc["stack"]) == 0
        top = F.element_at(F.when(~empty, stack), -1)
        opened = F.struct(F.concat(stack, F.array(x["at"])).alias("stack"), F.when(empty, floor).otherwise(F.greatest(floor, F.array_max(stack), x["at"])).alias("floor"))
        closed = F.struct(
            F.when(empty, stack).otherwise(F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).alias("stack"),
            F.when(empty | (top != x["at"]), F.greatest(floor, F.coalesce(top, F.lit(-1)), x["at"])).otherwise(floor).alias("floor"),
        )
        return F.when(x["closes"], closed).otherwise(opened)

    best = F.aggregate(items, start, step, lambda acc: F.greatest(acc["floor"], F.coalesce(F.array_max(acc["stack"]), F.lit(-1))))
    return F.when(best >= 0, class_of(best))


def provider_policy(provider: Column, local: list[str], rules: dict[str, list[str]], default: list[str]) -> tuple[Column, Column]:
    """(remote, allowed classes) of a provider: local ones see all, remote ones what their rule or else the default says. Names regardless of case and blanks."""
    name = F.lower(F.trim(provider))
    lists = lambda v: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    remote = ~name.isin(*[x.strip().lower() for x in local]) if local else F.lit(True)
    allowed = F.when(~remote, lists(CLASSES))
    for rule, classes in rules.items():
        allowed = allowed.when(name == rule.strip().lower(), lists(classes))
    return remote, allowed.otherwise(lists(default))


def placeholder(klass: Column) -> Column:
    return F.concat(F.lit("["), klass, F.lit(" content excluded by privacy policy]"))


def sanitized(text: Column, allowed: Column, remote: Column, default: str = "normal", redact: bool = True, name: str = NAME) -> Column:
    """(value, classification, blocked, redactions, changed) of a text for a provider.

    Marked stretches that the provider may not see, and all else if the default is not allowed, become a note of their class; a stretch is never
    more open than the default. What goes to a remote provider has its credentials redacted. An empty or null text stays as it is.
    """
    classes = "|".join(CLASSES)
    closed = rf"(?i)(?<!\\)\[{re.escape(name)}:({classes})\]([\s\S]*?)(?<!\\)\[/{re.escape(name)}:\1\]"
    prefix = rf"(?i)^\s*(?<!\\)\[{re.escape(name)}:({classes})\]\s*"
    part = lambda c, body: F.struct(c.alias("klass"), body.alias("body"))
    none = F.array().cast("array<struct<klass:string,body:string>>")
    base = F.lit(default)
    may = lambda c: F.array_contains(allowed, c)
    hides = remote if redact else F.lit(False)

    def found(t: Column) -> Column:
        """What is marked: stretches, what lies between them, and a class at the very beginning."""
        kinds = F.transform(F.regexp_extract_all(t, F.lit(closed), F.lit(1)), lambda c: highest(c, base))
        inside = F.zip_with(kinds, F.regexp_extract_all(t, F.lit(closed), F.lit(2)), part)
        return F.struct(inside.alias("inside"), F.split(t, closed, -1).alias("between"), F.nullif(F.regexp_extract(t, prefix, 1), F.lit("")).alias("first"))

    def cut(t: Column, m: Column) -> Column:
        # text before each marked stretch and after the last, then the stretch; empty text between is no part
        woven = F.flatten(F.transform(m["between"], lambda b, i: F.concat(F.when(b != "", F.array(part(base, b))).otherwise(none), F.when(i < F.size(m["inside"]), F.array(F.get(m["inside"], i))).otherwise(none))))
        parts = F.when(F.size(m["inside"]) > 0, woven).when(m["first"].isNotNull(), F.array(part(highest(m["first"], base), F.regexp_replace(t, prefix, "")))).otherwise(F.array(part(base, t)))
        return F.struct(parts.alias("parts"), ((F.size(m["inside"]) > 0) | m["first"].isNotNull()).alias("marked"))

    def shown(c: Column) -> Column:
        text = F.array_join(F.transform(c["parts"], lambda p: F.when(may(p["klass"]), p["body"]).otherwise(placeholder(p["klass"]))), "")
        klass = class_of(F.greatest(F.lit(CLASSES.index(default)).cast("long"), F.array_max(F.transform(c["parts"], lambda p: rank(p["klass"])))))
        blocked = F.size(F.filter(c["parts"], lambda p: ~may(p["klass"])))
        return F.struct(text.alias("text"), klass.alias("klass"), blocked.alias("blocked"), c["marked"].alias("marked"))

    def done(t: Column, s: Column) -> Column:
        kept = F.struct(s["text"].alias("text"), F.lit(0).alias("n"))
        out = F.when(hides, T.redacted(s["text"], T.PROVIDER_PATTERNS, T.PROVIDER_HINTS)).otherwise(kept)
        return T.bound(out, lambda r: F.struct(r["text"].alias("value"), s["klass"].alias("classification"), s["blocked"].alias("blocked"), r["n"].cast("int").alias("redactions"), ((r["text"] != t) | s["marked"]).alias("changed")))

    whole = T.bound(text, lambda t: T.bound(T.bound(T.bound(found(t), lambda m: cut(t, m)), shown), lambda s: done(t, s)))
    plain = F.struct(text.alias("value"), base.alias("classification"), F.lit(0).alias("blocked"), F.lit(0).alias("redactions"), F.lit(False).alias("changed"))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, plain).otherwise(whole)


def closed_more(a: str | None, b: str | None) -> str | None:
    found = [x for x in (a, b) if x]
    return max(found, key=CLASSES.index) if found else None


def history_class(values: Column, name: str = NAME) -> Column:
    """The most closed class in a JSON value: its ``classification`` fields and the marks in its strings, also in JSON within strings.

    A value with too many nodes or levels is local-only, as is a history result that is not quoted data. What is no JSON counts as one string. Null
    stays null.
    """
    pattern = re.compile(mark(name, "/?"), re.I)

    def one(raw: str | None) -> str | None:
        if raw is None:
            return None
        seen = 0

        def walk(node, depth: int) -> str | None:
            nonlocal seen
            seen += 1
            if seen > MOST_NODES or depth > MOST_DEPTH:
                return CLASSES[-1]
            if isinstance(node, str):
                found = None
                for c in pattern.findall(node):
                    found = closed_more(found, c.lower())
                if RESULT_SCHEMA in node and (node.lstrip()[:1] in ('{', '[', '"') or re.search(rf'"schema"\s*:\s*"{RESULT_SCHEMA}"', node)):
                    try:
                        return closed_more(found, walk(json.loads(node), depth + 1))
                    except (ValueError, RecursionError):
                        return CLASSES[-1]
                return found
            if not isinstance(node, (dict, list)):
                return None
            found = None
            if isinstance(node, dict):
                if node.get("schema") == RESULT_SCHEMA and node.get("quotedData") is not True:
                    found = CLASSES[-1]
                if node.get("classification") in CLASSES:
                    found = closed_more(found, node["classification"])
            for child in node.values() if isinstance(node, dict) else node:
                found = closed_more(found, walk(child, depth + 1))
            return found

        try:
            node = json.loads(raw)
        except (ValueError, RecursionError):
            node = raw
        return walk(node, 0)

    @F.pandas_udf("string")
    def of(column: pd.Series) -> pd.Series:
        return column.map(one)

    return of(values)


def sanitized_json(values: Column, allowed: list[str], remote: bool, default: str = "normal", redact: bool = True, name: str = NAME) -> Column:
    """(value, classification, blocked, redactions): a JSON payload whose content strings went through `sanitized`'s rules, at any depth.

    Strings below a content key, and any with a mark, are content; those under structural keys stay unless they are marked. Keys below content are
    treated like it. What is no JSON is treated as one content string.
    """
    classes, may = "|".join(CLASSES), frozenset(allowed)
    closed = re.compile(rf"(?<!\\)\[{re.escape(name)}:({classes})\]([\s\S]*?)(?<!\\)\[/{re.escape(name)}:\1\]", re.I)
    prefix = re.compile(rf"^\s*(?<!\\)\[{re.escape(name)}:({classes})\]\s*", re.I)
    any_mark = re.compile(rf"(?<!\\)\[/?{re.escape(name)}:(?:{classes})\]", re.I)
    patterns = [(re.compile(p, re.A), re.sub(r"\$(\d)", r"\\\1", by)) for p, by in T.PROVIDER_PATTERNS]

    def one(raw: str | None):
        if raw is None:
            return {"value": None, "classification": default, "blocked": 0, "redactions": 0}
        state = {"classification": default, "blocked": 0, "redactions": 0}

        def segment(body: str, klass: str) -> str:
            state["classification"] = closed_more(state["classification"], klass)
            if klass in may:
                return body
            state["blocked"] += 1
            return f"[{klass} content excluded by privacy policy]"

        def clean(text: str) -> str:
            if not text:
                return text
            out, at = [], 0
            for m in closed.finditer(text):
                if m.start() > at:
                    out.append(segment(text[at : m.start()], default))
                out.append(segment(m[2], closed_more(default, m[1].lower())))
                at = m.end()
            if at:
                out += [segment(text[at:], default)] if text[at:] else []
            elif first := prefix.match(text):
                out = [segment(text[first.end() :], closed_more(default, first[1].lower()))]
            else:
                out = [segment(text, default)]
            value = "".join(out)
            if remote and redact:
                for pattern, by in patterns:
                    value, n = pattern.subn(by, value)
                    state["redactions"] += n
            return value

        def walk(node, content: bool, key: str | None):
            if isinstance(node, str):
                has = bool(any_mark.search(node))
                if not has and (not content or (key or "").lower() in STRUCTURAL_KEYS):
                    return node
                return clean(node)
            if isinstance(node, list):
                return [walk(x, content, key) for x in node]
            if not isinstance(node, dict):
                return node
            out = {}
            for i, (k, child) in enumerate(node.items()):
                low, new = k.lower(), k
                if any_mark.search(k) or (content and low not in STRUCTURAL_KEYS and low not in CONTENT_KEYS):
                    new = clean(k)
                while new in out:
                    new = f"{new}_{i}"
                out[new] = walk(child, content or low in CONTENT_KEYS, k)
            return out

        try:
            value = json.dumps(walk(json.loads(raw), False, None), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            value = clean(raw)
        return {"value": value, **state}

    @F.pandas_udf("value string, classification string, blocked int, redactions int")
    def of(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in column], columns=["value", "classification", "blocked", "redactions"])

    return of(values)
