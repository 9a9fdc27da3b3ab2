"""Why exact values of a summary are not in its evidence: forms that are there instead, by class only, within a budget of lookups.

A lookup asks whether something stands in any source. What each value would look up, and what that finds, are columns; how far the budget
carries is a fold over a summary's values in their order. Whatever prefix of a value is there, its shorter ones are too, so the longest one says all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.text import bound, lower_letters, upper_letters
from mnemospark.operators.summaries import SPAN, supported

#: The budget of lookups times sources, the longest value whose near misses are looked for, the shortest part of a composed value, what
#: the evidence may have between two parts besides, the joins that are tried, and the least share of a value.
BUDGET, LONGEST, PART, EXTRA, JOINS, SHARE = 24_000, 96, 4, 2, 8, 32
#: Shapes of a value.
SHAPES = {
    "space": r"\s",
    "backslash": r"\\",
    "double-backslash": r"\\\\",
    "colon": ":",
    "equals": "=",
    "double-dash": "--",
    "slash": "/",
    "quote": "[\"']",
    "typographic-char": "[‘’‚‛“”„‟‐-―…   ​⁠﻿]",
    "digit-group-separator": "[0-9][ ,._'’][0-9]",
    "json-punctuation": r"[{}\[\]]|" + '":',
}
#: Typographic characters and what they stand for.
TYPOGRAPHIC = (
    ("[‘’‚‛]", "'"), ("[“”„‟]", '"'), ("[‐‑‒–—―]", "-"), ("…", "..."), ("[   ]", " "), ("[​‌‍⁠﻿]", ""),
)
LENGTHS = ((8, "len-1-8"), (16, "len-9-16"), (32, "len-17-32"), (64, "len-33-64"), (120, "len-65-120"))
TRANSFORMED = ("escaped-form-present", "unescaped-form-present", "whitespace-collapsed-present", "case-variant-present", "typographic-variant-present")


def has(sources: Column, value: Column) -> Column:
    return F.exists(sources, lambda s: F.contains(s, value))


def json_written(value: Column) -> Column:
    """A value as JSON writes it between its quotes."""
    written = F.to_json(F.struct(value.alias("v")))
    return F.substring(written, F.lit(7), F.length(written) - 8)


def json_read(value: Column) -> Column:
    r"""A value with its escapes undone: \n and the like, \uXXXX and \xXX, and any other character for itself."""
    pieces, between = F.regexp_extract_all(value, F.lit(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)"), F.lit(1)), F.split(value, r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", -1)
    plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

    def one(p: Column) -> Column:
        code = F.conv(F.substring(p, F.lit(2), F.length(p)), 16, 10).cast("int")
        # a code point as UTF-16, which Spark can decode
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        out = F.when(p.rlike("^[ux]..") & (F.length(p) > 1), wide)
        for k, v in plain.items():
            out = out.when(p == k, v)
        return out.otherwise(p)

    return F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(one(F.get(pieces, i)), F.lit("")))), "")


def typographic(value: Column) -> Column:
    for pattern, by in TYPOGRAPHIC:
        value = F.regexp_replace(value, pattern, by)
    return value


def forms(value: Column, sources: Column) -> Column:
    """The lookups of other forms of a value, in order: (relation, found). A form that is the value itself is not looked up."""
    none = F.array().cast("array<struct<relation:string,found:boolean>>")

    def ask(relation: str, form: Column) -> Column:
        return bound(form, lambda f: F.when(f != value, F.array(F.struct(F.lit(relation).alias("relation"), has(sources, f).alias("found")))).otherwise(none))

    lower, upper = ask("case-variant-present", lower_letters(value)), ask("case-variant-present", upper_letters(value))
    either = bound(lower, lambda low: F.when(F.exists(low, lambda x: x["found"]), low).otherwise(F.concat(low, upper)))
    collapsed = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    return F.concat(ask(TRANSFORMED[0], json_written(value)), ask(TRANSFORMED[1], json_read(value)), ask(TRANSFORMED[2], collapsed), either, ask(TRANSFORMED[4], typographic(value)))


def quoted(value: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def near(value: Column, sources: Column) -> Column:
    """(relation, need): what the analysis of near misses would find, null if nothing, and the lookups that it takes."""
    n = F.length(value)
    spots = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    without = lambda i: F.concat(F.substring(value, F.lit(1), i - 1), F.substring(value, i + 1, n))
    deletion = F.get(F.filter(spots, lambda i: has(sources, without(i))), F.lit(0))
    parts = F.sequence(F.lit(PART), F.greatest(n - PART, F.lit(PART)))
    # the longest part from either end that is there
    prefix = F.coalesce(F.array_max(F.filter(parts, lambda k: has(sources, F.substring(value, F.lit(1), k)))), F.lit(0))
    suffix = F.coalesce(F.array_max(F.filter(parts, lambda k: has(sources, F.substring(value, n - k + 1, k)))), F.lit(0))
    tries = n - 2 * PART + 1

    def composed(p: Column, s: Column) -> Column:
        lengths = F.filter(F.sequence(F.greatest(p, F.lit(PART)), F.lit(PART), F.lit(-1)), lambda k: k <= p)
        separators = F.array(F.lit(1), F.lit(2))
        cuts = F.flatten(F.transform(lengths, lambda k: F.transform(separators, lambda w: F.struct(k.alias("k"), w.alias("w")))))
        fits = lambda c: (n - c["k"] - c["w"] >= PART) & (n - c["k"] - c["w"] <= s) & ~F.substring(value, c["k"] + 1, c["w"]).rlike(r"[\p{L}\p{N}]")
        return F.filter(cuts, fits)

    def joined(c: Column) -> Column:
        gap = F.concat(F.lit(r"[^\p{L}\p{N}\r\n]{0,"), (c["w"] + EXTRA).cast("string"), F.lit("}"))
        pattern = F.concat(quoted(F.substring(value, F.lit(1), c["k"])), gap, quoted(F.substring(value, c["k"] + c["w"] + 1, n)))
        return F.exists(sources, lambda x: F.rlike(x, pattern))

    def verdict(p: Column, s: Column) -> Column:
        cuts = F.slice(composed(p, s), F.lit(1), F.lit(JOINS))

        def of(c: Column) -> Column:
            hit = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))), lambda i: joined(F.get(c, i - 1))), F.lit(0))
            found = bound(hit, lambda h: F.struct(F.when(h.isNotNull(), "composed-adjacent-present").otherwise("composed-two-present-parts").alias("relation"), (n + 2 * tries + F.coalesce(h, F.size(c))).alias("need")))
            return F.when(F.size(c) > 0, found).otherwise(F.struct(F.lit(None).cast("string").alias("relation"), (n + 2 * tries).alias("need")))

        return F.when(p == 0, F.struct(F.lit(None).cast("string").alias("relation"), (n + tries).alias("need"))).otherwise(bound(cuts, of))

    short = F.struct(F.lit(None).cast("string").alias("relation"), F.lit(0).alias("need"))
    removed = bound(deletion, lambda d: F.when(d.isNotNull(), F.struct(F.lit("single-deletion-present").alias("relation"), d.alias("need"))).otherwise(bound(prefix, lambda p: bound(suffix, lambda s: verdict(p, s)))))
    return F.when(n < 2 * PART, short).otherwise(removed)


def classified(values: Column, sources: Column, budget: int) -> Column:
    """(value, relations) of distinct ``values`` in order, as far as the budget carries, and what of it is left. Other forms of all come first."""
    n = F.size(sources)
    kind = "struct<left:bigint,out:boolean,done:array<struct<value:string,relations:array<string>>>>"
    looked = F.transform(values, lambda v: F.struct(v.alias("value"), forms(v, sources).alias("forms")))

    def cheap(acc: Column, x: Column) -> Column:
        can = F.when(acc["out"], 0).otherwise(F.floor(acc["left"] / n)).cast("int")
        short = acc["out"] | (F.size(x["forms"]) > can)
        found = F.array_distinct(F.transform(F.filter(F.slice(x["forms"], F.lit(1), F.greatest(can, F.lit(0))), lambda f: f["found"]), lambda f: f["relation"]))
        relations = F.concat(found, F.when(short, F.array(F.lit("not-classified-budget"))).otherwise(F.array().cast("array<string>")))
        left = acc["left"] - n * F.least(F.size(x["forms"]), can)
        return F.struct(F.when(short & ~acc["out"], F.lit(0)).otherwise(left).alias("left"), short.alias("out"), F.concat(acc["done"], F.array(F.struct(x["value"].alias("value"), relations.alias("relations")))).alias("done")).cast(kind)

    start = F.struct(F.lit(budget).cast("bigint").alias("left"), (n == 0).alias("out"), F.array().alias("done")).cast(kind)
    first = F.aggregate(looked, start, cheap)

    def second(a: Column) -> Column:
        open_ = F.size(F.filter(a["done"], lambda d: F.size(d["relations"]) == 0))
        asked = F.transform(a["done"], lambda d: F.struct(d["value"].alias("value"), d["relations"].alias("relations"), F.when((F.size(d["relations"]) == 0) & (F.length(d["value"]) <= LONGEST) & ~a["out"], near(d["value"], sources)).alias("near")))
        more = "struct<left:bigint,pending:int,out:boolean,partial:boolean,done:array<struct<value:string,relations:array<string>>>>"
        begin = F.struct(a["left"].alias("left"), open_.alias("pending"), a["out"].alias("out"), F.lit(False).alias("partial"), F.array().alias("done")).cast(more)

        def step(acc: Column, x: Column) -> Column:
            rest = F.when(acc["out"], 0).otherwise(F.floor(acc["left"] / n))
            share = F.least(rest, F.greatest(F.lit(SHARE), F.floor(rest / F.greatest(acc["pending"], F.lit(1)))))
            need, relation = x["near"]["need"], x["near"]["relation"]
            enough = (need < share) | ((need == share) & relation.isNotNull())
            long = F.length(x["value"]) > LONGEST
            new = F.when(long, "not-classified-length").when(acc["out"] | (share <= 0), "not-classified-budget").when(enough, F.coalesce(relation, F.lit("no-near-miss"))).otherwise("not-classified-partial")
            is_open = F.size(x["relations"]) == 0
            spent = F.when(is_open & ~long & ~acc["out"] & (share > 0), n * F.least(need, share)).otherwise(0)
            relations = F.when(is_open, F.array(new)).otherwise(x["relations"])
            partial = acc["partial"] | (is_open & (new == "not-classified-partial"))
            return F.struct((acc["left"] - spent).alias("left"), (acc["pending"] - is_open.cast("int")).alias("pending"), acc["out"].alias("out"), partial.alias("partial"), F.concat(acc["done"], F.array(F.struct(x["value"].alias("value"), relations.alias("relations")))).alias("done")).cast(more)

        return F.aggregate(asked, begin, step)

    return bound(first, second)


def shapes(value: Column) -> Column:
    return F.filter(F.array(*[F.when(value.rlike("(?U)" + p if name == "space" else p), name) for name, p in SHAPES.items()]), lambda x: x.isNotNull())


def length_class(value: Column) -> Column:
    out = F.when(F.length(value) <= LENGTHS[0][0], LENGTHS[0][1])
    for most, name in LENGTHS[1:]:
        out = out.when(F.length(value) <= most, name)
    return out.otherwise("len-121-plus")


def reports(summaries: DataFrame, keys: list[str], budget: int = BUDGET) -> DataFrame:
    """(keys, spans, values, used, complete) of each of ``summaries`` (keys, summary, sources): its unsupported occurrences, their distinct values with relations, and lookups spent.

    ``sources`` are the texts of the evidence; empty ones don't count. Work per summary is bounded by the budget's share of each value and by the longest value that is looked into.
    """
    sources = F.filter("sources", lambda s: F.coalesce(F.length(s), F.lit(0)) > 0)
    all_of = F.regexp_extract_all("summary", F.lit(SPAN), F.lit(1))
    rows = summaries.select(*keys, sources.alias("sources"), all_of.alias("all"))
    rows = rows.select(*keys, "sources", F.filter("all", lambda v: ~F.exists("sources", lambda s: supported(v, s))).alias("spans"))
    rows = rows.select(*keys, "spans", classified(F.array_distinct("spans"), F.col("sources"), budget).alias("c"))
    return rows.select(*keys, "spans", F.col("c.done").alias("values"), (budget - F.col("c.left")).alias("used"), (~F.col("c.out") & ~F.col("c.partial")).alias("complete"))


def counters(reported: DataFrame) -> DataFrame:
    """(kind, name, n): how many unsupported occurrences of all summaries have each relation, shape and length. No value is shown."""
    spans = reported.select("values", F.explode("spans").alias("v"))
    relations = F.flatten(F.transform(F.filter("values", lambda d: d["value"] == F.col("v")), lambda d: d["relations"]))
    each = [("relation", relations), ("shape", shapes(F.col("v"))), ("length", F.array(length_class(F.col("v"))))]
    named = F.concat(*[tagged(kind, c) for kind, c in each])
    return spans.select(F.inline(named)).groupBy("kind", "name").agg(F.count("*").alias("n"))


def tagged(kind: str, names: Column) -> Column:
    return F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
