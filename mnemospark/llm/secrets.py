"""Secret scans over an incremental blob ledger (operator 4). DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content. The ledger is a stored table with a row for each
(blob, rule version) that was scanned, with what was found in it; so a run scans a blob once, however many
paths or versions show it, and not at all if an earlier run did under the same rules. Findings belong to blobs and
are joined back to all paths. A blob is in the ledger with its findings or not at all: a run that fails leaves no half.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.llm.shared import exists, new_path, spread_join


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


# A run of a class that has to have n characters is as well written with {n,}: a shorter run holds no match, and a
# longer one is matched from its start either way. The assignment has no such form, as a failing match still uses up
# its text.
BASE = (
    Rule(
        "assign",
        "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
# A key goes up to its last line, or to the text's end where that is cut off.
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----|[\s\S]*)"
RULES = (*BASE, Rule("pem", PEM), Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"))
#: Raised whenever a rule changes; blobs that were scanned under another one are unseen.
RULE_VERSION = "2"
SPANS = "array<struct<start: int, rule: int, end: int>>"
LEDGER = f"sha binary, spans {SPANS}, rule_version string"


def content() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def address() -> Column:
    return F.unhex(F.sha2(content(), 256))


def unseen(history: DataFrame, ledger: DataFrame | None = None, version: str = RULE_VERSION) -> DataFrame:
    """(sha, text) of each blob that the ledger lacks under this rule version. Copies meet before the shuffle."""
    # copies are combined before they are dealt by address, and what is known is left out in the same partitioning
    blobs = history.select(address().alias("sha"), content().alias("text")).groupBy("sha").agg(F.first("text").alias("text"))
    if ledger is None:
        return blobs
    return blobs.join(ledger.where(F.col("rule_version") == version).select("sha").distinct(), "sha", "left_anti")


def hits(rule: Rule, number: int) -> Column:
    """Lengths of each match, of the text before it since the last one, and of the tested group."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    lengths = F.arrays_zip(F.transform(between, F.length).alias("skip"), F.transform(found, F.length).alias("n"), F.transform(tested, F.length).alias("tested"))
    row = F.transform(
        lengths,
        lambda x, i: F.struct(F.lit(number).alias("rule"), i.alias("i"), x["skip"].alias("skip"), x["n"].alias("n"), (x["tested"] >= rule.least).alias("good")),
    )
    return F.when(text.rlike(rule.pattern), row).otherwise(F.array().cast("array<struct<rule:int,i:int,skip:int,n:int,good:boolean>>"))


def findings(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(sha, spans) of every blob; spans in code points, by start and then rule, none of a clean blob."""
    rows = blobs.select("sha", F.explode_outer(F.concat(*[hits(r, k) for k, r in enumerate(rules)])).alias("hit")).select("sha", "hit.*")
    upto = Window.partitionBy("sha", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("skip") + F.col("n")).over(upto).cast("int")
    span = F.struct((F.col("end") - F.col("n")).alias("start"), F.col("rule"), F.col("end"))
    return rows.withColumn("end", end).groupBy("sha").agg(F.array_sort(F.collect_list(F.when(F.col("good"), span))).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(sha, spans, rule_version) of all runs so far; empty where there was none."""
    if not exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan(history: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Scan what the ledger at ``path`` lacks of ``history``'s blobs and add it; (sha, spans) of all blobs with any under ``version``.

    Null texts are empty blobs. Rows of other rule versions stay in the ledger and count for nothing. Where two runs
    scanned a blob at the same time, its equal rows are one.
    """
    spark = history.sparkSession
    blobs = unseen(history, read_ledger(spark, path), version)
    findings(blobs, rules).withColumn("rule_version", F.lit(version)).write.mode("append").partitionBy("rule_version").parquet(path)
    found = read_ledger(spark, path).where((F.col("rule_version") == version) & (F.size("spans") > 0))
    return found.select("sha", "spans").dropDuplicates(["sha"])


def shown(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, counts of the base kinds, base_sha256, and all spans as text.

    ``path`` is the ledger's folder, kept from run to run; without one the run has a ledger of its own. Rows stay, repeated
    ones and null doc_ids too; other columns are ignored.
    """
    found = scan(docs, path or new_path(docs.sparkSession, "ledger"))
    spans = F.coalesce("spans", F.array().cast(SPANS))
    rows = spread_join(docs.select("doc_id", address().alias("sha")), found, "sha", ["doc_id"]).select("doc_id", spans.alias("spans"))
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(shown(base, RULES), 256).alias("base_sha256"),
        shown(F.col("spans"), RULES).alias("spans"),
    )


def redacted(docs: DataFrame, mask: str = "[SECRET]", path: str | None = None) -> DataFrame:
    """``docs`` with each stretch of overlapping spans in ``text`` replaced by ``mask``; all columns and rows stay.

    ``n_chars``, where there is one, follows the text. Columns of other names are kept as they are, whatever they are called.
    Copies of a hot blob spread over tasks. ``path`` is as in `secret_spans`.
    """
    found = scan(docs, path or new_path(docs.sparkSession, "ledger"))
    rows = spread_join(docs.select(address().alias("sha"), F.col("doc_id").alias("by"), F.struct(*docs.columns).alias("row")), found, "sha", ["by"])
    old = F.col("row.text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.array(F.substring(old, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(old, acc["at"] + 1, F.lit(2**31 - 1))))
    clean = F.col("spans").isNull()
    out = rows.withColumn("new", F.when(clean, old).otherwise(masked))
    new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(clean, F.col("row.n_chars")).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def oracle() -> str:
    """The same rows as `secret_spans` in DuckDB."""
    per_rule = " union all ".join(
        f"select rid, {k} r, '{r.kind}' kind, i, length(p[i]) skip, length(m[i]) n, length(v[i]) >= {r.least} good from (select rid, string_split_regex(t, re) p, "
        f"regexp_extract_all(t, re, 0) m, regexp_extract_all(t, re, {r.group}) v from (select rid, t, '{r.pattern.replace(chr(39), chr(39) * 2)}' re from d)), "
        f"unnest(range(1, len(m) + 1)) as u(i)"
        for k, r in enumerate(RULES)
    )
    joined = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, r) filter (where {where}), '')"
    counts = ", ".join(f"count(*) filter (where r = {k}) n_{r.kind}" for k, r in enumerate(BASE))
    return (
        f"with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents), h as ({per_rule}), "
        "e as (select *, cast(sum(skip + n) over (partition by rid, r order by i) as bigint) e from h), "
        "f as (select rid, r, kind, e - n s, e from e where good) "
        f"select d.doc_id, {counts}, sha256({joined(f'r < {len(BASE)}')}) base_sha256, {joined('r is not null')} spans "
        "from d left join f on d.rid = f.rid group by d.rid, d.doc_id"
    )
