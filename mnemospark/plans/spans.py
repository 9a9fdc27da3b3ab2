"""Queries over exact values that summaries put in backticks. Documents are the evidence; values are made of them, of each kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions.text import upper_letters
from mnemospark.operators import spans as S
from mnemospark.plans.registry import query

HAS = "(contains(s1, {0}) or contains(s2, {0}))"
SHAPES_SQL = " ".join(
    f"union all select 'shape', '{name}' from v where regexp_matches(v, '{pattern.replace(chr(39), chr(39) * 2)}')" for name, pattern in S.SHAPES.items() if name != "typographic-char"
)
MADE = """
with d as (select doc_id, coalesce(text, '') as t from documents),
e as (select doc_id, t || chr(10) || 'say "quoted-' || doc_id || '" col' || chr(9) || 'val' as s1, 'readme-' || doc_id as s2, array_to_string(list_transform([upper(substr(t, 1, 15)), replace(substr(t, 1, 15), ' ', '  '), substr(t, 1, 10) || '#' || substr(t, 11, 10),
  substr(t, 1, 8) || '--' || substr(t, 31, 8), substr(t, 1, 8) || '++' || substr(t, 9, 8), 'zqxj wvkq ' || doc_id, repeat('zq', 70), '“quoted-' || doc_id || '”', 'col\\tval', substr(t, 1, 12), 'x', 'readme-' || doc_id, 'zqxj wvkq ' || doc_id], lambda x: '`' || x || '`'), ' ') as summary from d),
o as (select doc_id, s1, s2, unnest(regexp_extract_all(summary, '`([^`\\n]+)`', 1)) as v from e),
v as (select * from o where not (HAS(v) or HAS(ESC))),
u as (select distinct doc_id, s1, s2, v, length(v) as n from v),
f as (select *, list_concat(case when ESC <> v and HAS(ESC) then ['escaped-form-present'] else [] end, list_concat(case when contains(v, '\\') and HAS(replace(v, '\\t', chr(9))) then ['unescaped-form-present'] else [] end,
  list_concat(case when trim(regexp_replace(v, '\\s+', ' ', 'g')) <> v and HAS(trim(regexp_replace(v, '\\s+', ' ', 'g'))) then ['whitespace-collapsed-present'] else [] end,
  list_concat(case when (lower(v) <> v and HAS(lower(v))) or (upper(v) <> v and HAS(upper(v))) then ['case-variant-present'] else [] end, case when regexp_matches(v, '[“”]') and HAS(regexp_replace(v, '[“”]', '"', 'g')) then ['typographic-variant-present'] else [] end)))) as forms from u),
g as (select *, n >= 8 and len(list_filter(range(1, n + 1), lambda i: HAS(substr(v, 1, i - 1) || substr(v, i + 1)))) > 0 as del,
  coalesce(list_max(list_filter(range(4, n - 3), lambda k: HAS(substr(v, 1, k)))), 0) as p, coalesce(list_max(list_filter(range(4, n - 3), lambda k: HAS(substr(v, n - k + 1)))), 0) as q from f where len(forms) = 0 and n <= 96),
c as (select g.*, k, w, row_number() over (partition by doc_id, v order by k desc, w) as nth from g, unnest(range(4, p + 1)) a(k), unnest([1, 2]) b(w) where n >= 8 and not del and n - k - w >= 4 and n - k - w <= q and not regexp_matches(substr(v, k + 1, w), '[\\p{L}\\p{N}]')),
j as (select doc_id, v, bool_or(nth <= 8 and regexp_matches(s1 || chr(10) || s2, regexp_escape(substr(v, 1, k)) || '[^\\p{L}\\p{N}\\r\\n]{0,' || (w + 2) || '}' || regexp_escape(substr(v, k + w + 1)))) as adjacent from c group by all),
r as (select doc_id, v, case when len(forms) > 0 then forms when n > 96 then ['not-classified-length'] end as relations from f where len(forms) > 0 or n > 96
  union all select g.doc_id, g.v, [case when del then 'single-deletion-present' when j.adjacent then 'composed-adjacent-present' when j.v is not null then 'composed-two-present-parts' else 'no-near-miss' end] from g left join j on g.doc_id = j.doc_id and g.v = j.v)
"""


def filled(sql: str) -> str:
    import re

    sql = sql.replace("ESC", "replace(replace(replace(v, '\\', '\\\\'), '\"', '\\\"'), chr(9), '\\t')")
    while (at := sql.find("HAS(")) >= 0:
        depth, end = 1, at + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[:at] + HAS.format(sql[at + 4 : end - 1]) + sql[end:]
    return re.sub(r"\n\s*", " ", sql)


def made(t):
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    part = lambda a, n: F.substring(text, a, n)
    values = [
        upper_letters(part(1, 15)), F.replace(part(1, 15), F.lit(" "), F.lit("  ")), F.concat(part(1, 10), F.lit("#"), part(11, 10)), F.concat(part(1, 8), F.lit("--"), part(31, 8)), F.concat(part(1, 8), F.lit("++"), part(9, 8)),
        F.concat(F.lit("zqxj wvkq "), k), F.lit("zq" * 70), F.concat(F.lit("“quoted-"), k, F.lit("”")), F.lit("col\\tval"), part(1, 12), F.lit("x"), F.concat(F.lit("readme-"), k), F.concat(F.lit("zqxj wvkq "), k),
    ]
    summary = F.concat_ws(" ", *[F.concat(F.lit("`"), v, F.lit("`")) for v in values])
    sources = F.array(F.concat(text, F.lit('\nsay "quoted-'), k, F.lit('" col\tval')), F.concat(F.lit("readme-"), k), F.lit(""))
    return t.documents.select("doc_id", summary.alias("summary"), sources.alias("sources"))


@query(
    filled(MADE) + "select kind, name, count(*) as n from (select 'relation' as kind, unnest(relations) as name from v join r using (doc_id, v) union all select 'length', case when length(v) <= 8 then 'len-1-8' when length(v) <= 16 then 'len-9-16' when length(v) <= 32 then 'len-17-32' "
    f"when length(v) <= 64 then 'len-33-64' when length(v) <= 120 then 'len-65-120' else 'len-121-plus' end from v {SHAPES_SQL} union all select 'shape', 'typographic-char' from v where regexp_matches(v, '[“”]')) group by all"
)
def summary_span_classes(t):
    """How many values that the evidence lacks have each relation to it, each shape and each length."""
    return S.counters(S.reports(made(t), ["doc_id"]))
