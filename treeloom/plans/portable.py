"""SQL that Spark and DuckDB both run: the few places where their dialects differ, and the shared token tables."""

from __future__ import annotations

from treeloom.functions.text import TOKEN
from treeloom.sources import toy


class Spark:
    name = "spark"

    def agg(self, what: str, sep: str, order: str, where: str = "") -> str:
        return f"listagg({what}, '{sep}') WITHIN GROUP (ORDER BY {order})" + (f" FILTER (WHERE {where})" if where else "")

    def long(self, what: str) -> str:
        return f"CAST({what} AS BIGINT)"

    def contains(self, a: str, b: str) -> str:
        return f"contains({a}, {b})"


class Duck(Spark):
    name = "duck"

    def agg(self, what: str, sep: str, order: str, where: str = "") -> str:
        return f"string_agg({what}, '{sep}' ORDER BY {order})" + (f" FILTER (WHERE {where})" if where else "")


def duck_tokens(source: str = "documents", doc: str = "doc_id", text: str = "text") -> str:
    """CTEs raw, tok and ann as the library's tokens() and annotated() make them."""
    forms = " ".join(f"WHEN lw IN ({', '.join(repr(w) for w in words)}) THEN '{cat}'" for cat, words in toy.FUNCTION_WORDS.items())
    d = lambda k: f"(instr('0123456789abcdef', substr(md5(lw), {k}, 1)) - 1)"
    return f"""
raw AS (SELECT {doc} AS doc_id, unnest(t) AS txt, generate_subscripts(t, 1) - 1 AS tok_ix FROM (SELECT {doc}, regexp_extract_all(coalesce({text}, ''), '{TOKEN}', 1) AS t FROM {source})),
tok AS (SELECT doc_id, tok_ix::INT AS tok_ix, txt,
        CASE WHEN regexp_matches(txt, '^\\p{{L}}') THEN 'WORD' WHEN regexp_matches(txt, '^[0-9]{{4}}$') AND try_cast(txt AS INT) BETWEEN 874 AND 2199 THEN 'YEAR'
             WHEN regexp_matches(txt, '^[0-9]') THEN 'NUMBER' WHEN txt = chr(10) THEN 'P' ELSE 'PUNCTUATION' END AS kind,
        coalesce(sum((txt IN ('.', '!', '?', chr(10)))::INT) OVER (PARTITION BY doc_id ORDER BY tok_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS sent_ix FROM raw),
low AS (SELECT *, lower(txt) AS lw FROM tok),
cats AS (SELECT *, CASE WHEN kind <> 'WORD' THEN NULL {forms} WHEN {d(1)} <= 5 THEN 'no' WHEN {d(1)} <= 9 THEN 'so' WHEN {d(1)} <= 11 THEN 'lo' WHEN {d(1)} = 12 THEN 'ao' END AS cat FROM low),
ann AS (SELECT doc_id, tok_ix, sent_ix, txt, lw, kind, cat,
        CASE WHEN cat IS NOT NULL THEN ['nf', 'þf', 'þgf', 'ef'][{d(2)} % 4 + 1] END AS cs,
        CASE WHEN cat IS NOT NULL THEN ['kk', 'kvk', 'hk'][{d(3)} % 3 + 1] END AS gender,
        CASE WHEN cat IS NOT NULL THEN ['et', 'ft'][{d(4)} % 2 + 1] END AS num,
        CASE WHEN cat IS NOT NULL THEN CASE WHEN length(lw) > 4 THEN substr(lw, 1, length(lw) - 2) ELSE lw END END AS lemma,
        CASE WHEN cat IS NOT NULL THEN upper(['nf', 'þf', 'þgf', 'ef'][{d(2)} % 4 + 1] || ['et', 'ft'][{d(4)} % 2 + 1]) END AS infl FROM cats)
"""
