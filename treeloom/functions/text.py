"""Raw tokens as Catalyst expressions: splitting, kinds, sentence numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words, numbers, line ends, and any other mark by itself.
TOKEN = r"(\p{L}+|[0-9][0-9.,]*|\n|\S)"
#: The words among the tokens: no other token takes letters.
WORD = r"(\p{L}+)"
ENDS = (".", "!", "?", "\n")


def token_array(text: Column, token: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(token), F.lit(1))


def kind(token: Column) -> Column:
    """WORD, YEAR, NUMBER, P (a paragraph's end) or PUNCTUATION."""
    return (
        F.when(token.rlike(r"^\p{L}"), "WORD")
        .when(token.rlike(r"^[0-9]{4}$") & token.try_cast("int").between(874, 2199), "YEAR")
        .when(token.rlike("^[0-9]"), "NUMBER")
        .when(token == "\n", "P")
        .otherwise("PUNCTUATION")
    )


def tokens(docs: DataFrame, doc: str = "doc_id", text: str = "text", token: str = TOKEN, kind: Callable[[Column], Column] = kind) -> DataFrame:
    """doc_id, tok_ix, txt, kind, sent_ix, by the pattern of a token and the rule for its kind.

    Documents are dealt by id before they are split, so the running sentence number and everything later that is
    partitioned by document needs no further shuffle: one row a document moves, not one a token.
    """
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).repartition("doc_id")
    rows = rows.select("doc_id", F.posexplode(token_array(F.col("text"), token)).alias("tok_ix", "txt")).withColumn("kind", kind(F.col("txt")))
    before = Window.partitionBy("doc_id").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.col("txt").isin(*ENDS).cast("int")
    return rows.withColumn("sent_ix", F.coalesce(F.sum(ended).over(before), F.lit(0)).cast("int"))


def forms(docs: DataFrame, text: str = "text") -> DataFrame:
    """form, n: each lower-case word of any text, and how often it occurs. No document is dealt: tasks send each word once."""
    rows = docs.select(F.explode(token_array(F.col(text), WORD)).alias("txt"))
    return rows.groupBy(F.lower("txt").alias("form")).agg(F.count("*").alias("n"))


def tidy(text: Column) -> Column:
    """Blanks between tokens put right: none before closing marks, none after opening ones."""
    closed = F.regexp_replace(text, r" ([.,;:!?)\]}%”])", "$1")
    return F.regexp_replace(closed, r"([(\[{“„]) ", "$1")
