"""A deterministic toy catalogue: a lexicon derived from the words themselves, for any corpus.

Every engine can compute it: digits of the md5 of the lower-case word choose the category and the features, a few
function words are fixed, and three sixteenths of all words stay out of the lexicon.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions import text as T

FUNCTION_WORDS = {
    "gr": ("the", "a", "an", "der", "die", "das", "ein", "eine", "le", "la", "les", "un", "une", "el", "los", "las"),
    "fs": ("of", "with", "in", "to", "by", "for", "on", "at", "from", "von", "zu", "mit", "für", "de", "du", "des", "par", "dans", "sur", "pour", "del", "por", "para", "con", "en"),
    "st": ("and", "or", "that", "und", "oder", "et", "ou", "que", "qui", "y", "o"),
}
FORMS = {w: cat for cat, words in FUNCTION_WORDS.items() for w in words}
MULTIPLIERS = {
    "hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000, "hundert": 100, "tausend": 1_000,
    "cent": 100, "mille": 1_000, "cien": 100, "mil": 1_000,
}
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "zwei": 2, "drei": 3, "deux": 2, "trois": 3, "dos": 2, "tres": 3}
CURRENCIES = {"dollar": "USD", "dollars": "USD", "euro": "EUR", "euros": "EUR", "pound": "GBP", "pounds": "GBP", "krona": "SEK", "kronor": "SEK"}
NATIONS = {"danish": "DKK", "swedish": "SEK", "norwegian": "NOK", "canadian": "CAD"}
PERCENT = ("percent", "prozent", "pourcent")


def digit(form: Column, k: int) -> Column:
    """Hexadecimal digit k of the word's md5, as a number."""
    return F.conv(F.substring(F.md5(form), k, 1), 16, 10).cast("int")


def describe(form: Column, known: Column) -> dict[str, Column]:
    """The lexicon's columns for a lower-case form: cat (null if out of vocabulary), cs, gender, num, lemma, infl."""
    table = F.create_map(*[F.lit(x) for kv in FORMS.items() for x in kv])
    d1 = digit(form, 1)
    cat = F.when(~known, F.lit(None)).otherwise(F.coalesce(table[form], F.when(d1 <= 5, "no").when(d1 <= 9, "so").when(d1 <= 11, "lo").when(d1 == 12, "ao")))
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), digit(form, k) % len(names) + 1)
    cs, gender, num = pick(("nf", "þf", "þgf", "ef"), 2), pick(("kk", "kvk", "hk"), 3), pick(("et", "ft"), 4)
    only = lambda x: F.when(cat.isNotNull(), x)
    lemma = F.when(F.length(form) > 4, F.substring(form, F.lit(1), F.length(form) - 2)).otherwise(form)
    return {"cat": cat, "cs": only(cs), "gender": only(gender), "num": only(num), "lemma": only(lemma), "infl": only(F.upper(F.concat(cs, num)))}


def meaning(form: str) -> tuple[str | None, str | None]:
    """cat and lemma as describe() has them, of one lower-case word."""
    cat = FORMS.get(form)
    if cat is None:
        d1 = int(md5(form.encode()).hexdigest()[0], 16)
        cat = "no" if d1 <= 5 else "so" if d1 <= 9 else "lo" if d1 <= 11 else "ao" if d1 == 12 else None
    return cat, None if cat is None else form[:-2] if len(form) > 4 else form


def lexicon(tokens: DataFrame) -> DataFrame:
    """form, lemma, cat, cs, gender, num, infl: a row for each known word of a token table."""
    forms = tokens.where("kind = 'WORD'").select(F.lower("txt").alias("form")).distinct()
    made = describe(F.col("form"), F.lit(True))
    return forms.select("form", *[c.alias(n) for n, c in made.items()]).where("cat IS NOT NULL")


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """The lexicon of the words of all texts. By n, conditions on it stay above the count: each word is described once, not each token."""
    made = describe(F.col("form"), F.col("n") > 0)
    return T.forms(docs, text).select("form", *[c.alias(n) for n, c in made.items()]).where("cat IS NOT NULL")


def annotated(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens with the lexicon's columns. The toy lexicon is a function of the form, so nothing is joined."""
    rows = T.tokens(docs, doc, text).withColumn("lw", F.lower("txt"))
    made = describe(F.col("lw"), F.col("kind") == "WORD")
    return rows.select("doc_id", "tok_ix", "sent_ix", "txt", "lw", "kind", *[c.alias(n) for n, c in made.items()])
