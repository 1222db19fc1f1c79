"""Inflection as lookups in a paradigm table (lemma, cat, form, case, number, gender, definite)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CASES = ("nf", "þf", "þgf", "ef")
NAMES = dict(zip(CASES, ("nominative", "accusative", "dative", "genitive")))
SPECS = {"nf": "nominative", "nom": "nominative", "þf": "accusative", "acc": "accusative", "þgf": "dative", "dat": "dative", "ef": "genitive", "gen": "genitive", "ángr": "indefinite", "ind": "indefinite", "stofn": "canonical", "can": "canonical"}
DECLINED = ("no", "lo", "gr")


def like(form: Column, model: Column) -> Column:
    """form capitalised as the model is."""
    return F.when(model == F.upper(model), F.when(F.length(model) > 1, F.upper(form)).otherwise(F.initcap(form))).when(model.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(form, 1, 1)), F.substring(form, F.lit(2), F.length(form)))).otherwise(form)


def forms(words: DataFrame, paradigm: DataFrame) -> DataFrame:
    """words (key, ix, txt, cat, number, gender, definite) with nominative ... genitive, indefinite and canonical.

    Each word meets its lemma's rows once; of several forms the first in order is taken, and a word that the
    paradigm does not know, or of a category that is not declined, stays as it is.
    """
    own = paradigm.select(F.col("form").alias("_form"), F.col("cat").alias("_cat"), F.col("lemma").alias("_lemma"))
    low = F.lower("txt")
    found = words.join(own, (low == own["_form"]) & (words.cat == own["_cat"]), "left").withColumn("_n", F.row_number().over(Window.partitionBy("key", "ix").orderBy("_lemma"))).where("_n = 1").drop("_n", "_form", "_cat")
    # a lemma's forms are one row, so that words are neither multiplied nor grouped
    cells = F.collect_list(F.struct(F.col("form").alias("f"), F.col("case").alias("c"), F.col("number").alias("n"), F.col("gender").alias("g"), F.col("definite").alias("d")))
    p = paradigm.groupBy(F.col("lemma").alias("_lemma"), F.col("cat").alias("_c")).agg(cells.alias("_cells"))
    pairs = found.join(p, (found["_lemma"] == p["_lemma"]) & (found.cat == p["_c"]), "left").drop(p["_lemma"])
    agrees = lambda x: F.coalesce(x["g"] == F.col("gender"), F.lit(True))
    pick = lambda case, number, definite: F.array_min(F.transform(F.filter("_cells", lambda x: (x["c"] == case) & (x["n"] == number) & (x["d"] == definite) & agrees(x)), lambda x: x["f"]))
    wanted = {NAMES[c]: pick(c, F.col("number"), F.col("definite")) for c in CASES} | {"indefinite": pick("nf", F.col("number"), F.lit(False)), "canonical": pick("nf", F.lit("et"), F.lit(False))}
    out = pairs.select("key", "ix", "txt", "cat", "number", "gender", "definite", *[v.alias(k) for k, v in wanted.items()])
    for k in wanted:
        out = out.withColumn(k, F.when(F.col("cat").isin(*DECLINED), F.coalesce(like(F.col(k), F.col("txt")), F.col("txt"))).otherwise(F.col("txt")))
    return out


def phrases(forms: DataFrame) -> DataFrame:
    """The forms of whole noun phrases: words in order; articles go from the indefinite and, with numerals, the canonical form."""
    def line(column: str, keep: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(keep & (F.col(column) != ""), F.struct("ix", F.col(column).alias("x")))))
        return F.regexp_replace(F.array_join(F.transform(rows, lambda r: r["x"]), " "), r"[\s.,;:!?]+$", "")

    every = F.lit(True)
    plain = F.col("cat") != "gr"
    return forms.groupBy("key").agg(*[line(n, every).alias(n) for n in NAMES.values()], line("indefinite", plain).alias("indefinite"), line("canonical", plain & (F.col("cat") != "to")).alias("canonical"))


def formatted(phrase: DataFrame, spec: str) -> DataFrame:
    """(key, form) for one of the format names; others are an error."""
    if spec not in SPECS:
        raise ValueError(f"unknown format {spec!r}")
    return phrase.select("key", F.col(SPECS[spec]).alias("form"))


#: A paradigm made up for tests and queries: endings by case and number, an article as a suffix.
_ENDINGS = {"et": ("o", "u", "i", "is"), "ft": ("or", "ur", "um", "na")}


def toy_paradigm(stems: DataFrame) -> DataFrame:
    """Forms for stems (stem, cat, gender): eight endings, each without and with the suffix -in."""
    rows = [(c, n, d, e + ("in" if d else "")) for n, es in _ENDINGS.items() for c, e in zip(CASES, es) for d in (False, True)]
    table = F.array(*[F.struct(F.lit(c).alias("case"), F.lit(n).alias("number"), F.lit(d).alias("definite"), F.lit(e).alias("ending")) for c, n, d, e in rows])
    out = stems.select("stem", "cat", "gender", F.explode(table).alias("x"))
    return out.select(F.concat("stem", F.lit("o")).alias("lemma"), "cat", F.concat("stem", "x.ending").alias("form"), "x.case", "x.number", "gender", "x.definite")
