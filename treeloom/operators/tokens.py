"""The token pipeline: each phase takes a token table and gives one. Windows are partitioned by document throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import features as X
from treeloom.sources import toy

#: Tokens that a sentence may have to be parsed.
MAX_TOKENS = 90

Phase = Callable[[DataFrame], DataFrame]


class Pipeline:
    """Named phases in a fixed order; any may be replaced, left out, or put after another."""

    def __init__(self, phases: list[tuple[str, Phase]]):
        self.phases = list(phases)

    def replace(self, name: str, phase: Phase) -> Pipeline:
        return Pipeline([(n, phase if n == name else p) for n, p in self.phases])

    def without(self, name: str) -> Pipeline:
        return Pipeline([(n, p) for n, p in self.phases if n != name])

    def after(self, name: str, new: str, phase: Phase) -> Pipeline:
        return Pipeline([x for n, p in self.phases for x in ([(n, p), (new, phase)] if n == name else [(n, p)])])

    def __call__(self, df: DataFrame) -> DataFrame:
        for _, phase in self.phases:
            df = df.transform(phase)
        return df


def default_pipeline(lexicon: DataFrame | None = None) -> Pipeline:
    same: Phase = lambda df: df
    known: Phase = (lambda df: annotate(df, lexicon)) if lexicon is not None else same
    return Pipeline([("correct_tokens", same), ("annotate", known), ("recognize_entities", same), ("check_spelling", same), ("numbers", numbers), ("amounts", amounts), ("abbreviations", resplit), ("final_correct", same)])


def by_doc():
    return Window.partitionBy("doc_id").orderBy("tok_ix")


def by_sentence():
    return Window.partitionBy("doc_id", "sent_ix").orderBy("tok_ix")


# ---- segmentation


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, para_ix, text for each line of a text that is not blank."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("para_ix", "text"))
    return rows.where(F.trim("text") != "")


def sentences(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_ix, first, last, n_tokens and text of each sentence."""
    inside = tokens.where("kind <> 'P'")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_ix", "txt"))), lambda x: x["txt"]), " ")
    return inside.groupBy("doc_id", "sent_ix").agg(F.min("tok_ix").alias("first"), F.max("tok_ix").alias("last"), F.count("*").alias("n_tokens"), joined.alias("text"))


def first_sentences(tokens: DataFrame) -> DataFrame:
    """The tokens of each document's first sentence that has any; no rows for a document without tokens."""
    least = F.min(F.when(F.col("kind") != "P", F.col("sent_ix"))).over(Window.partitionBy("doc_id"))
    return tokens.withColumn("_least", least).where("kind <> 'P' AND sent_ix = _least").drop("_least")


def resplit(tokens: DataFrame) -> DataFrame:
    """A full stop after a single letter does not end a sentence if a lower-case word follows; sent_ix counts anew."""
    before, after = F.lag("txt").over(by_doc()), F.lead("txt").over(by_doc())
    inside = (F.col("txt") == ".") & (F.length(before) == 1) & before.rlike(r"^\p{L}") & after.rlike(r"^\p{Ll}")
    ends = F.col("txt").isin(".", "!", "?", "\n") & ~F.coalesce(inside, F.lit(False))
    rows = tokens.withColumn("_ends", ends.cast("int"))
    return rows.withColumn("sent_ix", F.coalesce(F.sum("_ends").over(by_doc().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")).drop("_ends")


def lost_characters(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Documents whose tokens do not account for every character but the blanks: none, if the splitting is sound."""
    own = tokens.groupBy("doc_id").agg(F.sum(F.when(F.col("txt") == "\n", 0).otherwise(F.length("txt"))).alias("n"))
    whole = docs.select("doc_id", F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")).alias("whole"))
    return whole.join(own, "doc_id", "left").where(F.coalesce("n", F.lit(0)) != F.col("whole")).select("doc_id")


def gate(tokens: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """Tokens with too_long, whether their sentence is longer than a parser takes."""
    return tokens.withColumn("too_long", F.count(F.when(F.col("kind") != "P", 1)).over(Window.partitionBy("doc_id", "sent_ix")) > most)


def prune_parentheses(tokens: DataFrame) -> DataFrame:
    """Tokens without the parentheses that hold no known word."""
    opens, closes = (F.col("txt") == "(").cast("int"), (F.col("txt") == ")").cast("int")
    depth = F.sum(opens).over(by_sentence()) - F.coalesce(F.sum(closes).over(by_sentence().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = tokens.withColumn("_depth", depth).withColumn("_group", F.sum(opens).over(by_sentence()))
    known = F.max(F.col("cat").isNotNull() & (F.col("_depth") > 0)).over(Window.partitionBy("doc_id", "sent_ix", "_group"))
    return rows.withColumn("_known", known).where(~((F.col("_depth") > 0) & ~F.col("_known"))).drop("_depth", "_group", "_known")


# ---- lexicon


def annotate(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """tokens with meanings, all readings of their lower-case form; empty if there are none.

    Frequent words are looked up once: the distinct forms are joined, and their readings come back by a join that
    broadcasts if the vocabulary is small and that AQE splits if a form is hot.
    """
    readings = lexicon.groupBy("form").agg(F.array_sort(F.collect_list(F.struct(*[c for c in lexicon.columns if c != "form"]))).alias("meanings"))
    rows = tokens.withColumn("form", F.lower("txt")).join(readings, "form", "left")
    return rows.withColumn("meanings", F.coalesce("meanings", F.array().cast(readings.schema["meanings"].dataType))).drop("form")


def hyphen_parts(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """form, found, how for forms with hyphens: the whole, else the parts together, else the last part alone."""
    known = lexicon.select(F.col("form").alias("_known")).distinct()
    rows = forms.select("form").distinct().withColumn("joined", F.regexp_replace("form", "-", "")).withColumn("last", F.element_at(F.split("form", "-"), -1))
    for column in ("form", "joined", "last"):
        rows = rows.join(known, F.col(column) == F.col("_known"), "left").withColumnRenamed("_known", f"_{column}")
    how = F.when(F.col("_form").isNotNull(), "whole").when(F.col("_joined").isNotNull(), "joined").when(F.col("_last").isNotNull(), "last").otherwise("unknown")
    return rows.select("form", F.coalesce("_form", "_joined", "_last").alias("found"), how.alias("how"))


def unknown_words(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    return tokens.where("kind = 'WORD'").join(lexicon.select("form").distinct(), F.lower("txt") == F.col("form"), "left_anti")


def foreign(tokens: DataFrame, ratio: float = 0.5) -> DataFrame:
    """For each sentence its words, known words, and whether too few of more than two words are known."""
    word = F.col("kind") == "WORD"
    own = tokens.groupBy("doc_id", "sent_ix").agg(F.count_if(word).alias("words"), F.count_if(word & F.col("cat").isNotNull()).alias("known"))
    return own.withColumn("is_foreign", (F.col("words") > 2) & (F.col("known") < F.lit(ratio) * F.col("words")))


# ---- numbers, amounts, dates


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def number_value(txt: Column) -> Column:
    """The value of a numeral (commas group thousands), a number word or a multiplier; null for other tokens."""
    numeral = F.regexp_replace(F.regexp_replace(txt, r"[.,]$", ""), ",", "").try_cast("double")
    return F.when(txt.rlike("^[0-9]"), numeral).otherwise(F.coalesce(_lookup(toy.NUMBER_WORDS, F.lower(txt)).cast("double"), _lookup(toy.MULTIPLIERS, F.lower(txt)).cast("double")))


def numbers(tokens: DataFrame, multiply: bool = True) -> DataFrame:
    """Runs of adjacent numbers that end in a multiplier become one NUMBER token with their product as value.

    Gaps and islands: a run is a stretch of number tokens; without `multiply` every number stays a token of its own.
    """
    rows = tokens.withColumn("value", number_value(F.col("txt")))
    if not multiply:
        return rows.withColumn("kind", F.when(F.col("value").isNotNull(), "NUMBER").otherwise(F.col("kind")))
    numeric, times = F.col("value").isNotNull(), _lookup(toy.MULTIPLIERS, F.lower("txt")).isNotNull()
    fresh = numeric & ~F.coalesce(F.lag(numeric).over(by_doc()) & times, F.lit(False))
    rows = rows.withColumn("_run", F.sum(F.when(fresh | ~numeric, 1).otherwise(0)).over(by_doc()))
    in_order = F.array_sort(F.collect_list(F.struct("tok_ix", "txt", "value")))
    others = [c for c in tokens.columns if c not in ("doc_id", "tok_ix", "txt", "kind", "sent_ix")]
    grouped = rows.groupBy("doc_id", "_run").agg(
        F.min("tok_ix").alias("tok_ix"), F.min("sent_ix").alias("sent_ix"), in_order.alias("_all"),
        F.min_by("kind", "tok_ix").alias("kind"), *[F.min_by(c, "tok_ix").alias(c) for c in others],
    )
    value = F.aggregate("_all", F.lit(1.0), lambda a, x: a * x["value"])
    return grouped.select("doc_id", "tok_ix", "sent_ix", F.array_join(F.transform("_all", lambda x: x["txt"]), " ").alias("txt"), F.when(value.isNotNull(), "NUMBER").otherwise(F.col("kind")).alias("kind"), *others, value.alias("value"))


def amounts(rows: DataFrame) -> DataFrame:
    """NUMBER + currency -> AMOUNT, NUMBER + nationality + currency -> AMOUNT in that nation's currency, NUMBER + percent word -> PERCENT.

    The tokens that are taken in are dropped; iso names the currency.
    """
    low = lambda k: F.lower(F.lead("txt", k).over(by_doc()))
    one, two = _lookup(toy.CURRENCIES, low(1)), _lookup(toy.CURRENCIES, low(2))
    nation = _lookup(toy.NATIONS, low(1))
    number = F.col("kind").isin("NUMBER", "YEAR") & F.col("value").isNotNull()
    size = F.when(number & nation.isNotNull() & two.isNotNull(), 3).when(number & one.isNotNull(), 2).when(number & low(1).isin(*toy.PERCENT), 2).otherwise(1)
    made = rows.withColumn("_size", size).withColumn("iso", F.when(F.col("_size") == 3, nation).when(number & one.isNotNull(), one))
    made = made.withColumn("_kind", F.when(F.col("iso").isNotNull(), "AMOUNT").when(F.col("_size") == 2, "PERCENT").otherwise(F.col("kind")))
    made = made.withColumn("_text", F.when(F.col("_size") == 3, F.concat_ws(" ", "txt", F.lead("txt", 1).over(by_doc()), F.lead("txt", 2).over(by_doc()))).when(F.col("_size") == 2, F.concat_ws(" ", "txt", F.lead("txt", 1).over(by_doc()))).otherwise(F.col("txt")))
    taken = (F.coalesce(F.lag("_size", 1).over(by_doc()), F.lit(1)) > 1) | (F.coalesce(F.lag("_size", 2).over(by_doc()), F.lit(1)) > 2)
    made = made.withColumn("_taken", taken).where("not _taken")
    return made.withColumn("kind", F.col("_kind")).withColumn("txt", F.col("_text")).drop("_size", "_kind", "_text", "_taken")


# Abbreviations of amounts in ISK and their factors.
AMOUNT_ABBREVIATIONS = {
    "kr.": 1,
    "kr": 1,
    "þ.kr.": 10**3,
    "þ.kr": 10**3,
    "þús.kr.": 10**3,
    "þús.kr": 10**3,
    "m.kr.": 10**6,
    "m.kr": 10**6,
    "mkr.": 10**6,
    "mkr": 10**6,
    "ma.kr.": 10**9,
    "ma.kr": 10**9,
    "mrð.kr.": 10**9,
    "mrð.kr": 10**9,
}


def abbreviated_amounts(rows: DataFrame, factors: dict[str, int] = AMOUNT_ABBREVIATIONS, iso: str = "ISK") -> DataFrame:
    """NUMBER (with value) + abbreviation -> AMOUNT; the longest abbreviation of at most four tokens is taken in."""
    nexts = [F.lead("txt", k).over(by_doc()) for k in range(1, 5)]
    number = F.col("kind").isin("NUMBER", "YEAR") & F.col("value").isNotNull()
    found = F.coalesce(*[F.when(number & _lookup(factors, F.concat(*nexts[:k])).isNotNull(), F.struct(F.lit(k + 1).alias("size"), F.concat(*nexts[:k]).alias("short"))) for k in (4, 3, 2, 1)])
    made = rows.withColumn("_found", found).withColumn("_size", F.coalesce("_found.size", F.lit(1)))
    taken = F.greatest(*[F.coalesce(F.lag("_size", k).over(by_doc()) - k, F.lit(0)) for k in range(1, 5)]) > 0
    made = made.withColumn("_taken", taken).where("not _taken")
    short = F.col("_found.short")
    out = {"value": F.coalesce(F.col("value") * _lookup(factors, short), F.col("value")), "kind": F.when(short.isNotNull(), "AMOUNT").otherwise(F.col("kind")), "txt": F.concat_ws(" ", "txt", short)}
    out["iso"] = F.when(short.isNotNull(), iso).otherwise(F.col("iso") if "iso" in rows.columns else F.lit(None))
    return made.withColumns(out).drop("_found", "_size", "_taken")


def ordinals(tokens: DataFrame) -> DataFrame:
    """A whole number with a full stop before a lower-case word is an ORDINAL."""
    fits = F.col("kind").isin("NUMBER", "YEAR") & F.col("txt").rlike(r"^[0-9]+\.$") & F.lead("txt").over(by_doc()).rlike(r"^\p{Ll}")
    return tokens.withColumn("kind", F.when(F.coalesce(fits, F.lit(False)), "ORDINAL").otherwise(F.col("kind")))


def currencies(tokens: DataFrame) -> DataFrame:
    """Pairs of a nationality and a currency word: iso, and the cases that both may stand in."""
    here, there = F.lower("txt"), F.lower(F.lead("txt").over(by_doc()))
    pair = _lookup(toy.NATIONS, here).isNotNull() & _lookup(toy.CURRENCIES, there).isNotNull()
    rows = tokens.withColumn("iso", F.when(pair, _lookup(toy.NATIONS, here))).withColumn("next", F.lead("txt").over(by_doc()))
    return rows.where("iso IS NOT NULL")


def timestamps(tokens: DataFrame) -> DataFrame:
    """A TIME token before a DATEABS or DATEREL token becomes one TIMESTAMPABS or TIMESTAMPREL token.

    The table has y, mo, d, h, m, s; zero means unknown.
    """
    after = F.lead("kind").over(by_doc())
    joins = (F.col("kind") == "TIME") & after.isin("DATEABS", "DATEREL")
    rows = tokens.withColumn("_joins", joins)
    for c in ("y", "mo", "d"):
        rows = rows.withColumn(c, F.when(F.col("_joins"), F.lead(c).over(by_doc())).otherwise(F.col(c)))
    rows = rows.withColumn("txt", F.when(F.col("_joins"), F.concat_ws(" ", "txt", F.lead("txt").over(by_doc()))).otherwise(F.col("txt")))
    rows = rows.withColumn("_kind", F.when(F.col("_joins"), F.concat(F.lit("TIMESTAMP"), F.substring(after, 5, 3))).otherwise(F.col("kind")))
    rows = rows.withColumn("_taken", F.coalesce(F.lag("_joins").over(by_doc()), F.lit(False))).where("not _taken")
    return rows.withColumn("kind", F.col("_kind")).drop("_joins", "_kind", "_taken")


def composites(tokens: DataFrame, joiners: tuple[str, ...] = ("and", "or", "und", "oder", "og", "eða")) -> DataFrame:
    """`pre - and word` and longer lists become one token: prefixes with their hyphens, the joiner and the word.

    Islands over a shape string: each document's tokens are coded by one letter each, and matches are cut out of it.
    """
    code = F.when(F.col("txt") == "-", "h").when(F.lower("txt").isin(*joiners), "j").when(F.col("txt") == ",", "c").when(F.col("kind") == "WORD", "w").otherwise("x")
    rows = tokens.withColumn("_c", code)
    at = lambda k: F.lead("_c", k).over(by_doc())
    begins = (F.col("_c") == "w") & (at(1) == "h") & (at(2) == "j") & (at(3) == "w")
    rows = rows.withColumn("_begins", F.coalesce(begins, F.lit(False)))
    inside = F.lit(False)
    for k in (1, 2, 3):
        inside = inside | F.coalesce(F.lag("_begins", k).over(by_doc()), F.lit(False))
    words = F.concat(F.col("txt"), F.lit("- "), F.lead("txt", 2).over(by_doc()), F.lit(" "), F.lead("txt", 3).over(by_doc()))
    rows = rows.withColumn("_text", F.when(F.col("_begins"), words).otherwise(F.col("txt"))).withColumn("_inside", inside & ~F.col("_begins"))
    return rows.where("not _inside").withColumn("txt", F.col("_text")).drop("_c", "_begins", "_text", "_inside")


# ---- phrases


def phrase_hits(tokens: DataFrame, phrases: DataFrame, most: int = 4) -> DataFrame:
    """doc_id, tok_ix, n, phrase_id for every place where a phrase (words, n, phrase_id) stands, by joins on n-grams."""
    low = tokens.select("doc_id", "tok_ix", F.lower("txt").alias("w0"))
    for k in range(1, most):
        low = low.withColumn(f"w{k}", F.lead("w0", k).over(by_doc()))
    grams = F.filter(F.array(*[F.when(F.col(f"w{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *[f"w{k}" for k in range(n)]).alias("words"))) for n in range(2, most + 1)]), lambda x: x.isNotNull())
    rows = low.select("doc_id", "tok_ix", F.explode(grams).alias("g")).select("doc_id", "tok_ix", "g.n", "g.words")
    return rows.join(phrases.select("words", "phrase_id"), "words").select("doc_id", "tok_ix", "n", "phrase_id")


def greedy(hits: DataFrame) -> DataFrame:
    """Of overlapping hits the one that is complete first, and of those the longest; then on from its end.

    Greedy choice is sequential, so a document's hits (not its tokens) are folded in order, inside Catalyst.
    """
    ordered = F.array_sort(F.collect_list(F.struct((F.col("tok_ix") + F.col("n")).alias("stop"), F.col("tok_ix").alias("start"), F.col("phrase_id"))))
    empty = F.struct(F.lit(0).cast("int").alias("free"), F.array().cast("array<struct<stop:int,start:int,phrase_id:bigint>>").alias("kept"))
    step = lambda s, x: F.when(x["start"] >= s["free"], F.struct(x["stop"].alias("free"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)
    folded = F.aggregate(F.transform("_h", lambda x: F.struct(x["stop"].cast("int").alias("stop"), x["start"].cast("int").alias("start"), x["phrase_id"].cast("long").alias("phrase_id"))), empty, step)
    rows = hits.groupBy("doc_id").agg(ordered.alias("_h")).select("doc_id", F.explode(folded["kept"]).alias("x"))
    return rows.select("doc_id", F.col("x.start").alias("tok_ix"), (F.col("x.stop") - F.col("x.start")).alias("n"), F.col("x.phrase_id").alias("phrase_id"))


def merge_phrases(tokens: DataFrame, chosen: DataFrame) -> DataFrame:
    """tokens with each chosen phrase as one token, its words joined by blanks."""
    rows = tokens.join(chosen, ["doc_id", "tok_ix"], "left")
    stop = F.max(F.col("tok_ix") + F.col("n")).over(by_doc())
    start = F.max(F.when(F.col("n").isNotNull(), F.col("tok_ix"))).over(by_doc())
    rows = rows.withColumn("_island", F.when(F.col("tok_ix") < stop, start).otherwise(F.col("tok_ix")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_ix", "txt"))), lambda x: x["txt"]), " ")
    return rows.groupBy("doc_id", "_island").agg(F.min("sent_ix").alias("sent_ix"), text.alias("txt"), F.min_by("kind", "tok_ix").alias("kind"), F.max("phrase_id").alias("phrase_id")).withColumnRenamed("_island", "tok_ix")


def keep_readings(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """Ambiguous pairs (w1, w2, cat1, cat2; null for any): tokens inside keep only the readings of those categories.

    tokens has meanings; each phrase matches two adjacent lower-case words.
    """
    rows = tokens.withColumn("_w", F.lower("txt")).withColumn("_next", F.lead(F.lower("txt")).over(by_doc()))
    rows = rows.join(phrases, (F.col("_w") == F.col("w1")) & (F.col("_next") == F.col("w2")), "left")
    second = F.lag("cat2").over(by_doc())
    wanted = F.coalesce(F.col("cat1"), second)
    return rows.withColumn("meanings", F.when(wanted.isNotNull(), F.filter("meanings", lambda m: m["cat"] == wanted)).otherwise(F.col("meanings"))).drop("_w", "_next", "w1", "w2", "cat1", "cat2")


# ---- names

_CAPITAL = r"^\p{Lu}\p{Ll}"


def name_runs(tokens: DataFrame) -> DataFrame:
    """Runs of at least one capitalised word inside a sentence, past its first token: doc_id, sent_ix, tok_ix, n, name, gender.

    gender is that of the first word's reading; a run of one word counts only if the word is not in the lexicon
    otherwise (weak names stay words).
    """
    first = F.row_number().over(by_sentence()) == 1
    rows = tokens.withColumn("_is", (F.col("kind") == "WORD") & F.col("txt").rlike(_CAPITAL) & ~first)
    rows = rows.withColumn("_run", F.sum((~F.col("_is")).cast("int")).over(by_sentence())).where("_is")
    name = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_ix", "txt"))), lambda x: x["txt"]), " ")
    runs = rows.groupBy("doc_id", "sent_ix", "_run").agg(F.min("tok_ix").alias("tok_ix"), F.count("*").alias("n"), name.alias("name"), F.min_by("gender", "tok_ix").alias("gender"), F.max(F.col("cat").isNotNull()).alias("known"))
    return runs.withColumn("weak", (F.col("n") == 1) & F.col("known")).drop("_run", "known")


def back_references(runs: DataFrame) -> DataFrame:
    """Single-word names with the latest earlier full name of the document that begins with the same word.

    An as-of join without a join: full names are carried forward over the runs of one document and first name.
    """
    rows = runs.withColumn("given", F.element_at(F.split("name", " "), 1))
    over = Window.partitionBy("doc_id", "given").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, -1)
    full = F.last(F.when(F.col("n") > 1, F.col("name")), ignorenulls=True).over(over)
    return rows.withColumn("full_name", F.when(F.col("n") == 1, full)).drop("given")


def compatible(a: Column, b: Column) -> Column:
    """Readings (name, gender, case) of two arrays that agree where both say something, joined: a cross product with a filter."""
    agree = lambda x, y: x.isNull() | y.isNull() | (x == y)
    pairs = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: agree(x["gender"], y["gender"]) & agree(x["case"], y["case"])), lambda y: F.struct(F.concat_ws(" ", x["name"], y["name"]).alias("name"), F.coalesce(x["gender"], y["gender"]).alias("gender"), F.coalesce(x["case"], y["case"]).alias("case")))))
    return F.array_distinct(pairs)


def companies(tokens: DataFrame, endings: tuple[str, ...] = ("Inc", "Ltd", "Corp", "GmbH", "hf", "ehf")) -> DataFrame:
    """Capitalised runs followed by a corporate ending: doc_id, tok_ix, name."""
    cap = F.col("txt").rlike(r"^\p{Lu}")
    ends = F.lead("txt").over(by_doc()).isin(*endings)
    rows = tokens.withColumn("_cap", cap & ~F.col("txt").isin(*endings)).withColumn("_run", F.sum((~F.col("_cap")).cast("int")).over(by_doc())).withColumn("_end", F.when(ends, F.lead("txt").over(by_doc())))
    name = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_ix", "txt"))), lambda x: x["txt"]), " ")
    own = rows.where("_cap").groupBy("doc_id", "_run").agg(F.min("tok_ix").alias("tok_ix"), name.alias("name"), F.max_by("_end", "tok_ix").alias("ending"))
    return own.where("ending IS NOT NULL").select("doc_id", "tok_ix", F.concat_ws(" ", "name", "ending").alias("name"))


def entities(tokens: DataFrame) -> DataFrame:
    """Adjacent capitalised unknown words past a sentence's first token, coalesced."""
    runs = name_runs(tokens.withColumn("cat", F.col("cat")))
    unknown = tokens.where("cat IS NULL AND kind = 'WORD'").select("doc_id", "tok_ix")
    return runs.join(unknown, ["doc_id", "tok_ix"], "left_semi").select("doc_id", "sent_ix", "tok_ix", "n", F.col("name").alias("entity"))


def full_name(names: Column, case: Column, gender: Column) -> Column:
    """The best (name, gender, case) of an array: both fit, then the case, then the gender, then the first."""
    rank = lambda x, i: F.struct(F.when((x["case"] == case) & (x["gender"] == gender), 0).when(x["case"] == case, 1).when(x["gender"] == gender, 2).otherwise(3).alias("r"), i.alias("i"), x["name"].alias("name"))
    return F.array_min(F.transform(names, rank))["name"]


def cases_of(meanings: Column) -> Column:
    """All cases of the readings; all four if none is declined."""
    found = F.array_sort(F.array_distinct(F.filter(F.transform(meanings, lambda m: X.case_of(m["infl"])), lambda c: c.isNotNull())))
    return F.when(F.size(found) == 0, F.array(*map(F.lit, sorted(X.CASES)))).otherwise(found)


def genders_of(meanings: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(meanings, lambda m: m["gender"]), lambda g: g.isNotNull())))


# ---- lemmas and statistics


def lemma_counts(tokens: DataFrame) -> DataFrame:
    """lemma, cat, n: one shuffle of partial counts."""
    return tokens.where("lemma IS NOT NULL").groupBy("lemma", "cat").agg(F.count("*").alias("n"))


def lemmatise(tokens: DataFrame, key: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """tokens with lemmas: distinct (lemma, cat) of their meanings in order, sorted by a comparator if one is given."""
    found = F.array_distinct(F.transform("meanings", lambda m: F.struct(m["lemma"].alias("lemma"), m["cat"].alias("cat"))))
    return tokens.withColumn("lemmas", F.array_sort(found, key) if key else found)


def lemma_value(meanings: Column, txt: Column, values: dict, fits: Callable[[Column], Column] | None = None) -> Column:
    """The value of a word's first lemma that a dict of lower-case lemmas has (of the meanings that fit), else of its form."""
    own = lambda m: _lookup(values, F.lower(m["lemma"]))
    found = F.filter(meanings, lambda m: own(m).isNotNull() & (fits(m) if fits else F.lit(True)))
    return F.coalesce(own(F.get(found, F.lit(0))), _lookup(values, F.lower(txt)))


def in_order_of(column: Column, locale: str = "IS") -> Column:
    """A string column that compares as the locale's collation orders it."""
    return F.collate(column, locale)


def job_statistics(parsed: DataFrame) -> DataFrame:
    """One row of statistics from sentences (n_tokens, combinations; null combinations: not parsed).

    Ambiguity is the token-weighted mean of combinations^(1/n_tokens) over parsed sentences, 1 without any.
    """
    ok = F.col("combinations") > 0
    weight = F.when(ok, F.col("n_tokens"))
    return parsed.agg(
        F.count("*").alias("num_sentences"), F.count_if(ok).alias("num_parsed"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("num_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("combinations"))), F.lit(0)).cast("long").alias("num_combinations"),
        F.coalesce(F.round(F.sum(F.when(ok, F.pow(F.col("combinations").cast("double"), 1 / F.col("n_tokens"))) * weight) / F.sum(weight), 9), F.lit(1.0)).alias("ambiguity"),
    )
