"""Whether a token's reading can stand for a terminal: one Catalyst predicate for the join of tokens and terminals.

A token is a struct (kind, txt, value, iso, cases, genders, names), a reading of it a struct (cat, cls, lemma, form,
infl), null for an unknown word, a terminal its name: a category or a literal, then variants with _ before each.
Catalogue tables (prepositions, verb frames, subjects, adjectives' arguments) come as maps; see Catalog.

Defined results: a null terminal or kind matches nothing; absent cases or genders (null or empty) are those of a token
that does not tell them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeloom.functions import features as X

# Fixed values of the data model: the terminal that each kind of token stands for, whatever its variants.
OF_KIND = {
    "ENTITY": "entity",
    "COMPANY": "fyrirtæki",
    "NUMWLETTER": "talameðbókstaf",
    "ORDINAL": "raðnr",
    "MEASUREMENT": "mælieining",
    "DATE": "dags",
    "DATEABS": "dagsföst",
    "DATEREL": "dagsafs",
    "TIME": "tími",
    "TIMESTAMP": "tímapunktur",
    "TIMESTAMPABS": "tímapunkturfast",
    "TIMESTAMPREL": "tímapunkturafs",
    "DOMAIN": "lén",
    "HASHTAG": "myllumerki",
    "SSN": "kennitala",
    "MOLECULE": "sameind",
    "USERNAME": "notandanafn",
    "URL": "vefslóð",
    "EMAIL": "tölvupóstfang",
    "SERIALNUMBER": "vörunúmer",
    "TELNO": "símanúmer",
}
# Classes of names, of streets and places, and the categories that stand for nouns.
NAME_CLASSES = ("nafn", "ætt")
PLACE_CLASSES = ("göt", "örn", "bær", "þor")
# Verb forms that a terminal must ask for to get them.
RESTRICTIVE = {"sagnb": "SAGNB", "lhþt": "LHÞT", "bh": "BH", "op": "OP", "sp": "SP", "expl": "það"}
# Variants that a verb's form must show if the terminal has them.
VERB_FORMS = {v: X.STRINGS[v] for v in ("p1", "p2", "p3", "gm", "mm", "nh", "fh", "bh", "vh", "nt", "sagnb", "lhþt", "op", "sp")} | {"lh": "LH"}


def _map(table: dict, kind: str) -> Column:
    """A dict of lists (or strings) as a map column; empty tables keep their type."""
    if not table:
        return F.create_map().cast(f"map<string,{kind}>")
    value = (lambda v: F.array(*map(F.lit, v))) if kind.startswith("array") else F.lit
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), value(v))])


class Tables:
    """Catalogue lookups of the predicate.

    prepositions: word -> cases (with nh for those before an infinitive); common: prepositions that need a reading as
    one; frames: verb -> argument cases joined by _ ("" for none, "_þf", "_þgf_þf"); subjects: verb -> its subjects'
    cases, lhþt, none; impersonal: verbs without a nominative subject; arguments: adjective -> cases; not_names: lower
    -case words that are no proper names; only_adverbs: adverbs that count as such whatever else they are.
    """

    def __init__(self, prepositions=None, common=(), frames=None, subjects=None, impersonal=(), arguments=None, not_names=(), only_adverbs=()):
        self.prepositions, self.frames = _map(prepositions or {}, "array<string>"), _map(frames or {}, "array<string>")
        self.subjects, self.arguments = _map(subjects or {}, "array<string>"), _map(arguments or {}, "array<string>")
        some = lambda words: F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
        self.common, self.impersonal, self.not_names, self.only_adverbs = map(some, (common, impersonal, not_names, only_adverbs))

    @classmethod
    def of(cls, rows: dict[str, list[tuple]]) -> Tables:
        """From the rows of a catalogue."""
        gather = lambda pairs: {k: sorted({v for w, v in pairs if w == k}) for k in dict.fromkeys(w for w, _ in pairs)}
        prepositions = gather([(w, x) for w, case, nh, _ in rows["prepositions"] for x in ([case, "nh"] if nh else [case])])
        frames = gather([(v, "".join(f"_{c}" for c in (a, b) if c)) for v, _, a, b, _, _ in rows["verb_objects"]])
        arguments = gather([(a, c) for a, cases, _, _ in rows["adjective_predicates"] if cases for c in cases.split()])
        return cls(prepositions, [w for w, _, _, common in rows["prepositions"] if common], frames, gather(rows["verb_subjects"]), (), arguments)


def last_part(lemma: Column) -> Column:
    return F.element_at(F.split(lemma, "-"), -1)


def _has(variants: Column, *names: str) -> Column:
    return F.exists(variants, lambda v: v.isin(*names))


def _endings(variants: Column, lemma: Column, form: Column) -> Column:
    """Variants x... and z... : the lemma's and the form's ending."""
    return F.forall(variants, lambda v: F.when(v.startswith("x"), lemma.endswith(F.substring(v, F.lit(2), F.length(v)))).when(v.startswith("z"), form.endswith(F.substring(v, F.lit(2), F.length(v)))).otherwise(True))


def _shown(variants: Column, infl: Column, among: tuple[str, ...] | None = None) -> Column:
    """Whether the inflection string shows each variant that it can show (of those in `among`)."""
    table = F.create_map(*[F.lit(x) for k, v in X.STRINGS.items() if among is None or k in among for x in (k, v)])
    return F.forall(variants, lambda v: F.coalesce(infl.contains(table[v]), F.lit(True)))


def _told(variants: Column, told: Column, among: tuple[str, ...]) -> Column:
    """Whether the variants of `among` are all told by an array; one that tells nothing fits."""
    return F.coalesce(F.size(told) <= 0, F.lit(True)) | F.forall(variants, lambda v: ~v.isin(*among) | F.array_contains(told, v))


def verb(reading: Column, variants: Column, tables: Tables) -> Column:
    """A verb's reading by form, person, voice and mood, by its subject, and by the cases of its arguments."""
    infl, lemma = reading["infl"], last_part(reading["lemma"])
    has = lambda *names: _has(variants, *names)
    first, last = F.coalesce(F.get(variants, F.lit(0)), F.lit("")), F.element_at(variants, -1)
    subjects = F.coalesce(tables.subjects[lemma], F.array().cast("array<string>"))
    lh, sagnb = infl.contains("LHÞT"), infl.contains("SAGNB")
    frames = lambda of: F.coalesce(tables.frames[of], F.array().cast("array<string>"))
    numbers = lambda sg, pl: F.when(has("et"), sg).otherwise(True) & F.when(has("ft"), pl).otherwise(True)
    # with a subject in another case than the nominative
    plain = ~sagnb | has("sagnb")
    one = F.when(first.isin("0", "1", "2"), (first == "1") & F.array_contains(frames(lemma), F.concat(F.lit("_"), F.get(variants, F.lit(1))))).otherwise(True)
    rest = F.when(has("none"), (has("sagnb") == sagnb) & F.array_contains(subjects, "none")).otherwise(plain & (~has("op") | infl.contains("OP")) & one & F.array_contains(subjects, last))
    own_subject = F.when(has("nh") & ~infl.contains("NH"), False).when(has("mm"), infl.contains("MM")).when(
        (has("gm") & ~infl.contains("GM")) | ~numbers(infl.contains("ET"), infl.contains("FT")) | infl.contains("það"), False
    ).when(has("lhþt"), lh & F.array_contains(subjects, "lhþt")).otherwise(~lh & rest)
    # with a nominative subject
    asked = F.forall(variants, lambda v: F.coalesce(infl.contains(F.create_map(*[F.lit(x) for kv in VERB_FORMS.items() for x in kv])[v]), F.lit(True)))
    unasked = F.lit(False)
    for v, s in RESTRICTIVE.items():
        unasked = unasked | (infl.contains(s) & ~has(v))
    weak = has("lhþt") & infl.contains("VB") & ~has("vb")
    clipped = has("bh") & infl.contains("ST")
    fits = numbers(~infl.contains("FT"), ~infl.contains("ET")) & asked & ~unasked & ~weak & ~clipped & F.when(has("expl"), infl.contains("það")).otherwise(True)
    counted = first.isin("0", "1", "2")
    cased = ~has("lhþt") | _shown(variants, infl, X.CASES)
    cases = F.concat(F.lit(""), F.array_join(F.transform(F.slice(variants, F.lit(2), F.greatest(F.coalesce(first.try_cast("int"), F.lit(0)), F.lit(0))), lambda c: F.concat(F.lit("_"), c)), ""))
    of = F.when(infl.contains("MM"), X.middle_stem(lemma)).otherwise(lemma)
    known = F.size(frames(of)) > 0
    framed = F.array_contains(frames(of), cases) | ((cases == "") & ~known)
    nominative = ~F.array_contains(tables.impersonal, lemma) & fits & F.when(counted, framed).otherwise(cased)
    return (reading["cat"] == "so") & F.when(infl == "-", ~(has("lh") & has("nt"))).when(has("subj"), own_subject).otherwise(nominative)


def _noun(token: Column, r: Column, variants: Column) -> Column:
    unknown = r["infl"] == "-"
    gender = F.forall(variants, lambda v: ~v.isin(*X.GENDERS) | (v == r["cat"]))
    forms = F.when(unknown, ~_has(variants, "gr")).otherwise(_shown(F.filter(variants, lambda v: ~v.isin(*X.GENDERS)), r["infl"]))
    usual = ~F.coalesce(r["cls"].isin(*NAME_CLASSES), F.lit(False)) & gender & forms & _endings(variants, r["lemma"], F.lower(token["txt"]))
    return r["cat"].isin(*X.GENDERS) & F.when(_has(variants, "abbrev"), unknown).otherwise(usual)


def _word(token: Column, r: Column, first: Column, variants: Column, t: Tables) -> Column:
    """A reading of a word, by the terminal's category."""
    low, infl, cat = F.lower(token["txt"]), r["infl"], r["cat"]
    plain = F.filter(variants, lambda v: ~v.startswith("x") & ~v.startswith("z"))
    full = F.concat(infl, F.when(cat.isin(*X.GENDERS), F.upper(cat)).otherwise(""))
    shown = _shown(plain, full)
    upper = token["txt"].rlike(r"^\p{Lu}")
    subject = F.filter(variants, lambda v: v.isin("sþf", "sþgf", "sef"))
    taken = F.coalesce(t.arguments[last_part(r["lemma"])], F.array().cast("array<string>"))
    adjective = (cat == "lo") & F.forall(subject, lambda v: F.array_contains(taken, F.substring(v, F.lit(2), F.length(v)))) & _endings(variants, r["lemma"], r["form"])
    own = F.when(low.contains("."), r["lemma"]).otherwise(low)
    governed = F.coalesce(t.prepositions[own], F.array().cast("array<string>"))
    preposition = F.array_contains(governed, F.coalesce(F.get(variants, F.lit(0)), F.lit(""))) & (_has(variants, "nh") | ~F.array_contains(t.common, own) | (cat == "fs"))
    adverb = F.array_contains(t.only_adverbs, low) | ~(F.size(F.coalesce(t.prepositions[low], F.array().cast("array<string>"))) > 0)
    name_case = F.lit(True)
    for c in X.CASES:  # a name's case must be asked for
        name_case = name_case & (~infl.contains(X.STRINGS[c]) | _has(variants, c))
    person = (r["cls"] == "ætt") | ((r["cls"] == "nafn") & ~_has(variants, "hk") & ((infl == "-") | name_case) & (~_has(variants, "kk") | (cat == "kk")) & (~_has(variants, "kvk") | (cat == "kvk")))
    place = r["cls"].isin(*PLACE_CLASSES) & cat.isin(*X.GENDERS) & F.forall(variants, lambda v: ~v.isin(*X.GENDERS) | (v == cat)) & _shown(F.filter(variants, lambda v: ~v.isin(*X.GENDERS)), infl)
    proper = upper & ~F.array_contains(t.not_names, low) & ~low.contains(" ") & F.when(F.size(variants) == 0, r["lemma"].contains("-")).otherwise(cat.isin(*X.GENDERS, "lo") & _shown(plain, infl, X.CASES))
    bare = F.when(cat.isin("lo", "so"), True).when(cat.isin(*X.GENDERS), F.forall(variants, lambda v: ~v.isin(*X.GENDERS, *X.NUMBERS) | v.isin("et") | (v == cat))).otherwise(F.size(F.filter(plain, lambda v: v.isin(*X.STRINGS))) == 0)
    default = (cat == first) & F.when(infl == "-", bare).otherwise(shown)
    return (
        F.when(first == "so", verb(r, variants, t))
        .when(first == "no", _noun(token, r, variants))
        .when(first == "lo", adjective & ((infl == "-") | shown))
        .when(first == "abfn", (cat == "abfn") & _shown(variants, infl, X.CASES))
        .when(first == "pfn", (cat == "pfn") & _shown(variants, infl, (*X.CASES, *X.NUMBERS)))
        .when(first == "stt", (cat == "st") & r["lemma"].isin("sem", "er"))
        .when(first == "eo", cat.endswith("ao") & adverb)
        .when(first == "ao", (cat == "ao") & _endings(variants, r["lemma"], r["form"]) & shown)
        .when(first == "fs", preposition)
        .when(first == "töl", cat == "töl")
        .when(first == "person", person)
        .when(first == "gata", place)
        .when(first == "sérnafn", proper)
        .otherwise(default)
    )


def _unknown(token: Column, first: Column, variants: Column) -> Column:
    """A word without readings: with a capital a bare proper name, and a neuter noun in the singular without article."""
    upper = token["txt"].rlike(r"^\p{Lu}")
    return ((first == "sérnafn") & upper & (F.size(variants) == 0) & ~token["txt"].contains(" ")) | ((first == "no") & _has(variants, "et") & _has(variants, "hk") & ~_has(variants, "gr"))


def _literal(token: Column, r: Column, terminal: Column) -> Column:
    """"form" by the text, 'lemma' by the reading's lemma, each perhaps with :category and variants."""
    body = F.regexp_extract(terminal, r"^['\"](.*)['\"]", 1)
    word, cat = F.split(body, ":")[0], F.get(F.split(body, ":"), F.lit(1))
    variants = F.filter(F.split(F.regexp_replace(terminal, r"^['\"].*['\"]", ""), "_"), lambda v: v != "")
    of_cat = cat.isNull() | (cat == r["cat"]) | ((cat == "no") & r["cat"].isin(*X.GENDERS))
    full = F.concat(r["infl"], F.when(r["cat"].isin(*X.GENDERS), F.upper(r["cat"])).otherwise(""))
    active = F.coalesce(cat != "so", F.lit(True)) | _has(variants, "mm") | ~r["infl"].contains("MM")
    return F.when(terminal.startswith('"'), (F.lower(token["txt"]) == F.lower(word)) & of_cat).otherwise((r["lemma"] == word) & of_cat & active) & ((r["infl"] == "-") | _shown(variants, full))


def _number(token: Column, first: Column, variants: Column) -> Column:
    singular = X.is_singular(token["value"])
    agrees = (~_has(variants, "et") | singular) & (~_has(variants, "ft") | ~singular)
    by_case, by_gender = _told(variants, token["cases"], X.CASES), _told(variants, token["genders"], X.GENDERS)
    some = lambda c: F.coalesce(F.size(token[c]) > 0, F.lit(False))
    return (
        F.when(first == "tala", agrees)
        .when(first == "ártal", token["txt"].rlike("^[0-9]{3,4}$") & token["value"].between(874, 2199))
        .when(first == "to", some("cases") & some("genders") & agrees & by_gender & by_case)
        .when(first == "töl", (some("cases") | some("genders")) & agrees & by_case)
        .otherwise(False)
    )


def _money(token: Column, first: Column, variants: Column, name: str) -> Column:
    """A currency or an amount: by ISO code and case, or as a noun."""
    code, case = F.get(variants, F.lit(0)), F.get(variants, F.lit(1))
    coded = (F.upper(code) == token["iso"]) & F.when(case.isNotNull(), F.coalesce(F.array_contains(token["cases"], case), F.lit(False))).otherwise(True)
    neuter = F.when(F.coalesce(F.size(token["genders"]) > 0, F.lit(False)), _told(variants, token["genders"], X.GENDERS)).otherwise(~_has(variants, "kk", "kvk"))
    noun = ~_has(variants, "abbrev") & _told(variants, token["cases"], X.CASES) & neuter
    if name == "amount":
        singular = X.is_singular(token["value"])
        noun = noun & ~_has(variants, "gr") & (~_has(variants, "et") | singular) & (~_has(variants, "ft") | ~singular)
        coded = F.when(code.isNull(), True).otherwise(coded)
    return F.when(first == name, F.coalesce(coded, F.lit(False))).otherwise((first == "no") & noun)


def _person(token: Column, first: Column, variants: Column) -> Column:
    case, gender = F.get(variants, F.lit(0)), F.get(variants, F.lit(1))
    fits = F.exists(token["names"], lambda n: (n["case"] == case) & (gender.isNull() | (n["gender"] == gender)))
    single = token["txt"].rlike(r"^\p{Lu}") & ~token["txt"].contains(" ") & case.isNotNull() & F.exists(token["names"], lambda n: n["case"] == case)
    return F.when(first == "sérnafn", single).otherwise((first == "person") & (case.isNull() | fits))


def sequence(txt: Column, variant: Column) -> Column:
    """Marks of lists: digits, one or two letters, roman numerals."""
    return F.when(variant == "digits", txt.rlike("^[0-9]+$")).when(variant == "letters", txt.rlike("^[a-z]{1,2}$")).when(variant == "roman", txt.rlike("^(?=[ivxlcdm])m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")).otherwise(False)


def matches(token: Column, reading: Column, terminal: Column, tables: Tables | None = None) -> Column:
    """Whether a token, by one of its readings, can stand for the terminal."""
    t = tables or Tables()
    kind, first, variants = token["kind"], X.category_of(terminal), X.variant_list(terminal)
    of_kind = F.create_map(*[F.lit(x) for kv in OF_KIND.items() for x in kv])
    percent = first.isin("töl", "prósenta") | ((first == "no") & ~_has(variants, "abbrev", "gr") & _has(variants, "hk") & _told(variants, token["cases"], X.CASES))
    word = F.when(terminal.rlike("^['\"]"), F.when(reading.isNull(), terminal.startswith('"') & (F.lower(token["txt"]) == F.lower(F.regexp_extract(terminal, '^"([^":]*)"$', 1)))).otherwise(_literal(token, reading, terminal)))
    word = word.when(first == "sequence", sequence(token["txt"], F.get(variants, F.lit(0)))).when(reading.isNull(), _unknown(token, first, variants)).otherwise(_word(token, reading, first, variants, t))
    out = (
        F.when(kind == "WORD", word)
        .when(kind == "PERSON", _person(token, first, variants))
        .when(kind == "PUNCTUATION", F.regexp_extract(terminal, r"^['\"](.*)['\"]$", 1) == token["txt"])
        .when(kind == "CURRENCY", _money(token, first, variants, "currency"))
        .when(kind == "AMOUNT", _money(token, first, variants, "amount"))
        .when(kind == "NUMBER", F.when(first == "sequence", sequence(token["txt"], F.get(variants, F.lit(0)))).otherwise(_number(token, first, variants)))
        .when(kind == "PERCENT", percent)
        .when(kind == "YEAR", first.isin("töl", "ártal", "tala") & ~_has(variants, "ft", "kk", "kvk"))
        .otherwise(first == of_kind[kind])
    )
    return F.coalesce(out, F.lit(False))


TOKEN = "struct<kind: string, txt: string, value: double, iso: string, cases: array<string>, genders: array<string>, names: array<struct<name: string, gender: string, case: string>>>"
READING = "struct<cat: string, cls: string, lemma: string, form: string, infl: string>"


def match_join(tokens, terminals, tables: Tables | None = None):
    """Pairs of a token (id, token, readings) and a terminal (terminal) that it matches, with its first reading that does.

    A grammar's terminals are few and go out to every task; each token tests them in place, so nothing is shuffled.
    """
    names = F.broadcast(terminals.agg(F.collect_set("terminal").alias("_all")))  # one row
    rows = tokens.join(names).select("id", "token", "readings", F.explode("_all").alias("terminal"))
    none = F.lit(None).cast(READING)
    some = F.when(F.coalesce(F.size("readings"), F.lit(0)) > 0, F.col("readings")).otherwise(F.array(none))
    hits = F.filter(F.transform(some, lambda r: F.struct(r.alias("reading"), matches(F.col("token"), r, F.col("terminal"), tables).alias("ok"))), lambda x: x["ok"])
    return rows.withColumn("_hits", hits).where(F.size("_hits") > 0).select("id", "terminal", F.get("_hits", F.lit(0))["reading"].alias("reading"))
