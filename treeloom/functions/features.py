"""Scalar functions on inflection strings, variants, terminals and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: names of cases, genders, numbers, persons, degrees and verb features.
CASES = ("nf", "þf", "þgf", "ef")
GENDERS = ("kk", "kvk", "hk")
NUMBERS = ("et", "ft")
# What stands in an inflection string for each variant that it can show.
STRINGS = {
    "nf": "NF", "þf": "ÞF", "þgf": "ÞGF", "ef": "EF", "kk": "KK", "kvk": "KVK", "hk": "HK", "et": "ET", "ft": "FT",
    "mst": "MST", "est": "EST", "esb": "ESB", "evb": "EVB", "p1": "1P", "p2": "2P", "p3": "3P", "op": "OP", "sp": "SP",
    "gm": "GM", "mm": "MM", "sb": "SB", "vb": "VB", "nh": "NH", "fh": "FH", "bh": "BH", "lh": "LH", "vh": "VH",
    "nt": "NT", "sagnb": "SAGNB", "lhþt": "LHÞT", "gr": "gr", "expl": "það", "þt": "ÞT",
}
# Variants of terminals alone: argument counts, subjects, abbreviations.
VARIANTS = (*STRINGS, "0", "1", "2", "subj", "abbrev", "sþf", "sþgf", "sef")


def case_of(infl: Column, default: Column | None = None) -> Column:
    """The case named in an inflection string; nominative is looked for first, then the longer before the shorter."""
    return F.when(infl.contains("NF"), "nf").when(infl.contains("ÞF"), "þf").when(infl.contains("ÞGF"), "þgf").when(infl.contains("EF"), "ef").otherwise(default if default is not None else F.lit(None).cast("string"))


def bit(variant: str) -> int:
    return 1 << VARIANTS.index(variant)


def mask_of(infl: Column) -> Column:
    """A bit for each variant whose sign stands in the inflection string, so that LHÞT shows lh and þt, too."""
    out = F.lit(0).cast("long")
    for v, sign in STRINGS.items():
        out = out + F.when(infl.contains(sign), F.lit(bit(v))).otherwise(F.lit(0))
    return out


def variants_of(infl: Column) -> Column:
    """Names of the variants in an inflection string, in their fixed order.

    Of a past participle the past and the participle are not told besides, of a superlative not its declension, and
    an impersonal verb has no person; the first of these three that applies is the only one.
    """
    shown = F.array_compact(F.array(*[F.when(infl.contains(s), F.lit(v)) for v, s in STRINGS.items()]))
    told = lambda *names: F.array_except(shown, F.array(*map(F.lit, names)))
    return (
        F.when(infl.contains("LHÞT"), told("þt", "lh"))
        .when(infl.contains("ESB"), told("sb"))
        .when(infl.contains("EVB"), told("vb"))
        .when(infl.contains("OP"), told("p1", "p2", "p3"))
        .otherwise(shown)
    )


def has_all(have: Column, need: Column) -> Column:
    return have.bitwiseAND(need) == need


def has_any(have: Column, need: Column) -> Column:
    return have.bitwiseAND(need) != 0


def middle_stem(lemma: Column) -> Column:
    """The middle-voice lemma of a verb."""
    return F.when(lemma.endswith("st"), lemma).otherwise(F.concat(lemma, F.lit("st")))


def variant_list(terminal: Column) -> Column:
    """The parts of a terminal's name after its category."""
    parts = F.split(terminal, "_")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def category_of(terminal: Column) -> Column:
    return F.element_at(F.split(terminal, "_"), 1)


def simplify_terminal(terminal: Column, category: Column) -> Column:
    """A literal terminal ('form' or "form", perhaps with category and variants) as category and variants."""
    after = F.regexp_extract(terminal, r"^(?:'[^']*'|\"[^\"]*\")[:_]?(.*)$", 1)
    rest = F.regexp_replace(after, "^:", "")
    return F.when(~terminal.rlike("^['\"]"), terminal).when(rest == "", category).when(F.split(rest, "_")[0] == category, rest).otherwise(F.concat_ws("_", category, rest))


def augment(category: Column, given: Column, found: Column) -> Column:
    """A terminal with all variants: the argument count and its cases first, as given, then the others sorted."""
    counted = F.get(given, F.lit(0)).isin("0", "1", "2")
    n = F.when(counted, F.get(given, F.lit(0)).try_cast("int") + 1).otherwise(F.lit(0))
    head = F.slice(given, F.lit(1), n)
    rest = F.array_sort(F.array_distinct(F.concat(F.slice(given, n + 1, F.greatest(F.size(given) - n, F.lit(0))), found)))
    return F.array_join(F.concat(F.array(category), head, rest), "_")


def is_singular(n: Column) -> Column:
    """Whether a noun counted by n stands in the singular: n ends in 1 but not in 11."""
    whole = F.abs(n) == F.floor(F.abs(n))
    return whole & (F.abs(n) % 10 == 1) & (F.abs(n) % 100 != 11)


def match_tag(tag: Column, wanted: str) -> Column:
    """Whether a tag's parts begin with the wanted ones; _ and - are the same."""
    parts = wanted.replace("_", "-").split("-")
    return F.slice(F.split(tag, "-"), 1, len(parts)) == F.array(*map(F.lit, parts))


def all_but_last_word(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*\S+$", "")


def token_key(kind: Column, txt: Column, meanings: Column) -> Column:
    """Equal for tokens that match the same terminals."""
    return F.xxhash64(kind, txt, F.to_json(meanings))


def cut_leading(text: Column, words: tuple[str, ...]) -> Column:
    """text without its leading words of the list, unless nothing else would be left."""
    cut = F.regexp_replace(text, rf"^(?:(?:{'|'.join(words)})\s+)+(?=\S)", "")
    return F.when(cut.isin(*words), text).otherwise(cut)


def replace_many(text: Column, pairs: dict[str, str]) -> Column:
    """All strings of pairs replaced in one pass, the longest first at each place."""
    import re

    if not pairs:
        return text
    pattern = "|".join(re.escape(k) for k in sorted(pairs, key=lambda k: (-len(k), k)))
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    between = F.split(text, pattern, -1)
    return F.concat_ws("", F.transform(between, lambda piece, i: F.concat(piece, F.coalesce(table[F.get(found, i)], F.lit("")))))


# ---- part-of-speech tags

#: First letter of the tag by category; fixed values of the tag set.
POS = {"no": "n", "lo": "l", "so": "s", "ao": "a", "fs": "a", "st": "c", "gr": "g", "fn": "f", "to": "t", "nhm": "cn"}
_LETTER = {"kk": "k", "kvk": "v", "hk": "h", "et": "e", "ft": "f", "nf": "n", "þf": "o", "þgf": "þ", "ef": "e"}


def letter(value: Column) -> Column:
    out = F.lit("")
    for name, one in _LETTER.items():
        out = F.when(value == name, F.lit(one)).otherwise(out)
    return out


def pos_tag(kind: Column, cat: Column, gender: Column, number: Column, case: Column) -> Column:
    """The tag of a token: nouns and adjectives with gender, number and case, prepositions with the case they take."""
    full = F.concat(letter(gender), letter(number), letter(case))
    return (
        F.when(kind.isin("NUMBER", "YEAR"), "ta")
        .when(kind == "PUNCTUATION", "p")
        .when(kind == "P", "")
        .when(cat.isin("no", "lo", "gr", "fn"), F.concat(F.create_map(*[F.lit(x) for kv in POS.items() for x in kv])[cat], full))
        .when(cat == "so", F.concat(F.lit("sf"), F.when(number == "ft", "3f").otherwise("3e")))
        .when(cat == "fs", F.concat(F.lit("a"), letter(case)))
        .when(cat == "ao", "aa")
        .when(cat == "st", "c")
        .otherwise("e")
    )
