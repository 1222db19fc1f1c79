"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Values are found by pattern and validated: payment cards by their Luhn digit, addresses by their octets, dates by the
calendar, telephone numbers by their digits. A valid value is permuted within its format by a keyed Feistel network
over Z_a x Z_b (alternating halves, each round adds a keyed digest of the other half), so equal values get equal
pseudonyms in every document and different ones stay different. Cards get a new Luhn digit, dates move within
1900-01-01 to 2099-11-12 (73,000 days, 250 x 292), octets within 0 to 255, digits of telephone and identity numbers
within the digits there, the letters and digits of an e-mail's local part among letters and digits, capitals where
they were. Mail domains, country codes and punctuation stay. A date is permuted as a day: two ways to write one day
(with or without leading zeros) get one day, each in its own way. With slashes the day comes first, unless only the
other order is a date; such a date becomes one that again reads in that order alone.

The patterns are linear in the text: runs that could begin an address are entered at their start only and never
given back, and all other repeats are bounded.

Defined results: null stays null and empty stays empty, texts without such data are returned as they are, values that
fail their validation are left alone, an empty table gives an empty result, and other columns are carried along, but
one named _found is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import free, read

KEY = "pseudonym-key-1"
ROUNDS = 8
#: Steps after which a walk to a date of the wanted order ends; three in five dates are of that order.
WALK = 64
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}(?:[A-Za-z]{2,63}|xn--[A-Za-z0-9-]{1,59})"
ADDRESS = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4}"
IDENTITY = r"\d{3}-\d{2}-\d{4}"
CARD = r"\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5}"
PHONE = r"\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}[ .-]?\d{2,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
#: One pass finds all kinds; none may touch a letter or digit outside.
FOUND = rf"(?:{MAIL}|(?<![A-Za-z0-9@])(?:(?<![\d.]){ADDRESS}(?![.]?\d)|{DATE}|{IDENTITY}|{PHONE}|{CARD}))(?![A-Za-z0-9])"
EPOCH, DAYS_A, DAYS_B = "1900-01-01", 250, 292
KINDS = ("mail", "address", "date", "identity", "card", "phone")


def _digest(key: str, kind: str | Column, round_: Column, other: Column, size: Column) -> Column:
    """A keyed number below 2^60 for one round."""
    line = F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), size.cast("string"), other.cast("string"))
    return F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str | Column, size: Column) -> Column:
    """The struct (l, r) that the pair (left, right) of Z_a x Z_b is mapped to, one to one."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    even = lambda s, i: F.struct(F.pmod(s["l"] + F.pmod(_digest(key, kind, i, s["r"], size), a), a).alias("l"), s["r"].alias("r"))
    odd = lambda s, i: F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(_digest(key, kind, i, s["l"], size), b), b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, lambda s, i: F.when(i % 2 == 0, even(s, i)).otherwise(odd(s, i)))


def _power(base: int, n: Column) -> Column:
    return F.pow(F.lit(float(base)), n).cast("long")


def _in_blocks(value: Column, size: int, kind: str, one) -> Column:
    """value with its blocks of at most `size` characters permuted by one(block, kind), one after the other.

    The kind of a block among several holds its place and all other blocks as they are then, so each character of the
    result depends on the whole value; from the last block back, every step can be undone.
    """

    def step(s: Column, i: Column) -> Column:
        head, block, tail = F.substring(s, F.lit(1), i * size), F.substring(s, i * size + 1, F.lit(size)), F.substring(s, (i + 1) * size + 1, F.length(s))
        own = F.when(F.length(s) > size, F.concat_ws("|", F.lit(kind), i.cast("string"), head, tail)).otherwise(F.lit(kind))
        return F.concat(head, one(block, own), tail)

    last = F.greatest(F.floor((F.length(value) - 1) / F.lit(size)).cast("int"), F.lit(0))
    return F.aggregate(F.sequence(F.lit(0), last), value, step)


def digits(value: Column, key: str, kind: str) -> Column:
    """A string of digits permuted among the strings of its length, in blocks of 34."""
    return _in_blocks(value, 34, kind, lambda block, own: _digits(block, key, own))


def _digits(value: Column, key: str, kind: Column) -> Column:
    n = F.length(value)
    half = F.floor((n + F.lit(1)) / F.lit(2)).cast("int")
    left, right = F.substring(value, F.lit(1), half), F.substring(value, half + 1, n - half)
    single = feistel(F.floor(value.cast("long") / 5), value.cast("long") % 5, F.lit(2), F.lit(5), key, kind, n)
    got = feistel(left.cast("long"), F.coalesce(F.nullif(right, F.lit("")).cast("long"), F.lit(0)), _power(10, half), F.greatest(_power(10, n - half), F.lit(1)), key, kind, n)
    pair = F.concat(F.lpad(got["l"].cast("string"), half, F.lit("0")), F.when(n > half, F.lpad(got["r"].cast("string"), n - half, F.lit("0"))).otherwise(F.lit("")))
    return F.when(n == 1, (single["l"] * 5 + single["r"]).cast("string")).otherwise(pair)


def letters(value: Column, key: str) -> Column:
    """A string of letters a-z permuted among the strings of its length, in blocks of 24."""
    return _in_blocks(value, 24, "letters", lambda block, own: _letters(block, key, own))


def _letters(value: Column, key: str, kind: Column) -> Column:
    n = F.length(value)
    half = F.floor((n + F.lit(1)) / F.lit(2)).cast("int")
    # a -> 0 ... z -> p in base 26, as conv() writes it
    plain, coded = "abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOP"
    number = lambda text: F.coalesce(F.conv(F.nullif(F.translate(text, plain, coded), F.lit("")), 26, 10).cast("long"), F.lit(0))
    text = lambda x, k: F.translate(F.lpad(F.conv(x.cast("string"), 10, 26), k, F.lit("0")), coded, plain)
    left, right = F.substring(value, F.lit(1), half), F.substring(value, half + 1, n - half)
    single = feistel(F.floor(number(value) / 13), number(value) % 13, F.lit(2), F.lit(13), key, kind, n)
    got = feistel(number(left), number(right), _power(26, half), F.greatest(_power(26, n - half), F.lit(1)), key, kind, n)
    pair = F.concat(text(got["l"], half), F.when(n > half, text(got["r"], n - half)).otherwise(F.lit("")))
    return F.when(n == 1, text(single["l"] * 13 + single["r"], n)).otherwise(pair)


def fill(mask: Column, own: Column, pattern: str) -> Column:
    """mask with its characters that match the pattern replaced, one by one, by those of own."""
    chars = F.split(mask, "")
    seen = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike(pattern), F.struct(F.concat(s["out"], F.substring(own, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return seen["out"]


def only(value: Column, pattern: str) -> Column:
    return F.regexp_replace(value, pattern, "")


def luhn_digit(body: Column) -> Column:
    """The digit that makes body plus it pass the Luhn test."""
    chars = F.reverse(F.split(body, ""))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10).otherwise(c.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def is_card(value: Column) -> Column:
    own = only(value, r"\D")
    n = F.length(own)
    return value.rlike(f"^(?:{CARD})$") & n.between(13, 19) & (luhn_digit(F.substring(own, F.lit(1), n - 1)) == F.substring(own, n, F.lit(1)))


def is_address(value: Column) -> Column:
    return value.rlike(f"^{ADDRESS}$") & F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)


_SLASH = r"^\d{1,2}/\d{1,2}/\d{4}$"


def month_first(value: Column) -> Column:
    """Whether a value with slashes is a date in that order alone."""
    return value.rlike(_SLASH) & F.try_to_timestamp(value, F.lit("d/M/yyyy")).isNull() & F.try_to_timestamp(value, F.lit("M/d/yyyy")).isNotNull()


def as_date(value: Column) -> Column:
    """The date of a value in one of the three forms, null if there is no such day."""
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))
    dot = F.when(value.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_timestamp(value, F.lit("d.M.yyyy")))
    slash = F.when(value.rlike(_SLASH), F.coalesce(F.try_to_timestamp(value, F.lit("d/M/yyyy")), F.try_to_timestamp(value, F.lit("M/d/yyyy"))))
    return F.coalesce(iso, dot, slash).cast("date")


def is_date(value: Column) -> Column:
    day = F.datediff(as_date(value), F.lit(EPOCH).cast("date"))
    return F.coalesce(day.between(0, DAYS_A * DAYS_B - 1), F.lit(False))


def is_phone(value: Column) -> Column:
    return value.rlike(f"^(?:{PHONE})$") & F.length(only(value, r"\D")).between(8, 15)


def mail(value: Column, key: str) -> Column:
    """Letters and digits of the local part permuted, each among their kind; capitals stay where they are."""
    given = F.substring_index(value, "@", 1)
    local = F.lower(given)
    named = fill(local, letters(only(local, "[^a-z]"), key), "^[a-z]$")
    named = fill(named, digits(only(local, "[^0-9]"), key, "mail"), "^[0-9]$")
    cased = F.array_join(F.zip_with(F.split(given, ""), F.split(named, ""), lambda a, b: F.when(a.rlike("^[A-Z]$"), F.upper(b)).otherwise(b)), "")
    return F.concat(F.when(given.rlike("[A-Z]"), cased).otherwise(named), F.lit("@"), F.substring_index(value, "@", -1))


def card(value: Column, key: str) -> Column:
    own = only(value, r"\D")
    body = digits(F.substring(own, F.lit(1), F.length(own) - 1), key, "card")
    return fill(value, F.concat(body, luhn_digit(body)), r"^\d$")


def address(value: Column, key: str) -> Column:
    o = F.split(value, r"\.")
    n = lambda i: F.element_at(o, i).cast("long")
    got = feistel(n(1) * 256 + n(2), n(3) * 256 + n(4), F.lit(65536), F.lit(65536), key, "address", F.lit(4))
    return F.concat_ws(".", *[x.cast("string") for x in (F.floor(got["l"] / 256), got["l"] % 256, F.floor(got["r"] / 256), got["r"] % 256)])


def _day_after(day: Column, key: str) -> Column:
    """The day, counted from EPOCH, that a day is mapped to."""
    got = feistel(F.floor(day / DAYS_B), F.pmod(day, F.lit(DAYS_B)), F.lit(DAYS_A), F.lit(DAYS_B), key, "date", F.lit(1))
    return (got["l"] * DAYS_B + got["r"]).cast("int")


def date(value: Column, key: str) -> Column:
    """The permuted day, written as the value is: the order, the marks, and days and months below ten with or without a zero.

    A date that reads with the month first alone is permuted until it is of that order again, which maps those dates
    one to one among themselves.
    """
    start = F.lit(EPOCH).cast("date")
    day = F.datediff(as_date(value), start)
    fits = lambda x: F.dayofmonth(F.date_add(start, x)) > 12
    walk = lambda s, _: F.when((s["n"] > 0) & fits(s["x"]), s).otherwise(F.struct(_day_after(s["x"], key).alias("x"), (s["n"] + 1).alias("n")))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(day.alias("x"), F.lit(0).alias("n")), walk)["x"]
    swapped = month_first(value)
    new = F.date_add(start, F.when(swapped, walked).otherwise(_day_after(day, key)))
    bare = value.rlike(r"^(?:\d[./]|\d\d?[./]\d[./])")
    shown = lambda padded, plain: F.when(bare, F.date_format(new, plain)).otherwise(F.date_format(new, padded))
    return (
        F.when(value.contains("-"), F.date_format(new, "yyyy-MM-dd"))
        .when(value.contains("."), shown("dd.MM.yyyy", "d.M.yyyy"))
        .when(swapped, shown("MM/dd/yyyy", "M/d/yyyy"))
        .otherwise(shown("dd/MM/yyyy", "d/M/yyyy"))
    )


def phone(value: Column, key: str) -> Column:
    """All digits but those of a country code."""
    code = F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .(-])|\+\d)", 1)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return F.concat(code, fill(rest, digits(only(rest, r"\D"), key, "phone"), r"^\d$"))


def kind(value: Column) -> Column:
    """The kind of a value found, null if it fails its validation."""
    return (
        F.when(value.contains("@"), "mail")
        .when(is_address(value), "address")
        .when(is_date(value), "date")
        .when(value.rlike(f"^{IDENTITY}$"), "identity")
        .when(is_card(value), "card")
        .when(is_phone(value), "phone")
    )


def pseudonym(value: Column, of: Column, key: str) -> Column:
    return (
        F.when(of == "mail", mail(value, key))
        .when(of == "address", address(value, key))
        .when(of == "date", date(value, key))
        .when(of == "identity", fill(value, digits(only(value, r"\D"), key, "identity"), r"^\d$"))
        .when(of == "card", card(value, key))
        .when(of == "phone", phone(value, key))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str = KEY, column: str = "text") -> DataFrame:
    """docs with the column rewritten and _found, an array of (kind, value, pseudonym); values left alone are not in it."""
    docs = docs.drop("_found")
    text, one, two = F.col(column), free(docs, "_values"), free(docs, "_kinds")
    has = text.rlike("[0-9@]")
    values = F.when(has, F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))).otherwise(F.array().cast("array<string>"))
    staged = docs.withColumn(one, F.coalesce(values, F.array().cast("array<string>")))
    kinds = F.transform(one, lambda v: F.struct(v.alias("value"), kind(v).alias("kind")))
    staged = staged.withColumn(two, F.when(F.size(one) > 0, kinds).otherwise(F.array().cast("array<struct<value: string, kind: string>>")))
    named = F.transform(two, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), pseudonym(x["value"], x["kind"], key).alias("pseudonym")))
    staged = staged.withColumn("_found", F.when(F.size(two) > 0, named).otherwise(F.array().cast("array<struct<kind: string, value: string, pseudonym: string>>")))
    between = F.split(text, FOUND, -1)
    joined = F.concat_ws("", F.transform(between, lambda piece, i: F.concat(piece, F.coalesce(F.get("_found", i)["pseudonym"], F.lit("")))))
    staged = staged.withColumn(column, F.when(F.size("_found") > 0, joined).otherwise(text))
    return staged.withColumn("_found", F.filter("_found", lambda x: x["kind"].isNotNull())).drop(one, two)


def _count_of(name: str) -> Column:
    return F.size(F.filter("_found", lambda x: x["kind"] == name))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Each document's text with pseudonyms, and how many values of each kind it had."""
    got = pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "text", *(_count_of(k).cast("long").alias(f"n_{k}") for k in KINDS))


QUERIES = {"op3_pii": op3_pii}
ORACLE: dict[str, str] = {}
