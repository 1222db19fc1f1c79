"""The token pipeline on sentences written for it."""

import pytest
from pyspark.sql import functions as F

from treeloom.functions import features as X
from treeloom.functions import kinds as N
from treeloom.functions import text as T
from treeloom.operators import tokens as K
from treeloom.sources import toy


def table(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def texts(df, *more):
    return [(r.txt, *(r[m] for m in more)) for r in df.orderBy("doc_id", "tok_ix").collect()]


def test_tokens_and_kinds(spark):
    rows = T.tokens(table(spark, "Year 1999: 3,5 (é)!\nb"))
    assert texts(rows, "kind", "sent_ix") == [("Year", "WORD", 0), ("1999", "YEAR", 0), (":", "PUNCTUATION", 0), ("3,5", "NUMBER", 0), ("(", "PUNCTUATION", 0), ("é", "WORD", 0), (")", "PUNCTUATION", 0), ("!", "PUNCTUATION", 0), ("\n", "P", 1), ("b", "WORD", 2)]


def test_no_character_is_lost(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert K.lost_characters(docs, T.tokens(docs)).count() == 0


def test_abbreviations_do_not_end_sentences(spark):
    rows = K.resplit(T.tokens(table(spark, "By J. smith. Then B. Next")))
    assert [r.sent_ix for r in rows.orderBy("tok_ix").collect()] == [0, 0, 0, 0, 0, 1, 1, 1, 2]


def test_numbers_multiply(spark):
    rows = T.tokens(table(spark, "two hundred thousand ships and 3 million dollars , 5 swedish kronor , 7 percent"))
    got = texts(K.numbers(rows).where("value is not null"), "value")
    assert got == [("two hundred thousand", 200_000.0), ("3 million", 3e6), ("5", 5.0), ("7", 7.0)]
    assert K.numbers(rows, multiply=False).where("value is not null").count() == 7
    made = texts(K.amounts(K.numbers(rows)).where("kind in ('AMOUNT', 'PERCENT')"), "kind", "iso", "value")
    assert made == [("3 million dollars", "AMOUNT", "USD", 3e6), ("5 swedish kronor", "AMOUNT", "SEK", 5.0), ("7 percent", "PERCENT", None, 7.0)]


def test_composites(spark):
    assert texts(K.composites(T.tokens(table(spark, "a sea- and landmap here")))) == [("a",), ("sea- and landmap",), ("here",)]


def test_phrases_prefer_the_first_complete(spark):
    rows = T.tokens(table(spark, "out of the box of the day"))
    phrases = spark.createDataFrame([("out of", 1), ("out of the box", 2), ("of the", 3), ("the box", 4)], "words string, phrase_id long")
    chosen = K.greedy(K.phrase_hits(rows, phrases))
    assert sorted((r.tok_ix, r.n, r.phrase_id) for r in chosen.collect()) == [(0, 2, 1), (2, 2, 4), (4, 2, 3)]
    assert texts(K.merge_phrases(rows, chosen)) == [("out of",), ("the box",), ("of the",), ("day",)]


def test_parentheses_of_unknown_words_go(spark):
    rows = T.tokens(table(spark, "a ( x y ) b ( z )")).withColumn("cat", F.when(F.col("txt").isin("a", "b", "z"), "no"))
    assert [t for t, in texts(K.prune_parentheses(rows))] == ["a", "b", "(", "z", ")"]


def test_names(spark):
    rows = T.tokens(table(spark, "Today Anna Berg met Bo. Then Anna left. Here Zed sat.")).withColumn("cat", F.when(F.col("txt") == "Bo", "no")).withColumn("gender", F.lit("kvk"))
    runs = K.back_references(K.name_runs(rows)).orderBy("tok_ix").collect()
    assert [(r.name, r.weak, r.full_name) for r in runs] == [("Anna Berg", False, None), ("Bo", True, None), ("Anna", False, "Anna Berg"), ("Zed", False, None)]


def test_companies(spark):
    assert [r.name for r in K.companies(T.tokens(table(spark, "the Big Box Ltd and Small Inc but Other"))).orderBy("tok_ix").collect()] == ["Big Box Ltd", "Small Inc"]


def test_compatible_readings(spark):
    a = F.from_json(F.lit('[{"name":"A","gender":"kk","case":"nf"},{"name":"A","gender":"kvk","case":"nf"}]'), "array<struct<name:string,gender:string,case:string>>")
    b = F.from_json(F.lit('[{"name":"B","gender":"kk","case":null}]'), "array<struct<name:string,gender:string,case:string>>")
    got = spark.range(1).select(K.compatible(a, b).alias("x"), K.full_name(a, F.lit("nf"), F.lit("kvk")).alias("n")).first()
    assert [tuple(r) for r in got.x] == [("A B", "kk", "nf")] and got.n == "A"


def test_foreign(spark):
    rows = T.tokens(table(spark, "a b c d. e f.")).withColumn("cat", F.when(F.col("txt") == "a", "no"))
    assert {(r.sent_ix, r.is_foreign) for r in K.foreign(rows).collect()} == {(0, True), (1, False)}


def test_pipeline_phases_can_be_changed(spark):
    p = K.default_pipeline().without("amounts").replace("correct_tokens", lambda df: df.withColumn("txt", F.lower("txt"))).after("numbers", "mark", lambda df: df.withColumn("seen", F.lit(1)))
    got = p(T.tokens(table(spark, "TWO hundred dollars"))).orderBy("tok_ix").collect()
    assert [(r.txt, r.seen) for r in got] == [("two hundred", 1), ("dollars", 1)]


def test_annotation_keeps_every_reading(spark):
    rows = T.tokens(table(spark, "Bank x"))
    lexicon = spark.createDataFrame([("bank", "bank", "no"), ("bank", "banka", "so")], "form string, lemma string, cat string")
    got = {r.txt: r for r in K.lemmatise(K.annotate(rows, lexicon)).collect()}
    assert [tuple(x) for x in got["Bank"].lemmas] == [("bank", "no"), ("banka", "so")] and got["x"].lemmas == []


def test_job_statistics(spark):
    rows = spark.createDataFrame([(4, 16), (2, 1), (3, 0), (99, None)], "n_tokens long, combinations long")
    r = K.job_statistics(rows).first()
    assert (r.num_sentences, r.num_parsed, r.num_tokens, r.num_combinations) == (4, 2, 108, 17) and r.ambiguity == pytest.approx((2 * 4 + 1 * 2) / 6)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_features(spark):
    assert one(spark, X.case_of(F.lit("ÞGFFT"))) == "þgf" and one(spark, X.case_of(F.lit("-"), F.lit("nf"))) == "nf"
    assert set(one(spark, X.variants_of(F.lit("LHÞT-SB-KK")))) == {"lhþt", "sb", "kk"}
    assert one(spark, X.has_all(X.mask_of(F.lit("NFET")), F.lit(X.bit("nf") | X.bit("et"))))
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert one(spark, X.augment(F.lit("so"), arr("subj", "sagnb", "þf"), arr("gm", "sagnb"))) == "so_gm_sagnb_subj_þf"
    assert one(spark, X.augment(F.lit("so"), arr("1", "þf", "et"), arr("p3"))) == "so_1_þf_et_p3"
    assert one(spark, X.simplify_terminal(F.lit("'vera'_so_nh"), F.lit("so"))) == "so_nh"
    assert [one(spark, X.is_singular(F.lit(n))) for n in (1.0, 11.0, 21.0, 111.0, 2.0, 1.5)] == [True, False, True, False, False, False]
    assert one(spark, X.cut_leading(F.lit("sá hinn maður"), ("sá", "hinn"))) == "maður" and one(spark, X.cut_leading(F.lit("sá"), ("sá",))) == "sá"
    assert one(spark, X.replace_many(F.lit("abcab"), {"ab": "ba", "abc": "x", "b": "y"})) == "xba"
    assert one(spark, X.match_tag(F.lit("NP-OBJ-X"), "NP_OBJ")) and not one(spark, X.match_tag(F.lit("NPX"), "NP"))
    assert one(spark, T.tidy(F.lit("a , b ( c ) !"))) == "a, b (c)!"


def test_toy_lexicon_is_a_function_of_the_form(spark):
    rows = toy.annotated(table(spark, "The cat of THE day"))
    got = {r.lw: r.cat for r in rows.collect()}
    assert got["the"] == "gr" and got["of"] == "fs"


def test_typed_tokens(spark):
    found = texts(N.tokens(table(spark, "a.b@x.is http://x.is/a?b=1 www.x.is #tag @me 010203-4567 2024-01-31 31/1 555-1234 12:30 3,5% $10 5km 3rd 4b 12xy 1999 7. Já")), "kind")
    assert found == [("a.b@x.is", "EMAIL"), ("http://x.is/a?b=1", "URL"), ("www.x.is", "DOMAIN"), ("#tag", "HASHTAG"), ("@me", "USERNAME"), ("010203-4567", "SSN"), ("2024-01-31", "DATEABS"), ("31/1", "DATEREL"), ("555-1234", "TELNO"), ("12:30", "TIME"), ("3,5%", "PERCENT"), ("$10", "AMOUNT"), ("5km", "MEASUREMENT"), ("3rd", "ORDINAL"), ("4b", "NUMWLETTER"), ("12xy", "SERIALNUMBER"), ("1999", "YEAR"), ("7.", "NUMBER"), ("Já", "WORD")]


def test_ordinals_need_a_lower_case_word(spark):
    rows = K.ordinals(T.tokens(table(spark, "the 3. day 4. End 5.")))
    assert [t for t in texts(rows, "kind") if t[1] in ("ORDINAL", "NUMBER")] == [("3.", "ORDINAL"), ("4.", "NUMBER"), ("5.", "NUMBER")]


def test_abbreviated_amounts(spark):
    rows = K.abbreviated_amounts(K.numbers(T.tokens(table(spark, "5 m.kr. og 2 kr. 7 x", "3 kr"))))
    assert texts(rows.where("value IS NOT NULL"), "kind", "value", "iso") == [("5 m.kr.", "AMOUNT", 5e6, "ISK"), ("2 kr.", "AMOUNT", 2.0, "ISK"), ("7", "NUMBER", 7.0, None), ("3 kr", "AMOUNT", 3.0, "ISK")]


def test_first_sentences(spark):
    rows = K.first_sentences(T.tokens(table(spark, "\n\nA b. C", "", None)))
    assert texts(rows) == [("A",), ("b",), (".",)]


def test_lemma_value(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'Hesta', array(named_struct('lemma', 'Hestur', 'cat', 'kk'))), (2, 'Blue', NULL), (3, 'hesta', array(named_struct('lemma', 'hestur', 'cat', 'so'))) t(i, txt, meanings)")
    got = df.orderBy("i").select(K.lemma_value(F.col("meanings"), F.col("txt"), {"hestur": "horse", "blue": "colour"}, lambda m: m["cat"] == "kk").alias("v"))
    assert [r.v for r in got.collect()] == ["horse", "colour", None]


def test_order_of_a_locale(spark):
    rows = spark.createDataFrame([(w,) for w in ("þ", "z", "á", "b", "a", "ö", "æ")], "w string")
    assert [r.w for r in rows.orderBy(K.in_order_of(F.col("w"))).collect()] == ["a", "á", "b", "z", "þ", "æ", "ö"]
