"""Queries over token tables, each with the same result as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeloom.functions import features as X
from treeloom.functions import kinds as N
from treeloom.functions import text as T
from treeloom.operators import tokens as K
from treeloom.plans.portable import duck_tokens
from treeloom.session import table
from treeloom.sources import toy

WITH = "WITH " + duck_tokens().strip()
#: Generated phrases with numbers, from the orders: `n word [word] [nation] currency .`
PHRASES = """SELECT o_orderkey AS doc_id, CAST(o_orderkey % 90 + 1 AS VARCHAR(9)) || ' ' ||
 CASE o_orderkey % 5 WHEN 0 THEN 'thousand ' WHEN 1 THEN 'hundred thousand ' WHEN 2 THEN '' WHEN 3 THEN 'million ' ELSE 'two hundred ' END ||
 CASE o_orderkey % 7 WHEN 0 THEN 'dollars' WHEN 1 THEN 'danish krona' WHEN 2 THEN 'percent' WHEN 3 THEN 'euros' WHEN 4 THEN 'swedish kronor' ELSE 'ships' END || ' and one more .' AS text FROM orders"""
_P = "WITH phr AS (" + PHRASES + "), " + duck_tokens("phr").strip()


def _docs(spark, d):
    return table(spark, d, "documents")


def _ann(spark, d):
    return toy.annotated(_docs(spark, d))


def _phrases(spark, d):
    o = F.col("o_orderkey")
    pick = lambda n, words: F.element_at(F.array(*map(F.lit, words)), (o % n + 1).cast("int"))
    text = F.concat((o % 90 + 1).cast("string"), F.lit(" "), pick(5, ["thousand ", "hundred thousand ", "", "million ", "two hundred "]), pick(7, ["dollars", "danish krona", "percent", "euros", "swedish kronor", "ships", "ships"]), F.lit(" and one more ."))
    return table(spark, d, "orders").select(o.alias("doc_id"), text.alias("text"))


Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("tokenize", f"{WITH} SELECT doc_id, tok_ix, txt, kind FROM tok")
def _(spark, d):
    return T.tokens(_docs(spark, d)).select("doc_id", "tok_ix", "txt", "kind")


@query("token_kinds", f"{WITH} SELECT kind, count(*) AS n, count(DISTINCT txt) AS forms FROM tok GROUP BY kind")
def _(spark, d):
    rows = _docs(spark, d).select(F.explode(T.token_array(F.col("text"))).alias("txt")).groupBy("txt").count()
    return rows.groupBy(T.kind(F.col("txt")).alias("kind")).agg(F.sum("count").alias("n"), F.count("*").alias("forms"))


_KIND = "CASE " + " ".join(f"WHEN regexp_full_match(txt, '{p}') THEN '{k}'" for k, p in N.PATTERNS.items()) + """ WHEN regexp_matches(txt, '^\\p{L}') THEN 'WORD' WHEN regexp_full_match(txt, '[0-9]{4}') AND try_cast(txt AS INT) BETWEEN 874 AND 2199 THEN 'YEAR'
 WHEN regexp_matches(txt, '^[0-9]') THEN 'NUMBER' WHEN txt = chr(10) THEN 'P' ELSE 'PUNCTUATION' END"""
#: Texts that hold tokens of the rarer kinds, from the orders.
MARKED = """SELECT o_orderkey AS doc_id, 'Order ' || o_orderkey || ' of ' || o_orderdate::DATE || ' at ' || o_orderkey % 24 || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || ' by clerk' || o_custkey || '@mail.example.org, see https://example.org/o?id=' || o_orderkey || ' or www.example.com #order @clerk' || o_custkey % 9
 || ' ' || o_orderkey % 100 || '% of $' || o_orderkey || ' and ' || o_orderkey % 50 || 'km, the ' || o_orderkey % 10 || 'th, 555-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || ' ' || o_orderkey % 31 || '/' || o_orderkey % 12 || ' 4b A' || o_orderkey || ' 12xy3.' AS text FROM orders"""


def _marked(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    two = lambda n, k: F.lpad((o % n).cast("string"), k, "0")
    parts = ["Order ", o, " of ", F.col("o_orderdate").cast("date"), " at ", o % 24, ":", two(60, 2), " by clerk", c, "@mail.example.org, see https://example.org/o?id=", o, " or www.example.com #order @clerk", c % 9]
    parts += [" ", o % 100, "% of $", o, " and ", o % 50, "km, the ", o % 10, "th, 555-", two(10000, 4), " ", o % 31, "/", o % 12, " 4b A", o, " 12xy3."]
    return table(spark, d, "orders").select(o.alias("doc_id"), F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("text"))


@query("typed_kinds", f"SELECT {_KIND} AS kind, count(*) AS n, count(DISTINCT txt) AS forms FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '{N.TOKEN}', 1)) AS txt FROM documents) GROUP BY 1")
def _(spark, d):
    rows = _docs(spark, d).select(F.explode(T.token_array(F.col("text"), N.TOKEN)).alias("txt")).groupBy("txt").count()
    return rows.groupBy(N.kind(F.col("txt")).alias("kind")).agg(F.sum("count").alias("n"), F.count("*").alias("forms"))


@query("typed_tokens", f"SELECT doc_id, tok_ix, txt, {_KIND} AS kind FROM (SELECT doc_id, unnest(t) AS txt, (generate_subscripts(t, 1) - 1)::INT AS tok_ix FROM (SELECT doc_id, regexp_extract_all(text, '{N.TOKEN}', 1) AS t FROM ({MARKED})))")
def _(spark, d):
    return N.tokens(_marked(spark, d)).select("doc_id", "tok_ix", "txt", "kind")


@query("first_sentence", f"{WITH} SELECT doc_id, tok_ix, txt FROM (SELECT *, min(sent_ix) OVER (PARTITION BY doc_id) AS s FROM tok WHERE kind <> 'P') WHERE sent_ix = s")
def _(spark, d):
    return K.first_sentences(T.tokens(_docs(spark, d))).select("doc_id", "tok_ix", "txt")


#: The value follows from the order itself: the SQL does not read the text.
@query("amount_abbrev", "SELECT o_orderkey AS doc_id, CAST((o_orderkey % 90 + 1) * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1000000000 END AS DOUBLE) AS value, 'ISK' AS iso, (o_orderkey % 90 + 1) || ' ' || CASE o_orderkey % 4 WHEN 0 THEN 'kr' WHEN 1 THEN 'þ.kr.' WHEN 2 THEN 'm.kr' ELSE 'ma.kr.' END AS txt FROM orders")
def _(spark, d):
    o = F.col("o_orderkey")
    short = F.element_at(F.array(*map(F.lit, ("kr", "þ.kr.", "m.kr", "ma.kr."))), (o % 4 + 1).cast("int"))
    docs = table(spark, d, "orders").select(o.alias("doc_id"), F.concat(F.lit("Cost "), (o % 90 + 1).cast("string"), F.lit(" "), short, F.lit(" and more")).alias("text"))
    return K.abbreviated_amounts(K.numbers(T.tokens(docs))).where("kind = 'AMOUNT'").select("doc_id", "value", "iso", "txt")


@query("paragraph_split", "SELECT doc_id, (i - 1)::INT AS para_ix, p[i] AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents) WHERE trim(p[i]) <> ''")
def _(spark, d):
    return K.paragraphs(_docs(spark, d))


@query("sentence_split", f"{WITH} SELECT doc_id, sent_ix, min(tok_ix) AS first, max(tok_ix) AS last, count(*) AS n_tokens, string_agg(txt, ' ' ORDER BY tok_ix) AS text FROM tok WHERE kind <> 'P' GROUP BY doc_id, sent_ix")
def _(spark, d):
    return K.sentences(T.tokens(_docs(spark, d)))


@query("abbrev_resplit", f"""{WITH}, e AS (SELECT *, lag(txt) OVER w AS b, lead(txt) OVER w AS a FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY tok_ix)),
f AS (SELECT *, (txt IN ('.', '!', '?', chr(10)) AND NOT coalesce(txt = '.' AND length(b) = 1 AND regexp_matches(b, '^\\p{{L}}') AND regexp_matches(a, '^\\p{{Ll}}'), false))::INT AS e FROM e),
g AS (SELECT doc_id, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY tok_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS sent_ix FROM f)
SELECT doc_id, sent_ix, count(*) AS n FROM g GROUP BY doc_id, sent_ix""")
def _(spark, d):
    return K.resplit(T.tokens(_docs(spark, d))).groupBy("doc_id", "sent_ix").agg(F.count("*").alias("n"))


@query("original_length_invariant", "SELECT count(*) AS documents, 0::BIGINT AS violations FROM documents")
def _(spark, d):
    docs = _docs(spark, d)
    bad = K.lost_characters(docs, T.tokens(docs)).agg(F.count("*").alias("violations"))
    return docs.agg(F.count("*").alias("documents")).join(F.broadcast(bad))  # one row each


@query("annotate", f"{WITH} SELECT doc_id, tok_ix, txt, cat, cs, gender, num, lemma, infl FROM ann")
def _(spark, d):
    return _ann(spark, d).select("doc_id", "tok_ix", "txt", "cat", "cs", "gender", "num", "lemma", "infl")


@query("annotate_join", f"{WITH} SELECT doc_id, tok_ix, (cat IS NOT NULL)::INT AS readings, cat AS first_cat FROM ann WHERE kind = 'WORD'")
def _(spark, d):
    rows = T.tokens(_docs(spark, d))
    got = K.annotate(rows.where("kind = 'WORD'"), toy.lexicon(rows))
    return got.select("doc_id", "tok_ix", F.size("meanings").alias("readings"), F.get("meanings", F.lit(0))["cat"].alias("first_cat"))


@query("oov_tokens", f"{WITH} SELECT lw AS form, count(*) AS n FROM ann WHERE kind = 'WORD' AND cat IS NULL GROUP BY lw")
def _(spark, d):
    rows = T.tokens(_docs(spark, d))
    return K.unknown_words(rows, toy.lexicon(rows)).groupBy(F.lower("txt").alias("form")).agg(F.count("*").alias("n"))


@query("annotate_hyphen_fallback", f"""{WITH}, lex AS (SELECT DISTINCT lw FROM ann WHERE cat IS NOT NULL),
f AS (SELECT DISTINCT a.lw || '-' || b.lw AS form, a.lw || b.lw AS joined, b.lw AS last FROM ann a JOIN ann b ON a.doc_id = b.doc_id AND b.tok_ix = a.tok_ix + 1 WHERE a.kind = 'WORD' AND b.kind = 'WORD' AND length(a.lw) > 6 AND length(b.lw) > 6)
SELECT f.form, coalesce(x.lw, y.lw, z.lw) AS found, CASE WHEN x.lw IS NOT NULL THEN 'whole' WHEN y.lw IS NOT NULL THEN 'joined' WHEN z.lw IS NOT NULL THEN 'last' ELSE 'unknown' END AS how
FROM f LEFT JOIN lex x ON f.form = x.lw LEFT JOIN lex y ON f.joined = y.lw LEFT JOIN lex z ON f.last = z.lw""")
def _(spark, d):
    rows = T.tokens(_docs(spark, d)).withColumn("lw", F.lower("txt"))
    pair = F.when((F.col("kind") == "WORD") & (F.lead("kind").over(K.by_doc()) == "WORD") & (F.length("lw") > 6) & (F.length(F.lead("lw").over(K.by_doc())) > 6), F.concat_ws("-", "lw", F.lead("lw").over(K.by_doc())))
    return K.hyphen_parts(rows.select(pair.alias("form")).where("form IS NOT NULL"), toy.lexicon(rows))


@query("lemma_freq", f"{WITH} SELECT lemma, cat, count(*) AS n FROM ann WHERE lemma IS NOT NULL GROUP BY lemma, cat")
def _(spark, d):
    # words are counted before they are looked up: the lexicon meets each form once
    forms = _docs(spark, d).select(F.explode(T.token_array(F.col("text"))).alias("txt")).groupBy(F.lower("txt").alias("lw"), T.kind(F.col("txt")).alias("kind")).count()
    made = toy.describe(F.col("lw"), F.col("kind") == "WORD")
    return forms.select(made["lemma"].alias("lemma"), made["cat"].alias("cat"), "count").where("lemma IS NOT NULL").groupBy("lemma", "cat").agg(F.sum("count").alias("n"))


@query("lemma_all", f"{WITH} SELECT doc_id, tok_ix, lemma || ' ' || cat AS lemma FROM ann WHERE lemma IS NOT NULL")
def _(spark, d):
    rows = T.tokens(_docs(spark, d))
    got = K.lemmatise(K.annotate(rows.where("kind = 'WORD'"), toy.lexicon(rows)))
    return got.select("doc_id", "tok_ix", F.explode("lemmas").alias("x")).select("doc_id", "tok_ix", F.concat_ws(" ", "x.lemma", "x.cat").alias("lemma"))


@query("lemma_sorted", f"{WITH} SELECT doc_id, sent_ix, string_agg(DISTINCT lemma, ',' ORDER BY lemma) AS lemmas FROM ann WHERE lemma IS NOT NULL GROUP BY doc_id, sent_ix")
def _(spark, d):
    return _ann(spark, d).where("lemma IS NOT NULL").groupBy("doc_id", "sent_ix").agg(F.array_join(F.array_sort(F.collect_set("lemma")), ",").alias("lemmas"))


@query("foreign_ratio", f"{WITH} SELECT doc_id, sent_ix, count_if(kind = 'WORD') AS words, count_if(kind = 'WORD' AND cat IS NOT NULL) AS known, count_if(kind = 'WORD') > 2 AND count_if(kind = 'WORD' AND cat IS NOT NULL) < 0.5 * count_if(kind = 'WORD') AS is_foreign FROM ann GROUP BY doc_id, sent_ix")
def _(spark, d):
    return K.foreign(_ann(spark, d))


@query("length_gate", f"{WITH} SELECT doc_id, sent_ix, count_if(kind <> 'P') > 90 AS too_long FROM tok GROUP BY doc_id, sent_ix")
def _(spark, d):
    return K.gate(T.tokens(_docs(spark, d))).groupBy("doc_id", "sent_ix").agg(F.max("too_long").alias("too_long"))


@query("paren_prune", f"""WITH par AS (SELECT doc_id, replace(coalesce(text, ''), ', ', ' ( xx ) ') AS text FROM documents), {duck_tokens('par').strip()},
o AS (SELECT *, sum((txt = '(')::INT) OVER w - coalesce(sum((txt = ')')::INT) OVER (PARTITION BY doc_id, sent_ix ORDER BY tok_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth,
      sum((txt = '(')::INT) OVER w AS grp FROM ann WINDOW w AS (PARTITION BY doc_id, sent_ix ORDER BY tok_ix)),
k AS (SELECT *, max(cat IS NOT NULL AND depth > 0) OVER (PARTITION BY doc_id, sent_ix, grp) AS known FROM o)
SELECT doc_id, count(*) AS kept FROM k WHERE NOT (depth > 0 AND NOT known) GROUP BY doc_id""")
def _(spark, d):
    docs = _docs(spark, d).select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(", "), F.lit(" ( xx ) ")).alias("text"))
    return K.prune_parentheses(toy.annotated(docs)).groupBy("doc_id").agg(F.count("*").alias("kept"))


_NUM = "CASE " + " ".join(f"WHEN lw = '{w}' THEN {v}.0::DOUBLE" for w, v in {**toy.NUMBER_WORDS, **toy.MULTIPLIERS}.items()) + " WHEN regexp_matches(txt, '^[0-9]') THEN try_cast(replace(regexp_replace(txt, '[.,]$', ''), ',', '') AS DOUBLE) END"
_MUL = "lw IN (" + ", ".join(f"'{w}'" for w in toy.MULTIPLIERS) + ")"
_RUNS = f"""{_P}, v AS (SELECT *, {_NUM} AS value, {_MUL} AS times FROM ann),
b AS (SELECT *, lag(value) OVER (PARTITION BY doc_id ORDER BY tok_ix) AS before FROM v),
r AS (SELECT *, sum(CASE WHEN value IS NOT NULL AND before IS NOT NULL AND times THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY tok_ix) AS run FROM b),
n AS (SELECT doc_id, min(tok_ix) AS tok_ix, string_agg(txt, ' ' ORDER BY tok_ix) AS txt, CASE WHEN bool_and(value IS NOT NULL) THEN product(value) END AS value, CASE WHEN bool_and(value IS NOT NULL) THEN 'NUMBER' ELSE min(kind) END AS kind FROM r GROUP BY doc_id, run)"""


@query("number_product", f"{_RUNS} SELECT doc_id, tok_ix, txt, kind, value FROM n WHERE value IS NOT NULL")
def _(spark, d):
    return K.numbers(T.tokens(_phrases(spark, d))).where("value IS NOT NULL").select("doc_id", "tok_ix", "txt", "kind", "value")


@query("number_words_kept", f"{_P} SELECT doc_id, tok_ix, txt, {_NUM} AS value FROM ann WHERE {_NUM} IS NOT NULL")
def _(spark, d):
    return K.numbers(T.tokens(_phrases(spark, d)), multiply=False).where("value IS NOT NULL").select("doc_id", "tok_ix", "txt", "value")


_CUR = "CASE " + " ".join(f"WHEN {{}} = '{w}' THEN '{c}'" for w, c in toy.CURRENCIES.items()) + " END"
_NAT = "CASE " + " ".join(f"WHEN {{}} = '{w}' THEN '{c}'" for w, c in toy.NATIONS.items()) + " END"
_AMOUNT = f"""{_RUNS}, l AS (SELECT *, lower(lead(txt, 1) OVER w) AS l1, lower(lead(txt, 2) OVER w) AS l2 FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY tok_ix)),
a AS (SELECT *, CASE WHEN kind = 'NUMBER' AND {_NAT.replace('{}', 'l1')} IS NOT NULL AND {_CUR.replace('{}', 'l2')} IS NOT NULL THEN 'nation' WHEN kind = 'NUMBER' AND {_CUR.replace('{}', 'l1')} IS NOT NULL THEN 'amount' WHEN kind = 'NUMBER' AND l1 IN ('percent', 'prozent', 'pourcent') THEN 'percent' END AS what FROM l)"""


@query("amount", f"{_AMOUNT} SELECT doc_id, tok_ix, value, CASE WHEN what = 'nation' THEN {_NAT.replace('{}', 'l1')} ELSE {_CUR.replace('{}', 'l1')} END AS iso FROM a WHERE what IN ('nation', 'amount')")
def _(spark, d):
    return K.amounts(K.numbers(T.tokens(_phrases(spark, d)))).where("kind = 'AMOUNT'").select("doc_id", "tok_ix", "value", "iso")


@query("percent", f"{_AMOUNT} SELECT doc_id, tok_ix, txt || ' ' || l1 AS txt, value FROM a WHERE what = 'percent'")
def _(spark, d):
    return K.amounts(K.numbers(T.tokens(_phrases(spark, d)))).where("kind = 'PERCENT'").select("doc_id", "tok_ix", "txt", "value")


@query("currency_pair", f"{_P}, l AS (SELECT *, lead(lw) OVER (PARTITION BY doc_id ORDER BY tok_ix) AS l1 FROM ann) SELECT {_NAT.replace('{}', 'lw')} AS iso, l1 AS next, count(*) AS n FROM l WHERE {_NAT.replace('{}', 'lw')} IS NOT NULL AND {_CUR.replace('{}', 'l1')} IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return K.currencies(T.tokens(_phrases(spark, d))).groupBy("iso", "next").agg(F.count("*").alias("n"))


@query("timestamp_pair", "SELECT event_id AS doc_id, 'TIMESTAMPABS' AS kind, hour(ts)::INT AS h, minute(ts)::INT AS m, year(ts)::INT AS y, month(ts)::INT AS mo, day(ts)::INT AS d FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, unnest(['TIME', 'DATEABS']), unnest([hour(ts)::INT, 0]), unnest([minute(ts)::INT, 0]), unnest([0, year(ts)::INT]), unnest([0, month(ts)::INT]), unnest([0, day(ts)::INT]) FROM events WHERE event_id % 2 = 1")
def _(spark, d):
    e = table(spark, d, "events")
    z = F.lit(0)
    # even events say the time first, odd ones the date
    time = F.struct(F.when(F.col("event_id") % 2 == 0, 0).otherwise(1).alias("tok_ix"), F.lit("TIME").alias("kind"), F.lit("t").alias("txt"), z.alias("y"), z.alias("mo"), z.alias("d"), F.hour("ts").alias("h"), F.minute("ts").alias("m"))
    date = F.struct(F.when(F.col("event_id") % 2 == 0, 1).otherwise(0).alias("tok_ix"), F.lit("DATEABS").alias("kind"), F.lit("d").alias("txt"), F.year("ts").alias("y"), F.month("ts").alias("mo"), F.dayofmonth("ts").alias("d"), z.alias("h"), z.alias("m"))
    rows = e.select(F.col("event_id").alias("doc_id"), F.explode(F.array(time, date)).alias("x")).select("doc_id", "x.*")
    return K.timestamps(rows).select("doc_id", "kind", "h", "m", "y", "mo", "d")


@query("composite_merge", f"""WITH com AS (SELECT doc_id, replace(coalesce(text, ''), ' and ', 'x- and ') AS text FROM documents), {duck_tokens('com').strip()},
c AS (SELECT *, CASE WHEN txt = '-' THEN 'h' WHEN lw IN ('and', 'or', 'und', 'oder', 'og', 'eða') THEN 'j' WHEN txt = ',' THEN 'c' WHEN kind = 'WORD' THEN 'w' ELSE 'x' END AS c FROM ann),
l AS (SELECT *, c || lead(c, 1) OVER w || lead(c, 2) OVER w || lead(c, 3) OVER w AS shape, lead(txt, 2) OVER w AS t2, lead(txt, 3) OVER w AS t3 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY tok_ix))
SELECT doc_id, tok_ix, txt || '- ' || t2 || ' ' || t3 AS txt FROM l WHERE shape = 'whjw'""")
def _(spark, d):
    docs = _docs(spark, d).select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(" and "), F.lit("x- and ")).alias("text"))
    return K.composites(T.tokens(docs)).where(F.col("txt").contains("- ")).select("doc_id", "tok_ix", "txt")


def _phrase_table(spark):
    words = ["of the", "in the", "to the", "de la", "and the", "of the the", "on the", "and of the"]
    return spark.createDataFrame([(w, i) for i, w in enumerate(words)], "words string, phrase_id long")


_PHR = ", ph AS (SELECT * FROM (VALUES ('of the', 0), ('in the', 1), ('to the', 2), ('de la', 3), ('and the', 4), ('of the the', 5), ('on the', 6), ('and of the', 7)) t(words, phrase_id)), g AS (SELECT doc_id, tok_ix, lw AS w0, lead(lw, 1) OVER w AS w1, lead(lw, 2) OVER w AS w2 FROM ann WINDOW w AS (PARTITION BY doc_id ORDER BY tok_ix)), h AS (SELECT doc_id, tok_ix, 2 AS n, phrase_id FROM g JOIN ph ON w0 || ' ' || w1 = words UNION ALL SELECT doc_id, tok_ix, 3, phrase_id FROM g JOIN ph ON w0 || ' ' || w1 || ' ' || w2 = words)"


@query("phrase_hits", f"{WITH}{_PHR} SELECT doc_id, tok_ix, n, phrase_id FROM h")
def _(spark, d):
    return K.phrase_hits(T.tokens(_docs(spark, d)), _phrase_table(spark), 3)


@query("phrase_merge")
def _(spark, d):
    rows = T.tokens(_docs(spark, d))
    return K.merge_phrases(rows, K.greedy(K.phrase_hits(rows, _phrase_table(spark), 3))).where("phrase_id IS NOT NULL")


@query("ambig_filter", f"{WITH}, l AS (SELECT *, lead(lw) OVER w AS nx, lag(lw) OVER w AS pv FROM ann WINDOW w AS (PARTITION BY doc_id ORDER BY tok_ix)) SELECT doc_id, tok_ix, CASE WHEN lw IN ('of', 'in') AND nx = 'the' AND cat <> 'no' THEN 0 WHEN lw = 'the' AND pv IN ('of', 'in') AND cat <> 'gr' THEN 0 WHEN cat IS NULL THEN 0 ELSE 1 END AS readings FROM l WHERE kind = 'WORD'")
def _(spark, d):
    rows = T.tokens(_docs(spark, d))
    pairs = spark.createDataFrame([("of", "the", "no", "gr"), ("in", "the", "no", "gr")], "w1 string, w2 string, cat1 string, cat2 string")
    got = K.keep_readings(K.annotate(rows, toy.lexicon(rows)), F.broadcast(pairs))  # a few configured pairs
    return got.where("kind = 'WORD'").select("doc_id", "tok_ix", F.size("meanings").alias("readings"))


_NAMES = f"""{WITH}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_ix ORDER BY tok_ix) = 1 AS first FROM ann),
i AS (SELECT *, kind = 'WORD' AND regexp_matches(txt, '^\\p{{Lu}}\\p{{Ll}}') AND NOT first AS cap FROM p),
r AS (SELECT *, sum((NOT cap)::INT) OVER (PARTITION BY doc_id, sent_ix ORDER BY tok_ix) AS run FROM i),
nm AS (SELECT doc_id, sent_ix, min(tok_ix) AS tok_ix, count(*) AS n, string_agg(txt, ' ' ORDER BY tok_ix) AS name, arg_min_null(gender, tok_ix) AS gender, count(*) = 1 AND max(cat IS NOT NULL) AS weak FROM r WHERE cap GROUP BY doc_id, sent_ix, run)"""


@query("name_runs", f"{_NAMES} SELECT doc_id, sent_ix, tok_ix, n, name, gender, weak FROM nm")
def _(spark, d):
    return K.name_runs(_ann(spark, d))


@query("weak_name", f"{_NAMES} SELECT weak, count(*) AS n FROM nm GROUP BY weak")
def _(spark, d):
    return K.name_runs(_ann(spark, d)).groupBy("weak").agg(F.count("*").alias("n"))


@query("name_backref", f"{_NAMES}, b AS (SELECT *, string_split(name, ' ')[1] AS given FROM nm) SELECT doc_id, tok_ix, name, CASE WHEN n = 1 THEN last_value(CASE WHEN n > 1 THEN name END IGNORE NULLS) OVER (PARTITION BY doc_id, given ORDER BY tok_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS full_name FROM b")
def _(spark, d):
    return K.back_references(K.name_runs(_ann(spark, d))).select("doc_id", "tok_ix", "name", "full_name")


@query("entity_coalesce", f"{_NAMES} SELECT nm.doc_id, nm.sent_ix, nm.tok_ix, nm.n, nm.name AS entity FROM nm JOIN ann USING (doc_id, tok_ix) WHERE ann.cat IS NULL")
def _(spark, d):
    return K.entities(_ann(spark, d))


@query("company", f"""WITH co AS (SELECT doc_id, replace(coalesce(text, ''), '.', ' Ltd .') AS text FROM documents), {duck_tokens('co').strip()},
e AS (SELECT *, lead(txt) OVER (PARTITION BY doc_id ORDER BY tok_ix) AS nx, regexp_matches(txt, '^\\p{{Lu}}') AND txt NOT IN ('Inc', 'Ltd', 'Corp', 'GmbH', 'hf', 'ehf') AS cap FROM tok),
r AS (SELECT *, sum((NOT cap)::INT) OVER (PARTITION BY doc_id ORDER BY tok_ix) AS run FROM e),
g AS (SELECT doc_id, min(tok_ix) AS tok_ix, string_agg(txt, ' ' ORDER BY tok_ix) AS name, arg_max_null(CASE WHEN nx IN ('Inc', 'Ltd', 'Corp', 'GmbH', 'hf', 'ehf') THEN nx END, tok_ix) AS ending FROM r WHERE cap GROUP BY doc_id, run)
SELECT doc_id, tok_ix, name || ' ' || ending AS name FROM g WHERE ending IS NOT NULL""")
def _(spark, d):
    docs = _docs(spark, d).select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("."), F.lit(" Ltd .")).alias("text"))
    return K.companies(T.tokens(docs))


@query("case_set", f"{WITH} SELECT lemma, string_agg(DISTINCT cs, ',' ORDER BY cs) AS cases, string_agg(DISTINCT gender, ',' ORDER BY gender) AS genders FROM ann WHERE cat = 'no' GROUP BY lemma")
def _(spark, d):
    rows = T.tokens(_docs(spark, d))
    per = toy.lexicon(rows).where("cat = 'no'").groupBy("lemma").agg(F.collect_list(F.struct("infl", "gender")).alias("m"))
    return per.select("lemma", F.array_join(K.cases_of(F.col("m")), ",").alias("cases"), F.array_join(K.genders_of(F.col("m")), ",").alias("genders"))


@query("case_intersect", f"{WITH}, l AS (SELECT *, lead(cat) OVER w AS c2, lead(cs) OVER w AS cs2, lead(gender) OVER w AS g2 FROM ann WINDOW w AS (PARTITION BY doc_id ORDER BY tok_ix)) SELECT cs AS common, count(*) AS n FROM l WHERE cat = 'lo' AND c2 = 'no' AND cs = cs2 GROUP BY cs")
def _(spark, d):
    rows = _ann(spark, d)
    nxt = lambda c: F.lead(c).over(K.by_doc())
    both = F.array_intersect(F.array("cs"), F.array(nxt("cs")))
    pairs = rows.withColumn("common", F.when((F.col("cat") == "lo") & (nxt("cat") == "no"), both))
    return pairs.where(F.size("common") > 0).groupBy(F.get("common", F.lit(0)).alias("common")).agg(F.count("*").alias("n"))


_MASK = " + ".join(f"CASE WHEN contains(infl, '{v.upper()}') THEN {X.bit(v)}::BIGINT ELSE 0 END" for v in X.VARIANTS)


@query("feature_mask", f"{WITH} SELECT infl, {_MASK} AS mask, count(*) AS n FROM ann WHERE infl IS NOT NULL GROUP BY infl")
def _(spark, d):
    return _ann(spark, d).where("infl IS NOT NULL").groupBy("infl").agg(F.count("*").alias("n")).select("infl", X.mask_of(F.col("infl")).alias("mask"), "n")


_VARS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(infl, '{v.upper()}') THEN '{v}' END" for v in X.VARIANTS) + "], lambda x: x IS NOT NULL), ',')"


@query("variants", f"{WITH} SELECT DISTINCT infl, {_VARS} AS variants FROM ann WHERE infl IS NOT NULL")
def _(spark, d):
    return _ann(spark, d).where("infl IS NOT NULL").select("infl").distinct().select("infl", F.array_join(X.variants_of(F.col("infl")), ",").alias("variants"))


@query("pos_tag", f"""{WITH}, t AS (SELECT *, CASE gender WHEN 'kk' THEN 'k' WHEN 'kvk' THEN 'v' WHEN 'hk' THEN 'h' ELSE '' END || CASE num WHEN 'et' THEN 'e' WHEN 'ft' THEN 'f' ELSE '' END AS gn, CASE cs WHEN 'nf' THEN 'n' WHEN 'þf' THEN 'o' WHEN 'þgf' THEN 'þ' WHEN 'ef' THEN 'e' ELSE '' END AS c FROM ann),
p AS (SELECT CASE WHEN kind IN ('NUMBER', 'YEAR') THEN 'ta' WHEN kind = 'PUNCTUATION' THEN 'p' WHEN kind = 'P' THEN '' WHEN cat = 'no' THEN 'n' || gn || c WHEN cat = 'lo' THEN 'l' || gn || c WHEN cat = 'gr' THEN 'g' || gn || c
 WHEN cat = 'so' THEN CASE WHEN num = 'ft' THEN 'sf3f' ELSE 'sf3e' END WHEN cat = 'fs' THEN 'a' || c WHEN cat = 'ao' THEN 'aa' WHEN cat = 'st' THEN 'c' ELSE 'e' END AS tag FROM t)
SELECT tag, count(*) AS n FROM p GROUP BY tag""")
def _(spark, d):
    rows = _ann(spark, d)
    return rows.groupBy(X.pos_tag(*(F.col(c) for c in ("kind", "cat", "gender", "num", "cs"))).alias("tag")).agg(F.count("*").alias("n"))


@query("augment_terminal", f"{WITH} SELECT DISTINCT cat, infl, cat || '_1_' || cs || '_' || array_to_string(list_sort(list_distinct(list_concat(['subj'], [cs, num]))), '_') AS terminal FROM ann WHERE cat = 'so'")
def _(spark, d):
    rows = _ann(spark, d).where("cat = 'so'").select("cat", "infl", "cs").distinct()
    given = F.array(F.lit("1"), F.col("cs"), F.lit("subj"))
    return rows.select("cat", "infl", X.augment(F.col("cat"), given, X.variants_of(F.col("infl"))).alias("terminal"))


@query("simplify_terminal", f"{WITH} SELECT lw, cat, cat AS plain, cat || '_' || cs AS with_case FROM (SELECT DISTINCT lw, cat, cs FROM ann WHERE cat IN ('gr', 'fs'))")
def _(spark, d):
    rows = _ann(spark, d).where("cat IN ('gr', 'fs')").select("lw", "cat", "cs").distinct()
    plain, cased = F.concat(F.lit("'"), "lw", F.lit("'")), F.concat(F.lit("'"), "lw", F.lit("'_"), "cs")
    return rows.select("lw", "cat", X.simplify_terminal(plain, F.col("cat")).alias("plain"), X.simplify_terminal(cased, F.col("cat")).alias("with_case"))


@query("number_agreement", "SELECT l_quantity AS n, count(*) AS rows, (abs(l_quantity) = floor(abs(l_quantity)) AND abs(l_quantity) % 10 = 1 AND abs(l_quantity) % 100 <> 11) AS singular FROM lineitem GROUP BY l_quantity")
def _(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("n")).agg(F.count("*").alias("rows"))
    return rows.withColumn("singular", X.is_singular(F.col("n")))


@query("tidy_text", "SELECT doc_id, regexp_replace(regexp_replace(text, ' ([.,;:!?)\\]}%”])', '\\1', 'g'), '([(\\[{“„]) ', '\\1', 'g') AS tidy FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.tidy(F.col("text")).alias("tidy"))


@query("all_but_last_word", "SELECT p_partkey, regexp_replace(p_name, '\\s*\\S+$', '') AS head FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", X.all_but_last_word(F.col("p_name")).alias("head"))


@query("middle_stem", f"{WITH} SELECT DISTINCT lemma, CASE WHEN ends_with(lemma, 'st') THEN lemma ELSE lemma || 'st' END AS mm FROM ann WHERE cat = 'so'")
def _(spark, d):
    return _ann(spark, d).where("cat = 'so'").select("lemma").distinct().withColumn("mm", X.middle_stem(F.col("lemma")))
