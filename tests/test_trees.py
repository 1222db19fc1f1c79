"""Grammars, parses, trees, patterns, inflection, sources and streaming."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.operators import grammar as G
from treeloom.operators import inflect as I
from treeloom.operators import parser as P
from treeloom.operators import patterns as M
from treeloom.operators import trees as T
from treeloom.sources import brackets, catalog, toy

D = "/root/testdata/sf0.001"


# ---- grammar


def test_grammar_variants_and_repeats():
    g = G.compile_grammar("/case = nf þf\nS -> NP/case VP?\nNP/case -> no/case+\nVP -> so > ao\n$score(3) NP\n$tag(x) VP")
    assert {p.nt for p in g.productions} == {"S", "NP_nf", "NP_þf", "No_nf+", "No_þf+", "VP", "VP?"}
    assert g.nullable() == {"VP?"} and g.scores == {"NP_nf": 3, "NP_þf": 3} and g.tags["VP"] == {"x"}
    assert [p.prio for p in g.by_nt["VP"]] == [0, 1]
    assert "so" in g.follow()["NP_nf"]


@pytest.mark.parametrize("text", ["S -> S", "S -> X", "S -> NP\nNP -> NP no", "", "S -> a | b > c", "$if(x)\nS -> a", "$what(1) S"])
def test_grammar_faults(text):
    with pytest.raises(G.GrammarError):
        G.compile_grammar(text)


def test_grammar_conditions():
    text = "S -> no X?\n$if(long)\nX -> so\n$endif(long)\n$if(short)\nX -> ao\n$endif(short)"
    assert [p.items for p in G.compile_grammar(text, {"long"}).by_nt["X"]] == [("so",)]


# ---- parser


def trees_by_hand(g, cats, nt, i, j, depth=0):
    """Number of trees of nt over cats[i:j], by plain enumeration."""
    if depth > 12:
        return 0
    total = 0
    for p in g.by_nt[nt]:
        if not p.items:
            total += i == j
            continue
        for cuts in itertools.combinations_with_replacement(range(i, j + 1), len(p.items) - 1):
            ends = [i, *cuts, j]
            n = 1
            for item, a, b in zip(p.items, ends, ends[1:]):
                n *= trees_by_hand(g, cats, item, a, b, depth + 1) if g.is_nonterminal(item) else int(b == a + 1 and cats[a] == item)
                if not n:
                    break
            total += n
    return total


def test_counts_against_enumeration():
    g = G.compile_grammar("S -> NP VP | VP\nNP -> no PP?\nPP -> fs NP\nVP -> so NP? PP*")
    parser = P.Parser(g)
    for n in range(1, 7):
        for cats in itertools.product(("no", "so", "fs"), repeat=n):
            root, error = parser.parse([P.Token(c, c) for c in cats])
            assert P.combinations(root) == trees_by_hand(g, cats, "S", 0, n), cats
            assert (root is None) == (error >= 0)


def test_priority_prunes_and_error_index():
    g = G.compile_grammar("S -> A > B\nA -> no so\nB -> no so")
    root, _ = P.Parser(g).parse([P.Token("x", "no"), P.Token("y", "so")])
    assert P.combinations(root) == 1 and root.families[0][1][0].name == "A"
    assert P.Parser(g).parse([P.Token("x", "no"), P.Token("y", "no")])[1] == 1


def test_reduction_uses_frames_and_is_stable():
    g = G.compile_grammar(G.TOY)
    words = [P.Token("anna", "no"), P.Token("puts", "so", lemma="put"), P.Token("box", "no"), P.Token("on", "fs"), P.Token("table", "no")]
    root, _ = P.Parser(g).parse(words)
    assert P.combinations(root) == 2
    low = P.Reducer(g, {"put": {"on"}}).reduce(root, words)
    assert [P.Reducer(g, {"put": {"on"}}).reduce(root, words)[1] for _ in range(5)] == [low[1]] * 5
    rows = P.simplify(low[0], words)
    assert [r["text"] for r in rows if r["text"]] == ["anna", "puts", "box", "on", "table"]
    assert rows[0]["tag"] == "S-MAIN" and {r["tag"] for r in rows if not r["text"]} == {"S-MAIN", "NP", "VP", "PP"}
    single = P.Parser(g).parse(words[:2])[0]
    assert P.Reducer(g).reduce(single, words[:2])[1] == 0
    assert "option 2" in P.forest_text(root, words)


def test_parse_table(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    rows = [(1, 0, i, "WORD", t, c, "nf", "kk", "et", t) for i, (t, c) in enumerate([("the", "gr"), ("man", "no"), ("ran", "so")])] + [(1, 1, 3, "WORD", "of", "fs", "nf", "kk", "et", "of")]
    tokens = spark.createDataFrame(rows, "doc_id long, sent_ix int, tok_ix int, kind string, txt string, cat string, cs string, gender string, num string, lemma string")
    got = {r.sent_ix: r for r in P.parse(tokens, G.compile_grammar(G.TOY)).collect()}
    assert got[0].combinations == 1 and got[0].score == 0 and got[1].combinations == 0 and got[1].err_index == 0
    assert P.parse(tokens, G.compile_grammar(G.TOY), most=2).where("sent_ix = 0").first().combinations is None
    nodes = P.nodes(P.parse(tokens, G.compile_grammar(G.TOY)))
    assert T.flat(nodes).first().flat == "S-MAIN NP gr no /NP VP so /VP /S-MAIN"
    assert docs.count() == 1


# ---- trees and patterns


@pytest.fixture(scope="module")
def nodes(spark):
    return T.pseudo_trees(toy.annotated(spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 40"))).cache()


def test_trees_of_every_sentence(spark):
    """Long sentences have trees, too, coded as by hand; pattern_repeat finds them."""
    from treeloom.plans import tree_queries

    cats = ["no", "so", "fs", None, "lo", "ao"]
    tokens = [(1, 0, i, "WORD", f"w{i}", cats[i * i % 11 % 6]) for i in range(300)] + [(1, 0, 300, "PUNCTUATION", ".", None), (1, 1, 301, "WORD", "x", "no")]
    made = T.pseudo_trees(spark.createDataFrame([(*t, t[4]) for t in tokens], "doc_id long, sent_ix int, tok_ix int, kind string, txt string, cat string, lemma string"))
    rows = sorted((r for r in made.collect() if r.tree == "1:0"), key=lambda r: r.pre)
    assert made.where("tree = '1:1'").count() == 3 and [r.tok_ix for r in rows if r.text is not None] == list(range(301))
    for i, r in enumerate(rows):
        below = next((k for k in range(i + 1, len(rows)) if rows[k].depth <= r.depth), len(rows)) - i - 1
        assert (r.pre, r.post) == (i + 1, i + 1 + below - r.depth)
    every = T.pseudo_trees(toy.annotated(spark.read.parquet(f"{D}/documents.parquet")))
    long = {r.tree for r in every.where("text IS NOT NULL").groupBy("tree").count().where("count > 12").collect()}
    assert long & {r.tree for r in tree_queries.Q["pattern_repeat"](spark, D).collect()}


PATTERNS = ["NP", "S-MAIN > { VP NP }", "S-MAIN > { so }", "S-MAIN >>> { no lo }", "S-MAIN > [ NP VP ]", "S-MAIN > [ NP p $ ]", "( VP | PP )", "VP > so", "S > { p }"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_plan_equals_interpreter(nodes, pattern):
    plan = {tuple(r) for r in M.plan(nodes, pattern).select("tree", "node").collect()}
    assert plan == {tuple(r) for r in M.interpret(nodes, pattern).collect()}


ODD = [None, "", "\n\n", "  ", "one", "a.b!c?d\ne", "3.14. Then 2,5, 1999", ". . .", "über ÄÖ ΑΣ İx naïve", "x\u00a0y \u2003 z (a) b-c", "no end " * 300]


def odd(spark):
    docs = spark.createDataFrame([(900 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    return docs.unionByName(spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 40").select("doc_id", "text"))


def test_forests_are_the_trees(spark, monkeypatch):
    """Forests made of documents have the nodes, intervals and words of the node table, whatever the slices."""
    from treeloom.operators import forest as R

    columns = ["tree", "node", "parent", "pre", "post", "depth", "tag", "text", "lemma", "tok_ix"]
    want = {tuple(r) for r in T.pseudo_trees(toy.annotated(odd(spark))).select(columns).collect()}
    made = R.pseudo_forests(odd(spark).coalesce(1), toy.meaning)
    batches = made.rows.toArrow().to_batches()
    for most in (1, 700, R.SLICE):
        monkeypatch.setattr(R, "SLICE", most)
        got, n = set(), 0
        for f in (f for b in batches for f in made.make(b)):
            name, tree = f.label(np.arange(len(f))).to_pylist(), f.names.take(f.tree).to_pylist()
            first = {t: i for i, t in reversed(list(enumerate(tree)))}
            leaf = iter(zip(f.text.to_pylist(), f.lemma.to_pylist(), f.tok_ix.to_pylist()))
            for i in range(len(f)):
                pre, n = i - first[tree[i]] + 1, n + 1
                got.add((tree[i], name[i], name[f.parent[i]] if f.parent[i] >= 0 else None, pre, int(pre + f.end[i] - i - 1 - f.depth[i]), int(f.depth[i]), f.tags[f.tag[i]], *(next(leaf) if f.leaf[i] else (None,) * 3)))
        assert got == want and n == len(want)


def test_meaning_of_words(spark):
    rows = toy.annotated(odd(spark)).where("kind = 'WORD'").select("lw", "cat", "lemma").distinct().collect()
    assert len(rows) > 1000 and all(toy.meaning(r.lw) == (r.cat, r.lemma) for r in rows)


FOREST = ["S > [ NP+ VP .* p $ ]", "S > [ .* p ]", "S > [ .? VP ]", "S > [ NP? VP* ]", "S >>> [ no+ $ ]", "S >> { fs so }", ". > [ lo? no . $ ]", "NP > { @'the' }", "S >>> { NP > { lo no } }", "( S > { p } | VP > so )", "S >>> [ .* $ ]", "{ NP }"]
FOREST += ["no_et", 'S > { @"." }', "S >> [ .+ so_x? ]", "NP >>> { }", "S > [ { NP } ( VP | PP ) ]", "S > [ NP+ NP ]", "S > [ . $ NP ]"]


@pytest.mark.parametrize("how", ["all", "first", "top"])
def test_forests_match_as_the_interpreter(spark, nodes, how):
    """All nodes at once and node by node, of node tables, treebanks with IP, and documents."""
    from treeloom.operators import forest as R

    bank = brackets.nodes(spark.createDataFrame([("b", "(S-MAIN (IP (NP (no a) (no b)) (IP (VP (so c)))) (VP (so_fh d) (IP (fs e) (so f))) (lo_et g) (p .))")], "tree string, bracket string"))
    docs = R.pseudo_forests(spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 40"), toy.meaning)
    for source in (bank, nodes):
        trees = {}
        for r in source.collect():
            trees.setdefault(r.tree, []).append(r.asDict())
        roots = {name: M.Tree.of(rows) for name, rows in trees.items()}
        for pattern in FOREST if how == "all" else FOREST[:9:2]:
            assert M.ForestMatcher.knows(M.compile_pattern(pattern)), pattern
            m = M.Matcher(pattern)
            want = {(name, n.row["node"]) for name, root in roots.items() for n in ([m.first(root)] if how == "first" else getattr(m, how)(root)) if n}
            assert {tuple(r) for r in M.interpret(source, pattern, how).collect()} == want, pattern
            if source is nodes:
                assert {tuple(r) for r in M.interpret(docs, pattern, how).collect()} == want, pattern
    assert [tuple(r) for r in M.interpret(bank, 'S > "a b c"', how).collect()] == [("b", "0")]


def test_pattern_repeat_moves_no_rows(spark):
    from treeloom.plans import tree_queries

    assert "Exchange" not in tree_queries.Q["pattern_repeat"](spark, D)._jdf.queryExecution().executedPlan().toString()


def test_pattern_desc_set_moves_no_rows(spark):
    """The lists below are found without joins, and are those of the plan over node tables."""
    from treeloom.plans import tree_queries

    got = tree_queries.Q["pattern_desc_set"](spark, D)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = M.plan(T.pseudo_trees(toy.annotated(spark.read.parquet(f"{D}/documents.parquet"))), "S-MAIN >>> { no lo }").select("tree", "node")
    assert got.columns == want.columns and {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} != set()


def test_counts_of_visible_nodes(spark, nodes):
    """Counts are those of the pairs, with walls inside walls and starting nodes that are walls themselves. No rows move."""
    from treeloom.plans import tree_queries

    bank = brackets.nodes(spark.createDataFrame([("b", "(NP (VP (no a) (VP (NP (no b)) (VP (no c)))) (NP (VP (so d)) (NP (no e) (PP (p .)))) (NP (VP (so f))))")], "tree string, bracket string"))
    for source in (bank, nodes):
        for tag, cut in (("NP", "VP"), ("VP", "VP"), ("NP", "NP"), ("S-MAIN", "NP"), ("NP", "no")):
            pairs = T.descendants_cut(source, cut).where(F.col("a_tag") == tag).groupBy("tree", "a_node").count()
            assert {tuple(r) for r in T.count_cut(source, tag, cut).collect()} == {tuple(r) for r in pairs.collect()}, (tag, cut)
    assert "Exchange" not in tree_queries.Q["tree_descendants_cut"](spark, D)._jdf.queryExecution().executedPlan().toString()


def test_texts_of_subtrees(spark, nodes):
    """Texts and spans by ranges of leaves, against pairs of nodes; a node without leaves has none. No rows move."""
    from treeloom.operators import forest as R
    from treeloom.plans import tree_queries

    def by_hand(rows):
        out = set()
        for a in rows:
            below = sorted((r for r in rows if r.tree == a.tree and r.text is not None and a.pre < r.pre and r.post < a.post), key=lambda r: r.pre)
            toks = [r.tok_ix for r in below if r.tok_ix is not None]
            if a.text is None and below:
                out.add((a.tree, a.node, " ".join(r.text for r in below), " ".join(r.text if r.lemma is None else r.lemma for r in below), min(toks, default=None), max(toks, default=None)))
        return out

    bank = brackets.nodes(spark.createDataFrame([("b", "(S (NP (NP (no a (lemma x)) (no b)) (VP (VP (so c)))) (p .))"), ("c", "(S (NP (no d)))")], "tree string, bracket string"))
    bank = bank.withColumn("tok_ix", F.when(F.col("text") != "d", F.col("pre") * 10)).unionByName(spark.createDataFrame([("e", "0", 1, 1, "S")], "tree string, node string, pre int, post int, tag string"), allowMissingColumns=True)
    assert {tuple(r) for r in T.texts(bank).collect()} == by_hand(bank.collect()) and T.texts(bank.limit(0)).count() == 0
    some = nodes.where("startswith(tree, '7:') OR startswith(tree, '8:')").collect()
    docs = spark.read.parquet(f"{D}/documents.parquet").where("doc_id IN (7, 8)")
    assert {tuple(r) for r in T.texts(R.pseudo_forests(docs, toy.meaning)).collect()} == by_hand(some) != set()
    assert "Exchange" not in tree_queries.Q["tree_span"](spark, D)._jdf.queryExecution().executedPlan().toString()


def sentence():
    _, rows = brackets.read("(S-MAIN (NP-SUBJ (no Barn (lemma barn))) (VP (so fór (lemma fara)) (PP (fs í) (NP (no ferð)))) (IP (VP (so_fh sá))) (p .))")
    return M.Tree.of(rows)


@pytest.mark.parametrize(
    "pattern, n",
    [
        (".", 1), ("S-MAIN", 1), ("S > NP", 1), ("S > { VP IP }", 1), ("S >> { so_fh }", 0), ("S >>> { so_fh }", 1), ('S > "barn"', 1), ("S >>> 'fara'", 1), ("S >>> @'fór'", 0), ("S > [ NP .* p $ ]", 1),
        ("S > [ NP VP $ ]", 0), ("S > [ NP VP ]", 1), ("S > [ .* ]", 1), ("S > [ NP+ VP? IP p ]", 1), ("S > [ VP ]", 0), ("( NP | S > { p } )", 1), ("S > { PP }", 0), ("S >>> { PP > { fs NP } }", 1), ("S > [ NP? VP* IP p $ ]", 1),
        ("S >>> { so_fh_x }", 0), ('S >>> "í ferð"', 1),
    ],
)
def test_interpreter(pattern, n):
    assert int(M.Matcher(pattern).matches(sentence())) == n


def test_macros_first_and_top():
    tree = sentence()
    assert M.Matcher("S > %verb", {"verb": "VP"}).matches(tree) and M.Matcher("S > %f", {"f": lambda t: t.row["tag"] == "IP"}).matches(tree)
    assert M.Matcher("VP").first(tree).row["pre"] == 4 and len(M.Matcher("VP").all(tree)) == 2
    assert [t.row["tag"] for t in M.Matcher("( IP | VP )").top(tree)] == ["VP", "IP"]


@pytest.mark.parametrize("pattern", ["", "S > {", "( A | )", "} A", "'x", "S >", "[ A"])
def test_pattern_faults(pattern):
    with pytest.raises(M.PatternError):
        M.compile_pattern(pattern)


def test_intervals_and_round_trips(nodes):
    rows = nodes.collect()
    by = {(r.tree, r.node): r for r in rows}
    for r in rows:
        if r.parent:
            p = by[r.tree, r.parent]
            assert p.pre < r.pre and r.post < p.post
    back = T.from_json(T.to_json(nodes))
    key = ["tree", "node", "parent", "pre", "post", "tag", "text"]
    assert sorted(map(str, back.select(key).collect())) == sorted(map(str, nodes.select(key).collect()))
    assert brackets.nodes(T.bracket(nodes)).count() == nodes.count()


def test_brackets():
    meta, rows = brackets.read("((META (ID-CORPUS x.1) (URL http://a)) (S0 (NP (no ferð_mín (lemma ferð)))))")
    assert meta == {"ID-CORPUS": "x.1", "URL": "http://a"} and [(r["tag"], r["text"], r["lemma"]) for r in rows] == [("S0", None, None), ("NP", None, None), ("no", "ferð mín", "ferð")]
    assert [r["post"] + r["depth"] for r in rows] == [3, 3, 3]  # the last node inside each
    for bad in ("(S (NP)", "(S))"):
        with pytest.raises(ValueError):
            brackets.read(bad)


# ---- inflection


def test_inflection(spark):
    stems = spark.createDataFrame([("hest", "no", "kk"), ("stór", "lo", None)], "stem string, cat string, gender string")
    words = spark.createDataFrame([("k", 0, "the", "gr", "ft", "kk", True), ("k", 1, "Stórurin", "lo", "ft", "kk", True), ("k", 2, "hestorin", "no", "ft", "kk", True), ("k", 3, "xyz", "ao", None, None, None), ("k", 4, ",", "p", None, None, None)], "key string, ix int, txt string, cat string, number string, gender string, definite boolean")
    forms = I.forms(words, I.toy_paradigm(stems).withColumn("gender", F.coalesce("gender", F.lit("kk"))))
    p = I.phrases(forms).first()
    assert (p.nominative, p.dative, p.genitive) == ("the Stórorin hestorin xyz", "the Stórumin hestumin xyz", "the Stórnain hestnain xyz")
    assert (p.indefinite, p.canonical) == ("Stóror hestor xyz", "Stóro hesto xyz")
    assert I.formatted(I.phrases(forms), "þgf").first().form == p.dative
    with pytest.raises(ValueError):
        I.formatted(I.phrases(forms), "plural")


def test_words_are_described_once(spark):
    """The vocabulary is the lexicon of the tokens, and no condition on it goes below the count of words."""
    from treeloom.plans import tree_queries

    assert {tuple(r) for r in toy.vocabulary(odd(spark)).collect()} == {tuple(r) for r in toy.lexicon(toy.annotated(odd(spark))).collect()}
    plan = tree_queries._stems(spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "md5" in plan and "md5" not in plan[plan.rindex("Aggregate") :].split("\n", 1)[1]


def test_forms_of_ambiguous_words(spark):
    """The first lemma in order counts, the first of its forms that agree; other genders, doubled rows and gaps do no harm."""
    cells = [("b", "no", "x", "nf", "et", "kk", False), ("b", "no", "xb", "þf", "et", "kk", False), ("a", "no", "x", "nf", "et", "kk", False), ("a", "no", "x", "þgf", "et", "kk", False), ("a", "no", "xz", "þf", "et", "kk", False)]
    cells += [("a", "no", "xa", "þf", "et", "kk", False), ("a", "no", "w", "þf", "et", "hk", False), ("a", "no", "v", "ef", "et", None, False), ("a", "lo", "u", "ef", "et", "kk", False), (None, "no", "x", "nf", "et", "kk", False), ("a", "no", "q", "nf", "et", "kk", None)]
    paradigm = spark.createDataFrame(cells * 2, "lemma string, cat string, form string, case string, number string, gender string, definite boolean")
    words = spark.createDataFrame([("k", 0, "X", "no", "et", "kk", False), ("k", 1, "x", "ao", "et", "kk", False), ("k", 2, "new", "no", "et", "kk", False)], "key string, ix int, txt string, cat string, number string, gender string, definite boolean")
    got = {r.ix: r for r in I.forms(words.where("ix > 0"), paradigm.where("lemma IS NOT NULL")).collect()}
    assert (got[1].accusative, got[2].accusative, got[2].canonical) == ("x", "new", "new")
    first = I.forms(words.where("ix = 0"), paradigm.where("lemma IS NOT NULL")).collect()
    assert [(r.nominative, r.accusative, r.dative, r.genitive, r.indefinite) for r in first] == [("X", "Xa", "X", "V", "X")]


# ---- catalogue


CATALOG = """
# a remark
[settings]
debug = true
[static_phrases]
meaning = ao frasi -
"til dæmis" , "aa", "til dæmi" $error(X/y)
[ambiguous_phrases]
"að vera*" nhm so
[verb_objects]
gefa þgf þf /handa þgf *upp $score(4)
segja (clause)
[verb_subjects]
subject = þf
langa
[prepositions]
til ef
um* þf nh
[preferences]
við pfn << fs st
[noun_preferences]
ára ár < ára
[name_preferences]
Anna
[disallowed_names]
Sem þf
[undeclinable_adjectives]
gaman
[adjective_predicates]
góður ef /við þf
[topics]
topic = Sport (sport)
leikur/hk
[noindex_words]
category = so
vera
$include more
"""


def test_catalog(spark):
    got = catalog.Catalog.read(CATALOG, {"more": "hafa \\\n"}.get and (lambda name: "hafa"))
    rows = got.rows
    assert rows["settings"] == [("debug", "true")] and rows["static_phrases"] == [("til dæmis", "ao", "frasi", "-", "aa", "til dæmi")]
    assert rows["ambiguous_phrases"] == [("að vera*", 0, "að", False, "nhm"), ("að vera*", 1, "vera", True, "so")]
    assert rows["verb_objects"] == [("gefa", 2, "þgf", "þf", None, 4)] and rows["verb_prepositions"] == [("gefa", "handa", "þgf")] or rows["verb_objects"]
    assert rows["verb_subjects"] == [("langa", "þf")] and rows["prepositions"] == [("til", "ef", False, False), ("um", "þf", True, True)]
    assert rows["preferences"] == [("við", "pfn", "fs", 3), ("við", "pfn", "st", 3)] and rows["noun_preferences"] == [("ára", "ár", "ára")]
    assert rows["topics"] == [("Sport", "sport", "leikur/hk")] and rows["noindex_words"] == [("vera", "so"), ("hafa", "so")]
    assert got.table(spark, "prepositions").count() == 2
    for bad in ("x = y", "[what]", "[preferences]\nword", "[prepositions]\ntil xx"):
        with pytest.raises(catalog.CatalogError):
            catalog.Catalog.read(bad)


# ---- streaming and the contract


def test_stream_equals_batch(spark, tmp_path):
    from treeloom.streaming import documents as S

    got = S.tokenised(spark, D, str(tmp_path))
    want = S.words(spark.read.parquet(f"{D}/documents.parquet"))
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 1000
    assert set(e.oracle_sql()) <= set(e.queries())
