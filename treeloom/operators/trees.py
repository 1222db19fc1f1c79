"""Trees as node tables with interval codes, and what is asked of them.

A node is a row (tree, node_id, parent_id, pre, post, depth, sib_ix, kind, tag, terminal, text, lemma, cat, tok_ix):
d is below a exactly if a.pre < d.pre and d.post < a.post.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import features as X
from treeloom.operators import forest as R


def pseudo_trees(tokens: DataFrame, most: int | None = None) -> DataFrame:
    """A tree for each sentence, or each of at most `most` tokens, by fixed rules: S over NP and VP groups over tokens.

    A verb opens a VP group and any other word after a verb an NP group; punctuation hangs below S.
    """
    rows = tokens.where("kind <> 'P'")
    if most is not None:
        rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "sent_ix"))).where(F.col("n") <= most)
    by = Window.partitionBy("doc_id", "sent_ix").orderBy("tok_ix")
    group = F.when(F.col("kind") == "PUNCTUATION", "p").when(F.col("cat") == "so", "VP").when(F.col("cat") == "fs", "PP").otherwise("NP")
    rows = rows.withColumn("ix", F.row_number().over(by)).withColumn("grp", group)
    fresh = F.when(F.coalesce(F.lag("grp").over(by) == F.col("grp"), F.lit(False)) & (F.col("grp") != "p"), 0).otherwise(1)
    rows = rows.withColumn("g", F.sum(fresh).over(by))
    tree = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("sent_ix").cast("string")).alias("tree")
    none = F.lit(None).cast("string")
    root = rows.groupBy("doc_id", "sent_ix").agg(F.count("*").alias("n"), F.max("g").alias("gs")).select(tree, F.lit("S").alias("node"), none.alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(1).alias("sib_ix"), F.lit("S-MAIN").alias("tag"), none.alias("text"), none.alias("lemma"), none.alias("cat"), F.lit(None).cast("int").alias("tok_ix"))
    groups = rows.where("grp <> 'p'").groupBy("doc_id", "sent_ix", "g", "grp").agg(F.min("ix").alias("at")).select(tree, F.concat(F.lit("G"), "g").alias("node"), F.lit("S").alias("parent"), F.lit(1).alias("depth"), "at", F.col("g").cast("int").alias("sib_ix"), F.col("grp").alias("tag"), none.alias("text"), none.alias("lemma"), none.alias("cat"), F.lit(None).cast("int").alias("tok_ix"))
    inside = F.row_number().over(Window.partitionBy("doc_id", "sent_ix", "g").orderBy("tok_ix"))
    leaf = F.col("grp") != "p"
    leaves = rows.select(tree, F.concat(F.lit("T"), "ix").alias("node"), F.when(leaf, F.concat(F.lit("G"), "g")).otherwise("S").alias("parent"), F.when(leaf, 2).otherwise(1).alias("depth"), F.col("ix").alias("at"), F.when(leaf, inside).otherwise(F.col("g")).cast("int").alias("sib_ix"), F.when(leaf, F.coalesce(F.col("cat"), F.lit("x"))).otherwise("p").alias("tag"), F.col("txt").alias("text"), "lemma", "cat", "tok_ix")
    every = root.unionByName(groups).unionByName(leaves)
    pre = F.row_number().over(Window.partitionBy("tree").orderBy("at", "depth"))
    return every.withColumn("pre", pre).withColumn("post", F.col("pre")).drop("at").transform(_with_post)


def _with_post(nodes: DataFrame) -> DataFrame:
    """post: order in which nodes are left, from pre and depth (post = pre + number of nodes below - depth)."""
    # the next node that is not deeper ends the subtree; depth is at most two here. From the last node on, so that the
    # window only grows and long sentences take linear time
    rest = Window.partitionBy("tree").orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, -1)
    size = F.count("*").over(Window.partitionBy("tree"))
    nexts = [F.min(F.when(F.col("depth") <= d, F.col("pre"))).over(rest) for d in range(3)]
    end = F.when(F.col("depth") == 0, nexts[0]).when(F.col("depth") == 1, nexts[1]).otherwise(nexts[2])
    return nodes.withColumn("post", (F.coalesce(end, size + 1) - 1 - F.col("depth")).cast("int"))


# ---- joins


def children(nodes: DataFrame) -> DataFrame:
    """parent and child columns of each pair."""
    p = nodes.select("tree", F.col("node").alias("p_node"), F.col("tag").alias("p_tag"))
    return nodes.join(p, (nodes.tree == p.tree) & (nodes.parent == p.p_node)).select(nodes["*"], "p_node", "p_tag")


def descendants(nodes: DataFrame) -> DataFrame:
    """Pairs of an inner node a_* and each node below it; joined by tree, then by interval."""
    a = nodes.where("text IS NULL").select("tree", F.col("node").alias("a_node"), F.col("tag").alias("a_tag"), F.col("pre").alias("a_pre"), F.col("post").alias("a_post"), F.col("depth").alias("a_depth"))
    return nodes.join(a, "tree").where("a_pre < pre AND post < a_post")


def descendants_cut(nodes: DataFrame, cut: str) -> DataFrame:
    """Pairs as descendants(), without nodes of the tag `cut` and those below such a node that is itself below a."""
    below = descendants(nodes)
    walls = nodes.where(F.col("tag") == cut).select("tree", F.col("pre").alias("w_pre"), F.col("post").alias("w_post"))
    behind = (below.tree == walls.tree) & (walls.w_pre > below.a_pre) & (walls.w_post < below.a_post) & (walls.w_pre <= below.pre) & (walls.w_post >= below.post)
    return below.join(walls, behind, "left_anti")


def count_cut(source: DataFrame | R.Forests, tag: str, cut: str) -> DataFrame:
    """How many pairs descendants_cut() has for each node of the tag, level by level instead of pair by pair."""
    return R.forests(source).map(lambda f: R.visible_counts(f, tag, cut), "tree string, a_node string, n long")


def enclosing(nodes: DataFrame, tag: str) -> DataFrame:
    """Each node's nearest ancestor whose tag begins with `tag`."""
    found = descendants(nodes).where(X.match_tag(F.col("a_tag"), tag))
    return found.groupBy("tree", "node").agg(F.max_by("a_node", "a_depth").alias("enclosing"))


def nth_child(nodes: DataFrame, tag: str, n: int) -> DataFrame:
    """The n-th child with the tag, counted from one, of each parent that has as many."""
    own = nodes.where(X.match_tag(F.col("tag"), tag) & F.col("parent").isNotNull())
    return own.withColumn("_n", F.row_number().over(Window.partitionBy("tree", "parent").orderBy("sib_ix"))).where(F.col("_n") == n).drop("_n")


def top_matches(matches: DataFrame) -> DataFrame:
    """Of (tree, node, pre, post) those that are not inside another one."""
    o = matches.select("tree", F.col("pre").alias("o_pre"), F.col("post").alias("o_post"))
    return matches.join(o, (matches.tree == o.tree) & (o.o_pre < matches.pre) & (matches.post < o.o_post), "left_anti")


def first_match(matches: DataFrame) -> DataFrame:
    return matches.groupBy("tree").agg(F.min_by("node", "pre").alias("node"))


# ---- projections


def _ordered(what: Column, by: str = "pre") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(by), what.alias("x")))), lambda s: s["x"])


def texts(source: DataFrame | R.Forests) -> DataFrame:
    """text, lemma and token span of every inner node's subtree, of a node table or of forests."""
    return R.forests(source).map(R.texts, "tree string, a_node string, text string, lemma string, first int, last int")


def leaves_of(nodes: DataFrame, cat: str, what: str = "lemma") -> DataFrame:
    """Lemmas (or texts) of a category in each tree, in order."""
    return nodes.where(F.col("cat") == cat).groupBy("tree").agg(F.array_join(_ordered(F.col(what)), ",").alias(what + "s"))


def substituted(nodes: DataFrame, tag: str, by: str) -> DataFrame:
    """Each tree's text with the first subtree of the tag replaced by a string."""
    chosen = nodes.where(X.match_tag(F.col("tag"), tag)).groupBy("tree").agg(F.min_by(F.struct("pre", "post"), "pre").alias("s"))
    rows = nodes.where("text IS NOT NULL").join(chosen, "tree", "left")
    inside = F.coalesce((F.col("pre") >= F.col("s.pre")) & (F.col("post") <= F.col("s.post")), F.lit(False))
    kept = rows.where(~inside).select("tree", "pre", "text").union(chosen.select("tree", "s.pre", F.lit(by)))
    return kept.groupBy("tree").agg(F.array_join(_ordered(F.col("text")), " ").alias("text"))


# ---- renderers: opening and closing events in order


def _events(nodes: DataFrame, leaf: Column, opened: Column, closed: Column) -> DataFrame:
    """Events at (pre, 0) when a node opens and after its subtree, the deeper one first, when it closes."""
    last = F.col("post") + F.col("depth")  # the greatest pre inside the subtree
    at = F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("k"), F.when(F.col("text").isNotNull(), leaf).otherwise(opened).alias("x")), F.struct(last.alias("at"), (F.lit(1 << 30) - F.col("depth")).alias("k"), F.when(F.col("text").isNull(), closed).alias("x")))
    return nodes.select("tree", F.explode(at).alias("e")).where("e.x IS NOT NULL")


def _rendered(events: DataFrame, sep: str, name: str) -> DataFrame:
    return events.groupBy("tree").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]), sep).alias(name))


def flat(nodes: DataFrame) -> DataFrame:
    """TAG ... /TAG with terminals inside."""
    return _rendered(_events(nodes, F.col("tag"), F.col("tag"), F.concat(F.lit("/"), "tag")), " ", "flat")


def bracket(nodes: DataFrame) -> DataFrame:
    """(TAG (cat text) ...) with blanks in texts as underscores."""
    leaf = F.concat(F.lit("("), F.when(F.col("tag") == "p", "PUNCT").otherwise(F.col("tag")), F.lit(" "), F.translate("text", " ()", "___"), F.lit(")"))
    return _rendered(_events(nodes, leaf, F.concat(F.lit("("), "tag"), F.lit(")")), " ", "bracket")


def view(nodes: DataFrame) -> DataFrame:
    """A line for each node, indented by its depth."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(F.col("text").isNull(), F.col("tag")).otherwise(F.concat("tag", F.lit(": '"), "text", F.lit("'"))))
    return nodes.groupBy("tree").agg(F.array_join(_ordered(line), "\n").alias("view"))


def to_json(nodes: DataFrame) -> DataFrame:
    """One JSON text for each tree: its nodes in order."""
    fields = [c for c in ("node", "parent", "pre", "post", "depth", "sib_ix", "tag", "text", "lemma", "cat", "tok_ix") if c in nodes.columns]
    return nodes.groupBy("tree").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pre", F.struct(*fields).alias("n"))))).alias("json"))


def from_json(trees: DataFrame) -> DataFrame:
    n = "node STRING, parent STRING, pre INT, post INT, depth INT, sib_ix INT, tag STRING, text STRING, lemma STRING, cat STRING, tok_ix INT"
    rows = trees.select("tree", F.explode(F.from_json("json", f"array<struct<pre: int, n: struct<{n.replace(' STRING', ': string').replace(' INT', ': int')}>>>")).alias("x"))
    return rows.select("tree", "x.n.*")
