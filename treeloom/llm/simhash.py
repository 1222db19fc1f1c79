"""SimHash near-duplicates over deletion-variant signatures.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values have it. Two fingerprints link at
three or fewer differing bits. The 64 bits are cut into two segments, so that one of them differs by at most one bit;
each segment is indexed with one bit wiped out, for each of its bits, and an equality join on (segment, wiped bit,
rest) brings together every pair that can link. Members of a bucket are verified together, and only edges of a
spanning forest leave it. Buckets above BUCKET members are cut finer first: of the other segment's four parts one must
agree, and so on for the parts that remain, which bounds a bucket by its free bits whatever the input. Copies share a
fingerprint and are linked once.

similar_groups() serves the pipeline: five-word shingles, linked from a Jaccard similarity of 0.8 on. Three bits reach
similarities of about 0.95, so bands of min-hashes propose more pairs; see there. Its fingerprints and min-hashes share
one hash of each distinct shingle.

Defined results: a text without words (null, empty) has fingerprint zero and links like any other; a text of fewer
words than a shingle is one shingle; null doc_ids never become a component's id while another is there; repeated
doc_ids are rows of their own; an empty table gives an empty result; other columns are ignored, or carried along where
documents are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import HOT_ROWS, arrow, joined, keep, read, small
from treeloom.llm.components import components

BITS = 3
WORDS = 3
SEED = 42
#: Members up to which a bucket is verified as it is.
BUCKET = 4_096
#: Fingerprints that a task turns into signatures, 64 each.
EXPLODED = 4_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as an unsigned number."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone splits
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(tokens))
    digest, view = xxhash.xxh64_intdigest, memoryview(line)
    return majority(np.array([digest(view[a:b], SEED) for a, b in zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow(docs.select("doc_id", "text"), lambda b: _fingerprints(b, words), f"doc_id {kind}, fp long")


def forest(members: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints, found by breadth-first search.

    Each member is compared once, with those not reached yet, so a dense bucket takes time in proportion to its size.
    """
    left = np.unique(members.view(np.uint64))
    edges = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= bits
            reached = left[near]
            if len(reached):
                edges += [(int(at.view(np.int64)), int(x)) for x in reached.view(np.int64)]
                queue += list(reached)
                left = left[~near]
    return edges


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        edges = [e for members in batch.column("members") for e in forest(members.values.to_numpy())]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], ["a", "b"])


def _edges(rows: DataFrame) -> DataFrame:
    """Edges within the buckets of (key, fp)."""
    buckets = rows.groupBy("key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1).select("members")
    return arrow(buckets, _forests, "a long, b long")


def _segments():
    fp = F.col("fp")
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit((1 << 32) - 1))


def _parts(bits: list[int], depth: int) -> list[list[int]]:
    """Each way to pick one of four parts of the bits, `depth` times over from those that remain: the bits picked."""
    if not depth:
        return [[]]
    out = []
    for k in range(4):
        own = bits[k * len(bits) // 4 : (k + 1) * len(bits) // 4]
        out += [own + more for more in _parts([b for b in bits if b not in own], depth - 1)]
    return out


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints linked by chains of at most BITS differing bits."""
    fps = fps.repartition(1 + fps.count() // EXPLODED)  # a row becomes 64: tasks by what comes out of them
    high, low = _segments()
    wiped = lambda s, part, b: F.lit((s << 5) + b).cast("long") * (1 << 32) + part.bitwiseAND(F.lit(((1 << 32) - 1) ^ (1 << b)))
    keys = F.array(*[wiped(s, part, b) for s, part in ((0, high), (1, low)) for b in range(32)])
    rows = fps.select("fp", F.explode(keys).alias("key"))
    # A bucket holds the members of two segment values that differ in the wiped bit, so one of them has over half.
    values = fps.select(F.explode(F.array(F.struct(F.lit(0).alias("s"), high.alias("v")), F.struct(F.lit(1).alias("s"), low.alias("v")))).alias("x")).groupBy("x.s", "x.v").count()
    hot = keep(values.where(F.col("count") > bucket // 2), "hot-segments")
    if hot.isEmpty():
        return keep(_edges(rows), "links")
    hot_keys = hot.select(F.explode(F.array(*[F.col("s").cast("long") * (1 << 37) + F.lit(b << 32).cast("long") + F.col("v").bitwiseAND(F.lit(((1 << 32) - 1) ^ (1 << b))) for b in range(32)])).alias("key")).distinct()
    hot_keys = small(keep(hot_keys, "hot-keys"))
    found = _edges(rows.join(hot_keys, "key", "left_anti"))
    level = rows.join(hot_keys, "key", "left_semi").select("fp", F.col("key").alias("base"), F.lit(0).alias("way"), "key")
    for depth in range(4):
        level = keep(level, "hot-rows")
        over = level.groupBy("key").count().where(F.col("count") > bucket).select("key")
        over = keep(over, "hot-over") if depth < 3 else None  # at depth 3, 13 free bits and the wiped one bound a bucket
        if over is None or over.isEmpty():
            found = found.union(_edges(level))
            break
        over = small(over)
        found = found.union(_edges(level.join(over, "key", "left_anti")))
        other = F.when(F.shiftrightunsigned(F.col("base"), 37) == 0, low).otherwise(high)
        masks = [sum(1 << b for b in picked) for picked in _parts(list(range(32)), depth + 1)]
        ways = F.array(*[F.struct(F.lit(w).alias("way"), F.lit(m).cast("long").alias("mask")) for w, m in enumerate(masks)])
        finer = level.join(over, "key", "left_semi").withColumn("w", F.explode(F.filter(ways, lambda x: F.floor(x["way"] / 4) == F.col("way")) if depth else ways))
        level = finer.select("fp", "base", F.col("w.way").alias("way"), F.xxhash64("base", "w.way", other.bitwiseAND(F.col("w.mask"))).alias("key"))
    return keep(found, "links")


def groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""
    made = keep(fingerprints(docs, words), "fingerprints")
    fps = keep(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fps")
    of_fp = _heads(fps, components(links(fps.select("fp"))), "fp", F.col("least"))
    return joined(made, of_fp.withColumnRenamed("head", "component_id"), "fp", fps.where(F.col("n") >= HOT_ROWS).select("fp", "n"))


def _heads(items: DataFrame, linked: DataFrame, key: str, least: Column) -> DataFrame:
    """(key, head) of all items: the least value among all items of the same root."""
    rooted = keep(items.join(linked, items[key] == linked["node"]).select(key, least.alias("least"), "root"), "rooted")
    heads = keep(rooted.groupBy("root").agg(F.min("least").alias("head")), "heads")  # components of two items at least
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_ROWS)
    of_linked = joined(rooted.select(key, "root"), heads, "root", sizes).select(F.col(key).alias("_key"), "head")
    return items.join(of_linked, items[key] == F.col("_key"), "left").select(key, F.coalesce("head", least).alias("head"))


# ---- texts alike by their shingles

#: Bands of a text, each of DEEP min-hashes. At a similarity of 0.8 a pair shares a band with a chance of
#: 1 - (1 - 0.8^5)^16 = 0.998.
BANDS, DEEP = 16, 5
#: Shingle hashes of a block of a bucket; a task holds two blocks at once.
BLOCK_HASHES = 4_000_000
#: Members of buckets that a task compares, about.
DEALT = 2_000
_RANDOM = np.random.RandomState(77)
_FACTORS = _RANDOM.randint(0, 1 << 31, BANDS * DEEP).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.randint(0, 1 << 31, BANDS * DEEP).astype(np.uint32)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; a text of fewer words is one shingle."""
    tokens = (text or "").encode().lower().split()
    k = min(words, max(1, len(tokens)))
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens], dtype=np.int64) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, view = xxhash.xxh3_64_intdigest, memoryview(line)
    return np.unique(np.array([digest(view[a:b]) for a, b in zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist())] or [0], dtype=np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A hash for each band of a text's distinct shingles."""
    own = hashes.astype(np.uint32)
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(own), 1024):
        mixed = own[at : at + 1024, None] * _FACTORS
        mixed ^= mixed >> np.uint32(15)
        least = np.minimum(least, (mixed * np.uint32(0x846CA68B) + _SHIFTS).min(0))
    return [xxhash.xxh3_64_intdigest(least[b * DEEP : (b + 1) * DEEP].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def _banded(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        made = {t: (majority(own), bands(own), len(own)) for t in set(texts) for own in [shingles(t, words)]}
        rows = [made[t] for t in texts]
        fps = pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("id"), fps, pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.int64())], ["doc_id", "id", "fp", "bands", "size"])


def _shingled(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t, words).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for a, b in zip(batch.column("sa"), batch.column("sb")):
            a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
            both = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= similarity * max(len(a), len(b)) else 0
            good.append(both >= similarity * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def alike(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the members whose shingle sets have the similarity, found by breadth-first search.

    Members of one root are connected already and need no edge. Each member is compared once, with those not reached
    yet: a dense bucket takes time in proportion to its shingles, one without any link that times its members.
    """
    m, sizes = len(ids), np.array([len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    column, owner = column[shared], np.repeat(np.arange(m), sizes)[shared]
    own = np.split(column, np.searchsorted(owner, np.arange(1, m)))
    marked, left, edges = np.zeros(len(often), bool), np.ones(m, bool), []
    for start in range(m):
        queue = [start] if left[start] else []
        left[start] = False
        while queue and left.any():
            at = queue.pop()
            marked[own[at]] = True
            both = np.bincount(owner[marked[column]], minlength=m)
            marked[own[at]] = False
            same = left & (roots == roots[at])
            near = left & ~same & (both >= similarity * (sizes + sizes[at] - both))
            edges += [(int(max(ids[at], x)), int(min(ids[at], x))) for x in ids[near]]
            if near.any() or same.any():
                queue += np.flatnonzero(near | same).tolist()
                left &= ~(near | same)
                still = left[owner]
                column, owner = column[still], owner[still]
    return edges


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "id", "root", "shingles")))


def _compared(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Edges of the buckets, whose rows come one after the other; one bucket is held at a time."""
    found = []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])
    for _, rows in groupby(_members(batches), itemgetter(0, 1, 2)):
        ids, roots, sets = zip(*(r[3:] for r in rows))
        if len(ids) > 1:
            found += alike(np.array(ids, np.int64), np.array(roots, np.int64), [np.frombuffer(s, np.uint64) for s in sets], similarity)
        if len(found) > 10_000:
            yield pack()
            found = []
    if found:
        yield pack()


def _compare(crowded: DataFrame, sets: DataFrame, similarity: float, meet: bool) -> DataFrame:
    """Verified edges (a, b) from the buckets (key, id, root, blocks, head).

    A bucket of more than one block is cut by a hash. At first its least member is in every block, which connects a
    group of copies in one pass; with `meet`, each pair of blocks is a bucket, so that every two members meet.
    """
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    if meet:
        places = F.transform(F.filter(every, lambda i: i != own), lambda i: F.struct(F.least(i, own).alias("i"), F.greatest(i, own).alias("j")))
    else:
        places = F.when(F.col("id") == F.col("head"), F.transform(every, lambda i: F.struct(i.alias("i"), i.alias("j")))).otherwise(F.array(F.struct(own.alias("i"), own.alias("j"))))
    rows = crowded.select("key", "id", "root", F.explode(places).alias("place")).select("key", "place.i", "place.j", "id", "root").join(sets, "id")
    rows = rows.repartition(1 + crowded.count() // DEALT, "key", "i", "j").sortWithinPartitions("key", "i", "j")  # few rows may be much work
    return arrow(rows, lambda b: _compared(b, similarity), "a long, b long")


def _similar_links(texts: DataFrame, docs: DataFrame, near: DataFrame, words: int, similarity: float, block: int) -> DataFrame:
    """(node, root) of the texts that verified pairs connect; see similar_groups()."""
    banded = texts.select("id", "size", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("id").alias("head"), F.bit_xor(F.xxhash64("id")).alias("members")).where("n > 1")
    # copies share most of their bands: of buckets with the same members one is enough
    buckets = buckets.groupBy("n", "size", "head", "members").agg(F.min("key").alias("key"))
    blocks = F.least("n", F.greatest(F.ceil(F.col("n") / F.lit(block)), F.ceil(F.col("size") / F.lit(BLOCK_HASHES)))).cast("int")
    crowded = keep(banded.select("key", "id").join(buckets.select("key", "head", blocks.alias("blocks")), "key"), "crowded")
    sets = keep(_sets(crowded.select("id").union(near.select("a")).union(near.select("b")).distinct(), texts, docs, words), "shingles")
    found = _compare(crowded.withColumn("root", F.col("id")), sets, similarity, False)
    pairs = keep(found.union(_verify(near.where("a <> b").distinct(), sets, similarity)), "pairs")
    roots = keep(components(pairs), "roots")
    cut = crowded.where("blocks > 1")
    if cut.isEmpty():
        return roots
    # buckets whose blocks have not all been connected by their least member
    cut = keep(cut.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "cut")
    apart = small(cut.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"))
    more = keep(_compare(cut.join(apart, "key", "left_semi"), sets, similarity, True), "pairs")
    return roots if more.isEmpty() else keep(components(more.union(roots)), "roots")


def _sets(ends: DataFrame, texts: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the texts `ends`. Only these are split again, one row of each."""
    ends = keep(texts.join(ends, "id").select(F.col("id").alias("_i"), F.col("least.doc_id").alias("_d")), "ends")
    bodies = docs.select(F.col("doc_id").alias("_doc"), text_id(F.col("text")).alias("id"), "text")
    bodies = bodies.join(small(ends), (F.col("id") == F.col("_i")) & F.col("_doc").eqNullSafe(F.col("_d")), "left_semi")
    sets = arrow(bodies.select("id", "text"), lambda b: _shingled(b, words), "id long, shingles binary")
    return sets.groupBy("id").agg(F.first("shingles").alias("shingles"))


def _verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity."""
    for end, name in (("a", "sa"), ("b", "sb")):
        often = pairs.groupBy(end).agg(F.count("*").alias("n")).where(F.col("n") >= HOT_ROWS)
        pairs = joined(pairs, sets.select(F.col("id").alias(end), F.col("shingles").alias(name)), end, often)
    return arrow(pairs.select("a", "b", "sa", "sb"), lambda b: _verified(b, similarity), "a long, b long")


def text_id(text: Column) -> Column:
    """Equal texts have equal ids; null counts as the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, block: int = BUCKET // 2) -> DataFrame:
    """(doc_id, id, component_id, head) of every row; head is the struct (none, doc_id, id) of the row that stands for it.

    Texts are linked from a Jaccard similarity of their shingle sets on, each link verified by the sets themselves.
    Pairs are proposed by the deletion-variant signatures (three bits of SimHash) and by bands of min-hashes. The
    members of a band's bucket are compared by their shingle sets, so no pair that shares a band is lost; only the
    edges of a spanning forest leave a bucket. A bucket of more than `block` members or BLOCK_HASHES shingles is cut
    into blocks: each with the least member first, every two of them together where that leaves texts unconnected.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_id(F.col("text")).alias("id"), "text")
    rows = keep(arrow(rows, lambda b: _banded(b, words), f"doc_id {kind}, id long, fp long, bands array<long>, size long"), "banded")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")
    texts = keep(rows.groupBy("id").agg(F.min(own).alias("least"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("fp", "bands", "size"))), "texts")
    of_fp = keep(texts.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct-fps")
    near = links(of_fp.select("fp"))
    first, second = of_fp.select(F.col("fp").alias("a"), F.col("id").alias("ia")), of_fp.select(F.col("fp").alias("b"), F.col("id").alias("ib"))
    near = near.join(first, "a").join(second, "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    same = joined(texts.select("id", "fp"), of_fp.select("fp", F.col("id").alias("head")), "fp", of_fp.where(F.col("n") >= HOT_ROWS).select("fp", "n")).where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    near = keep(near.union(same).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "near")
    roots = _similar_links(texts, docs, near, words, similarity, block)
    of_text = _heads(texts.select("id", "least"), roots, "id", F.col("least"))
    out = joined(rows.select("doc_id", "id"), of_text, "id", texts.where(F.col("n") >= HOT_ROWS).select("id", "n"))
    return out.select("doc_id", "id", F.col("head.doc_id").alias("component_id"), "head")


def representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group: the one with the least doc_id (null last, then the text's hash decides)."""
    found = keep(similar_groups(docs, words, similarity), "groups")
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("id") == F.col("head.id"))
    gone = keep(found.where(~is_head).select(F.col("doc_id").alias("_d"), F.col("id").alias("_i")).distinct(), "gone")
    again = keep(found.where(is_head).groupBy(F.col("doc_id").alias("_d"), F.col("id").alias("_i")).count().where("count > 1").select("_d", "_i"), "again")
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_doc"), text_id(F.col("text")).alias("_text"))
    same = F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_i"))
    left = row.join(small(gone), same, "left_anti")
    if again.isEmpty():
        return left.select("row.*")
    once = left.join(small(again), same, "left_semi").groupBy("_doc", "_text").agg(F.first("row").alias("row"))
    return left.join(small(again), same, "left_anti").select("row.*").unionByName(once.select("row.*"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    got = groups(read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLE: dict[str, str] = {}
