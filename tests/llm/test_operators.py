"""Each corpus operator against a brute-force version, and on nulls, empty texts, ties, repeats and empty tables."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from treeloom.llm import chat, components, decontaminate, hosts, mixing, pii, quality, sharding, simhash, tokens, toxicity

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one two three four five six", "en", "b", 27),
    (4, "one two three four five six", "en", "b", 27), (5, "One two three FOUR five six", "en", "b", 27), (6, "word " * 30_000, "en", "c", 150_000), (7, "é" * 20, "fr", "c", 20),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("shard", F.lit("x")).withColumn("size", F.lit("y")).withColumn("n_tokens", F.lit(1))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().lower().split()


# ---- mixing


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit >= 2 * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mixing_targets_and_copies(spark):
    random.seed(4)
    rows = [(i, " ".join(["w"] * random.randint(0, 40)), "en", random.choice(["a", "b", "é", "Z", None]), 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    sizes = mixing.keep(mixing.sizes_of(docs))
    got = mixing.copies(sizes, mixing.plan(sizes)).collect()
    total = Counter()
    for r in rows:
        total[r[3]] += len(r[1].split())
    want = targets_by_hand(total)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == total[r.source]
        assert r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1) and r.copies <= 2
        taken[r.source] += r["size"] * r.copies
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.02)
    assert mixing.mix(docs).count() == sum(r.copies for r in got)


def test_mixing_odd_rows(odd, none):
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.where("text is null").count() == 0
    assert mixing.mix(none).count() == 0


# ---- sharding


def test_sharding_law_and_slots(spark, odd, none):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for size in (sharding.BUCKET_BYTES, 3_000):  # one bucket a shard, and many
        rows = sharding.shards(docs, bucket_bytes=size).select("row.doc_id", "shard", "slot").collect()
        assert len(rows) == docs.count()
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(40))
        again = {(r.doc_id, r.shard, r.slot) for r in sharding.shards(docs.repartition(7), bucket_bytes=size).select("row.doc_id", "shard", "slot").collect()}
        assert again == {tuple(r) for r in rows}
    grown = docs.select(sharding.shard_of(F.col("doc_id"), 40).alias("a"), sharding.shard_of(F.col("doc_id"), 41).alias("b"))
    assert grown.where("a <> b and b <> 40").count() == 0 and grown.where("b = 40").count() > 0
    got = sharding.shards(odd).select("row.*", F.col("shard").alias("s"), F.col("slot").alias("k")).collect()
    assert len(got) == len(ODD) and len({(r.s, r.k) for r in got}) == len(ODD)
    assert sharding.shards(none).count() == 0
    hot = spark.range(900).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    slots = {(r.shard, r.slot): r.doc_id for r in sharding.shards(hot, bucket_bytes=500).select("row.doc_id", "shard", "slot").collect()}
    assert len(slots) == 900 and Counter(slots.values())[-1] == 300  # a key of a third of all rows, over many buckets


def test_sharding_write(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    sharding.write(docs, str(tmp_path / "out"), n=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("_shard").distinct().count() == 5


# ---- hosts


def test_hosts_rules_and_parts(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/x?q#f", "https://x.net", "http://net/", "http://sub.example.com/de/1", "ftp://a.org/fr/1", "http://a.org/frx", "http://h.example.net?x/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in hosts.judge(pages, labels).collect()}
    assert [(got[i].host, got[i].path) for i in range(4)] == [("", ""), ("", ""), ("a.example.net", "/en/x"), ("x.net", "")]
    assert [got[i].rule for i in range(9)] == [None, None, "example.net/en/", None, "net/", "example.com/de/", "org/fr/", None, None]
    assert [got[i].verdict for i in range(9)] == ["allow", "allow", "allow", "allow", "block", "block", "allow", "allow", "allow"]


def test_hosts_shrinkage(spark):
    """A host with many bad pages is blocked; one with a single bad page of a good domain is not."""
    pages = [(i, f"http://bad.site.io/{i}") for i in range(60)] + [(100, "http://new.fine.io/1")] + [(200 + i, f"http://www.fine.io/{i}") for i in range(300)]
    labels = [(i, 0, 0) for i in range(60)] + [(100, 0, 0)] + [(200 + i, 1, 0) for i in range(300)]
    got = {r.host: r.verdict for r in hosts.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == {"bad.site.io": "block", "new.fine.io": "allow", "www.fine.io": "allow"}
    empty = spark.createDataFrame([], "page_id long, url string")
    assert hosts.judge(empty, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


# ---- tokens


def test_tokens_round_trip(spark, odd, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "Straße's <|endoftext|>x ÀÉ, ½ Ǆ 12a. \x1cb"), (None, "x")], "doc_id long, text string"))
    tokens.write_tokens(docs, str(tmp_path / "a"), path)
    got = tokens.read_tokens(spark, str(tmp_path / "a")).collect()
    start = 0
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = {r.doc_id: r for r in got}
    for r in rows:
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (got[r.doc_id].ids, got[r.doc_id].start, got[r.doc_id].n_tokens) == (ids, start, len(ids))
        start += len(ids)
    tokens.write_tokens(odd, str(tmp_path / "b"), path)
    assert tokens.read_tokens(spark, str(tmp_path / "b")).count() == len(ODD)
    tokens.write_tokens(none, str(tmp_path / "c"), path)
    assert tokens.read_tokens(spark, str(tmp_path / "c")).count() == 0


def test_tokens_scan_reads_no_ids_for_metadata(spark, tmp_path):
    import public_tokenizers

    tokens.write_tokens(spark.read.parquet(f"{D}/documents.parquet"), str(tmp_path / "a"), public_tokenizers.path("word_bpe_49k.json"))
    plan = spark.read.parquet(str(tmp_path / "a")).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]


def token_texts(seed, n=400):
    """Random texts of letters, marks, apostrophes, digits, combining marks, other scripts and white space."""
    r = random.Random(seed)
    pieces = [*"abzABZéÉßÀÞþ×÷'!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~019½ \t\n\x0b\x1c ̸́ſKİıΣςǅЖ日🙂ﬁ", "the", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "Don't", "und&&&", "x<|", "..."]
    return ["".join(r.choice(pieces) for _ in range(r.randrange(40))) for _ in range(n)] + [None, ""]


@pytest.mark.parametrize("known", [32 << 20, 2_000])
def test_tokens_encoder_equals_the_plain_tokenizer_over_batches(known, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "KNOWN_BYTES", known, raising=False)
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encoder = Tokenizer.from_file(path), tokens.Encoder(path)
    for seed in range(6):
        texts = token_texts(seed)
        values, offsets = encoder(pa.array(texts, pa.string()))
        for text, a, b in zip(texts, offsets, offsets[1:]):
            assert values[a:b].tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_tokens_encoder_asks_the_library_once_for_a_word(monkeypatch):
    import public_tokenizers

    encoder, asked = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    ids = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda tokenizer, texts: asked.extend(w for t in texts for w in t.split()) or ids(tokenizer, texts))
    encoder(pa.array(["Und und&&& und, don't &&&", "die und"]))
    assert sorted(asked) == ["&&&", ",", "die", "don't", "und"]
    encoder(pa.array(["Die UND, die&&&, don't", None]))
    assert asked[5:] == ["&&&,"]


def test_tokens_encoder_takes_no_threads_of_its_own(monkeypatch):
    import public_tokenizers

    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


# ---- toxicity


def distance(a, b):
    """Edits with adjacent swaps, by the full table."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_against_full_tables():
    random.seed(2)
    terms = [(w, False) for w in ("abcab", "scum", "worthless", "babab", "abcabcab")] + [("lowei", True)]
    m = toxicity.Matcher(terms)
    for _ in range(3000):
        t = list(random.choice(terms)[0])
        for _ in range(random.randint(0, 3)):
            k = random.randrange(len(t) + 1)
            t[k : k + random.randint(0, 1)] = random.choice(["", "a", "b", "z"])
            if len(t) > 2 and random.random() < 0.3:
                t[1], t[2] = t[2], t[1]
        token = "".join(t)
        want = {}
        for k, (w, stem) in enumerate(terms):
            least = min(distance(token[:n], w) for n in range(len(token) + 1)) if stem else distance(token, w)
            if least <= toxicity.edits_for(len(w)):
                want[k] = least
        assert m.match(token) == want, token


def test_toxicity_learns_and_generalises(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("_score", "toxic").collect()
    right = sum((r._score >= 0.5) == (r.toxic == 1) for r in got)
    assert right / len(got) > 0.95
    bent = [t[0][:2] + "0" + t[0][3:] for t, w in zip(model.terms, model.fuzzy) if w >= 3 and len(t[0]) >= 5 and not t[1]]
    assert len(bent) >= 3 and model.score("you " + " and ".join(bent[:3])) > 0.5 > model.score("the quick brown fox")
    assert model.score("he said “you idiot” to me") <= model.score("he said you idiot to me")


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (6, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r._score <= 1 for r in rows)
    assert toxicity.clean(none, model).count() == 0
    assert toxicity.train(none, labels.limit(0)).score("x") < 0.5


def test_held_out(spark):
    rows = spark.range(200).withColumn("h", toxicity.held_out(F.col("id"))).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


# ---- decontamination


def edit_end(p, t):
    """Least edits of p against any stretch of t."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_decontamination_against_full_tables():
    random.seed(8)
    letters = "abcdefgh  "
    items = [(i, "".join(random.choice(letters) for _ in range(random.randint(5, 90)))) for i in range(12)]
    own = decontaminate.Items(items)
    for _ in range(150):
        body = list(random.choice(items)[1])
        for _ in range(random.randint(0, 9)):
            k = random.randrange(len(body))
            body[k : k + 1] = random.choice(["", "x", "ab"])
            body = body or ["a"]
        text = "".join(random.choice(letters) for _ in range(40)) + " " + "".join(body) + " " + "".join(random.choice(letters) for _ in range(40))
        found = {i: d for i, d, _, _ in own.leaks(text)}
        for i, item in items:
            form = decontaminate.normal(item)
            least = edit_end(form, decontaminate.normal(text))
            if not form:
                assert i not in found
            elif least <= decontaminate.budget(len(form)):
                assert i in found and least <= found[i] <= decontaminate.budget(len(form))
            else:
                assert i not in found


def test_decontamination_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "One, two: three four; five six!"), (2, None), (3, ""), (1, "One, two: three four; five six!")], "item_id long, text string")
    got = decontaminate.leaks(odd, items).collect()
    assert sorted(r.doc_id for r in got if r._leaks) == [4, 4, 5] and len(got) == len(ODD)
    assert decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.clean(none, items).count() == 0 and decontaminate.leaks(odd, items.limit(0)).where("size(_leaks) > 0").count() == 0
    whole = {r.doc_id for r in decontaminate.leaks(odd, items).where("size(_leaks) > 0").collect()}
    old, decontaminate.blocks.__defaults__ = decontaminate.blocks.__defaults__, (1,)
    try:
        assert {r.doc_id for r in decontaminate.leaks(odd, items).where("size(_leaks) > 0").collect()} == whole
    finally:
        decontaminate.blocks.__defaults__ = old


# ---- SimHash


def fingerprint_by_hand(text, k=3):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_by_hand(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def same_parts(a, b):
    turn = lambda d: {frozenset(k for k in d if d[k] == v) for v in d.values()}
    return turn(a) == turn(b)


def jaccard(a, b, k=5):
    own = lambda t: {tuple(w[i : i + k]) for w in [words(t)] for i in range(max(1, len(w) - k + 1))}
    x, y = own(a), own(b)
    return len(x & y) / len(x | y)


def alike_by_hand(texts, similarity=0.8):
    """Component of each distinct text, all pairs compared."""
    parent = {t: t for t in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if jaccard(a, b) >= similarity:
                parent[find(b)] = find(a)
    return {t: find(t) for t in texts}


@pytest.mark.parametrize("block", [2048, 16])
def test_similar_groups_of_crowded_buckets(spark, block):
    """A passage that most texts share, families at 0.75 to 0.95, and no family lost or joined with another one."""
    random.seed(block)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(14):
        base = passage + [f"w{random.randrange(10**6)}" for _ in range(60)]
        for _ in range(6):
            own = list(base)
            for at in random.sample(range(60, 120), random.randint(0, 4)):
                own[at] = f"x{random.randrange(10**6)}"
            texts.append(" ".join(own))
    texts = sorted(set(texts))
    want = alike_by_hand(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {texts[r.doc_id]: r.component_id for r in simhash.similar_groups(docs, block=block).collect()}
    assert same_parts(got, want)


def test_alike_against_all_pairs():
    """The links of a bucket connect what all its pairs connect, and no more."""
    random.seed(4)
    for _ in range(60):
        m = random.randint(2, 30)
        base = [random.getrandbits(64) for _ in range(30)]
        sets = [np.unique(np.array(random.sample(base, random.randint(24, 30)) + [random.getrandbits(64) for _ in range(random.randint(0, 3))], dtype=np.uint64)) for _ in range(m)]
        ids = np.arange(m) * 7 - 50
        roots = np.array([random.choice(ids[: i + 1]) if random.random() < 0.2 else ids[i] for i in range(m)])

        def parts(edges):
            of = {int(i): int(i) for i in ids}
            for a, b in edges:
                x, y = of[int(a)], of[int(b)]
                of = {k: x if v == y else v for k, v in of.items()}
            return of

        pairs = [(i, j) for i in range(m) for j in range(i)]
        known = [(ids[i], ids[j]) for i, j in pairs if roots[i] == roots[j]]
        close = [(ids[i], ids[j]) for i, j in pairs if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        got = simhash.alike(ids, roots, sets, 0.8)
        assert same_parts(parts(known + got), parts(known + close)) and len(got) < m


def test_representatives_go_by_row(spark):
    """Repeated and null ids lose no text: one row of each group stays, whatever its id."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(3, b), (7, a), (7, b), (None, b), (None, None), (5, a), (5, a)]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_d", F.lit(1)).withColumn("row", F.lit(2)))
    assert got.columns == ["doc_id", "text", "_d", "row"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, b), (5, a), (None, None)], key=str)


def test_simhash_groups(spark, odd, none):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    rows = docs.collect()
    fps = {r.doc_id: fingerprint_by_hand(r.text) for r in rows}
    roots = roots_by_hand(sorted(set(fps.values())))
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(least.get(roots[f], i), i)
    got = simhash.groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fp % 2**64 == fps[r.doc_id] and r.component_id == least[roots[fps[r.doc_id]]]
    assert simhash.groups(none).count() == 0


@pytest.mark.parametrize("bucket", [4096, 32, 8])
def test_simhash_hot_buckets_lose_no_link(spark, bucket):
    random.seed(bucket)
    base = [random.getrandbits(64) for _ in range(3)]
    fps = {random.getrandbits(64) for _ in range(30)} | {b ^ sum(1 << x for x in random.sample(range(64), random.randint(0, 5))) for b in base for _ in range(150)}
    signed = [int(np.uint64(f).view(np.int64)) for f in sorted(fps)]
    want = roots_by_hand(sorted(fps))
    linked = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket)).collect()}
    got = {f: linked.get(s, s) for f, s in zip(sorted(fps), signed)}
    assert same_parts(got, want)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 502)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 502: 500}
    assert components.components(edges.limit(0)).count() == 0


def test_similar_texts_stay_once(spark, odd, none):
    random.seed(1)
    text = [f"w{random.randrange(10**6)}" for _ in range(300)]
    other = [f"w{random.randrange(10**6)}" for _ in range(300)]
    near = list(text)
    near[100] = "changed"
    near[200] = "too"
    rows = [(10, " ".join(text)), (11, " ".join(near)), (12, " ".join(other)), (10, " ".join(text)), (13, " ".join(text))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    kept = sorted((r.doc_id for r in simhash.representatives(docs).collect()), key=str)
    assert kept == sorted([1, 10, 12, 4, 6, 7], key=str)  # texts without words are alike, and so are two cases of one text
    assert simhash.representatives(none).count() == 0


# ---- quality


def repeated_by_hand(w):
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    return len({i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)})


def test_quality_base(spark):
    random.seed(3)
    for _ in range(300):
        w = [random.choice("abc") for _ in range(random.randint(0, 40))]
        assert quality.repeated([x.encode() for x in w]) == repeated_by_hand(w)
    assert quality.base("a b\na b\n\n \t\n#*$ é|\na b") == (8, 11, 4, 2, 0)
    assert quality.base(None) == (0, 0, 0, 0, 0)


def test_grams_are_all_counted():
    random.seed(6)
    text = "".join(random.choice("abcdé ") for _ in range(5000)) + "".join(chr(0x4E00 + random.randrange(9000)) for _ in range(20_000))
    want = Counter(text[i : i + 5] for i in range(len(text) - 4))
    assert quality.grams(text) == want
    old, quality.CHUNK = quality.CHUNK, 700
    try:
        assert quality.grams(text) == want
    finally:
        quality.CHUNK = old


def test_model_is_a_distribution(spark, none):
    """After any context the probabilities of all characters, with the unseen one, sum to one."""
    docs = spark.createDataFrame([(i, "abracadabra banana bandana cabana " * 3 + "abc" * i, "x") for i in range(20)], "doc_id long, text string, lang string")
    model = quality.tables(quality.count(docs))
    letters = sorted(set("abrcdn "))
    for context in ("\x02\x02\x02\x02", "abra", "bana", "zzzz", "ana "):
        total = sum(float(np.exp(model.logs("x", quality._codes(context + c))[0])) for c in letters)
        assert 0.9 < total < 1.01, context
    good, bad = model.score("x", "banana cabana"), model.score("x", "qzxw vkjq")
    assert good < bad and model.score("x", "") is None and model.score("y", "abc") is None
    assert quality.tables(quality.count(none)).tables == {}


def test_quality_odd_rows(odd, none):
    got = {r.doc_id: r for r in quality.judge(odd).collect()}
    assert not got[1].kept and got[1].base_failed and got[6].n_words == 30_000 and got[6].base_failed
    assert quality.judge(none).count() == 0


def test_quality_keeps_every_gram(spark, monkeypatch):
    """However small a part of the model is, all n-grams of all languages count: scores are those of the whole model."""
    random.seed(4)
    rows = [(i, " ".join("".join(random.choice("abcdefgé") for _ in range(random.randint(1, 7))) for _ in range(60)), ("x", "y", None)[i % 3 if i < 30 else 0]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = quality.tables(quality.count(docs))
    monkeypatch.setattr(quality, "GRAMS", 1000)
    logs = quality.probabilities(quality.count(docs)).cache()
    assert logs.count() == quality.count(docs).count() > 4000
    model = quality.parts(logs, quality.GRAMS)
    assert len(model) > 4 and sum(len(p.value.keys) - 1 for p in model) == logs.count()
    got = {r.doc_id: r.log_perplexity for r in quality.judge(docs).collect()}
    for i, text, lang in rows:
        assert got[i] == pytest.approx(whole.score(lang or "", text), abs=1e-4)


# ---- PII


def test_feistel_is_a_permutation(spark):
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v")).select(pii.digits(F.col("v"), "k", "t").alias("p")).collect()
    assert {r.p for r in rows} == {f"{i:03d}" for i in range(1000)}
    days = spark.range(73_000).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v")).select(pii.date(F.col("v"), "k").alias("p"))
    assert days.distinct().count() == 73_000
    pairs = spark.range(26 * 26).select(F.concat(F.char(F.col("id") % 26 + 97), F.char(F.floor(F.col("id") / 26) + 97)).alias("v")).select(pii.letters(F.col("v"), "k").alias("p"))
    assert pairs.distinct().count() == 26 * 26 and pairs.where(~F.col("p").rlike("^[a-z]{2}$")).count() == 0


def test_long_values_are_permuted_whole(spark):
    """No tail stays, each change reaches every block, and different values stay different."""
    base = "abcdefghijklmnopqrstuvwxyz" * 2 + "tail"
    rows = [(base, "1" * 70), ("b" + base[1:], "2" + "1" * 69), (base[:-1] + "m", "1" * 69 + "2"), (base[:24], "1" * 34), (base[:24] + "a", "1" * 35)]
    values = spark.createDataFrame(rows, "a string, d string")
    got = [(r.a, r.p, r.d, r.q) for r in values.select("a", pii.letters(F.col("a"), "k").alias("p"), "d", pii.digits(F.col("d"), "k", "t").alias("q")).collect()]
    for a, p, d, q in got:
        assert len(p) == len(a) and p.isalpha() and len(q) == len(d) and q.isdigit()
    for own, size in ((1, 24), (3, 34)):
        blocks = [[g[own][i : i + size] for i in range(0, len(g[own]), size)] for g in got[:3]]
        assert all(len({b[k] for b in blocks}) == 3 for k in range(2))
    assert got[0][1][24:] != base[24:] and got[0][3][34:] != "1" * 36
    ends = spark.range(260).select(F.concat(F.lit("x" * 23), F.char(F.col("id") % 26 + 97), F.char(F.floor(F.col("id") / 26) + 97)).alias("v"))
    assert ends.select(pii.letters(F.col("v"), "k").alias("p")).distinct().count() == 260
    mail = spark.createDataFrame([("to firstname.middlename.verylongsurname@example.org now",)], "text string")
    local = pii.pseudonymise(mail).first().text.split()[1].split("@")[0]
    assert len(local) == 36 and not local.endswith("name") and [i for i, c in enumerate(local) if c == "."] == [9, 20]


def test_long_and_odd_texts_are_linear(spark):
    """Runs that look like addresses neither overflow a stack nor take quadratic time."""
    import time

    rows = [(1, "x@a" + ".a" * 20_000), (2, "a." * 100_000), (3, "a@" * 50_000), (4, "1-" * 100_000), (5, "x@" + "a" * 200_000), (6, "9" * 200_000), (7, "+1 " * 50_000)]
    began = time.time()
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and time.time() - began < 60


def test_mail_and_date_forms(spark):
    values = ["A.Bc9@Mail.Example.ORG", "a.bc9@Mail.Example.ORG", "me@a.b.com.123", "x@john@y.org", "_lead@y.org", "12/31/1999", "1/31/1999", "1.2.2024", "01.02.2024", "7@y.org"]
    docs = spark.createDataFrame([(i, f"say {v} now") for i, v in enumerate(values)], "doc_id long, text string")
    got = {r.doc_id: r.text[4:-4] for r in pii.pseudonymise(docs).collect()}
    assert all(got[i] != v for i, v in enumerate(values))
    assert got[0].lower() == got[1].lower() and [c.isupper() for c in got[0]] == [c.isupper() for c in values[0]]
    assert got[2].endswith("@a.b.com.123") and got[3].startswith("x@") and got[4][0] == "_"
    for i in (5, 6):
        month, day, _ = map(int, got[i].split("/"))
        assert month <= 12 < day
    assert [int(x) for x in got[7].split(".")] == [int(x) for x in got[8].split(".")] and len(got[8]) == 10 and "0" != got[7][0]
    only = spark.range(73_000).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d")).where("day(d) > 12")
    turned = only.select(pii.date(F.date_format("d", "MM/dd/yyyy"), "k").alias("p"))
    assert turned.distinct().count() == only.count() and turned.where("substring(p, 4, 2) <= '12'").count() == 0
    one = spark.createDataFrame([(c,) for c in "abcdefghijklmnopqrstuvwxyz"], "v string").select(pii.letters(F.col("v"), "k").alias("p")).collect()
    assert sorted(r.p for r in one) == list("abcdefghijklmnopqrstuvwxyz") and len({(ord(r.p) - 97 - i) % 26 for i, r in enumerate(one)}) > 1


def luhn(number):
    d = [int(c) for c in number if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms(spark, odd, none):
    text = "a.b-77@mail.example.org 4111 1111 1111 1111, 378282246310005 and 4111111111111112; 2024-02-29 30.02.2024 1.2.3.4 +1 (988) 555-2485 123-45-6789"
    docs = spark.createDataFrame([(1, text), (2, "again 4111 1111 1111 1111 here"), (3, "none 12 a@b")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(docs).collect()}
    found = {x.value: x.pseudonym for x in got[1]._found}
    assert set(found) == {"a.b-77@mail.example.org", "4111 1111 1111 1111", "378282246310005", "2024-02-29", "1.2.3.4", "+1 (988) 555-2485", "123-45-6789"}
    assert all(a != b and len(a) == len(b) or a == "1.2.3.4" for a, b in found.items())
    assert luhn(found["4111 1111 1111 1111"]) and luhn(found["378282246310005"])
    assert found["4111 1111 1111 1111"] in got[2].text and "4111111111111112" in got[1].text and "30.02.2024" in got[1].text
    assert got[3].text == "none 12 a@b"
    want = text
    for a, b in found.items():
        want = want.replace(a, b)
    assert got[1].text == want
    rows = pii.pseudonymise(odd).collect()
    assert Counter(r.text for r in rows) == Counter(r[1] for r in ODD) and pii.pseudonymise(none).count() == 0


# ---- chat

CHAT = [
    (1, 0, "user", "find it"),
    (1, 1, "tool", '{"tool_call_id": "c2", "content": "early"}'),
    (1, 2, "assistant", '{"tool_calls": [{"id": "c1", "name": "search", "arguments": {"query": "é", "limit": 2}}]}'),
    (1, 3, "assistant", '{"tool_calls": [{"id": "c2", "function": {"name": "fetch", "arguments": "{\\"url\\": 5}"}, "after": ["c4"]}]}'),
    (1, 4, "tool", '{"tool_call_id": "c1", "content": "ok"}'),
    (1, 5, "assistant", '{"tool_calls": [{"id": "c4", "name": "nope", "arguments": "{"}]}'),
    (1, 6, "tool", '{"tool_call_id": "gone", "content": ""}'),
    (2, 0, "assistant", '{"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "x"}, "after": ["b"]}]}'),
    (2, 1, "assistant", '{"tool_calls": [{"id": "b", "name": "search", "arguments": {}, "after": ["a"]}]}'),
    (3, 0, None, None), (3, 1, "user", "{not json"), (3, 1, "user", "{not json"),
]


def test_chat_links_and_orders(spark):
    rows = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumn("json", F.lit(1))
    got = chat.link(rows).collect()
    assert len(got) == len(CHAT)
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.anchor, r.depth, r.turn))
    assert [r.turn for r in one] == [0, 2, 4, 5, 3, 1, 6]  # calls after what they build on, results after their calls
    by = {r.turn: r for r in one}
    assert by[2].json == '{"content":"","role":"assistant","tool_calls":[{"function":{"arguments":{"limit":2,"query":"é"},"name":"search"},"id":"c1","type":"function"}]}'
    assert (by[2].n_calls, by[2].n_linked, by[2].n_valid) == (1, 1, 1) and (by[3].n_linked, by[3].n_valid) == (1, 0)
    assert by[5].n_linked == 0 and by[6].orphan and not by[4].orphan
    assert all(r.n_cyclic == 1 for r in got if r.conv_id == 2)
    assert [r.json for r in got if r.conv_id == 3 and r.turn == 0] == ['{"content":"","role":""}']
    assert chat.link(rows.limit(0)).count() == 0


def chain(n, start=0, conv=1, turn=None):
    """Calls in reverse: each builds on the next one."""
    return [(conv, start + i, "assistant", '{"tool_calls": [{"id": "k%d", "name": "search", "arguments": {"query": "q"}, "after": ["k%d"]}]}' % (start + i, start + i + 1)) for i in range(n)]


def order_by_hand(edges):
    """Place of each node by exploring every path, cycles as sets that reach themselves."""
    nodes = {x for e in edges for x in e}
    reach = {a: set() for a in nodes}
    for a, b in edges:
        reach[a].add(b)
    for k in nodes:
        for a in nodes:
            if k in reach[a]:
                reach[a] |= reach[k]
    cyclic = {a for a in nodes if a in reach[a]}

    def place(x):
        return max([(x, 0), *((p[0], p[1] + 1) for p in (place(a) for a, b in edges if b == x and x not in cyclic))])

    return {(b, *place(b), b in cyclic) for _, b in edges}


def test_chat_order_against_paths(spark):
    random.seed(5)
    for most in (10**6, 0):  # as rows, and over tables
        rows, want = [], set()
        for conv in range(12 if most else 3):
            edges = sorted({(a, b) for a, b in ((random.randrange(9), random.randrange(9)) for _ in range(random.randint(3, 11))) if a != b})
            rows += [(str(conv), a, b) for a, b in edges]
            want |= {(str(conv), *x) for x in order_by_hand(edges)}
        got = chat.places(spark.createDataFrame(rows, "conv string, from long, to long"), most).collect()
        assert {(r.conv, r.t, r.anchor, r.depth, r.cyclic) for r in got} == want


def test_chat_long_chains_repeats_and_odd_json(spark):
    deep = '{"tool_call_id": "x", "content": ' + "[" * 100_000 + "]" * 100_000 + "}"
    odd = ['{"tool_call_id":"a","content":"\\ud800"}', '{"tool_call_id":"a","content":NaN}', '{"tool_call_id":"a","content":1e999}', deep, '{"tool_calls":[{"id":"z","name":"search","arguments":"{\\"query\\":Infinity}"}]}']
    rows = chain(300) + [(2, i, "tool", t) for i, t in enumerate(odd)] + chain(1, 0, 3) * 2 + [(None, 1, "assistant", chain(1)[0][3]), (None, None, "tool", '{"tool_call_id":"k0"}')]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    first = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.anchor, r.depth, r.turn))
    assert [r.turn for r in first] == list(range(299, -1, -1)) and not any(r.n_cyclic for r in first)
    two = {r.turn: r for r in got if r.conv_id == 2}
    assert "\\ud800" in two[0].json and two[0].orphan and not two[1].orphan and not two[2].orphan and not two[3].orphan
    assert (two[4].n_calls, two[4].n_valid) == (1, 0)
    assert [(r.n_calls, r.n_valid) for r in got if r.conv_id == 3] == [(1, 1)] * 2
    none = {r.turn: r for r in got if r.conv_id is None}
    assert none[1].n_linked == 1 and none[None].anchor == 1 and none[None].depth == 1 and not none[None].orphan


def test_schema_faults():
    s = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "integer"}}, "b": {"enum": [1, 2]}}, "required": ["a"], "additionalProperties": False}
    assert chat.fault({"a": [1, 2.0], "b": 2}, s) is None
    assert [chat.fault(x, s) for x in ({}, {"a": [True]}, {"a": [], "b": 3}, {"a": [], "c": 1}, [])] == ["$.a: missing", "$.a[0]: not of type integer", "$.b: not among the allowed values", "$.c: unknown", "$: not of type object"]


# ---- every operator on odd tables


def odd_columns(spark):
    names = ["_score", "_hits", "_leaks", "_found", "_values", "_kinds", "shard", "slot", "row", "size", "component_id", "label", "id", "fp", "_d", "_i", "item", "bucket"]
    big = "word " * 200_000 + "x@a" + ".a" * 3_000
    rows = [*ODD, (None, "no id", "en", None, 5), (8, big, None, "c", len(big)), (9, "\x00\x01 \u2028 a", "en", "c", 6)]
    docs = spark.createDataFrame(rows, DOCS)
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    return docs.withColumn("m", F.create_map(F.lit("k"), F.struct(F.col("doc_id").alias("d")))), len(rows)


def test_every_operator_on_odd_tables(spark, tmp_path):
    import public_tokenizers

    docs, n = odd_columns(spark)
    labels = spark.createDataFrame([(4, 1, 1), (8, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, "a")], "item_id long, text string")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == n
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns
    tokens.write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"))
    assert tokens.read_tokens(spark, str(tmp_path / "t")).count() == n
    assert pii.pseudonymise(docs).select("_values", "_kinds", "m", "_found").count() == n
    assert mixing.mix(docs).columns == docs.columns
    assert quality.judge(docs).count() == n
    told = decontaminate.leaks(docs, items)
    assert told.count() == n and decontaminate.clean(docs, items).columns == docs.columns
    assert simhash.groups(docs).count() == n
    alone = simhash.representatives(docs)
    assert alone.columns == docs.columns and {r.doc_id for r in alone.select("doc_id").collect()} >= {6, 7, 8, 9}
    placed = sharding.shards(docs)
    assert placed.count() == n and [(f.name, f.dataType.typeName()) for f in placed.select("row.*").schema] == [(f.name, f.dataType.typeName()) for f in docs.schema]
    before = Counter(str(r.m) for r in docs.collect())
    assert Counter(str(r.m) for r in placed.select("row.m").collect()) == before


def test_operators_run_first_on_plain_tables(tmp_path):
    """In a session that has shipped nothing yet, an operator on a plain DataFrame finds its code on the workers."""
    import subprocess
    import sys

    code = "from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); from treeloom.llm import simhash; d = s.createDataFrame([(1, 'a b')], 'doc_id long, text string'); assert simhash.fingerprints(d).count() == 1"
    import os
    from pathlib import Path

    root = str(Path(simhash.__file__).resolve().parents[2])
    run = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {root!r}); {code}"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=180)
    assert run.returncode == 0, run.stderr[-2000:]


# ---- pipeline


def test_pipeline_runs_in_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, D)
        assert docs.columns == names
    out = corpus_pipeline.run(spark, D)
    assert out.columns == [*names, "shard", "slot"] and out.count() > 50
