"""Quality rules: plain counts of a text, then bands of n-gram perplexity for each language.

Character n-grams of all texts are counted, each task summing its own before they are shuffled. From the counts Spark
derives a modified Kneser-Ney model: continuation counts for the lower orders, three discounts for each order and
language, and back-off weights, interpolated from the lowest order up by joins. Every text that is judged was counted,
so each of its positions has an n-gram of the highest order; all of them are kept, as sorted arrays of 64-bit hashes
with probabilities beside them. The hashes' leading bits cut them into parts of about GRAMS entries, as many as the
input asks for, and a task holds one part at a time. Each language's bands lie around the quartiles of its documents'
log perplexity.

Defined results: a null text has no words and fails the base rules; a null language is one of its own; texts without
n-grams have no perplexity (null) and are judged by the base rules alone; a language with fewer than LEAST_DOCS
measured documents has its own median, but the widest interquartile range of the others, all of which lies on either
side of it, and no bands if there is no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import arrow, keep, read, small

ORDER = 5
#: Entries of a part of the model, about; up to 28 bytes each.
GRAMS = 4_000_000
#: Bands: this many interquartile ranges beyond the quartiles. On the labelled rows of sf0.1 that pass the base rules,
#: 2 rejects 54 % of those of quality 0 and 2.4 % of those of quality 1 (1.5: 66 % and 4.5 %; 3: 17 % and 1.2 %).
SPREAD = 2.0
LEAST_DOCS = 30
LEAST_WORDS, REPEATED = 10, 20
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Characters handled at once, and the most different ones among them that an n-gram key can hold.
CHUNK, ALPHABET = 1 << 20, 4096
#: Characters whose n-grams a task sums before it hands them on.
TOGETHER = 12 << 20
_PAD = "\x02"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


# ---- base rules


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes], n: int = 5) -> int:
    """Words inside windows of n words that occur at least twice."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(m, np.uint64)
    for i in range(n):
        key = (key ^ (key >> np.uint64(29))) * _M1 + own[i : i + m]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice)).tolist()
    windows = {i: tuple(words[i : i + n]) for i in at}  # hashes may collide, words don't
    seen = Counter(windows.values())
    inside = np.zeros(len(words), bool)
    for i in at:
        if seen[windows[i]] > 1:
            inside[i : i + n] = True
    return int(inside.sum())


# ---- n-grams


def form(text: str) -> str:
    """Lower case with single blanks, after the pad that begins every text."""
    words = text.replace(_PAD, " ").lower().split()
    return _PAD * (ORDER - 1) + " ".join(words) if words else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(text: str) -> dict[str, int]:
    """Counts of the n-grams of ORDER characters of a text that is in form already, possibly of several texts in a row."""
    out: Counter = Counter()
    step = 2 * CHUNK
    at = 0
    while at < len(text):
        codes = _codes(text[at : at + step + ORDER - 1])
        letters = np.unique(codes)
        if len(letters) > ALPHABET and step > 256:
            step //= 4  # fewer letters in a shorter stretch
            continue
        place = np.searchsorted(letters, codes).astype(np.uint64)
        m = len(codes) - ORDER + 1
        if m > 0:
            key = np.zeros(m, np.uint64)
            for i in range(ORDER):
                key = (key << np.uint64(12)) | place[i : i + m]
            found, n = np.unique(key, return_counts=True)
            cut = np.stack([(found >> np.uint64(12 * (ORDER - 1 - i))) & np.uint64(4095) for i in range(ORDER)], axis=1).astype(np.int64)
            line = letters[cut].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            for i, c in enumerate(n.tolist()):
                out[line[i * ORDER : (i + 1) * ORDER]] += c
        at += step
        step = 2 * CHUNK
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language and n-gram the count in some texts together; an n-gram that spans two texts holds a pad inside and is left out."""
    by: dict[str, list[str]] = {}
    held = 0

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, texts in by.items():
            found = [(g, n) for g, n in grams("".join(texts)).items() if _PAD not in g.lstrip(_PAD)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([g for g, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if text:
                by.setdefault(lang or "", []).append(form(text))
                held += len(text)
                if held > TOGETHER:
                    yield from counted()
                    by, held = {}, 0
    yield from counted()


def count(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts."""
    rows = arrow(docs.select(F.col("lang").cast("string").alias("lang"), "text"), _counted, "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# ---- the model


def _first(own: np.uint64, n: int) -> np.uint64:
    return np.uint64((int(own) + n * int(_M2)) % (1 << 64))


def hashes(codes: np.ndarray, n: int, salt: np.uint64) -> np.ndarray:
    """64-bit hashes of all runs of n codes."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    key = np.full(m, _first(salt, n), np.uint64)
    for i in range(n):
        key = (key ^ (key >> np.uint64(31))) * _M1 + codes[i : i + m].astype(np.uint64)
    return (key ^ (key >> np.uint64(29))) * _M2


def salt(lang: str) -> np.uint64:
    import zlib

    return np.uint64(zlib.crc32(lang.encode()) + 1)


class Table:
    """Sorted hashes with a value beside each, and where the hashes of each leading bit pattern begin.

    Hashes are uniform, so a pattern of one bit more than the entries need holds half an entry on average, and a
    lookup reads one or two places.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.uint64(2**64 - 1))
        self.values = np.append(values[order], np.float32(np.nan)).astype(np.float32)
        bits = len(keys).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        at = self.starts[keys >> self.shift]
        here = self.keys[at]
        low = np.flatnonzero(here < keys)
        while len(low):
            at[low] += 1
            here[low] = self.keys[at[low]]
            low = low[here[low] < keys[low]]
        return np.where(here == keys, self.values[at], np.float32(default))


class Model:
    """For each language and order the n-grams' log probabilities and the contexts' log back-off weights."""

    def __init__(self, tables: dict[str, tuple[list[Table], list[Table], float]]):
        self.tables = tables

    def logs(self, lang: str, codes: np.ndarray) -> np.ndarray:
        """Natural log probability of each code from place ORDER - 1 on, given the ones before."""
        probabilities, weights, unseen = self.tables[lang]
        own = salt(lang)
        m = len(codes) - ORDER + 1
        out = np.zeros(m, np.float32)
        todo = np.arange(m)
        for n in range(ORDER, 0, -1):
            if not len(todo):
                break
            starts = todo + ORDER - n
            keys = hashes(codes, n, own)[starts] if len(todo) > m // 8 else _hashes_at(codes, starts, n, own)
            found = probabilities[n - 1].get(keys, np.nan)
            seen = ~np.isnan(found)
            out[todo[seen]] += found[seen]
            todo = todo[~seen]
            if n > 1 and len(todo):
                out[todo] += weights[n - 2].get(_hashes_at(codes, todo + ORDER - n, n - 1, own), 0.0)
        out[todo] += unseen
        return out

    def score(self, lang: str, text: str | None) -> float | None:
        """Mean negative log probability of a text's characters, the log of its perplexity."""
        line = form(text or "")
        if not line or lang not in self.tables:
            return None
        total, codes = 0.0, _codes(line)
        for at in range(0, len(codes) - ORDER + 1, CHUNK):
            total += float(self.logs(lang, codes[at : at + CHUNK + ORDER - 1]).sum(dtype=np.float64))
        return -total / (len(codes) - ORDER + 1)


def _hashes_at(codes: np.ndarray, starts: np.ndarray, n: int, own: np.uint64) -> np.ndarray:
    key = np.full(len(starts), _first(own, n), np.uint64)
    for i in range(n):
        key = (key ^ (key >> np.uint64(31))) * _M1 + codes[starts + i].astype(np.uint64)
    return (key ^ (key >> np.uint64(29))) * _M2


def levels(counts: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For each order, the lowest first: (lang, gram, alpha, gamma, letters) and (lang, context, gamma, letters); from (lang, gram, n), the counts of the highest order."""
    level = keep(counts, "grams")
    every: dict[int, DataFrame] = {}
    for n in range(ORDER, 0, -1):
        every[n] = level
        if n > 1:  # continuation counts: how many different characters stand before
            level = keep(level.groupBy("lang", F.substring("gram", 2, n - 1).alias("gram")).agg(F.count("*").alias("n")), "grams")
    for n in range(1, ORDER + 1):
        own = every[n]
        bins = own.where("n <= 4").groupBy("lang", "n").count().collect()  # four rows a language
        t = {lang: [0] * 5 for lang in {r.lang for r in bins}}
        for r in bins:
            t[r.lang][r.n] = r["count"]
        cut = {lang: _discounts(x[1:]) for lang, x in t.items()}
        d = lambda k: F.coalesce(F.create_map(*[F.lit(v) for lang, x in cut.items() for v in (lang, x[k])])[F.col("lang")], F.lit((0.5, 1.0, 1.5)[k])) if cut else F.lit((0.5, 1.0, 1.5)[k])
        less = F.when(F.col("n") == 1, d(0)).when(F.col("n") == 2, d(1)).otherwise(d(2))
        context = own.groupBy("lang", F.substring("gram", 1, n - 1).alias("context")).agg(F.sum("n").alias("c"), F.sum(less).alias("cut"), F.count("*").alias("letters"))
        context = keep(context.select("lang", "context", "c", (F.col("cut") / F.col("c")).alias("gamma"), "letters"), "contexts")
        joined = own.withColumn("context", F.substring("gram", 1, n - 1)).join(context, ["lang", "context"])
        yield joined.select("lang", "gram", F.greatest((F.col("n") - less) / F.col("c"), F.lit(0.0)).alias("alpha"), "gamma", "letters"), context


def tables(counts: DataFrame) -> Model:
    """The model from (lang, gram, n), on the driver: for texts that were not counted, by the back-off."""
    found = [(rows.select("lang", "gram", "alpha").toArrow(), context.select("lang", "context", "gamma").toArrow()) for rows, context in levels(counts)]
    return Model(_assembled(*map(list, zip(*found))))


def probabilities(counts: DataFrame) -> DataFrame:
    """(lang, gram, log) of every n-gram of the highest order: the interpolation of _assembled() as joins."""
    below = None
    for n, (rows, _) in enumerate(levels(counts), 1):
        if below is None:
            p = rows.select("lang", "gram", (F.col("alpha") + F.greatest("gamma", F.lit(1e-6)) / (F.col("letters") + 1)).alias("p"))
        else:
            lower = below.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower"))
            joined = rows.withColumn("tail", F.substring("gram", 2, n - 1)).join(lower, ["lang", "tail"])
            p = joined.select("lang", "gram", (F.col("alpha") + F.greatest("gamma", F.lit(1e-9)) * F.col("lower")).alias("p"))
        below = keep(p, "probabilities")
    return below.select("lang", "gram", F.log(F.greatest("p", F.lit(1e-12))).cast("float").alias("log"))


def _hashed(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.zeros(batch.num_rows, np.uint64)
        langs = np.array([x or "" for x in batch.column("lang").to_pylist()], object)
        rows = _codes("".join(batch.column("gram").to_pylist())).reshape(batch.num_rows, ORDER)
        for lang in set(langs):
            at = np.flatnonzero(langs == lang)
            keys[at] = _row_hashes(rows[at], salt(lang))
        yield pa.RecordBatch.from_arrays([pa.array(_part(keys, bits).astype(np.int32)), pa.array(keys.view(np.int64)), batch.column("log")], ["part", "key", "log"])


def _part(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)


def parts(logs: DataFrame, most: int) -> list:
    """Broadcasts of a Table for each pattern of the hashes' leading bits, of about `most` entries; made one at a time."""
    spark = logs.sparkSession
    bits = max(0, (-(-logs.count() // most) - 1).bit_length())
    rows = arrow(logs, lambda b: _hashed(b, bits), "part int, key long, log float")
    rows = keep(rows.repartitionByRange(1 << bits, "part") if bits else rows, "hashed")
    out = []
    for i in range(1 << bits):
        own = rows.where(F.col("part") == i).select("key", "log").toArrow()
        keys, values = (own.column(c).combine_chunks().to_numpy() for c in ("key", "log"))
        out.append(spark.sparkContext.broadcast(Table(keys.view(np.uint64) << np.uint64(bits), values)))
    return out


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of n-grams counted once, twice, three and four times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(k, max(0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _by_lang(table: pa.Table, n: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language the codes (rows, n) of the strings and the values."""
    out = {}
    langs = table.column(0).combine_chunks().dictionary_encode() if table.num_rows else None
    if langs is None:
        return {}
    index = langs.indices.to_numpy()
    lines = _codes("".join(table.column(1).to_pylist())).reshape(table.num_rows, n) if n else np.zeros((table.num_rows, 0), np.uint32)
    values = table.column(2).to_numpy()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        own = index == k
        out[lang] = lines[own], values[own]
    return out


def _row_hashes(rows: np.ndarray, own: np.uint64) -> np.ndarray:
    n = rows.shape[1]
    key = np.full(len(rows), _first(own, n), np.uint64)
    for i in range(n):
        key = (key ^ (key >> np.uint64(31))) * _M1 + rows[:, i].astype(np.uint64)
    return (key ^ (key >> np.uint64(29))) * _M2


def _assembled(alphas: list[pa.Table], gammas: list[pa.Table]) -> dict:
    """Interpolate from the lowest order up: p(gram) = alpha(gram) + gamma(context) * p(gram without its first character)."""
    alpha = [_by_lang(t, n) for n, t in enumerate(alphas, 1)]
    gamma = [_by_lang(t, n - 1) for n, t in enumerate(gammas, 1)]
    out = {}
    for lang in alpha[0]:
        own = salt(lang)
        probabilities: list[Table] = []
        weights: list[Table] = []
        letters = len(alpha[0][lang][0])
        root = float(gamma[0][lang][1][0]) if lang in gamma[0] else 1.0
        floor = max(root, 1e-6) / (letters + 1)
        below: list[Table] = []
        for n in range(1, ORDER + 1):
            rows, a = alpha[n - 1].get(lang, (np.zeros((0, n), np.uint32), np.zeros(0)))
            if n == 1:
                p = a + floor
            else:
                contexts, g = gamma[n - 1].get(lang, (np.zeros((0, n - 1), np.uint32), np.zeros(0)))
                back = Table(_row_hashes(contexts, own), np.log(np.maximum(g, 1e-9)))
                weights.append(back)
                p = a + np.exp(back.get(_row_hashes(rows[:, :-1], own), 0.0)) * np.exp(_lower(below, weights[:-1], rows[:, 1:], own, np.log(floor)))
            below = [*below, Table(_row_hashes(rows, own), np.log(np.maximum(p, 1e-12)))]
        probabilities = below
        out[lang] = probabilities, weights, float(np.log(floor))
    return out


def _lower(below: list[Table], weights: list[Table], rows: np.ndarray, own: np.uint64, unseen: float) -> np.ndarray:
    """Log probabilities of the rows' last character given the others, by the tables of the orders below."""
    out, todo = np.zeros(len(rows), np.float64), np.arange(len(rows))
    for n in range(rows.shape[1], 0, -1):
        tail = rows[todo, rows.shape[1] - n :]
        found = below[n - 1].get(_row_hashes(tail, own), np.nan)
        seen = ~np.isnan(found)
        out[todo[seen]] += found[seen]
        tail, todo = tail[~seen], todo[~seen]
        if n > 1 and len(todo):
            out[todo] += weights[n - 2].get(_row_hashes(tail[:, :-1], own), 0.0)
    out[todo] += unseen
    return out


# ---- the operator


def scores(langs: list, texts: list, model: list) -> list[float | None]:
    """Mean negative log probability of each text's characters, the log of its perplexity; all texts were counted."""
    totals, found, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    bits = len(model).bit_length() - 1
    waiting: list[tuple[int, np.ndarray]] = []
    held = 0

    def look_up() -> None:
        keys = np.concatenate([k for _, k in waiting])
        owner = np.repeat([i for i, _ in waiting], [len(k) for _, k in waiting])
        part = _part(keys, bits)
        for i, table in enumerate(model):
            at = np.flatnonzero(part == i) if bits else slice(None)
            logs = table.value.get(keys[at] << np.uint64(bits), np.nan)
            if bits:
                table.__dict__.pop("_value", None)  # one part at a time
            totals[:] += np.bincount(owner[at], logs, len(texts))
            found[:] += np.bincount(owner[at][~np.isnan(logs)], minlength=len(texts))
        waiting.clear()

    for i, (lang, text) in enumerate(zip(langs, texts)):
        codes = _codes(form(text or ""))
        sizes[i] = max(0, len(codes) - ORDER + 1)
        for at in range(0, int(sizes[i]), CHUNK):
            waiting.append((i, hashes(codes[at : at + CHUNK + ORDER - 1], ORDER, salt(lang or ""))))
            held += len(waiting[-1][1])
            if held >= 4 * CHUNK:
                look_up()
                held = 0
    if waiting:
        look_up()
    if (found != sizes).any():
        raise ValueError("a text holds n-grams that were not counted")
    return [-t / n if n else None for t, n in zip(totals.tolist(), sizes.tolist())]


def _measured(batches: Iterator[pa.RecordBatch], model: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        rules = list(zip(*map(base, texts))) or [[]] * 5
        logs = scores(langs, texts, model)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(x, pa.int64()) for x in rules), pa.array(logs, pa.float64())], ["doc_id", "lang", *COUNTS, "log_perplexity"])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the counts, log_perplexity, base_failed and kept for every row."""
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    model = parts(probabilities(count(docs)), GRAMS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = arrow(docs, lambda b: _measured(b, model), f"doc_id {kind}, lang string, {', '.join(f'{c} long' for c in COUNTS)}, log_perplexity double")
    rows = keep(rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))), "measured")
    sound = rows.where("not base_failed and log_perplexity is not null")
    q = F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000))
    bands = sound.groupBy("lang").agg(q.alias("q"), F.count("*").alias("n"))
    enough = F.col("n") >= LEAST_DOCS
    width = F.when(enough, F.col("q")[2] - F.col("q")[0])
    bands = bands.withColumn("width", F.coalesce(width, F.max(width).over(Window.partitionBy())))  # a row for each language
    low, high = (F.when(enough, F.col("q")[k]).otherwise(F.col("q")[1] + s * F.col("width")) + s * SPREAD * F.col("width") for k, s in ((0, -1), (2, 1)))
    bands = bands.select(F.col("lang").alias("_lang"), low.alias("low"), high.alias("high"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return rows.join(small(bands), F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("kept", ~F.col("base_failed") & inside)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept", F.round("log_perplexity", 6).alias("log_perplexity"))


QUERIES = {"op7_quality": op7_quality}
ORACLE: dict[str, str] = {}
