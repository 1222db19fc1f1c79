"""Toxicity: a learned lexicon, matched with Levenshtein automata and weighed in its context.

The lexicon (words, and stems that begin many words) is learned from labelled rows: terms whose share among toxic
texts is far above that among others, chosen greedily so that each toxic text is covered several times over. A trie
of the lexicon is intersected with the Levenshtein automaton of the term's length (adjacent swaps count as one edit):
states of the product are sets of (trie node, edits), determinised as tokens reach them. Each hit weighs its term's
log-odds, less if it is misspelled, less if quotation marks enclose it, more if other hits stand near. A logistic
curve over these sums, fitted on the same rows, gives the score.

The model is fitted on a bounded sample: at most about TRAIN_ROWS labelled documents, chosen by a hash of doc_id. All
documents are scored, whole. lang, source, labels and doc_id are no input of a score.

Defined results: a null or empty text scores as one without hits; a null doc_id is never held out nor learned from;
repeated labels count as the worst; without labels of both kinds every score is 0; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import arrow, fields, free, keep, read

#: Labelled documents that the model is fitted on, at most (a hash picks them, so about this many).
TRAIN_ROWS = 24_000
#: Terms of the lexicon, at most; those covering most texts come first.
TERMS = 2_000
#: Share of the toxic texts, and least number of them, that a term must occur in; its least log-odds.
SHARE, LEAST, ODDS = 0.004, 3, 2.0
#: Times that each toxic text is to be covered by different terms.
COVER = 8
STEM = range(4, 9)
WINDOW = 8
QUOTED, NEAR = 0.4, 0.15
#: A misspelled term weighs this share of the exact one before any text is seen; PRIOR toxic texts stand for that
#: guess, and the toxic and clean training texts with words so near to the term move it. In the score misspelled hits
#: are worth at least FUZZY_WORTH of exact ones, as few training texts hold any.
FUZZY, PRIOR, FUZZY_WORTH = 0.7, 1.0, 0.6
#: Least weight at which a misspelled hit counts.
FUZZY_LEAST = 1.0
#: Weights at which a hit counts in a higher tier, and the most that a term weighs.
TIERS, WEIGHT_MOST = (3.0, 6.0), 8.0
_EDGE = " \t.,;:!?()[]{}|\"'“”„«»‘’`*_#<>-–—…"
_OPEN, _CLOSE = "\"“„«‘", "\"”“»’"
_LETTERS = re.compile(r"[^\W\d_]+")


def edits_for(n: int) -> int:
    """Edits that a term of n letters may have."""
    return 0 if n < 5 else 1 if n < 8 else 2


class Matcher:
    """The product of the lexicon's trie and its Levenshtein automata, determinised on demand.

    terms: (text, stem) pairs; a stem may be followed by anything. match(token) gives {term index: least edits}.
    """

    KEPT = 300_000

    def __init__(self, terms: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]
        self.terms = terms
        self.limit = [edits_for(len(t)) for t, _ in terms]
        self.reach = [0]  # most edits that any term below a node may have
        for k, (text, _) in enumerate(terms):
            node = 0
            self.reach[0] = max(self.reach[0], self.limit[k])
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(())
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], self.limit[k])
            self.ends[node] += (k,)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.stems: list[dict[int, int]] = []
        self.finals: list[dict[int, int]] = []
        self.next: list[dict[str, int]] = []
        self.seen: dict[str, dict[int, int]] = {}
        self.start = self._state({(0, 0, ""): None})

    def _state(self, items) -> int:
        """The state of (node, edits, letter still owed by a swap) items, closed under skipped letters of a term."""
        best: dict[tuple[int, str], int] = {}
        stack = [(n, e, owed) for n, e, owed in items]
        while stack:
            n, e, owed = stack.pop()
            if e > self.reach[n] or best.get((n, owed), 9) <= e:
                continue
            best[n, owed] = e
            if not owed:
                stack += [(child, e + 1, "") for child in self.children[n].values()]
        key = frozenset((n, e, owed) for (n, owed), e in best.items())
        if key not in self.ids:
            ends: dict[int, int] = {}
            for n, e, owed in key:
                if not owed:
                    for k in self.ends[n]:
                        if e <= self.limit[k]:
                            ends[k] = min(e, ends.get(k, 9))
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.stems.append({k: e for k, e in ends.items() if self.terms[k][1]})
            self.finals.append({k: e for k, e in ends.items() if not self.terms[k][1]})
            self.next.append({})
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        found = []
        for n, e, owed in self.sets[state]:
            if owed:
                if c == owed:
                    found.append((n, e, ""))
                continue
            children = self.children[n]
            if c in children:
                found.append((children[c], e, ""))
            if e < self.reach[n]:
                found.append((n, e + 1, ""))
                for letter, child in children.items():
                    if letter != c:
                        found.append((child, e + 1, ""))
                        if c in self.children[child]:
                            found.append((self.children[child][c], e + 1, letter))
        self.next[state][c] = to = self._state(found) if found else -1
        return to

    def match(self, token: str) -> dict[int, int]:
        found = self.seen.get(token)
        if found is None:
            if len(self.seen) > self.KEPT or len(self.sets) > self.KEPT:
                self._reset()
            state, found = self.start, {}
            for c in token:
                to = self.next[state].get(c)
                state = self._step(state, c) if to is None else to
                if state < 0:
                    break
                for k, e in self.stems[state].items():
                    found[k] = min(e, found.get(k, 9))
            else:
                for k, e in self.finals[state].items():
                    found[k] = min(e, found.get(k, 9))
            self.seen[token] = found
        return found


class Model:
    """Lexicon with weights for exact and misspelled hits, and the logistic curve over a text's features."""

    def __init__(self, terms: list[tuple[str, bool]], weights: list[float], fuzzy: list[float], curve: list[float]):
        self.terms, self.weights, self.fuzzy, self.curve = terms, weights, fuzzy, curve
        self._matcher = None

    def __getstate__(self):
        return self.__dict__ | {"_matcher": None, "_tokens": {}}

    @property
    def matcher(self) -> Matcher:
        if self._matcher is None:
            self._matcher, self._tokens = Matcher(self.terms), {}
        return self._matcher

    def best(self, token: str) -> tuple[int, int, float] | None:
        """(term, edits, weight) of a token's heaviest exact hit, or else of its heaviest one; None without a hit."""
        found = [(e == 0, self.fuzzy[k] if e else self.weights[k], k, e) for k, e in self.matcher.match(token.strip(_EDGE).lower()).items() if not e or self.fuzzy[k]]
        _, w, k, e = max(found, default=(True, 0.0, 0, 0))
        return (k, e, w) if found else None

    def hits(self, text: str) -> tuple[int, list[tuple[int, int, int, float, bool]]]:
        """Number of tokens, and (place, term, edits, weight, quoted) of each hit."""
        words = (text or "").split()
        self.matcher
        cache = self._tokens
        if len(cache) > 400_000:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = self.best(w)
        at = [i for i, w in enumerate(words) if cache[w] is not None]
        return len(words), [(i, *cache[words[i]], quoted(words, i)) for i in at]

    def features(self, text: str) -> list[float]:
        return self.features_of(*self.hits(text))

    def features_of(self, n: int, found: list[tuple[int, int, int, float, bool]]) -> list[float]:
        """Weight of all hits for each hundred words, for exact hits of each tier the log of their sum in context,
        and the log of the sum of misspelled hits.
        """
        sums = [0.0] * (len(TIERS) + 2)
        places = [i for i, *_ in found]
        total = 0.0
        low = high = 0
        for i, _, e, w, inside in found:
            while places[low] < i - WINDOW:
                low += 1
            while high < len(places) and places[high] <= i + WINDOW:
                high += 1
            scaled = (QUOTED if inside else 1.0) * (1 + NEAR * min(4, high - low - 1))
            sums[-1 if e else sum(w >= t for t in TIERS)] += scaled
            total += scaled * w
        return [math.log1p(total * 100 / n) if n else 0.0, *(math.log1p(x) for x in sums)]

    def judge(self, text: str) -> tuple[float, int]:
        """The score and the number of hits, from one scan of the text."""
        n, found = self.hits(text)
        z = self.curve[0] + sum(c * x for c, x in zip(self.curve[1:], self.features_of(n, found)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len(found)

    def score(self, text: str) -> float:
        return self.judge(text)[0]


def quoted(words: list[str], i: int) -> bool:
    """Whether quotation marks open at most WINDOW words before word i and close at most WINDOW words after it."""
    opened = False
    for w in words[max(0, i - WINDOW) : i + 1]:
        if w[0] in _OPEN:
            opened = True
        elif w[-1] in _CLOSE or w.rstrip(".,;:!?")[-1:] in _CLOSE:
            opened = False
    if not opened:
        return False
    return any(w.rstrip(".,;:!?")[-1:] in _CLOSE for w in words[i : i + WINDOW + 1])


def terms_of(text: str) -> set[tuple[str, bool]]:
    """All words of a text, and the stems that begin its longer words."""
    words = {w for w in _LETTERS.findall((text or "").lower()) if len(w) > 2}
    return {(w, False) for w in words} | {(w[:k], True) for w in words for k in STEM if len(w) > k}


def _count_terms(batches: Iterator[pa.RecordBatch], wanted: frozenset | None) -> Iterator[pa.RecordBatch]:
    """Texts of a batch that have each term, among `wanted` terms if given."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            n: Counter = Counter()
            for text in batch.column("text").slice(at, 500).to_pylist():
                n.update(terms_of(text) if wanted is None else terms_of(text) & wanted)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in n]), pa.array([s for _, s in n], pa.bool_()), pa.array(list(n.values()), pa.int64())], ["term", "stem", "n"])


def _counts(texts: DataFrame, wanted: frozenset | None, least: int = 1) -> dict[tuple[str, bool], int]:
    rows = arrow(texts.select("text"), lambda b: _count_terms(b, wanted), "term string, stem boolean, n long").groupBy("term", "stem").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return {(r.term, r.stem): r.n for r in rows.toLocalIterator()}


def _rows_of(batches: Iterator[pa.RecordBatch], what) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [what(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(got, pa.list_(pa.float64()))], ["toxic", "row"])


def _mapped(texts: DataFrame, what) -> DataFrame:
    """(toxic, row): what(text), a list of numbers, for each text."""
    return arrow(texts.select("text", "toxic"), lambda b: _rows_of(b, what), "toxic long, row array<double>")


def cover(texts: list[list[int]], odds: list[float], terms: list[tuple[str, bool]]) -> list[int]:
    """Indices of terms, greedily: the term that most texts still lack comes next; whole words before stems, long stems before short ones."""
    inside: dict[int, set[int]] = {}
    for i, own in enumerate(texts):
        for k in own:
            inside.setdefault(k, set()).add(i)
    left = [COVER] * len(texts)
    gain = {k: len(v) for k, v in inside.items()}
    chosen: list[int] = []
    least = max(LEAST, SHARE * len(texts))
    while gain and len(chosen) < TERMS:
        k = max(gain, key=lambda k: (gain[k], not terms[k][1], len(terms[k][0]), odds[k], terms[k][0]))
        if gain[k] < least:
            break
        chosen.append(k)
        text, stem = terms[k]
        for i in inside[k]:
            left[i] -= 1
            if left[i] == 0:
                for j in texts[i]:
                    if j in gain:
                        gain[j] -= 1
        del gain[k]
        same = [j for j in gain if terms[j][0] == text or stem and terms[j][0].startswith(text) or terms[j][1] and text.startswith(terms[j][0])]
        for j in (j for j in same if odds[j] < odds[k] + 1):  # says no more
            del gain[j]
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> list[float]:
    """Coefficients of a ridge logistic regression by Newton's method, the constant first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (y - p) - ridge * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)) + 1e-9 * np.eye(len(b)), gradient)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b.tolist()


def raised(curve: list[float]) -> list[float]:
    """The curve with the coefficient of misspelled hits at its least worth."""
    return [*curve[:-1], max(curve[-1], FUZZY_WORTH * curve[-2])]


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit the model on at most about `rows` labelled documents, equal texts once."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    n = usable.count()
    if n > rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    picked = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")  # bounded by `rows`
    sample = keep(picked.where("text IS NOT NULL").groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).drop("h"), "toxic-sample")
    bad, good = sample.where("toxic = 1"), sample.where("toxic <> 1")
    nb, ng = bad.count(), good.count()
    if not nb or not ng:
        return Model([], [], [], [-30.0] + [0.0] * (len(TIERS) + 3))
    in_bad = _counts(bad, None, max(LEAST, math.floor(SHARE * nb)))
    in_good = _counts(good, frozenset(in_bad))
    lift = lambda b, g: math.log((b + 0.1) / (nb + 1)) - math.log((g + 0.1) / (ng + 1))
    odds = {t: lift(b, in_good.get(t, 0)) for t, b in in_bad.items()}
    terms = sorted(t for t, w in odds.items() if w >= ODDS)
    index = {t: k for k, t in enumerate(terms)}
    own = _mapped(bad, lambda text: [float(index[t]) for t in terms_of(text) if t in index])
    chosen = [terms[k] for k in cover([[int(k) for k in r.row] for r in own.toLocalIterator()], [odds[t] for t in terms], terms)]
    weights = [min(odds[t], WEIGHT_MOST) for t in chosen]
    model = Model(chosen, weights, [FUZZY * w for w in weights], [0.0] * (len(TIERS) + 4))

    def misspelled(text: str) -> list[float]:
        return sorted({float(k) for _, k, e, _, _ in model.hits(text)[1] if e > 0})

    seen = {0: Counter(), 1: Counter()}
    for r in _mapped(sample, misspelled).select("toxic", F.explode("row").alias("k")).groupBy("toxic", "k").count().toLocalIterator():
        seen[int(r.toxic == 1)][int(r.k)] += r["count"]
    for k, w in enumerate(weights):
        ratio = (seen[1][k] + PRIOR) / nb / ((seen[0][k] + PRIOR * math.exp(-FUZZY * w) * ng / nb) / ng)
        moved = min(FUZZY * w, math.log(ratio))
        model.fuzzy[k] = moved if moved >= FUZZY_LEAST else 0.0
    model = Model(model.terms, model.weights, model.fuzzy, model.curve)  # without what was matched before
    rows_ = [(r.toxic, r.row) for r in _mapped(sample, model.features).toLocalIterator()]
    model.curve = raised(logistic(np.array([x for _, x in rows_]), np.array([float(t == 1) for t, _ in rows_])))
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        judged = [model.judge(t) for t in batch.column("text").to_pylist()]
        made = [pa.array([s for s, _ in judged], pa.float64()), pa.array([n for _, n in judged], pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("_score", "_hits")) -> DataFrame:
    """docs with the probability of the toxic label and the number of lexicon hits; columns of these names are replaced."""
    docs = docs.drop(*names)
    return arrow(docs, lambda b: _scored(b, model, names), f"{fields(docs)}, {names[0]} double, {names[1]} long")


def clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents that score below the limit."""
    names = free(docs, "_score"), free(docs, "_hits")
    return score(docs, model, names).where(F.col(names[0]) < limit).drop(*names)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_hits").alias("n_hits"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE: dict[str, str] = {}
