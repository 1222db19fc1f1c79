"""Token-id output: documents as Parquet list columns that allow selective reads.

Texts are dealt by ranges of doc_id, encoded, and written in ascending order. Token ids are dictionary-encoded,
doc_id and the offsets delta-encoded; row groups and pages are small enough that page indexes skip what a reader does
not ask for. Readers of metadata (doc_id, start, n_tokens) never touch the ids.

Defined results: a null or empty text gives the end id alone, a null doc_id comes first, equal doc_ids are ordered
by text, an empty table gives an empty file set, and columns besides doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.llm.common import arrow, read, shared_dir, small

END = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 1_000
#: Bytes of texts encoded at once.
BYTES = 12 << 20
#: Bytes of words and their ids that an encoder remembers from batch to batch.
KNOWN_BYTES = 32 << 20
#: Marks whose runs never join the piece of the letters before them: those of ASCII but for the apostrophe.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that the normaliser leaves alone but for their case, as classes of a pattern.
_LOWER, _UPPER = "a-zß-öø-ÿ", "A-ZÀ-ÖØ-Þ"
_LETTERS = "".join(re.findall(f"[{_LOWER}{_UPPER}]", "".join(map(chr, range(256)))))

FILE_OPTIONS = {
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
}


class Encoder:
    """Encodes batches of texts, each distinct word once; words of earlier batches are remembered, up to KNOWN_BYTES.

    White space always ends a piece of this tokenizer, so a text's ids are those of its words in a row, and letters
    and a run of marks after them are pieces of their own. Words of plain letters skip the normaliser and the splitting
    pattern, which leave them as they are: many are encoded as one text and cut at the ids whose token carries the
    word-end suffix. All other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        plain = json.loads(self.whole.to_str()) | {"normalizer": None, "added_tokens": [], "post_processor": None}
        plain["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words, self.lists = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; few texts at a time, as the library keeps strings and offsets of every token."""
        return [np.array(e.ids, "<u4") for k in range(0, len(texts), 256) for e in tokenizer.encode_batch_fast(texts[k : k + 256], add_special_tokens=False)]

    def _places(self, words: pa.Array) -> np.ndarray:
        """For each distinct word the place of its ids in self.lists, where new words are added."""
        found = pc.index_in(words, value_set=self.words)
        places, known = found.fill_null(0).to_numpy(), len(self.words)
        new = words.filter(found.is_null())
        plain = pc.match_substring_regex(new, f"^[{_LOWER}]+$")
        letters, others = new.filter(plain), new.filter(pc.invert(plain))
        lines = pa.ListArray.from_arrays(pa.array([*range(0, len(letters), 64), len(letters)], pa.int32()), letters)
        values = np.concatenate([np.zeros(0, "<u4"), *self._ids(self.plain, pc.binary_join(lines, " ").to_pylist())])
        ends = np.flatnonzero(self.ends[values]) + 1
        assert len(ends) == len(letters), "a word of plain letters is one piece"
        rest = self._ids(self.whole, others.to_pylist())
        offsets = np.concatenate([[0], ends, len(values) + np.cumsum([len(x) for x in rest])]).astype(np.int32)
        self.lists = pa.concat_arrays([self.lists, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([values, *rest])))])
        self.words = pa.concat_arrays([self.words, letters, others])
        plain = plain.to_numpy(zero_copy_only=False)
        places = places.astype(np.int64)
        places[found.is_null().to_numpy(zero_copy_only=False)] = known + np.where(plain, np.cumsum(plain) - 1, len(letters) + np.cumsum(~plain) - 1)
        return places

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, without end ids, and the offsets of the texts in them."""
        per_text = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = per_text.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.string())
        core = pc.ascii_rtrim(words, _MARKS)
        plain = pc.match_substring_regex(core, f"^[{_LOWER}{_UPPER}]+$")
        marked = pc.and_(plain, pc.not_equal(core, words))
        marks = pc.utf8_ltrim(words.filter(marked), _LETTERS)
        marked = marked.to_numpy(zero_copy_only=False)
        # each distinct word is one list or two: its own and its marks'
        pieces = pa.concat_arrays([pc.if_else(plain, pc.utf8_lower(core), words), marks]).dictionary_encode()
        places = self._places(pieces.dictionary)
        first = np.concatenate([[0], np.cumsum(1 + marked)])
        parts = np.empty(first[-1], np.int64)
        of_piece = places[pieces.indices.to_numpy()]
        parts[first[:-1]] = of_piece[: len(words)]
        parts[first[:-1][marked] + 1] = of_piece[len(words) :]
        lengths = np.diff(self.lists.offsets.to_numpy())[parts]
        at = np.concatenate([[0], np.cumsum(lengths)])[first].astype(np.int32)
        of_word = pa.ListArray.from_arrays(pa.array(at), self.lists.take(pa.array(parts)).flatten())
        values = of_word.take(coded.indices).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(np.diff(at)[coded.indices.to_numpy()])]).astype(np.int64)
        offsets = per_text.offsets.to_numpy().astype(np.int64)
        if self.words.nbytes + self.lists.nbytes > KNOWN_BYTES:
            self.words, self.lists = pieces.dictionary, self.lists.take(pa.array(places))
        return values, ends[offsets - offsets[0]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker and file. A task has one core, so the library gets no threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, before, code = TaskContext.get().partitionId(), 0, encoder(path)
    for rows in _gathered(batches):
        values, offsets = code(rows.column("text"))
        n = rows.num_rows
        ends = offsets[1:] + np.arange(1, n + 1)  # with an end id for each text
        ids = np.insert(values.astype(np.int32), offsets[1:], end)
        starts = np.concatenate([[0], ends])
        lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
        columns = [rows.column("doc_id"), pa.array(np.full(n, part, np.int64)), pa.array(before + starts[:-1]), pa.array(np.diff(starts)), lists]
        made = pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "local_start", "n_tokens", "ids"])
        for at in range(0, n, 2_000):
            yield made.slice(at, 2_000)
        before += int(starts[-1])
        pa.default_memory_pool().release_unused()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches, put together up to BYTES: the more text at once, the fewer words are encoded again."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        step = max(1, min(batch.num_rows, batch.num_rows * BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            rows = batch.slice(at, step)
            if held and sum(x.nbytes for x in held) + rows.nbytes > BYTES:
                yield pa.concat_batches(held)
                held = []
            held.append(rows)
    if held:
        yield pa.concat_batches(held)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = END) -> None:
    """Encode docs (doc_id, text) and write (doc_id, part, local_start, n_tokens, ids) in ascending doc_id order."""
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = arrow(ordered, lambda batches: _encode(batches, vocabulary, end), f"doc_id {kind}, part long, local_start long, n_tokens long, ids array<int>")
    rows.write.options(**FILE_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids; start counts the ids of all documents before. Unread columns are not scanned."""
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    return rows.join(small(starts), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values, offsets = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        pa.default_memory_pool().release_unused()


def op2_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return arrow(read_tokens(spark, path), _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


QUERIES = {"op2_tokens": op2_tokens}
ORACLE: dict[str, str] = {}
