"""Bracketed treebanks: s-expressions to node rows, with the META block and lemmas."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_PART = re.compile(r"[()]|[^\s()]+")


def parse(text: str) -> list:
    """Nested lists of the first expression; unbalanced brackets are an error."""
    stack: list[list] = [[]]
    for part in _PART.findall(text):
        if part == "(":
            stack.append([])
        elif part == ")":
            if len(stack) < 2:
                raise ValueError("unbalanced: ) without (")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(part)
    if len(stack) != 1:
        raise ValueError("unbalanced: ( without )")
    return stack[0]


def read(text: str) -> tuple[dict[str, str], list[dict]]:
    """(meta, node rows) of one tree: a leaf is (TAG word) or (TAG word (lemma x))."""
    meta: dict[str, str] = {}
    rows: list[dict] = []

    def walk(x: list, parent: str | None, depth: int, sib: int) -> None:
        tag, *rest = x
        words = [w for w in rest if isinstance(w, str)]
        lists = [w for w in rest if isinstance(w, list)]
        lemma = next((w[1] for w in lists if w and w[0] == "lemma" and len(w) > 1), None)
        lists = [w for w in lists if w and w[0] != "lemma"]
        own = {"node": str(len(rows)), "parent": parent, "pre": len(rows) + 1, "depth": depth, "sib_ix": sib, "tag": tag, "text": " ".join(words).replace("_", " ") if words else None, "lemma": lemma}
        rows.append(own)
        for i, c in enumerate(lists, 1):
            walk(c, own["node"], depth + 1, i)
        own["post"] = len(rows) - depth

    top = parse(text)
    while len(top) == 1 and isinstance(top[0], list) and top[0] and isinstance(top[0][0], list):
        top = top[0]
    sib = 0
    for x in (x for x in top if isinstance(x, list) and x):
        if x[0] == "META":
            meta |= {k[0]: " ".join(w for w in k[1:] if isinstance(w, str)) for k in x[1:] if isinstance(k, list) and k}
        elif isinstance(x[0], str):
            sib += 1
            walk(x, None, 0, sib)
    return meta, rows


_SQL = "tree string, node string, parent string, pre int, post int, depth int, sib_ix int, tag string, text string, lemma string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SQL.split(", ")]
    kinds = [pa.int32() if x.endswith(" int") else pa.string() for x in _SQL.split(", ")]
    for batch in batches:
        rows = [{"tree": t, **r} for t, x in zip(batch.column("tree").to_pylist(), batch.column("bracket").to_pylist()) for r in read(x or "")[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)


def nodes(trees: DataFrame) -> DataFrame:
    """The node table of (tree, bracket)."""
    return trees.select("tree", "bracket").mapInArrow(_read, _SQL)
