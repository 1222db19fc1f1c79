"""Catalogue text: sections of word lists, phrases, frames and preferences, read in order into rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class CatalogError(ValueError):
    pass


def lines(text: str, include: Callable[[str], str] | None = None, name: str = "text") -> Iterator[tuple[str, str, int]]:
    """(line, file, number) without comments and blanks; `\\` at the end goes on, `$include file` reads another text."""
    held, first = "", 0
    for number, raw in enumerate(text.split("\n"), 1):
        line = re.sub(r"#(?=([^\"]*\"[^\"]*\")*[^\"]*$).*", "", raw).strip()
        if held:
            line, number = held + " " + line, first
        if line.endswith("\\"):
            held, first = line[:-1].rstrip(), number
            continue
        held = ""
        if not line:
            continue
        found = re.match(r"\$include\s+(\S+)$", line)
        if found:
            if include is None:
                raise CatalogError(f"{name}:{number}: nothing to include from")
            yield from lines(include(found.group(1)), include, found.group(1))
        else:
            yield line, name, number


#: Columns of each section's table.
SCHEMAS = {
    "settings": "name string, value string",
    "static_phrases": "words string, cat string, cls string, infl string, tags string, lemmas string",
    "ambiguous_phrases": "words string, position int, word string, by_lemma boolean, cats string",
    "verb_objects": "verb string, n_args int, case1 string, case2 string, particle string, score int",
    "verb_prepositions": "verb string, prep string, case string",
    "verb_subjects": "verb string, case string",
    "prepositions": "prep string, case string, nh boolean, common boolean",
    "preferences": "word string, worse string, better string, factor int",
    "noun_preferences": "word string, worse string, better string",
    "name_preferences": "name string",
    "disallowed_names": "name string, case string",
    "undeclinable_adjectives": "word string",
    "adjective_predicates": "adjective string, cases string, prep string, prep_case string",
    "noindex_words": "word string, cat string",
    "topics": "topic string, identifier string, word string",
}
CASES = ("nf", "þf", "þgf", "ef")


@dataclass
class Catalog:
    rows: dict[str, list[tuple]] = field(default_factory=lambda: {name: [] for name in SCHEMAS})

    def table(self, spark: SparkSession, section: str) -> DataFrame:
        return spark.createDataFrame(self.rows[section], SCHEMAS[section])

    @classmethod
    def read(cls, text: str, include: Callable[[str], str] | None = None) -> Catalog:
        out, section, state = cls(), None, {}
        for line, name, number in lines(text, include):
            found = re.match(r"\[(\w+)\]$", line)
            try:
                if found:
                    section, state = found.group(1), {}
                    if section not in SCHEMAS:
                        raise CatalogError(f"unknown section {section}")
                elif section is None:
                    raise CatalogError("a line before the first section")
                else:
                    getattr(out, f"_{section}")(_without_marks(line), state)
            except (CatalogError, ValueError, IndexError) as why:
                raise CatalogError(f"{name}:{number}: {why}") from why
        return out

    @classmethod
    def load(cls, path: str) -> Catalog:
        base = Path(path).parent
        return cls.read(Path(path).read_text(encoding="utf-8"), lambda f: (base / f).read_text(encoding="utf-8"))

    def add(self, section: str, *row) -> None:
        self.rows[section].append(row)

    def _settings(self, line: str, state: dict) -> None:
        name, sep, value = (x.strip() for x in line.partition("="))
        if not sep:
            raise CatalogError("no =")
        self.add("settings", name, value)

    def _static_phrases(self, line: str, state: dict) -> None:
        if line.startswith("meaning"):
            state["meaning"] = line.split("=", 1)[1].split()
            return
        words, *more = re.findall(r'"([^"]*)"', line)
        cat, cls_, infl = state.get("meaning", ["ao", "frasi", "-"])
        self.add("static_phrases", words, cat, cls_, infl, *(more + [None, None])[:2])

    def _ambiguous_phrases(self, line: str, state: dict) -> None:
        found = re.match(r'"([^"]+)"\s+(.*)$', line)
        if not found:
            raise CatalogError("no phrase")
        words, cats = found.group(1).split(), found.group(2).split()
        if len(words) != len(cats):
            raise CatalogError("as many words as categories are needed")
        for k, (w, c) in enumerate(zip(words, cats)):
            self.add("ambiguous_phrases", found.group(1), k, w.rstrip("*"), w.endswith("*"), c)

    def _verb_objects(self, line: str, state: dict) -> None:
        score = re.search(r"\$score\(\s*([+-]?\d+)\s*\)", line)
        line = re.sub(r"\$\w+\([^)]*\)", "", line)
        head, *preps = line.split("/")
        verb, *rest = head.split()
        particle = next((w[1:] for w in rest if w.startswith("*")), None)
        cases = [w.strip("|") for w in rest if not w.startswith("*")]
        if any(c not in CASES for c in cases):  # clauses and fixed phrases are read over
            return
        if len(cases) > 2:
            raise CatalogError("more than two objects")
        self.add("verb_objects", verb, len(cases), *(cases + [None, None])[:2], particle, int(score.group(1)) if score else 0)
        for prep in preps:
            words = prep.split()
            if words and words[-1] in CASES:
                self.add("verb_prepositions", verb, " ".join(words[:-1]), words[-1])

    def _verb_subjects(self, line: str, state: dict) -> None:
        if "=" in line:
            state["case"] = line.split("=", 1)[1].strip()
            return
        if "case" not in state:
            raise CatalogError("a verb before its subject's case")
        self.add("verb_subjects", line.split()[0], state["case"])

    def _prepositions(self, line: str, state: dict) -> None:
        parts = line.split()
        nh = "nh" in parts
        parts = [p for p in parts if p != "nh"]
        common = parts[-2].endswith("*")
        if parts[-1] not in CASES:
            raise CatalogError(f"unknown case {parts[-1]}")
        self.add("prepositions", " ".join(parts[:-1]).rstrip("*"), parts[-1], nh, common)

    def _preferences(self, line: str, state: dict) -> None:
        arrow = re.search(r"<{1,3}", line)
        if not arrow:
            raise CatalogError("no <")
        words, better = line[: arrow.start()].split(), line[arrow.end() :].split()
        if len(words) < 2 or not better:
            raise CatalogError("nothing to prefer")
        for w in words[1:]:
            for b in better:
                self.add("preferences", words[0], w, b, (1, 3, 9)[len(arrow.group()) - 1])

    def _noun_preferences(self, line: str, state: dict) -> None:
        left, _, better = line.partition("<")
        word, worse = left.split()
        self.add("noun_preferences", word, worse, better.strip())

    def _name_preferences(self, line: str, state: dict) -> None:
        self.add("name_preferences", line)

    def _disallowed_names(self, line: str, state: dict) -> None:
        name, *cases = line.split()
        for c in cases or CASES:
            self.add("disallowed_names", name, c)

    def _undeclinable_adjectives(self, line: str, state: dict) -> None:
        self.add("undeclinable_adjectives", line.split()[0])

    def _adjective_predicates(self, line: str, state: dict) -> None:
        head, *preps = line.split("/")
        adjective, *cases = head.split()
        self.add("adjective_predicates", adjective, " ".join(cases), None, None)
        for prep in preps:
            words = prep.split()
            self.add("adjective_predicates", adjective, None, " ".join(words[:-1]), words[-1])

    def _noindex_words(self, line: str, state: dict) -> None:
        if line.startswith("category"):
            state["cat"] = line.split("=", 1)[1].strip()
            return
        self.add("noindex_words", line, state.get("cat"))

    def _topics(self, line: str, state: dict) -> None:
        if line.startswith("topic"):
            value = line.split("=", 1)[1].strip()
            found = re.match(r"(.*?)\s*\((\w+)\)$", value)
            state["topic"] = found.groups() if found else (value, None)
            return
        self.add("topics", *state.get("topic", (None, None)), line)


def _without_marks(line: str) -> str:
    """A line without the remarks that only a grammar checker reads."""
    return re.sub(r"\$error\([^)]*\)", "", line).strip()
