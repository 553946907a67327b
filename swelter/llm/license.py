"""Fuzzy search for short license notices.

A notice of m characters may occur with up to k edits. Cut into k + 1 parts, at least one
part of every such occurrence is intact (pigeonhole), so the parts are exact seeds: one
automaton finds the seeds of all notices in a single pass, and only the places around
seeds are verified by the regex library's bounded-error matching, which reports the span
and its edits. Words that name a license or its version must be intact all the same, so
edits never turn one license into another. Texts are lower-cased (A-Z), reduced to words
and joined by blanks first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swelter.llm.common import cols, hidden, let

#: The base phrases, found exactly, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: More notices, and the label of each.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the mit license", "mit"),
    ("licensed under the apache license", "apache-2"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons zero", "cc0"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd-3"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu free documentation license", "gfdl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("european union public licence", "eupl"),
    ("boost software license", "bsl"),
    ("sil open font license", "ofl"),
    ("all rights reserved", "proprietary"),
)
#: Words of notices that tell licenses apart: these must be intact.
NAMES = frozenset("mit apache 2 cc by nc noncommercial sharealike attribution zero lesser affero general documentation gnu mozilla eclipse european union boost sil reserved".split())
#: Holds beside any other license's notice, so it counts only alone.
FALLBACK = "proprietary"
#: One edit is allowed for so many characters; shorter notices must be intact.
CHARS_PER_EDIT = 10

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPANS = "array<struct<label string, base boolean, first_word long, last_word long, edits int, length int, matched string>>"
SCHEMA = f"n_words long, spans {SPANS}"


class Scanner:
    """The automaton and patterns of a list of notices; made once in each Python worker."""

    def __init__(self, base=BASE, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        self.notices: list[tuple] = []
        self.names: list[list[str]] = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (phrase, label) in enumerate((*base, *notices)):
            k = len(phrase) // chars_per_edit
            self.notices.append((phrase, label, n < len(base), k, regex.compile(f"(?e)(?:{regex.escape(phrase)}){{e<={k}}}")))
            self.names.append([w for w in phrase.split() if w in NAMES])
            cuts = [len(phrase) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(phrase[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()

    @staticmethod
    def named(joined: str, a: int, b: int, names: list[str]) -> bool:
        """Whether the whole words around a match hold all names."""
        while a > 0 and joined[a] != " ":
            a -= 1
        words = joined[a : joined.find(" ", b - 1) if " " in joined[b - 1 :] else len(joined)].split()
        return all(w in words for w in names)

    def scan(self, text: str | None) -> tuple[int, list[tuple]]:
        """Number of words, and spans (label, base, first word, last word, edits, length, matched)."""
        words = WORDS.findall((text or "").encode("utf-8", "replace").lower().decode("utf-8"))
        joined = f" {' '.join(words)} "
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(joined):
            for n, offset in places:
                phrase, _, _, k, _ = self.notices[n]
                at = end + 1 - size - offset
                span = [max(0, at - k), min(len(joined), at + len(phrase) + k)]
                held = windows.setdefault(n, [])
                if held and held[-1][0] <= span[1] and span[0] <= held[-1][1]:
                    held[-1] = [min(held[-1][0], span[0]), max(held[-1][1], span[1])]
                else:
                    held.append(span)
        spans = []
        for n, places in windows.items():
            phrase, label, base, k, pattern = self.notices[n]
            for a, b in places:
                while m := pattern.search(joined, a, b):
                    if self.named(joined, m.start(), m.end(), self.names[n]):
                        spans.append((n, m.start(), m.end(), sum(m.fuzzy_counts), m.group()))
                        a = max(m.end(), a + 1)
                    else:
                        a = m.start() + 1
            if base:  # the matches don't overlap and may be off by a blank: exact places by comparison
                exact = f" {phrase} "
                spans = [s for s in spans if not (s[0] == n and s[3] == 0)]
                for a, b in places:
                    at = joined.find(exact, max(0, a - 1), b + 1)
                    while at >= 0:
                        spans.append((n, at + 1, at + 1 + len(phrase), 0, phrase))
                        at = joined.find(exact, at + 1, b + 1)
        spans.sort(key=lambda s: (s[1], s[0]))
        out, seen, at, word = [], set(), 0, -1
        for n, a, b, edits, got in spans:
            word += joined.count(" ", at, a + 1) if a >= at else 0
            at = max(at, a + 1)
            if (n, a) in seen:
                continue
            seen.add((n, a))
            phrase, label, base, _, _ = self.notices[n]
            first = max(0, word)
            out.append((label, base, first, first + got.strip().count(" "), edits, len(phrase), got))
        return len(words), out


def scanned(docs: DataFrame, text: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """docs with `_n_words` and `_spans`, the occurrences in order of place.

    Whole texts, row by row: nothing is shuffled. Null and empty texts have no words and
    no spans. A base phrase without edits is reported at each place where its words stand
    consecutively; fuzzy matches of one notice don't overlap. Columns of docs with these
    two names are replaced, others stay whatever they are called.
    """
    docs, back = hidden(docs.drop("_n_words", "_spans"), ("_s",))

    @F.pandas_udf(SCHEMA)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(base, notices)
        names = ("label", "base", "first_word", "last_word", "edits", "length", "matched")
        for texts in batches:
            found = [scanner.scan(t) for t in texts]
            yield pd.DataFrame({"n_words": [n for n, _ in found], "spans": [[dict(zip(names, s)) for s in spans] for _, spans in found]})

    out = docs.withColumn("_s", scan(F.col(text)))
    return out.select(*cols(docs.columns), F.col("_s.n_words").alias("_n_words"), F.col("_s.spans").alias("_spans")).withColumnsRenamed(back)


def digest(spans: Column) -> dict[str, Column]:
    """Columns of a document from its spans: base places, labels and a score.

    The score is the share of intact characters of the best span, 0 without one. FALLBACK
    is a label only where there is no other.
    """
    exact = F.filter(spans, lambda s: s["base"] & (s["edits"] == 0))
    named = lambda of: F.array_sort(F.array_distinct(F.transform(of, lambda s: s["label"])))
    labels = lambda of: F.array_join(let(named(of), lambda x: F.when(F.size(x) > 1, F.array_remove(x, FALLBACK)).otherwise(x)), ",")
    starts = F.transform(exact, lambda s: s["first_word"])
    best = F.array_max(F.transform(spans, lambda s: 1 - s["edits"] / s["length"]))
    return {
        "n_base": F.size(exact).cast("long"),
        "first_word": F.array_min(starts),
        "last_word": F.array_max(starts),
        "base_labels": labels(exact),
        "labels": labels(spans),
        "score": F.coalesce(best, F.lit(0.0)),
    }
