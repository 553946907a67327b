"""Fill-in-the-middle: cuts a text at two of its units and puts the middle last.

Units are runs of ASCII letters and all other single code points. An automaton (Aho and
Corasick) scans a text once and reports where the class of its characters changes, and
sentinels. Between two changes lie letters, one unit, or others, one unit each, so these
events alone tell how many units stand before any place: the place after a number of
units is looked up by rank, and nothing is listed unit by unit. Tasks in Python find the
places; the texts are cut, joined and put back by Spark's own functions.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swelter.llm.common import cols, hidden

#: The sentinels, and the percentages of texts that are transformed and put suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20

#: What the automaton reports of a place.
CHANGE, SENTINEL = 0, 1


def _alphabet() -> tuple[bytes, list[bytes], list[bytes]]:
    """A table of ASCII characters to those that matter, which are letters, and which are others.

    Letters and others that no sentinel holds are as good as one of their class.
    """
    own = {c for s in (PREFIX, SUFFIX, MIDDLE) for c in s}
    letters = sorted({c for c in own if c in string.ascii_letters} | {"a"})
    others = sorted({c for c in own if c not in string.ascii_letters} | {" "})
    table = "".join(chr(i) if chr(i) in own else "a" if chr(i) in string.ascii_letters else " " for i in range(256))
    return table.encode("latin-1"), letters, others


class Scanner:
    """Finds the units of texts. Made once in each Python worker."""

    def __init__(self):
        self.table, letters, others = _alphabet()
        self.letters = frozenset(letters)
        self.automaton = ahocorasick.Automaton()
        for a in letters:
            for b in others:
                self.automaton.add_word(a + b, CHANGE)
                self.automaton.add_word(b + a, CHANGE)
        for s in (PREFIX, SUFFIX, MIDDLE):
            self.automaton.add_word(s, SENTINEL)
        self.automaton.make_automaton()

    def events(self, text: str) -> tuple[np.ndarray, bool, bool]:
        """(places where the class changes, whether letters come first, whether a sentinel is there)."""
        # one ASCII character for each code point: what isn't ASCII is no letter and in no sentinel
        plain = text.encode("ascii", "replace").translate(self.table).decode("ascii")
        found = np.fromiter((2 * end + what for end, what in self.automaton.iter(plain)), dtype=np.int64)
        return found[found % 2 == CHANGE] // 2, plain[:1] in self.letters, bool((found % 2 == SENTINEL).any())

    def cuts(self, text: str, first: int, second: int) -> tuple[int, bool, int, int]:
        """(n units, whether a sentinel is there, code points before the middle and before the suffix).

        first and second are taken modulo n + 1; the prefix has as many units as the
        smaller and prefix and middle as many as the larger.
        """
        changes, letters, sentinel = self.events(text)
        starts = np.concatenate([[0], changes]) if text else np.zeros(0, dtype=np.int64)
        lengths = np.diff(np.append(starts, len(text)))
        units = np.where(np.arange(len(starts)) % 2 == (0 if letters else 1), 1, lengths)
        upto = np.cumsum(units)
        n = int(upto[-1]) if len(upto) else 0

        def place(k: int) -> int:
            if k == 0:
                return 0
            at = int(np.searchsorted(upto, k))  # the stretch that holds the k-th unit
            into = k - int(upto[at] - units[at])
            return int(starts[at]) + (int(lengths[at]) if units[at] == 1 else into)

        a, b = sorted((first % (n + 1), second % (n + 1)))
        return n, sentinel, place(a), place(b)


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2^32 from the seed and a key; a null key counts as an empty one."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """docs with `_n`, `_form`, `_prefix`, `_middle`, `_suffix` and `_output`.

    `_form` is psm, spm or plain: texts that are empty or hold a sentinel, and those that
    the draw leaves alone, stay as they are and have no parts (null). Null texts count as
    empty. Whole texts, row by row; nothing is shuffled. What a row becomes depends on
    its key and text alone, so rows that repeat come out alike. Columns of docs with
    these names are replaced, others stay whatever they are called.
    """
    names = ("_n", "_form", "_prefix", "_middle", "_suffix", "_output")
    docs, back = hidden(docs.drop(*names), ("_c", "_d", "_t"))

    @F.pandas_udf("n long, sentinel boolean, a int, b int")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for texts, first, second in batches:
            yield pd.DataFrame([scanner.cuts(t, x, y) for t, x, y in zip(texts, first, second)], columns=["n", "sentinel", "a", "b"])

    out = docs.withColumns({"_t": F.coalesce(F.col(text), F.lit("")), "_d": F.array(*draws(F.col(key), seed))})
    out = out.withColumn("_c", cut(F.col("_t"), F.get("_d", F.lit(0)), F.get("_d", F.lit(1))))
    plain = (F.col("_c.n") == 0) | F.col("_c.sentinel") | (F.get("_d", F.lit(2)) % 100 >= TRANSFORMED)
    form = F.when(plain, "plain").when(F.get("_d", F.lit(3)) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    a, b, whole = F.col("_c.a"), F.col("_c.b"), F.col("_t")
    part = lambda start, n: F.when(F.col("_form") != "plain", F.substring(whole, start + 1, n))
    out = out.withColumn("_form", form).withColumns({"_prefix": part(F.lit(0), a), "_middle": part(a, b - a), "_suffix": part(b, F.length(whole) - b)})
    p, m, s = F.lit(PREFIX), F.lit(MIDDLE), F.lit(SUFFIX)
    output = F.when(F.col("_form") == "psm", F.concat(p, "_prefix", s, "_suffix", m, "_middle")).when(F.col("_form") == "spm", F.concat(s, "_suffix", p, "_prefix", m, "_middle")).otherwise(whole)
    out = out.withColumns({"_output": output, "_n": F.col("_c.n")})
    return out.select(*cols(docs.columns), *names).withColumnsRenamed(back)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from.

    No sentinel starts with the end of one, so the first of each kind in an output is the
    one that was put there.
    """
    after = lambda s: F.locate(s, output) + len(s)
    between = lambda s, e: F.substring(output, after(s), F.locate(e, output) - after(s))
    last = F.substring(output, after(MIDDLE), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), last, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), last, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
