"""Spelling variants: words that differ by one inserted, deleted or replaced letter.

Words are found by an inverted index of positional q-grams. The index is dealt to tasks in
blocks by long grams: of two words one edit apart, the shorter of m letters, the first
m // 2 letters or the last m - m // 2 are the same, so a word is posted to the blocks of
both its halves, as the shorter or equal one and as the longer one. A block that holds
more than BLOCK words is split by the halves of what its words don't share yet, and so on,
so blocks stay small whatever the words, and no pair is lost.

In a block, the postings of the rarest bigrams of a word, at the same place or one to
either side, are merged by a heap. A word that holds too few of the others as well (an
edit touches two bigrams at most) is dropped; what is left is compared.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.llm.common import scratch, written

#: Fixed value: what words are made of.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Of so many (document, word) hashes one has a letter deleted.
NOISE = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A word's form has at least so many times its occurrences.
RATIO = 2
#: Words of a block that isn't split, and words that a task counts before it hands them on.
BLOCK, AT_ONCE = 2000, 200_000
#: Postings of words that a task merges, about.
TASK_ROWS = 30_000
Q = 2


def runs_of(text: str | None) -> list[str]:
    """Maximal runs of letters, only A-Z lower-cased."""
    return RUN.findall((text or "").encode("utf-8").lower().decode("utf-8"))


def noised(run: str, start: int) -> str:
    """run, or run without a letter where its hash says so; start is the hash of what stands before it."""
    h = zlib.crc32(run.encode("utf-8"), start)
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least LEAST_LENGTH letters found LEAST_COUNT times or more in whole texts.

    Null texts have no words; a null key counts as an empty one; rows that repeat count
    each time. Tasks count before anything moves.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        handed = lambda: pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
        for b in batches:
            for k, t in zip(b["key"].to_pylist(), b["text"].to_pylist()):
                start = zlib.crc32(f"{k}:".encode())
                for run, n in Counter(runs_of(t)).items():
                    if len(run) >= LEAST_LENGTH:
                        w = noised(run, start)
                        if len(w) >= LEAST_LENGTH:
                            held[w] += n
                if len(held) >= AT_ONCE:
                    yield handed()
                    held.clear()
        yield handed()

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with one letter replaced or one put in; b isn't shorter."""
    p = shared(a, b)
    if len(a) == len(b):
        return p < len(a) and a[p + 1 :] == b[p + 1 :]
    return a[p:] == b[p + 1 :]


def shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


class Block:
    """The index of one block: words of m letters and of m + 1 that share their first `lo` and last `hi`."""

    def __init__(self, m: int, lo: int, hi: int, words: list[str]):
        self.m, self.lo, self.hi, self.rest = m, lo, hi, m - lo - hi
        self.words = sorted(words, key=lambda w: (len(w), w))
        self.inner = [f"\0{w[lo : len(w) - hi]}\1" for w in self.words]
        self.postings: dict[tuple[str, int], list[int]] = {}
        for i, s in enumerate(self.inner):
            for p in range(len(s) - 1):
                self.postings.setdefault((s[p : p + Q], p), []).append(i)
        self.members = {k: set(v) for k, v in self.postings.items()}

    def near(self) -> Iterator[tuple[str, str]]:
        """Pairs one edit apart whose path through the splits leads here; the first isn't longer."""
        for i, w in enumerate(self.words):
            if len(w) > self.m:
                return
            for j in self.candidates(i):
                other = self.words[j]
                if one_edit(w, other) and self.is_home(w, other):
                    yield w, other

    def candidates(self, i: int) -> Iterator[int]:
        """Later words that hold enough of the bigrams of the i-th about where it has them."""
        if self.rest == 1:  # all words of m letters here differ by just that letter
            yield from (j for j in range(i + 1, len(self.words)) if len(self.words[j]) == self.m or self.inner[i][1] in self.inner[j])
            return
        s, get = self.inner[i], self.postings.get
        around = [[(s[p : p + Q], p + d) for d in (-1, 0, 1)] for p in range(len(s) - 1)]
        lists = [[x for k in ks if (x := get(k))] for ks in around]
        order = sorted(range(len(lists)), key=lambda g: sum(map(len, lists[g])))
        # an edit touches Q grams of the word, so one of any Q + 1 is intact
        few, others = order[: Q + 1], [[self.members[k] for k in around[g] if k in self.members] for g in order[Q + 1 :]]
        last, held = -1, 0
        for j in [*heapq.merge(*[x for g in few for x in lists[g]]), -1]:
            if j == last:
                held += 1
                continue
            if last > i:
                missing = max(0, Q + 1 - held)
                for sets in others:
                    if missing > Q:
                        break
                    missing += not any(last in x for x in sets)
                if missing <= Q:
                    yield last
            last, held = j, 1

    def is_home(self, a: str, b: str) -> bool:
        """A pair may lie in blocks of both halves; it belongs to that of the first then."""
        p, lo, hi = shared(a, b), 0, 0
        while (lo, hi) != (self.lo, self.hi):
            t = self.m - lo - hi
            if p >= lo + t // 2:
                lo += t // 2
            else:
                hi += t - t // 2
            if lo > self.lo or hi > self.hi:
                return False
        return True


def _halved(rows: DataFrame) -> DataFrame:
    """rows (word, m, lo, hi) twice, with the first and with the last half of the rest shared as well."""
    t = F.col("m") - F.col("lo") - F.col("hi")
    half = F.floor(t / 2).cast("int")
    sides = F.array(F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), (F.col("hi") + t - half).alias("hi")))
    return rows.select("word", "m", F.explode(sides).alias("s")).select("word", "m", F.col("s.lo").cast("int").alias("lo"), F.col("s.hi").cast("int").alias("hi"))


def blocks(words: DataFrame) -> DataFrame:
    """(key, word, m, lo, hi): words (word) dealt to blocks of at most BLOCK that hold a pair at least.

    Blocks whose words share all but one letter aren't split any more; the alphabet
    bounds them.
    """
    length = F.length("word")
    rows = words.select("word", F.explode(F.array(length, length - 1)).alias("m"), F.lit(0).alias("lo"), F.lit(0).alias("hi")).where(F.col("m") >= LEAST_LENGTH)
    done = None
    while True:
        beginning, end = F.substring(F.col("word"), F.lit(1), F.col("lo")), F.substring(F.col("word"), length - F.col("hi") + 1, F.col("hi"))
        rows = _halved(rows).withColumn("key", F.concat_ws(" ", F.col("m").cast("string"), beginning, end))
        own = F.count_if(length == F.col("m"))
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), own.alias("own")).where("size > 1 and own > 0").select(F.col("key").alias("_key"), "size")
        rows = written(rows.join(sizes, F.col("key") == F.col("_key")).drop("_key"), "blocks")
        large = (F.col("size") > BLOCK) & (F.col("m") - F.col("lo") - F.col("hi") > 1)
        leaves = rows.where(~large).drop("size")
        done = leaves if done is None else done.unionByName(leaves)
        rows = rows.where(large).select("word", "m", "lo", "hi")
        if rows.isEmpty():
            return done


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): each two distinct words one edit apart, once."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for t in batches for r in zip(*(t[c].to_pylist() for c in ("key", "m", "lo", "hi", "word"))))
        for (_, m, lo, hi), own in itertools.groupby(rows, key=lambda r: r[:4]):
            found = list(Block(m, lo, hi, [r[4] for r in own]).near())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found)], names=["a", "b"])

    dealt = blocks(words)
    # rows are short and their work isn't, so tasks are sized by rows
    return dealt.repartition(max(1, dealt.count() // TASK_ROWS), "key").sortWithinPartitions("key").mapInArrow(pairs, "a string, b string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of the way from form to form.

    Each turn doubles the steps that are taken; counts double with each step, so ways are short.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("_w"), F.col("root").alias("_further"))
        moved = written(now.join(further, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("went")), "roots")
        now = moved.drop("went")
        if moved.where("went").isEmpty():
            return now


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of the vocabulary.

    A word's form is the commonest of its near words, the first in code-point order of
    several, if it is RATIO times as common as the word; its root is where forms lead.
    A table without texts has no words. Columns of docs besides key and text don't matter.
    """
    with scratch(docs.sparkSession):
        words = written(vocabulary(docs, key, text), "words")
        pairs = written(near_pairs(words.select("word")), "pairs")
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
        # a word has no more near words than its length and the alphabet allow
        best = counted.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("n"), "b")).alias("best"))
        has = -F.col("best.n") >= RATIO * F.col("n")
        out = words.join(best, F.col("word") == F.col("a"), "left").select(
            "word", F.when(has, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.n")).alias("form_n"),
        )
        out = written(out, "variants")
        ends = roots(out.where("form is not null")).select(F.col("word").alias("_w"), "root")
        out = out.join(ends, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return written(out, "variants", keep=True)
