"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A sketch holds the LEAST least of a text's occurrence-labelled five-word k-mers under one
of SKETCHES hash functions, in the order in which they stand in the text. Two texts meet
in a bucket if they hold the same two k-mers of a sketch in the same order, so the more
likely, the better they align: texts that agree in scattered places are told from those
with the same k-mers in another order.

In a bucket of up to SMALL texts all pairs are candidates; in a larger one all texts are
compared with its least, and buckets with one least make up a crowd. Texts of a crowd
that are like its least hang together by it. Each that is unlike has to be compared with
the whole crowd. Where they are up to SMALL, this is done but for texts that are so near
the least that they can't be near it (edit distances keep the triangle inequality). Where
more differ, the crowd shares a passage of unlike texts, or drifts: it is then dealt to
blocks of texts of about one length, and a block's words are counted against another's by
one product of matrices. Similar texts have at least so many words in common as are
intact, so this shows most pairs unlike without looking at them singly; of the others
those are aligned that aren't connected yet, so a block makes no more links than it has
texts. No bucket is cut, no text left out and no pair of a bucket lost.

Candidates are similar if their words align with a share of at least 0.8 of the longer
text's words intact (1 - edit distance / length). Classes are the connected components.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swelter.llm.common import cols, free, scratch, written

K, SKETCHES, LEAST, SMALL, SIMILARITY = 5, 12, 4, 16, 0.8
WORD = re.compile(r"[^\W_]+")


def node_of(text: Column) -> Column:
    """Names a text: rows of equal texts are one node; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


#: Words whose hashes a task remembers.
MEMO_WORDS = 50_000


def word_hashes(text: str | None, memo: dict[str, int]) -> np.ndarray:
    def look(w: str) -> int:
        h = zlib.crc32(w.encode("utf-8", "replace"))
        if len(memo) < MEMO_WORDS:
            memo[w] = h
        return h

    words, get = WORD.findall((text or "").lower()), memo.get
    return np.array([get(w) or look(w) for w in words], dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers: multiply, shift, multiply."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all k-word windows, equal ones labelled by their occurrence.

    A text of fewer than k words is one k-mer.
    """
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = _mixed(out + words[i : len(words) - k + 1 + i].astype(np.uint64) + np.uint64(1))
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    if new.all():
        return out
    at = np.arange(len(out))
    label = np.empty(len(out), dtype=np.uint64)
    label[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(label > 0, _mixed(out + label), out)


_SEEDS = np.arange(1, SKETCHES + 1, dtype=np.uint64)
_XOR = ((_SEEDS * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32)[:, None]
_ODD = ((_SEEDS * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
#: k-mers that are hashed at a time, which bounds the memory of long texts.
AT_ONCE = 1 << 16


def sketches(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket numbers, the two k-mers that each stands for, in the order of the text).

    A text of one k-mer has one bucket; empty for a text without k-mers.
    """
    if not len(grams):
        return np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64)
    short = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    kept, least = [], None
    for first in range(0, len(grams), AT_ONCE):
        h = (short[None, first : first + AT_ONCE] ^ _XOR) * _ODD
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        rows = np.arange(SKETCHES)
        take = min(LEAST, h.shape[1])
        at, value = np.empty((SKETCHES, take), dtype=np.int64), np.empty((SKETCHES, take), dtype=np.uint32)
        for j in range(take):
            at[:, j] = h.argmin(axis=1)
            value[:, j] = h[rows, at[:, j]]
            h[rows, at[:, j]] = np.uint32(0xFFFFFFFF)
        kept.append((at + first, value))
    if len(kept) > 1:  # the least of each block's least
        at, value = np.hstack([x for x, _ in kept]), np.hstack([x for _, x in kept])
        best = np.argsort(value, axis=1, kind="stable")[:, :LEAST]
        least = np.take_along_axis(at, best, axis=1)
    else:
        least = kept[0][0]
    least.sort(axis=1)  # the order of the text
    i, j = np.triu_indices(least.shape[1], 1) if least.shape[1] > 1 else (np.array([0]), np.array([0]))
    pairs = np.stack([grams[least[:, i]].ravel(), grams[least[:, j]].ravel()], axis=1)
    key, one = np.unique(_mixed(_mixed(pairs[:, 0]) + pairs[:, 1]).view(np.int64), return_index=True)
    return key, pairs[one].view(np.int64)


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences if it is at most `most`, else most + 1."""
    if max(len(a), len(b)) - _common(a, b) > most:
        return most + 1
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[::-1][:n] == b[::-1][:n]
    tail = n if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not len(a) or not len(b):
        return max(len(a), len(b))
    return _in_band(a.tolist(), b.tolist(), most)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """At least as many as the words that both hold, counted by 12 bits of them."""
    bins = [np.bincount(x & np.uint32(0xFFF), minlength=4096) for x in (a, b)]
    return int(np.minimum(*bins).sum())


def _in_band(a: list[int], b: list[int], most: int) -> int:
    """Edit distance, most + 1 if it is more, within `most` of the diagonal.

    A column of the table is kept as two bit sets, of the steps up and down in it, which
    whole-number operations move on by one column (Myers, Hyyro). Only the rows within
    the band are kept; they slide along by BLOCK columns at a time.
    """
    m, n = len(a), len(b)
    width = 2 * most + BLOCK + 1
    if m <= 2 * width:
        return _columns(a, b, most)
    # rows of a in the window: first <= i < first + size; the row above it counts as one more a column
    size, first = width, 0
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    mask = (1 << size) - 1
    up, down, bottom, at = mask, 0, size, {}
    for col in range(n):
        if col % BLOCK == 0:
            shift = max(0, min(col - most, m - size) - first)
            if shift:
                # new rows below go up by one each
                up, down = (up >> shift) | (((1 << shift) - 1) << (size - shift)), down >> shift
                first, bottom = first + shift, bottom + shift
            at = {}
        y = b[col]
        eq = at.get(y)
        if eq is None:
            eq = 0
            for i in _within(where.get(y, ()), first, first + size):
                eq |= 1 << (i - first)
            at[y] = eq
        x = eq | down
        d0 = (((eq & up) + up) ^ up) | x
        hp = down | (mask & ~(d0 | up))
        hn = up & d0
        if hp >> (size - 1) & 1:
            bottom += 1
        elif hn >> (size - 1) & 1:
            bottom -= 1
        hp, hn = (hp << 1) | 1, hn << 1
        up = (hn | ~(d0 | hp)) & mask
        down = hp & d0 & mask
    return min(bottom, most + 1)


#: Columns after which the band moves on.
BLOCK = 1024


def _within(places: list[int] | tuple, low: int, high: int) -> list[int] | tuple:
    return places[bisect.bisect_left(places, low) : bisect.bisect_left(places, high)]


def _columns(a: list[int], b: list[int], most: int) -> int:
    """_in_band() with whole columns."""
    if len(a) < len(b):
        a, b = b, a
    at: dict[int, int] = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | (1 << i)
    n = len(b)
    mask, last = (1 << n) - 1, 1 << (n - 1)
    up, down, got, left, get = mask, 0, n, len(a), at.get
    for y in a:
        eq = get(y, 0)
        x = eq | down
        d0 = (((eq & up) + up) ^ up) | x
        hp = down | (mask & ~(d0 | up))
        hn = up & d0
        if hp & last:
            got += 1
        elif hn & last:
            got -= 1
        left -= 1
        if got - left > most:
            return most + 1
        hp, hn = (hp << 1) | 1, hn << 1
        up = (hn | ~(d0 | hp)) & mask
        down = hp & d0 & mask
    return min(got, most + 1)


def unpacked(words: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(words), dtype="<u4")


#: Texts that are sketched before their rows are handed over.
AT_A_TIME = 500


def sketched(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, id, key, n, words, buckets): one row per row of docs, whole texts, nothing shuffled.

    id is a short name of the text: candidates are found by it, links are between nodes.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        for b in batches:
            for first in range(0, len(b), AT_A_TIME):
                part = b.iloc[first : first + AT_A_TIME]
                words = [word_hashes(t, memo) for t in part["text"]]
                yield pd.DataFrame({
                    "node": part["node"].to_numpy(), "id": part["id"].to_numpy(), "key": part["key"].astype("Int64").array, "n": [len(w) for w in words],
                    "words": [zlib.compress(w.astype("<u4").tobytes(), 1) for w in words], "buckets": [sketches(kmers(w))[0] for w in words],
                })

    rows = docs.select(node_of(F.col(text)).alias("node"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("id"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(of, "node binary, id long, key long, n int, words binary, buckets array<long>")


def _pairs_within(groups: DataFrame, members: str) -> DataFrame:
    """(a, b) of each two of a group's members, an array of SMALL at most."""
    each = groups.select(F.array_sort(members).alias("all")).select("all", F.posexplode("all").alias("i", "a"))
    return each.select("a", F.explode(F.slice("all", F.col("i") + 2, SMALL)).alias("b"))


def candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b), stars (a, b)) of rows (id, h); a is the smaller id.

    One aggregate with partial sums finds the buckets of two texts or more, and the pair
    itself where there are no more rows. Only members of other buckets are looked up. The
    stars are the comparisons of buckets above SMALL with their least; pairs has them too.
    """
    seen = rows.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).where("a <> b")
    seen = written(seen, "shared")
    met = written(rows.join(seen.where("n > 2").select("h"), "h").distinct(), "members")
    sizes = met.groupBy("h").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    met = written(met.join(sizes, "h"), "members")
    inside = _pairs_within(met.where(F.col("size") <= SMALL).groupBy("h").agg(F.collect_list("id").alias("ids")), "ids")
    star = met.where((F.col("size") > SMALL) & (F.col("id") > F.col("least"))).select(F.col("least").alias("a"), F.col("id").alias("b"))
    star = written(star.distinct(), "stars")
    pairs = seen.where("n = 2").select("a", "b").unionByName(inside).unionByName(star).distinct()
    return written(pairs, "candidates"), star


def compared(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(a, b, la, lb, na, nb, similar, d) of distinct pairs (a, b) of ids.

    d is the edit distance of similar texts, and no more than it for others; na and nb are
    the nodes, la and lb the numbers of words. Lengths that are too unlike decide before
    any words move.
    """
    lengths = words.select("id", "n").distinct()
    pairs = pairs.join(lengths.select(F.col("id").alias("a"), F.col("n").alias("la")), "a").join(lengths.select(F.col("id").alias("b"), F.col("n").alias("lb")), "b")
    possible = F.least("la", "lb") >= F.lit(similarity) * F.greatest("la", "lb")
    side = lambda x: words.select(F.col("id").alias(x), F.col("node").alias(f"n{x}"), F.col("words").alias(f"w{x}"))
    joined = pairs.where(possible).join(side("a"), "a").join(side("b"), "b")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            got = []
            for x, y in zip(t["wa"], t["wb"]):
                u, v = unpacked(x), unpacked(y)
                most = int((1 - similarity) * max(len(u), len(v)) + 1e-9)
                d = distance(u, v, most)
                got.append((d <= most, d if d <= most else max(d, max(len(u), len(v)) - _common(u, v))))
            yield t.drop(columns=["wa", "wb"]).assign(similar=[x for x, _ in got], d=[x for _, x in got])

    near = joined.select("a", "b", "la", "lb", "na", "nb", "wa", "wb").mapInPandas(align, "a long, b long, la int, lb int, na binary, nb binary, similar boolean, d int")
    none = F.lit(None).cast("binary")
    far = pairs.where(~possible).select("a", "b", "la", "lb", none.alias("na"), none.alias("nb"), F.lit(False).alias("similar"), F.abs(F.col("la") - F.col("lb")).alias("d"))
    return near.unionByName(far)


def links(table: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(na, nb): nodes of similar texts, enough of them to connect all that meet in a bucket.

    table: the written result of sketched(). Texts without words take no part.
    """
    spark = table.sparkSession
    with scratch(spark):
        texts = table.where("n > 0")
        pairs, star = candidates(texts.select("id", F.explode("buckets").alias("h")))
        # later comparisons have none but texts of these pairs; one row of each text
        paired = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        words = written(texts.select("id", "node", "n", "words").join(paired, "id", "left_semi").dropDuplicates(["id", "node"]), "words")
        first = written(compared(pairs, words, similarity), "links")
        # members of crowds (named by their least) with what is known of their distance from it
        known = written(star.join(first, ["a", "b"]).select(F.col("a").alias("h"), F.col("b").alias("id"), F.col("lb").alias("n"), "similar", "d"), "known")
        unlike = known.where("not similar")
        counts = written(unlike.groupBy("h").agg(F.count("*").alias("unlike")), "unlike-counts")
        asked = unlike.select("h", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("d").alias("dx"))
        few = asked.join(counts.where(F.col("unlike") <= SMALL).select("h"), "h")
        longer, bound = F.greatest("n", "nx"), F.lit(1 - similarity)
        unproven = ~F.col("similar") | (F.col("dx") - F.col("d") <= bound * longer + 1e-9)
        fits = (F.abs(F.col("n") - F.col("nx")) <= bound * longer + 1e-9) & (F.col("x") != F.col("id"))
        more = known.join(few.withColumnRenamed("h", "_h"), (F.col("h") == F.col("_h")) & fits & unproven).select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))
        more = written(more.distinct().join(pairs, ["a", "b"], "left_anti"), "candidates")
        second = compared(more, words, similarity)
        mixed = known.join(counts.where(F.col("unlike") > SMALL).select("h"), "h").select("h", "id", "n", "similar")
        found = first.unionByName(second).where("similar").select("na", "nb").unionByName(_by_words(mixed, words, similarity))
        return written(found.distinct(), "links", keep=True)


#: Numbers of a block's matrix, texts of a block at most and at least, and most columns.
CELLS, MOST_TEXTS, LEAST_TEXTS, MOST_BINS = 1 << 23, 2000, 32, 1 << 18


def _bins(length: Column) -> Column:
    """Columns of the matrix for texts of up to so many words: 16 for each word, so that few words share one by chance."""
    return F.least(F.lit(float(MOST_BINS)), F.pow(F.lit(2.0), F.ceil(F.log2(16 * length))))


def counted(words: list[bytes], bins: int) -> np.ndarray:
    """(texts, bins): how many of a text's words, each labelled by its occurrence, fall to a bin."""
    out = np.zeros((len(words), bins), dtype=np.float32)
    for row, w in zip(out, words):
        np.add.at(row, (kmers(unpacked(w), 1) % np.uint64(bins)).astype(np.int64), 1)
    return out


def _by_words(crowds: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(na, nb): nodes of similar texts of a crowd, enough to connect all that are similar.

    crowds: (h, id, n, similar), the texts of crowds but for their leasts, n words long;
    those that are similar to their least hang together already. Texts are dealt by the
    class of their length (similar ones are of the same class or next to it) and, where
    a class has more texts than a block, by a hash.
    """
    step = F.lit(math.log(1 / similarity))
    crowds = crowds.withColumn("cls", F.floor(F.log("n") / step).cast("int"))
    room = F.greatest(F.lit(LEAST_TEXTS), F.least(F.lit(MOST_TEXTS), F.lit(CELLS) / _bins(F.exp((F.col("cls") + 2) * step))))
    blocks = lambda n: F.ceil(n / room).cast("int")
    sizes = crowds.groupBy("h", "cls").agg(blocks(F.count("*")).alias("all"), blocks(F.count_if(~F.col("similar"))).alias("unlike"))
    sizes = written(sizes, "crowd-sizes")
    own, other = crowds.join(sizes, ["h", "cls"]), sizes.select(F.col("h").alias("_h"), F.col("cls").alias("_cls"), F.col("all").alias("_all"), F.col("unlike").alias("_unlike"))
    beside = (F.col("h") == F.col("_h")) & (F.abs(F.col("cls") - F.col("_cls")) <= 1)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    nth = lambda n: F.pmod(F.xxhash64("id", "h"), F.col(n)).cast("int")
    asking = own.where("not similar").join(other.where("_all > 0"), beside).select("h", "id", "n", "similar", F.lit(True).alias("asks"), F.col("cls").alias("c1"), nth("unlike").alias("b1"), F.col("_cls").alias("c2"), spread("_all").alias("b2"))
    asked = own.join(other.where("_unlike > 0"), beside).select("h", "id", "n", "similar", F.lit(False).alias("asks"), F.col("_cls").alias("c1"), spread("_unlike").alias("b1"), F.col("cls").alias("c2"), nth("all").alias("b2"))
    rows = asking.unionByName(asked).join(words.select("id", "node", "words"), "id")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        x, y = block[block["asks"]], block[~block["asks"]]
        out = []
        if len(x) and len(y):
            nx, ny = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None, :]
            bins = int(min(MOST_BINS, 2 ** math.ceil(math.log2(16 * max(nx.max(), ny.max())))))
            common = counted(x["words"].tolist(), bins) @ counted(y["words"].tolist(), bins).T
            longer = np.maximum(nx, ny)
            most = ((1 - similarity) * longer + 1e-9).astype(np.int64)
            ix, iy = x["id"].to_numpy()[:, None], y["id"].to_numpy()[None, :]
            like = y["similar"].to_numpy()
            # two that are both unlike the least meet twice
            able = (common >= longer - most) & (np.minimum(nx, ny) >= longer - most) & (ix != iy) & (like[None, :] | (ix < iy))
            # texts with one label are connected; those like the least are from the start
            ids, at = np.unique(np.r_[ix[:, 0], iy[0]], return_inverse=True)
            label, px, py = np.arange(len(ids)), at[: len(x)], at[len(x) :]
            if like.any():
                label[py[like]] = label[py[like][0]]
            wx, wy, ax, ay = x["words"].tolist(), y["words"].tolist(), x["node"].tolist(), y["node"].tolist()
            for i in np.flatnonzero(able.any(axis=1)):
                left, own = np.flatnonzero(able[i]), unpacked(wx[i])
                left = left[np.argsort(-common[i, left], kind="stable")]
                while len(left := left[label[py[left]] != label[px[i]]]):
                    j, left = left[0], left[1:]
                    if distance(own, unpacked(wy[j]), int(most[i, j])) <= most[i, j]:
                        label[label == label[py[j]]] = label[px[i]]
                        out.append((ax[i], ay[j]))
        return pd.DataFrame(out, columns=["na", "nb"], dtype=object)

    return rows.groupBy("h", "c1", "b1", "c2", "b2").applyInPandas(compare, "na binary, nb binary")


def components(edges: DataFrame, a: str = "na", b: str = "nb") -> DataFrame:
    """(node, root): the least node of every linked node's connected component.

    Stars are merged by turns towards larger and smaller neighbours until nothing
    changes; each turn is an aggregate and a join on edges, written in between.
    """
    spark = edges.sparkSession
    with scratch(spark):
        now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "stars")
        mark = None
        while True:
            with scratch(spark):
                both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
                least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
                wide = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars")
                down = wide.groupBy("u").agg(F.min("v").alias("m"))
                near = wide.join(down, "u")
                now = written(near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars", keep=True)
            new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
            if new == mark:
                break
            mark = new
        found = now.groupBy("u").agg(F.min("v").alias("root"))
        roots = found.select(F.col("root").alias("u")).distinct()
        return written(found.unionByName(roots.select("u", F.col("u").alias("root"))).withColumnRenamed("u", "node"), "components", keep=True)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(node, class_id, first_node): for each distinct text its class and the node that stands for it.

    class_id is the least key of the class (nulls last, so null only if all are), and
    first_node the text of the row that has it (of several, the least). Equal texts are
    one node; null texts count as empty, and all texts without words that are equal are
    copies of each other. An empty table has no classes.
    """
    with scratch(docs.sparkSession):
        table = written(sketched(docs, key, text), "sketched")
        nodes = table.groupBy("node").agg(F.min("key").alias("key"))
        roots = components(links(table, similarity))
        rooted = nodes.join(roots, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root"))
        first = rooted.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "node")).alias("first"))
        return written(rooted.join(first, "root").select("node", F.col("first.key").alias("class_id"), F.col("first.node").alias("first_node")), "classes", keep=True)


def classified(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with `_class` (the least key of its class) and `_first`, true for rows that stand for theirs.

    Columns of docs with these two names are replaced, others stay whatever they are called.
    """
    kept = [c for c in docs.columns if c.lower() not in ("_class", "_first")]
    name = {c: free(docs.columns, f"_near_{c}") for c in ("own", "node", "class_id", "first_node")}
    found = classes(docs, key, text, similarity).withColumnsRenamed({c: name[c] for c in ("node", "class_id", "first_node")})
    out = docs.withColumn(name["own"], node_of(F.col(text))).join(found, F.col(name["own"]) == F.col(name["node"]), "left")
    first = (F.col(name["own"]) == F.col(name["first_node"])) & F.col(key).cast("long").eqNullSafe(F.col(name["class_id"]))
    return out.select(*cols(kept), F.col(name["class_id"]).alias("_class"), first.alias("_first"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stand for their class, one for each, columns unchanged."""
    name = {c: free(docs.columns, f"_near_{c}") for c in ("own", "key", "node", "class_id")}
    reps = classes(docs, key, text, similarity).where("node = first_node").select(F.col("node").alias(name["node"]), F.col("class_id").alias(name["class_id"]))
    # joined by text and key, so that copies of one text spread out
    named = docs.withColumns({name["own"]: node_of(F.col(text)), name["key"]: F.col(key).cast("long")})
    mine = named.join(reps, (F.col(name["own"]) == F.col(name["node"])) & F.col(name["key"]).eqNullSafe(F.col(name["class_id"])))
    return mine.dropDuplicates([name["own"], name["key"]]).select(*cols(docs.columns))
