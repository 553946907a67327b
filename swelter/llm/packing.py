"""Best-fit packing of token pieces after a dominance reduction.

Pieces of equal length are alike, so the instance is the histogram of lengths: at most
`capacity` numbers, whatever the corpus. On it, Martello and Toth's reduction fixes sets
of up to three pieces that provably dominate what else could stand beside their largest
piece, by its exact cases and by their own three-piece rule; what is left is packed by
best fit, longest first, many bins at once. Both give patterns (lengths of a bin) with a
multiplicity. The pieces then take the patterns' places by their rank among equal
lengths, which Spark counts in parallel.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from swelter.llm.common import written

CAPACITY, END_ID = 2048, 0
#: White space as Unicode has it, and letters of the Latin blocks.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: Places at which every byte-level pre-tokenizer cuts: before the last of a run of white space, before
#: such a run, and behind Latin letters that an ASCII mark or the end follows.
CHUNKS = re.compile(f"[{WHITE}]?[{LETTERS}]++(?=[\\x00-\\x40\\x5b-\\x60\\x7b-\\x7f]|\\Z)|[{WHITE}]?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])")
#: A space inside a run of white space, or at its end where the text ends: no pre-tokenizer need cut before it.
INNER_SPACE = f"[{WHITE}] ([{WHITE}]|\\z)"
#: Bytes of texts whose parts are told apart together, and distinct parts that are looked up together.
BLOCK_BYTES, SLICE_PARTS = 1 << 25, 1 << 14
#: Rows of one length that are numbered in one part.
RANK_ROWS = 1 << 16
#: Chunks whose ids a worker remembers, and the longest such chunk.
MEMO_CHUNKS, MEMO_CHARS = 400_000, 64


class ChunkIds(dict):
    """chunk: its ids as little-endian unsigned 32-bit numbers, encoded when first asked for."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, chunk: str) -> bytes:
        got = np.array(self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()
        if len(chunk) <= MEMO_CHARS and len(self) < MEMO_CHUNKS:
            self[chunk] = got
        return got


class Encoder:
    """Ids of whole texts, as the tokenizer's own encode gives them, by remembered chunks.

    A byte-level tokenizer cuts texts into words and encodes each by itself. Text is cut
    only where the pre-tokenizer's pattern must cut too (CHUNKS), and the tokenizer
    encodes each chunk, so a chunk that was seen before needs no second look. Texts that
    hold one of the tokenizer's added tokens are encoded whole. Another pre-tokenizer, or
    a normalizer, is an error. Many texts at once (each) are first cut before every space,
    and only their distinct parts are cut into chunks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores out
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made["pre_tokenizer"] or {}
        if made.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only plain byte-level tokenizers encode word by word")
        self.tokenizer = Tokenizer.from_file(path)
        added = [t["content"] for t in made.get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.known = ChunkIds(self.tokenizer)

        self.tokens = added

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(self._whole(text), dtype="<u4")

    def _whole(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()
        return self._chunked(text)

    def _chunked(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, CHUNKS.findall(text)))

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text in turn; null texts have none."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, BLOCK_BYTES + (ends[at - 1] if at else 0), "right")))
            yield from self._block(pc.fill_null(texts.slice(at, upto - at), ""))
            at = upto

    def _block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Distinct parts are looked up once, and Arrow puts their ids in the texts' order.

        A part begins with its space, but for a text's first. A text that may not be cut
        before each of its spaces is one part.
        """
        uncut = pc.match_substring_regex(texts, INNER_SPACE)
        for token in self.tokens:
            uncut = pc.or_(uncut, pc.match_substring(texts, token))
        cut = pc.split_pattern(pc.if_else(uncut, "", texts), " ")
        words, bounds = cut.values.dictionary_encode(), cut.offsets.to_numpy()
        first = pc.if_else(uncut, texts, cut.values.take(cut.offsets[:-1]))
        ids = []
        for at in range(0, len(words.dictionary), SLICE_PARTS):  # few are Python's own strings at a time
            some = words.dictionary.slice(at, SLICE_PARTS).to_numpy(zero_copy_only=False)
            ids.append(pa.array([self._chunked(" " + w) for w in some], pa.large_binary()))
        ids.append(pa.array([self._whole(x) for x in first.to_numpy(zero_copy_only=False)], pa.large_binary()))
        part = words.indices.to_numpy().copy()
        part[bounds[:-1]] = np.arange(len(words.dictionary), len(words.dictionary) + len(texts))
        _, ends, data = pa.concat_arrays(ids).take(pa.array(part)).buffers()
        ends = np.frombuffer(ends, dtype="int64", count=len(part) + 1)[bounds] // 4
        data = np.frombuffer(data, dtype="<u4", count=ends[-1]) if ends[-1] else np.empty(0, "<u4")
        for a, b in zip(ends, ends[1:]):
            yield data[a:b]


def encoder(path: str) -> Encoder:
    """One for each file in a worker's process, so that what a task has seen serves the next.

    This module travels with each task, so its own names don't last; the library's do.
    """
    import tokenizers

    held = vars(tokenizers).setdefault("_swelter_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, piece, start, length, ids_crc32): the pieces of every row's ids.

    tokenizer: the file's path, the same on every executor. A document is its text's ids
    and END_ID; one longer than capacity is cut into pieces of capacity, the first of
    which takes the remainder. Null and empty texts are END_ID alone. row tells repeated
    rows apart. The CRC is over little-endian unsigned 32-bit ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            made = [(i, *p) for i, ids in enumerate(encode.each(b["text"])) for p in pieces(ids, capacity)]
            of, piece, start, length, crc = np.array(made, dtype="int64").reshape(-1, 5).T
            rows = b.select(["key", "row"]).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, (piece.astype("int32"), start, length, crc))], ["key", "row", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "key long, row long, piece int, start long, length long, ids_crc32 long")


def pieces(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc) of a document's ids, END_ID added."""
    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
    head = len(ids) % capacity or capacity
    cuts = [0, *range(min(head, len(ids)), len(ids) + 1, capacity)]
    return [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def reduce_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets, longest piece first; counts is left with the rest.

    Returns patterns with multiplicities: a reason that holds for one set holds until one
    of its lengths is used up, so equal sets are fixed together.
    """
    fixed: Counter[tuple[int, ...]] = Counter()
    for j in sorted(counts, reverse=True):
        while counts[j] > 0 and (pattern := _dominating(j, counts, capacity)):
            need = Counter(pattern)
            times = min(counts[x] // n for x, n in need.items())
            fixed[pattern] += times
            for x, n in need.items():
                counts[x] -= n * times
    return list(fixed.items())


def _dominating(j: int, counts: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """A set with j that dominates all others with j, or None.

    Alone, if nothing fits beside j. With the longest k that fits, if both fill the bin,
    or if no more than two others ever fit beside j and the best two together are no
    longer than k: what stands beside j elsewhere may be exchanged for k. With k and the
    longest b that fits beside both, if no more than two others fit and none of their
    pairs is of two longer than b but together longer than k: one of a pair then goes
    into k's place, the other into b's, or both into k's.
    """
    space = capacity - j
    left = lambda x: counts.get(x, 0) - (x == j)
    others = sorted(x for x, n in counts.items() if x <= space and left(x) > 0)
    if not others:
        return (j,)
    k = others[-1]
    shortest = [x for x in others[:3] for _ in range(min(3, left(x)))][:3]
    if k == space or len(shortest) < 2 or shortest[0] + shortest[1] > space:
        return (j, k)
    if len(shortest) == 3 and sum(shortest) <= space:
        return None
    # the pair whose sum is nearest to the space
    best, hi = 0, len(others) - 1
    for lo, x in enumerate(others):
        while hi >= lo and (others[hi] + x > space or (hi == lo and left(x) < 2)):
            hi -= 1
        if hi < lo:
            break
        best = max(best, x + others[hi])
    if best <= k:
        return (j, k)
    beside = [x for x in others if x <= space - k and left(x) > (x == k)]
    if not beside:
        return None
    b = beside[-1]
    longer = [x for x in others if x > b for _ in range(min(2, left(x)))]
    # pairs of two longer than b that don't go into k's place together
    return None if _between(longer, k, space) else (j, k, b)


def _between(xs: list[int], low: int, high: int) -> bool:
    """Whether two of the sorted xs sum to more than low and at most high."""
    hi = len(xs) - 1
    for lo in range(len(xs)):
        while hi > lo and xs[lo] + xs[hi] > high:
            hi -= 1
        if hi <= lo:
            return False
        if xs[lo] + xs[hi] > low:
            return True
    return False


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on a histogram: bins of equal content move together."""
    spaces: dict[int, Counter[tuple[int, ...]]] = {}  # space left: contents and how many bins
    order: list[int] = []
    for x in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        left = counts[x]
        while left:
            at = bisect.bisect_left(order, x)
            if at < len(order):
                space = order[at]
                content, bins = spaces[space].popitem()
            else:
                space, content, bins = capacity, (), left
            # the bin that x went to stays the tightest one while another x fits
            per = min(space // x, left)
            take = min(bins, left // per)
            left -= take * per
            kept = [(space, content, bins - take)] if content else []
            if at < len(order) and not spaces[space]:
                del spaces[space], order[at]
            for rest, held, n in [*kept, (space - per * x, content + (x,) * per, take)]:
                if n and rest not in spaces:
                    spaces[rest] = Counter()
                    bisect.insort(order, rest)
                if n:
                    spaces[rest][held] += n
    return [(held, n) for bins in spaces.values() for held, n in bins.items()]


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    rest = dict(counts)
    return reduce_histogram(rest, capacity) + best_fit(rest, capacity)


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a written table with key, row, piece, length) with `sequence_id` and `offset`.

    Only the histogram (capacity rows at most) reaches the driver, and only the patterns'
    slots go back. A slot is a range of ranks of one length; there are some tens for each
    length, and the table's size is checked before it is broadcast. Ranks within a length
    are counted in parts of about RANK_ROWS rows, so a frequent length is spread over tasks.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # length: (rank from, to, sequence from, offset)
    used: Counter[int] = Counter()
    sequence = 0
    for pattern, times in patterns(counts, capacity):
        offset = 0
        for x in pattern:
            slots[x].append((used[x], used[x] + times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    rows = [(x, *s) for x, held in slots.items() for s in held]
    parts = {x: -(-n // RANK_ROWS) for x, n in counts.items() if n > RANK_ROWS}
    n_parts = F.lit(1)
    if parts:
        n_parts = F.coalesce(F.create_map(*[F.lit(v) for x in parts.items() for v in x])[F.col("length")], n_parts)
    inside = pieces.withColumn("part", F.pmod(F.xxhash64("key", "row", "piece"), n_parts))
    sums = inside.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = inside.withColumn("nth", F.row_number().over(W.partitionBy("length", "part").orderBy("key", "row", "piece")) - 1)
    ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "part")
    table = spark.createDataFrame(rows, "slot_length long, first long, last long, sequence long, offset long")
    if len(rows) <= MAX_SLOTS:
        table = F.broadcast(table)
    hit = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    return ranked.join(table, hit).withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first")).drop("slot_length", "first", "last", "sequence", "rank")


#: Slots that are broadcast, about 5 MB; more are joined by a shuffle.
MAX_SLOTS = 100_000


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All pieces of docs with their places; an empty table has none.

    Rows are tokenized once; the pieces (numbers only) are written, so row numbers and
    ranks can't change when an executor is lost.
    """
    return packed(written(tokenized(docs, tokenizer, capacity, key, text), "pieces"), capacity)
