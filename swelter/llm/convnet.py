"""Quality of texts by a convolutional network over their bytes, in numpy.

FILTERS filters of WIDTH bytes slide over the whole text. Their largest values in each
stretch of SEGMENT bytes are kept, and those of two neighbouring stretches make a chunk,
so chunks overlap by half and cover every byte. A hidden layer looks at each chunk's
maxima together, which tells what is there from what is missing (a chunk of one word
repeated excites few filters); its largest and its mean value over all chunks give one
probability. Texts of any length go through in parts of bounded size.

A filter is a table of a weight for each byte at each place, so sliding it is looking up.
All weights are learned from labelled texts: shards of them train side by side in Spark
tasks and their weights are averaged after each round, so no text leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swelter.llm.common import cols, hidden, scratch, written

WIDTH, FILTERS, HIDDEN, SEGMENT = 6, 32, 16, 128
FOLDS, HELD_OUT = 4, 2
#: Labels that a network is fitted on at most, and those of a shard.
FIT_LABELS, SHARD = 4096, 512
#: Rounds of one pass over each shard, texts of a step, and the step's rate and shrinkage.
ROUNDS, BATCH, RATE, DECAY = 10, 16, 0.01, 1e-4
#: Bytes of texts that are looked at together.
AT_ONCE = 1 << 18
SEED = 5


def fold_of(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(FOLDS))


@dataclass
class Packed:
    """Texts one after the other, each filled up with zeros to whole segments."""

    data: np.ndarray  # bytes, WIDTH more at the end
    used: np.ndarray  # places of each segment at which a filter lies within its text
    n_segments: np.ndarray  # of each text, 1 at least

    @classmethod
    def of(cls, texts: Sequence[bytes]) -> Packed:
        n = np.array([max(1, -(-len(t) // SEGMENT)) for t in texts])
        ends = np.cumsum(n)
        data = np.zeros(int(ends[-1]) * SEGMENT + WIDTH, dtype=np.uint8)
        used = np.full(int(ends[-1]), SEGMENT)
        for t, k, end in zip(texts, n, ends):
            at = (end - k) * SEGMENT
            data[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
            # a text shorter than the filters has one place, with zeros behind it
            places = max(min(1, len(t)), len(t) - WIDTH + 1)
            for j in range(max(0, k - 2), k):
                used[end - k + j] = min(SEGMENT, max(0, places - j * SEGMENT))
        return cls(data, used, n)


def _chunks(maxima: np.ndarray, n_segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first segment of each chunk, its last, number of chunks of each text)."""
    ends = np.cumsum(n_segments)
    n = np.maximum(1, n_segments - 1)
    first = np.arange(len(maxima))
    keep = np.ones(len(maxima), dtype=bool)
    keep[ends[n_segments > 1] - 1] = False  # a text's last segment starts no chunk, unless it is alone
    first = first[keep]
    alone = np.repeat(n_segments == 1, n)
    return first, np.where(alone, first, first + 1), n


@dataclass
class Net:
    """Weights: of bytes at places, then of chunks' maxima, then of texts."""

    tables: np.ndarray  # WIDTH, 256, FILTERS
    bias: np.ndarray
    inner: np.ndarray  # FILTERS, HIDDEN
    inner_bias: np.ndarray
    outer: np.ndarray  # 2 * HIDDEN
    outer_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = SEED) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        zero = lambda n: np.zeros(n, dtype=np.float32)
        return cls(draw(0.3, WIDTH, 256, FILTERS), zero(FILTERS), draw(0.25, FILTERS, HIDDEN), zero(HIDDEN), draw(0.2, 2 * HIDDEN), zero(1))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in astuple(self)])

    @classmethod
    def from_flat(cls, flat: np.ndarray) -> Net:
        parts, at = [], 0
        for x in astuple(cls.fresh()):
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return cls(*parts)

    def by_pairs(self) -> np.ndarray:
        """The tables of each two neighbouring places as one, for pairs of bytes."""
        if not hasattr(self, "_pairs"):
            self._pairs = np.stack([(self.tables[k][:, None, :] + self.tables[k + 1][None, :, :]).reshape(-1, FILTERS) for k in range(0, WIDTH, 2)])
        return self._pairs

    def slid(self, data: np.ndarray) -> np.ndarray:
        """Values (places, FILTERS) of all filters at all places but the last WIDTH."""
        pair = data[:-1].astype(np.int32) * 256 + data[1:]
        n, tables = len(data) - WIDTH, self.by_pairs()
        out = tables[0].take(pair[:n], axis=0)
        for k in range(1, len(tables)):
            out += tables[k].take(pair[2 * k : 2 * k + n], axis=0)
        return out

    def segments(self, packed: Packed, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest values (segments, FILTERS), and with places where each is."""
        whole = len(packed.used)
        best, where = np.empty((whole, FILTERS), dtype=np.float32), np.empty((whole, FILTERS), dtype=np.int64) if places else None
        step = 64  # segments whose values fit a processor's cache
        for a in range(0, whole, step):
            b = min(a + step, whole)
            values = self.slid(packed.data[a * SEGMENT : b * SEGMENT + WIDTH]).reshape(b - a, SEGMENT, FILTERS)
            for i in np.flatnonzero(packed.used[a:b] < SEGMENT):
                values[i, packed.used[a + i] :] = -1e9  # filled up
            if places:
                at = values.argmax(axis=1)
                where[a:b] = at + (np.arange(a, b) * SEGMENT)[:, None]
                best[a:b] = np.take_along_axis(values, at[:, None, :], axis=1)[:, 0]
            else:
                values.max(axis=1, out=best[a:b])
        return best, where

    def texts(self, maxima: np.ndarray, n_segments: np.ndarray) -> dict[str, np.ndarray]:
        """What lies between segments' maxima and texts' logits, all that learning needs."""
        first, last, n = _chunks(maxima, n_segments)
        seen = np.maximum(0, np.maximum(maxima[first], maxima[last]) + self.bias)
        inside = np.maximum(0, seen @ self.inner + self.inner_bias)
        starts = np.cumsum(n) - n
        top, mean = np.maximum.reduceat(inside, starts, axis=0), np.add.reduceat(inside, starts, axis=0) / n[:, None]
        return {"first": first, "last": last, "n": n, "seen": seen, "inside": inside, "top": top, "mean": mean, "logits": np.hstack([top, mean]) @ self.outer + self.outer_bias}

    def probabilities(self, texts: Sequence[bytes]) -> np.ndarray:
        packed = Packed.of(texts)
        logits = self.texts(self.segments(packed)[0], packed.n_segments)["logits"]
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -60, 60)))

    def gradient(self, texts: Sequence[bytes], labels: np.ndarray) -> np.ndarray:
        """Gradient of the mean cross-entropy, as flat().

        Only the places of largest values are learned at, so it costs little beside
        finding them.
        """
        packed = Packed.of(texts)
        maxima, where = self.segments(packed, places=True)
        t = self.texts(maxima, packed.n_segments)
        off = (1 / (1 + np.exp(-np.clip(t["logits"], -60, 60))) - labels) / len(labels)
        text_of = np.repeat(np.arange(len(labels)), t["n"])
        from_top = (t["inside"] == t["top"][text_of]) * (off[:, None] * self.outer[:HIDDEN])[text_of]
        from_mean = (off[:, None] * self.outer[HIDDEN:] / t["n"][:, None])[text_of]
        inside = (from_top + from_mean) * (t["inside"] > 0)
        seen = (inside @ self.inner.T) * (t["seen"] > 0)
        of_first = maxima[t["first"]] >= maxima[t["last"]]
        segments = np.zeros_like(maxima)
        np.add.at(segments, t["first"], seen * of_first)
        np.add.at(segments, t["last"], seen * ~of_first)
        s, f = np.nonzero(segments)
        tables, at = np.zeros_like(self.tables), where[s, f]
        for k in range(WIDTH):
            np.add.at(tables[k], (packed.data[at + k], f), segments[s, f])
        outer = np.concatenate([(off[:, None] * t["top"]).sum(axis=0), (off[:, None] * t["mean"]).sum(axis=0)])
        grads = (tables, seen.sum(axis=0), t["seen"].T @ inside, inside.sum(axis=0), outer, np.array([off.sum()]))
        return np.concatenate([x.ravel() for x in grads])


def trained(flat: np.ndarray, texts: Sequence[bytes], labels: np.ndarray, seed: int) -> np.ndarray:
    """Weights after one pass over the texts in an order drawn by seed (Adam)."""
    order = np.random.default_rng(seed).permutation(len(texts))
    flat, mean, square, t = flat.astype(np.float32), 0.0, 0.0, 0
    for first in range(0, len(order), BATCH):
        some = order[first : first + BATCH]
        g = Net.from_flat(flat).gradient([texts[i] for i in some], labels[some]) + DECAY * flat
        t += 1
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        flat = flat - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return flat.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Net:
    """A network from labelled rows of docs.

    labels: (key, label 0/1); other values and nulls take no part. Of more than FIT_LABELS
    labels those with the smallest hashes of their keys are used. The driver sees weights
    only, one set a shard and round. Without labels of both kinds the network is as drawn.
    """
    with scratch(docs.sparkSession):
        marked = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("y"))
        marked = marked.orderBy(F.xxhash64("_key"), "_key", "y").limit(FIT_LABELS)
        rows = docs.select(F.col(key).alias("_key"), F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("text")).join(F.broadcast(marked), "_key")
        rows = written(rows, "labelled")
        kinds = rows.agg(F.count("*").alias("n"), F.min("y").alias("a"), F.max("y").alias("b")).first()
        net = Net.fresh()
        if not kinds.n or kinds.a == kinds.b:
            return net
        shards = -(-kinds.n // SHARD)
        # as many of each kind in every shard: dealt out by the order of a hash within the kind
        dealt = F.row_number().over(_by_hash())
        rows = written(rows.withColumn("shard", F.pmod(dealt, F.lit(shards)).cast("int")).repartition(shards, "shard"), "shards")
        for turn in range(ROUNDS):
            found = rows.groupBy("shard").applyInPandas(_shard_pass(net.flat(), turn), "shard int, weights binary").collect()
            net = Net.from_flat(np.mean([np.frombuffer(r.weights, dtype="<f4") for r in sorted(found)], axis=0))
        return net


def _by_hash():
    from pyspark.sql.window import Window

    return Window.partitionBy("y").orderBy(F.xxhash64("_key"), "_key", F.xxhash64("text"))  # FIT_LABELS rows


def _shard_pass(flat: np.ndarray, turn: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_key", "y"], kind="stable")
        got = trained(flat, [bytes(t) for t in rows["text"]], rows["y"].to_numpy().astype(np.float32), SEED + turn)
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "weights": [got.astype("<f4").tobytes()]})

    return run


def scored(docs: DataFrame, net: Net, text: str = "text") -> DataFrame:
    """docs with `_score`, the probability of label 1.

    Whole texts, row by row; nothing is shuffled. Null texts count as empty; an empty text
    has one chunk without a place in it, and the score of that. A column of docs called
    `_score` is replaced, others stay whatever they are called.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, held, size = [], [], 0
            for t in texts:
                held.append((t or "").encode("utf-8"))
                size += len(held[-1])
                if size >= AT_ONCE:
                    out.append(net.probabilities(held))
                    held, size = [], 0
            if held:
                out.append(net.probabilities(held))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    docs, back = hidden(docs.drop("_score"), ("_s",))
    out = docs.withColumn("_s", score(F.col(text)))
    return out.select(*cols(docs.columns), F.col("_s").alias("_score")).withColumnsRenamed(back)
