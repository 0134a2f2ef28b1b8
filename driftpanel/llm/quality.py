"""Quality classifier on random-indexing word vectors, pooled per document.

Each word has a fixed sparse index vector of +1 and -1; a word's vector is the sum of the index
vectors of its neighbours, ``REACH`` to either side, over the whole corpus. Words share ``BUCKETS``
rows by hash, so that the table's size is fixed. A document is the mean of its words' vectors, each
scaled to length one, and the logarithm of its length. A network of two layers learns the labels
from at most ``MAX_LABELLED`` labelled documents, the first by a hash of the id; a temperature set
on a fifth of them that it did not learn from calibrates its probabilities.

Null and empty texts pool to zeros and are scored like others. Labels count once for each id, by
their mean; null labels and null ids teach nothing. Repeated rows are scored each; other columns are
ignored; an empty table gives no rows. Without labels of both kinds the score is their mean, or 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, fold, slices, sum_tables, table_rows

BUCKETS, WIDTH, NONZERO, REACH, BLOCK = 1 << 14, 64, 2, 2, 1 << 20
#: The table travels in pieces of this many numbers.
PIECE = 1 << 16
MAX_LABELLED, HIDDEN, EPOCHS = 20_000, 32, 60
TOKEN = re.compile(rb"[a-z\x80-\xff]+|[0-9]+|[^\sa-z0-9\x80-\xff]+")


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word) % BUCKETS
        return out


def bucketed(texts: list[str | None], known: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as buckets, and how many each text has."""
    words = [TOKEN.findall((x or "").encode().translate(ASCII_LOWER)) for x in texts]
    lens = np.array([len(w) for w in words])
    return np.fromiter((known[w] for ws in words for w in ws), np.int64, int(lens.sum())), lens


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    digest = np.array([[xxhash.xxh3_64_intdigest(b"%d" % b, k + 1) for k in range(NONZERO)] for b in range(BUCKETS)], np.uint64)
    return (digest % np.uint64(WIDTH)).astype(np.int64), np.where(digest >> np.uint64(63), 1.0, -1.0)


def word_vectors(docs: DataFrame, text_col: str) -> np.ndarray:
    """The table of word vectors over all texts, rows of length one."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        table, known = np.zeros(BUCKETS * WIDTH), Buckets()
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                b, lens = bucketed(part.column("text").to_pylist(), known)
                doc = np.repeat(np.arange(len(lens)), lens)
                for d in range(1, REACH + 1):
                    near = np.flatnonzero(doc[:-d] == doc[d:]) if len(b) > d else np.empty(0, np.int64)
                    for x, y in ((b[near], b[near + d]), (b[near + d], b[near])):
                        for k in range(NONZERO):
                            table += np.bincount(x * WIDTH + place[y, k], sign[y, k], len(table))
        yield table_rows(dict(enumerate(np.split(table.astype(np.int64), range(PIECE, len(table), PIECE)))))

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(gather, "k int, data binary")
    sums = sum_tables(rows, "i8", salts=16)
    flat = np.concatenate([sums[k] for k in range(len(sums))]) if sums else np.zeros(BUCKETS * WIDTH, np.int64)
    table = flat.reshape(BUCKETS, WIDTH).astype(np.float32)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[str | None], table: np.ndarray, known: Buckets) -> np.ndarray:
    b, lens = bucketed(texts, known)
    out = np.zeros((len(lens), WIDTH + 1), np.float32)
    full = np.flatnonzero(lens)
    if len(full):
        out[full, :WIDTH] = np.add.reduceat(table[b], (np.cumsum(lens) - lens)[full], axis=0) / lens[full, None]
    out[:, WIDTH] = np.log1p(lens)
    return out


def vectors(rows: DataFrame, table: np.ndarray, keep: str, schema: str, fn) -> DataFrame:
    """``fn`` of the pooled vectors of each run of rows, beside the columns in ``keep``."""
    sent = rows.sparkSession.sparkContext.broadcast(table)
    names = keep.split()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets()
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                got = fn(pooled(part.column("text").to_pylist(), sent.value, known))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *got], names=[x.split()[0].strip("`") for x in schema.split(", ")])

    return rows.mapInArrow(apply, schema)


class Network:
    """Inputs to HIDDEN units (tanh) to one logit, over a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean = float(y.mean()) if len(y) else 0.5
        self.flat = len(np.unique(y)) < 2
        if self.flat:
            return
        rng = np.random.default_rng(7)
        self.center, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.center) / self.scale
        test = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
        p = {"a": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1)}
        self.p = p
        m, v, t = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
        zt, yt = z[~test], y[~test]
        for _ in range(EPOCHS):
            order = rng.permutation(len(yt))
            for i in range(0, len(yt), 256):
                q = order[i : i + 256]
                h = np.tanh(zt[q] @ p["a"] + p["b"])
                g = (1 / (1 + np.exp(-(h @ p["c"] + p["d"]))) - yt[q]) / len(q)
                back = np.outer(g, p["c"]) * (1 - h * h)
                grads = {"a": zt[q].T @ back + 1e-4 * p["a"], "b": back.sum(axis=0), "c": h.T @ g + 1e-4 * p["c"], "d": np.array([g.sum()])}
                t += 1
                for k, w in grads.items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * w, 0.999 * v[k] + 0.001 * w * w
                    p[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        if test.any():
            logit = self.logit(x[test])
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            self.temperature = float(min(grid, key=lambda s: float(np.mean(np.logaddexp(0, logit / s) - y[test] * logit / s))))

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        return np.tanh(z @ self.p["a"] + self.p["b"]) @ self.p["c"] + self.p["d"][0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.mean) if self.flat else 1 / (1 + np.exp(-self.logit(x) / self.temperature))


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out: int = 0,
    threshold: float = 0.3, max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """One row for each document: the id, held_out, score (probability of label 1) and predicted.
    Learns from labelled documents whose crc32(id as text) modulo ``folds`` is not ``held_out``."""
    table = word_vectors(docs, text_col)
    taught = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("double").alias("y")).filter((fold(id_col, folds) != held_out) & F.col("id").isNotNull() & F.col("y").isNotNull())
    sample = taught.groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    labelled = rows.join(F.broadcast(sample), "id")  # max_labelled rows of two numbers
    learned = vectors(labelled.select("id", "y", "text"), table, "id y", "id bigint, y double, x array<float>", lambda x: [pa.array(list(x), pa.list_(pa.float32()))])
    got = learned.dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").toPandas()  # max_labelled rows
    network = Network(np.stack(got["x"].to_list()) if len(got) else np.zeros((0, WIDTH + 1)), got["y"].to_numpy(np.float64))

    def apply(x: np.ndarray) -> list[pa.Array]:
        p = network.probability(x)
        return [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))]

    all_rows = rows.withColumn("held", fold("id", folds) == held_out)
    return vectors(all_rows.select("id", "held", "text"), table, "id held", f"`{id_col}` bigint, held_out boolean, score double, predicted int", apply)
