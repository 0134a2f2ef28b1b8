"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A word's probability is that of its class given the two words before it, times its own within the
class. Classes are softmaxes over hashed features: the word before, the word before that (a skip),
and the pair. The most frequent words form classes of ``MEMBERS``, with a softmax of their own over
the word before and the class; other words fall into classes by their ending, with their share of
the class's counts; words seen once share a class with the one unknown word. The whole is a
distribution over the words of training and one unknown.

Words are counted over all training documents by the block exchange of ``common``. Training makes
one pass over every training token: each task takes gradient steps from the class shares on its own
documents, and the tasks' weights are averaged by tokens. Weights and head words have a fixed size,
whatever the input: ``ROWS`` rows for each kind of feature, which more contexts share the larger the
input, and ``HEADS * MEMBERS`` words predicted in context within their class; of any other word only
the class is. Counts stay distributed. Scoring works on packed words in numpy batches.

Null and empty texts hold only the end token. Repeated rows and null ids are scored like others;
other columns are ignored; an empty table gives no rows. Without training tokens every word is
unknown.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, as_list, Block, corpus_counts, fold, pack, parts, per_block, reliable, sum_tables, table_rows, total_counts, unpack, word_blocks

HEADS, MEMBERS, ENDINGS = 8, 128, 32
RARE = HEADS + ENDINGS
CLASSES = RARE + 1
ROWS = 1 << 13
#: The weights travel in pieces of this many numbers.
PIECE = 1 << 16
BATCH, RATE = 8192, 0.25
START = np.uint32(0xFFFF)
LN10 = float(np.log(10))


def words_and_end(text: str) -> list[bytes]:
    words = ascii_words(text)
    words.append(b"")
    return words


def ending(word: bytes) -> int:
    return HEADS + xxhash.xxh3_64_intdigest(word[-3:]) % ENDINGS


@dataclass
class Vocabulary:
    """What the driver holds of the corpus: totals, class masses and the head words."""

    tokens: int
    types: int
    singles: int
    mass: np.ndarray  # of each class, sum of count + 0.5 over its words
    head: dict[bytes, int]  # rank
    head_counts: np.ndarray


def vocabulary(blocks: DataFrame) -> Vocabulary:
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = total_counts(list(batches))
        known = [(n, w) for w, n in total.items() if n]
        mass = np.zeros(CLASSES, np.int64)
        for n, w in known:
            mass[ending(w) if n > 1 else RARE] += 2 * n + 1
        top = heapq.nlargest(HEADS * MEMBERS, (x for x in known if x[0] > 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], pa.int64()) for x in (sum(n for n, _ in known), len(known), sum(n == 1 for n, _ in known))]
            + [as_list(mass, pa.int64()), as_list([w for _, w in top], pa.binary()), as_list([n for n, _ in top], pa.int64())],
            names=["tokens", "types", "singles", "mass", "words", "counts"],
        )

    rows = reliable(parts(blocks).mapInArrow(summarise, "tokens bigint, types bigint, singles bigint, mass array<bigint>, words array<binary>, counts array<bigint>"))
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "singles")], *[F.coalesce(F.sum(F.col("mass")[k]), F.lit(0)).alias(f"m{k}") for k in range(CLASSES)]).first()
    each = rows.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select("w.words", "w.counts")
    top = each.orderBy(F.desc("counts"), "words").limit(HEADS * MEMBERS).collect()
    head, counts = {bytes(r.words): i for i, r in enumerate(top)}, np.array([r.counts for r in top], np.int64)
    mass = np.array([sums[f"m{k}"] for k in range(CLASSES)], np.float64) / 2
    for w, i in head.items():
        mass[ending(w)] -= counts[i] + 0.5
        mass[i // MEMBERS] += counts[i] + 0.5
    return Vocabulary(sums.tokens, sums.types, sums.singles, mass, head, counts)


CODED = "ids array<bigint>, marks array<bigint>, lens array<bigint>, code binary, base array<double>, fixed array<double>, known array<bigint>"


def coded(blocks: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Blocks with each word as class, place in a head class and 16 bits of hash; and by document
    the sums of what needs no model: base score, in-class scores outside the head, known words."""
    sent = blocks.sparkSession.sparkContext.broadcast(vocab)

    def encode(block: Block) -> pa.Table:
        v = sent.value
        words, c = block.words(), block.numbers("n")
        rank = np.fromiter((v.head.get(w, -1) for w in words), np.int64, block.size)
        cls = np.fromiter((ending(w) for w in words), np.int64, block.size)
        cls[c < 2] = RARE
        cls[rank >= 0] = rank[rank >= 0] // MEMBERS
        fixed = np.zeros(block.size)
        tail = (rank < 0) & (c > 1)
        fixed[tail] = np.log10((c[tail] + 0.5) / v.mass[cls[tail]])
        fixed[(rank < 0) & (c == 1)] = np.log10(0.5 / max(1, v.singles))
        fixed[c == 0] = np.log10(0.5) if v.singles else 0.0
        base = np.log10((c + 0.5) / (v.tokens + 0.5 * (v.types + 1)))
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) & 0xFFFF for w in words), np.int64, block.size)
        code = ((cls << 24) | (np.maximum(rank, 0) % MEMBERS << 16) | hashed)[block.seq]
        start = np.cumsum(block.lens) - block.lens
        by_doc = [np.add.reduceat(x[block.seq], start) for x in (base, fixed, (c > 0).astype(np.int64))]
        return pa.table({
            "ids": as_list(block.ids, pa.int64()), "marks": as_list(block.marks, pa.int64()), "lens": as_list(block.lens, pa.int64()), "code": pa.array([pack(code)], pa.binary()),
            "base": as_list(by_doc[0], pa.float64()), "fixed": as_list(by_doc[1], pa.float64()), "known": as_list(by_doc[2], pa.int64()),
        })

    return reliable(per_block(blocks, corpus_counts(blocks), encode, CODED))


def features(code: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, ...]:
    """Class, place, the three feature rows of the class softmax and the row of the in-class one."""
    cls, place, word = (code >> 24).astype(np.int64), (code >> 16 & 0xFF).astype(np.int64), code & 0xFFFF
    start = np.cumsum(lens) - lens
    one, two = np.empty_like(word), np.empty_like(word)
    one[1:], two[2:] = word[:-1], word[:-2]
    one[start] = START
    two[start] = START
    second = start[lens > 1] + 1
    two[second] = START
    with np.errstate(over="ignore"):
        k = [one * np.uint32(2654435761), two * np.uint32(2246822519), (one * np.uint32(40503) + two * np.uint32(3266489917)) * np.uint32(668265263), (one * np.uint32(374761393) + cls.astype(np.uint32)) * np.uint32(2654435761)]
    rows = [(x >> np.uint32(19)).astype(np.int64) for x in k]  # 13 bits
    return cls, place, rows[0], rows[1] + ROWS, rows[2], rows[3]


class Model:
    """Weights of the class softmax and of the head classes' own; biases are the shares. ``flat``
    holds those of single words, the head classes' own, and those of pairs (zero if left out)."""

    def __init__(self, vocab: Vocabulary, flat: np.ndarray | None = None):
        self.bias = np.log((vocab.mass + 1e-3) / (vocab.mass.sum() + 1e-3 * CLASSES)).astype(np.float32)
        member = np.full((HEADS, MEMBERS), -1e4, np.float32)
        n = len(vocab.head_counts)
        member.ravel()[:n] = np.log(vocab.head_counts + 0.5)
        self.member = member
        ends = np.cumsum([2 * ROWS * CLASSES, ROWS * MEMBERS, ROWS * CLASSES])
        self.flat = np.zeros(ends[2], np.float32)
        if flat is not None:
            self.flat[: len(flat)] = flat
        self.w, self.u, self.pair = (x.reshape(-1, n) for x, n in zip(np.split(self.flat, ends[:2]), (CLASSES, MEMBERS, CLASSES)))

    def classes(self, rows: tuple[np.ndarray, ...]) -> np.ndarray:
        x = np.take(self.w, rows[0], axis=0)
        x += np.take(self.w, rows[1], axis=0)
        x += np.take(self.pair, rows[2], axis=0)
        x += self.bias
        x -= x.max(axis=1, keepdims=True)
        return x

    def members(self, cls: np.ndarray, row: np.ndarray) -> np.ndarray:
        x = np.take(self.member, cls, axis=0)
        x += np.take(self.u, row, axis=0)
        x -= x.max(axis=1, keepdims=True)
        return x

    def log10(self, code: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Of each word, without the fixed in-class part."""
        cls, place, *rows = features(code, lens)
        out = np.empty(len(code))
        for a in range(0, len(code), BATCH):
            b = slice(a, a + BATCH)
            x = self.classes(tuple(r[b] for r in rows[:3]))
            out[b] = x[np.arange(len(x)), cls[b]] - np.log(np.exp(x).sum(axis=1))
            head = np.flatnonzero(cls[b] < HEADS)
            y = self.members(cls[b][head], rows[3][b][head])
            out[a + head] += y[np.arange(len(y)), place[b][head]] - np.log(np.exp(y).sum(axis=1))
        return out / LN10

    def train(self, code: np.ndarray, lens: np.ndarray, seen: list[np.ndarray]) -> None:
        """One pass of gradient steps, scaled by each row's own history in ``seen``."""
        cls, place, *rows = features(code, lens)
        for a in range(0, len(code), BATCH):
            b = slice(a, a + BATCH)
            x = np.exp(self.classes(tuple(r[b] for r in rows[:3])))
            x /= x.sum(axis=1, keepdims=True)
            x[np.arange(len(x)), cls[b]] -= 1
            for r in rows[:2]:
                step(self.w, seen[0], r[b], x)
            step(self.pair, seen[2], rows[2][b], x)
            head = np.flatnonzero(cls[b] < HEADS)
            if len(head):
                y = np.exp(self.members(cls[b][head], rows[3][b][head]))
                y /= y.sum(axis=1, keepdims=True)
                y[np.arange(len(y)), place[b][head]] -= 1
                step(self.u, seen[1], rows[3][b][head], y)


def step(weights: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total, own = np.add.reduceat(np.take(gradient, order, axis=0), first), ordered[first]
    seen[own] += np.einsum("ij,ij->i", total, total)
    total *= (RATE / np.sqrt(seen[own] + 1.0))[:, None]
    weights[own] -= total


def fit(table: DataFrame, vocab: Vocabulary) -> Model:
    """One averaged pass over all training tokens of ``coded`` blocks."""
    sent = table.sparkSession.sparkContext.broadcast(vocab)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n = Model(sent.value), 0
        seen = [np.zeros(n, np.float32) for n in (2 * ROWS, ROWS, ROWS)]
        for batch in batches:
            for code, lens, marks in zip(*(batch.column(c) for c in ("code", "lens", "marks"))):
                lens, keep = np.asarray(lens.values), np.asarray(marks.values) != 0
                code = unpack(code.as_py())[np.repeat(keep, lens)]
                if len(code):
                    model.train(code, lens[keep], seen)
                    n += len(code)
        if n:
            pieces = np.split(model.flat * np.float32(n), range(PIECE, len(model.flat), PIECE))
            yield table_rows({-1: np.array([n], np.float32)} | dict(enumerate(pieces)))

    sums = sum_tables(table.select("code", "lens", "marks").mapInArrow(learn, "k int, data binary"), "f4", salts=16)
    return Model(vocab, np.concatenate([sums[k] for k in range(len(sums) - 1)]) / sums[-1][0] if sums else None)


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1) -> DataFrame:
    """One row for each document: the id, held_out, n_tokens, n_known, train_tokens, base_score (of
    unigrams) and score, log10 of the text's probability. Learns from documents whose
    crc32(id as text) modulo ``folds`` is not ``held_out``."""
    out = fold(id_col, folds)
    blocks = word_blocks(docs, words_and_end, id_col=id_col, text_col=text_col, mark=F.when(out != held_out, 1).otherwise(0), kept=True)
    vocab = vocabulary(blocks)
    table = coded(blocks, vocab)
    sent = docs.sparkSession.sparkContext.broadcast((vocab, fit(table, vocab).flat))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, flat = sent.value
        model = Model(vocab, flat)
        for batch in batches:
            for ids, marks, lens, code, base, fixed, known in zip(*batch.columns):
                lens = np.asarray(lens.values)
                each = model.log10(unpack(code.as_py()), lens)
                total = np.add.reduceat(each, np.cumsum(lens) - lens) + np.asarray(fixed.values)
                held = pa.array(np.asarray(marks.values) == 0)
                tokens = pa.array(np.full(len(lens), vocab.tokens), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.values, held, pa.array(lens, pa.int64()), known.values, tokens, base.values, pa.array(total)], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return table.mapInArrow(apply, f"`{id_col}` bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
