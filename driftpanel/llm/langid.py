"""Language identification by language-bitmask n-gram filters.

Text becomes lower-case letters and blanks; its n-grams are all runs of four bytes without two
blanks together. Training counts every n-gram of every training text by language, across the
cluster. A language owns an n-gram if it holds at least ``SHARE`` of the n-gram's rates over all
languages. The n-grams go into one Bloom filter whose slices, one bit plane for each language, share
their places, so that one look-up returns the set of all languages that own an n-gram. A text's
hits are counted for each language, corrected for the false positives that the fill of its plane
leads to, and the language with the most wins; ties go to the first by name.

Null texts and texts without a letter are ``und`` with score 0, as is all if nothing can be
learned. A text none of whose n-grams is known gets the language with the most training text and
score 0. Repeated rows and null ids are treated like others; other columns are ignored; an empty
table gives no rows. At most 64 languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, reliable, slices

N, BLOCK = 4, 1 << 20
#: 2 ** PLACES places of the filter, HASHES of them for each n-gram.
PLACES, HASHES = 22, 3
SHARE, LEAST_COUNT, LEAST_RATE = 0.2, 3, 1e-6
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: Bytes below 0x80 that are no letters become blanks; the bytes of other characters stay.
BLANKS = bytes(b if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as 32-bit codes, and how many each text has."""
    cells = [b" " + x.lower().encode().translate(BLANKS) + b" " for x in texts]
    lens = np.array([len(c) + 1 for c in cells])
    data = np.frombuffer(b" ".join([*cells, b"   "]), np.uint8)
    n = int(lens.sum())
    code = data[:n].astype(np.uint32)
    blank = data == 32
    pair = blank[:-1] & blank[1:]
    bad = pair[:n].copy()
    for k in range(1, N):
        code |= data[k : n + k].astype(np.uint32) << np.uint32(8 * k)
        if k < N - 1:
            bad |= pair[k : n + k]
    doc = np.repeat(np.arange(len(texts)), lens)
    return code[~bad], np.bincount(doc[~bad], minlength=len(texts))


def places(code: np.ndarray) -> list[np.ndarray]:
    mixed = code ^ (code >> np.uint32(15))
    return [((mixed * f) ^ (mixed >> np.uint32(13))) * FACTORS[(i + 1) % 3] >> np.uint32(32 - PLACES) for i, f in enumerate(FACTORS)]


def train(docs: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray, np.ndarray, int]:
    """Languages by name, the filter's masks by place, each plane's rate of false positives, and the
    index of the language with the most n-grams. Their sizes do not grow with the input."""
    named = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    langs = [r.lang for r in named.select("lang").distinct().orderBy("lang").limit(65).collect()]
    if len(langs) > 64:
        raise ValueError("more than 64 languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                lang = np.array([langs.index(x) for x in part.column("lang").to_pylist()])
                code, n = grams(part.column("text").to_pylist())
                of = np.repeat(lang, n)
                for k in np.unique(lang).tolist():
                    held.setdefault(k, []).append(np.unique(code[of == k], return_counts=True))
                    if len(held[k]) > 8:
                        held[k] = [added(held[k])]
        for k, tables in held.items():
            code, n = added(tables)
            for a in range(0, len(code), 50_000):
                b = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(code[b].astype(np.int64)), pa.array(np.full(len(code[b]), k), pa.int32()), pa.array(n[b].astype(np.int64))], names=["code", "lang", "n"])

    counted = reliable(named.mapInArrow(count, "code bigint, lang int, n bigint").groupBy("code", "lang").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return [], np.empty(0), np.empty(0), 0
    total = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, float(n))])
    rated = counted.withColumn("rate", F.col("n") / total[F.col("lang")])
    whole = rated.groupBy("code").agg(F.sum("rate").alias("whole"))
    owned = rated.filter((F.col("n") >= LEAST_COUNT) & (F.col("rate") >= LEAST_RATE)).join(whole, "code").filter(F.col("rate") >= SHARE * F.col("whole"))
    masks = owned.groupBy("code").agg(F.bit_or(F.expr("shiftleft(1L, lang)")).alias("mask"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.asarray(batch.column("code")).astype(np.uint32)
            at = np.concatenate(places(code)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(np.asarray(batch.column("mask")), HASHES))], names=["place", "mask"])

    rows = masks.mapInArrow(place, "place bigint, mask bigint").groupBy("place").agg(F.bit_or("mask").alias("mask")).toPandas()  # 2 ** PLACES at most
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(langs) <= t(0).itemsize * 8)
    table = np.zeros(1 << PLACES, kind)
    table[rows["place"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64).astype(kind)
    fill = np.array([np.count_nonzero(table >> kind(k) & kind(1)) / len(table) for k in range(len(langs))])
    return langs, table, fill**HASHES, max(totals, key=lambda k: (totals[k], -k))


def added(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate([t[0] for t in tables]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([t[1] for t in tables]), len(code)).astype(np.int64)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1) -> DataFrame:
    """One row for each document: the id, held_out, lang_pred and score (the share of the best
    language in all corrected hits). Learns from documents whose crc32(id as text) modulo ``folds``
    is not ``held_out``."""
    out = fold(id_col, folds) == held_out
    model = train(docs.filter(~out), text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, wrong, most = sent.value
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                pred, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if langs:
                    code, n = grams([x or "" for x in part.column("text").to_pylist()])
                    found = table[(at := places(code))[0]]
                    for x in at[1:]:
                        found = found & table[x]
                    edge = np.concatenate([[0], np.cumsum(n)])
                    hits = np.empty((len(langs), part.num_rows))
                    for k in range(len(langs)):
                        total = np.concatenate([[0], np.cumsum(found >> found.dtype.type(k) & found.dtype.type(1), dtype=np.int64)])
                        hits[k] = np.maximum(0, (total[edge[1:]] - total[edge[:-1]] - n * wrong[k]) / (1 - wrong[k]))
                    best, whole = hits.argmax(axis=0), hits.sum(axis=0)
                    score = np.divide(hits.max(axis=0), whole, out=score, where=whole > 0)
                    best = np.where(whole > 0, best, most)
                    letter = part.column("letter").to_pylist()
                    pred = [langs[b] if x else "und" for b, x in zip(best.tolist(), letter)]
                    score = np.where(letter, score, 0.0)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held"), pa.array(pred), pa.array(score)], names=[id_col, "held_out", "lang_pred", "score"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), out.alias("held"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(decide, f"`{id_col}` bigint, held_out boolean, lang_pred string, score double")
