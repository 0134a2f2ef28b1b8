"""Removal of long repeated byte strings by common-prefix interval trees.

Every string of ``length`` bytes holds a *seed*, the ``seed_bytes(length)``-byte string in it of the least hash
(the leftmost of equals), so that equal strings have equal seeds at equal places. One seed stands
for a run of windows; its context is those windows' bytes. Only seeds that occur more than once go
on, and of contexts that are equal as a whole one goes on for all of them (a seed with one context
is a tree of one leaf, which needs no bytes). The suffixes that start at a seed are sorted into an
enhanced suffix array, its stack scan gives the common-prefix intervals, and in each interval the
bytes before the seed are tested: members that differ there form a maximal repeat with all its
occurrences, and if left and right extents reach ``length`` they are repeated bytes.

A seed with more than ``MAX_CONTEXTS`` different contexts is no task's work: its contexts' windows are
counted by hash across the cluster, which gives the same bytes in time linear in them. Keys that hold many
rows are joined by broadcast of at most a thousand keys (``common.spread_join``).

The same search runs over words in the place of bytes: a word is one unit, its 64-bit hash.

Texts are UTF-8 bytes of any length, worked on whole; matches never cross documents. Null texts are
empty. Repeated rows repeat each other; null ids stay null; other columns are carried along; an
empty table gives no rows. Documents are recognised by a 64-bit hash of the text and its length.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SMALL_BATCH, free_names, hash_filter, lean, reliable, slices, spread_join, written

BLOCK = (1 << 17) - 1  # bytes of text worked on at a time, about 150 times that in memory
MAX_CONTEXTS = 5000
MULTIPLIER = 0x9E3779B97F4A7C15
WORD_BYTES = 8  # of a word's hash
ODD = np.array([0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def seed_bytes(length: int) -> int:
    """A third of the length, about: longer seeds meet less by chance, shorter ones are fewer."""
    return max(1, length * 8 // 25)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[0]
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER ** i and its inverse, modulo 2**64."""
    one, inverse = np.full(n, MULTIPLIER, np.uint64), np.full(n, pow(MULTIPLIER, -1, 1 << 64), np.uint64)
    one[0] = inverse[0] = 1
    return np.cumprod(one, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


class Hashes:
    """Hashes of substrings of ``data`` (bytes, or words' hashes) from one sum, by place and length."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(19, int(len(data)).bit_length())
        power, self.inverse = powers(size)
        values = byte_values()[data] if data.dtype == np.uint8 else data
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * power[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def word_values(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words one after another, as 64-bit hashes, and how many each text has. Words are
    ``[^\\x20\\x09-\\x0D]+``, or letters of ``UNSPACED``."""
    cells = [x.encode() for x in texts]
    for i, cell in enumerate(cells):
        if len(cell) and np.frombuffer(cell, np.uint8).max() >= 0xE0 and ANY_UNSPACED.search(texts[i]):
            cells[i] = " ".join(BLANK_WORD.findall(texts[i])).encode()
    data = np.frombuffer(b"".join(c + b" " for c in cells), np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    until = np.searchsorted(start, np.cumsum([len(c) + 1 for c in cells]))
    return Hashes(data).of(start, end), np.diff(np.concatenate([[0], until]))


def units(texts: list[str], words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, or words' hashes, one after another, and how many each text has."""
    if words:
        return word_values(texts)
    cells = [x.encode() for x in texts]
    return np.frombuffer(b"".join(cells), np.uint8), np.array([len(c) for c in cells])


def seeds(data: np.ndarray, lens: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of documents of ``lens`` bytes (or words) in ``data``: each seed's document, its place, the first and
    last window that it stands for (places in ``data``), its hash and its context's hash."""
    size = seed_bytes(length)
    w, n = length - size + 1, len(data) - size + 1
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    hashes = Hashes(data)
    place = np.arange(len(data) + 1)
    h = hashes.of(place[:n], place[size : size + n])
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max)
    padded[:n] = key
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: n - w + 1], before[w - 1 : n])
    doc = np.repeat(np.arange(len(lens)), lens)
    window = np.flatnonzero(doc[: n - w + 1] == doc[length - 1 : length + n - w])
    seed = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(window):
        return tuple(np.empty(0, np.int64) for _ in range(6))
    new = np.concatenate([[True], seed[1:] != seed[:-1]])
    at = np.flatnonzero(new)
    lo, hi = window[at], window[np.concatenate([at[1:] - 1, [len(window) - 1]])]
    seed = seed[at]
    context = hashes.of(lo, hi + length) + (seed - lo).astype(np.uint64) * ODD[1] + (hi - lo).astype(np.uint64) * ODD[2]
    return doc[seed], seed, lo, hi, h[seed].view(np.int64), mix(context).view(np.int64)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def maximal_repeats(contexts: list[bytes], at: list[int], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """Of contexts with the same seed at ``at``: (left, right, members) of the maximal repeats of
    ``length`` bytes or more around it, as far as a member gains bytes by it."""
    suffix, before = [c[p:] for c, p in zip(contexts, at)], [c[:p][::-1] for c, p in zip(contexts, at)]
    order = sorted(range(len(contexts)), key=suffix.__getitem__)
    lcp = [common(suffix[i], suffix[j]) for i, j in zip(order, order[1:])]
    best = [-1] * len(contexts)
    stack: list[tuple[int, int]] = []  # (common prefix, first place) of the intervals still open
    for k in range(len(lcp) + 1):
        now, first = lcp[k] if k < len(lcp) else -1, k
        while stack and stack[-1][0] > now:
            right, first = stack.pop()
            members = order[first : k + 1]
            if right + max(at[i] for i in members) >= length:
                ranked = sorted(members, key=before.__getitem__)
                near = [common(before[i], before[j]) for i, j in zip(ranked, ranked[1:])]
                left = [max(a, b) for a, b in zip([0, *near], [*near, 0])]
                gains: dict[int, list[int]] = {}
                for i, x in zip(ranked, left):
                    if x > best[i]:
                        best[i] = x
                        if x + right >= length:
                            gains.setdefault(x, []).append(i)
                for x, who in gains.items():
                    yield x, right, who
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def repeated_spans(docs: DataFrame, *, length: int = 400, text_col: str = "text", max_contexts: int = MAX_CONTEXTS, words: bool = False) -> DataFrame:
    """key, n_bytes (of a text: its hash and length) and spans array<struct<s, e>>: the bytes
    covered by a ``length``-byte string that also starts elsewhere. Texts without any are absent.

    With ``words``, the length and the spans are in words (see ``word_values``), whatever stands between them.
    """
    width = WORD_BYTES if words else 1
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("key"), text.alias("text")).filter(F.octet_length("text") >= (2 * length - 1 if words else length))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                data, lens = units(part.column("text").to_pylist(), words)
                doc, seed, lo, hi, h, c = seeds(data, lens, length)
                base = (np.cumsum(lens) - lens)[doc]
                size = np.asarray(pc.binary_length(part.column("text")))
                columns = [np.asarray(part.column("key"))[doc], size[doc], seed - base, lo - base, hi - base + length, h, c]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["key", "n_bytes", "p", "s", "e", "seed", "context"])

    found = written(rows.mapInArrow(lean(find), "key bigint, n_bytes bigint, p bigint, s bigint, e bigint, seed bigint, context bigint"), "seeds", SMALL_BATCH)
    often = found.groupBy("seed").agg(F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("varied")).filter("n > 1").drop("n")
    candidates = reliable(spread_join(found, often, ["seed"]))
    same = candidates.filter("not varied").select("key", "n_bytes", "s", "e")

    varied = candidates.filter("varied")
    each = reliable(varied.groupBy("seed", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "n_bytes", "p", "s", "e")).alias("r")))
    copied = spread_join(varied, each.filter("n > 1").select("seed", "context"), ["seed", "context"]).select("key", "n_bytes", "s", "e")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                out = [[], [], [], []]
                data, lens = units(part.column("text").to_pylist(), words)
                for base, at in zip((np.cumsum(lens) - lens).tolist(), part.column("at").to_pylist()):
                    for x in at:
                        for to, v in zip(out, (x["seed"], x["context"], x["p"] - x["s"], data[base + x["s"] : base + x["e"]].tobytes())):
                            to.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["seed", "context", "at", "bytes"])

    keys = reliable(each.select("seed", "context", "r.*").groupBy("key", "n_bytes").agg(F.collect_list(F.struct("seed", "context", "p", "s", "e")).alias("at")))
    texts = rows.filter(hash_filter(keys.select("key"), "key")(F.col("key"))).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    one = texts.dropDuplicates(["key", "n_bytes"])  # of copies of a text one is sent by each task
    whole = reliable(one.join(keys, ["key", "n_bytes"]).select("text", "at").mapInArrow(lean(cut), "seed bigint, context bigint, at bigint, bytes binary"), SMALL_BATCH)

    large = reliable(whole.groupBy("seed").agg(F.count("*").alias("m")).filter(F.col("m") > max_contexts).select("seed", F.lit(True).alias("many")))
    few = large.isEmpty()
    marked = whole.withColumn("many", F.lit(None).cast("boolean")) if few else reliable(spread_join(whole, large, ["seed"], "left"))
    small = marked.filter("many is null").select("seed", "context", "at", "bytes")
    extents = small.repartition("seed").sortWithinPartitions("seed").mapInArrow(lean(functools.partial(scan, length=length, width=width)), EXTENTS)
    if not few:
        each_window = marked.filter("many").mapInArrow(lean(functools.partial(windows, length=length, width=width)), "seed bigint, context bigint, d bigint, w bigint")
        twice = each_window.groupBy("seed", "d", "w").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        hot = each_window.join(twice.repartition("seed", "d", "w"), ["seed", "d", "w"])  # Spark can split a window of many contexts
        extents = extents.union(hot.select("seed", "context", (-F.col("d")).alias("left"), (F.col("d") + length).alias("right")))
    partial = spread_join(varied, extents, ["seed", "context"]).select("key", "n_bytes", (F.col("p") - F.col("left")).alias("s"), (F.col("p") + F.col("right")).alias("e"))
    spans = same.union(copied).union(partial)
    return spans.groupBy("key", "n_bytes").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


EXTENTS = "seed bigint, context bigint, left bigint, right bigint"


def windows(batches: Iterator[pa.RecordBatch], length: int, width: int = 1) -> Iterator[pa.RecordBatch]:
    """Each window of ``length`` units (of ``width`` bytes) of each context: its place from the seed and its hash."""
    kind = np.uint8 if width == 1 else np.uint64
    for batch in batches:
        for part in slices(batch, "bytes", 64 << 10):
            out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
            for seed, context, at, data in zip(*(part.column(c).to_pylist() for c in ("seed", "context", "at", "bytes"))):
                starts = np.arange(len(data) // width - length + 1)
                h = Hashes(np.frombuffer(data, kind)).of(starts, starts + length)
                for to, v in zip(out, (np.full(len(starts), seed), np.full(len(starts), context), starts - at, h.view(np.int64))):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["seed", "context", "d", "w"])


def scan(batches: Iterator[pa.RecordBatch], length: int, width: int = 1) -> Iterator[pa.RecordBatch]:
    """The extents of each seed's contexts in maximal repeats, in whole units of ``width`` bytes. Rows
    come sorted by seed."""
    rest = None
    for batch in with_end(batches):
        table = pa.Table.from_batches([batch]) if batch is not None else None
        if rest is not None:
            table = pa.concat_tables([rest, table]) if table is not None else rest
        if table is None or not table.num_rows:
            continue
        seed = np.asarray(table.column("seed"))
        ends = np.concatenate([np.flatnonzero(seed[1:] != seed[:-1]) + 1, [len(seed)]])
        if batch is not None:  # the last seed may go on in the next batch
            rest, ends = table.slice(int(ends[-2]) if len(ends) > 1 else 0), ends[:-1]
        context, at, data = (table.column(c).to_pylist() for c in ("context", "at", "bytes"))
        out, start = [], 0
        for end in ends.tolist():
            for left, right, members in maximal_repeats(data[start:end], [x * width for x in at[start:end]], length * width):
                if left // width + right // width >= length:
                    out += [(int(seed[start]), context[start + i], left // width, right // width) for i in members]
            start = end
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["seed", "context", "left", "right"])


def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def merged(spans) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((int(x["s"]), int(x["e"])) for x in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, *, length: int = 400, text_col: str = "text", whole_characters: bool = False, max_contexts: int = MAX_CONTEXTS, passage_words: int | None = None) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept (binary): each text's bytes without those
    covered by a ``length``-byte string that also starts anywhere else.

    ``whole_characters`` leaves characters whole that a span would cut: it removes only those that
    lie inside. Columns of ``docs`` named like an output are replaced.

    ``passage_words`` adds n_passage_words: how many of a text's words (see ``word_values``) lie in runs of so many
    that also stand anywhere else, whatever the blanks between them. They are counted, not removed.
    """
    spans = reliable(repeated_spans(docs, length=length, text_col=text_col, max_contexts=max_contexts), SMALL_BATCH)
    counts = []
    if passage_words is not None:
        counts, docs = ["n_passage_words"], docs.drop("n_passage_words")
        runs = repeated_spans(docs, length=passage_words, text_col=text_col, max_contexts=max_contexts, words=True)
        spans = reliable(spans.join(runs.select("key", "n_bytes", covered("spans").alias(counts[0])), ["key", "n_bytes"], "full"), SMALL_BATCH)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    key, maybe_, spans_, r = free_names(docs, "_key", "_maybe", "_spans", "_r")
    keyed = docs.withColumns({key: F.xxhash64(text), "n_bytes": F.octet_length(text).cast("bigint")})
    own = spans.select(F.col("key").alias(key), "n_bytes", F.col("spans").alias(spans_), *counts)
    maybe = keyed.withColumn(maybe_, hash_filter(spans.select("key"), "key")(F.col(key)))

    def strip(text: str, found: list) -> tuple[int, int, bytes]:
        data, at, parts, removed = text.encode(), 0, [], merged(found)
        if whole_characters:
            removed = [(a, b) for a, b in (inner(data, a, b) for a, b in removed) if a < b]
        for a, b in removed:
            parts.append(data[at:a])
            at = b
        return sum(b - a for a, b in removed), len(removed), b"".join([*parts, data[at:]])

    hit = spread_join(maybe.filter(F.col(maybe_)), own, [key, "n_bytes"], "left").withColumn(r, text)
    columns = [*[F.col(f"`{c}`") for c in docs.columns], F.col("n_bytes")]
    known = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in counts]
    stripped = stripped_rows(hit.select(*columns, *known, r, spans_), r, spans_, strip, "n_removed bigint, n_spans bigint, kept binary")
    none = [*(F.lit(0).cast("bigint").alias(c) for c in counts), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), text.cast("binary").alias("kept")]
    return stripped.union(maybe.filter(~F.col(maybe_)).select(*columns, *none))


def covered(spans: str) -> Column:
    """How many places lie in any of the spans of this column."""
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    add = lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["end"]), F.lit(0).cast("bigint"))).alias("n"), F.greatest(x["e"], a["end"]).alias("end"))
    return F.aggregate(F.array_sort(spans), none, add, lambda a: a["n"])


def stripped_rows(rows: DataFrame, text: str, spans: str, fn: Callable[[str, list], tuple], outputs: str) -> DataFrame:
    """``rows`` with the ``outputs`` of ``fn(text, spans)`` (no spans: empty) for these two columns, a slice of a batch at a time."""
    carried = [c for c in rows.columns if c not in (text, spans)]
    added = T.StructType.fromDDL(outputs)
    kinds = to_arrow_schema(added)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, BLOCK):
                cells = list(zip(*(fn(x, s or []) for x, s in zip(part.column(text).to_pylist(), part.column(spans).to_pylist()))))
                new = [pa.array(x, f.type) for x, f in zip(cells, kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *new], names=[*carried, *added.names])

    return rows.mapInArrow(lean(apply), T.StructType([*(rows.schema[c] for c in carried), *added.fields]))


#: Letters of scripts that are written without blanks: each counts as a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
ANY_UNSPACED, WORD = re.compile(f"[{UNSPACED}]"), re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")
BLANK_WORD = re.compile(rf"[{UNSPACED}]|[^\x20\x09-\x0d{UNSPACED}]+")
#: Characters of a word's code, 6 bits of its hash each.
CODE = 6


class Codes(dict):
    """Codes of words, of one width."""

    def __missing__(self, word: str) -> str:
        if len(self) > 1 << 15:
            self.clear()
        code = base64.b64encode(xxhash.xxh3_64_digest(word.encode()))[:CODE].decode()
        self[word] = code
        return code

    def of(self, text: str) -> str:
        words = WORD.findall(text) if ANY_UNSPACED.search(text) else text.split()
        return "".join(map(self.__getitem__, words))


def remove_passages(docs: DataFrame, *, words: int = 51, text_col: str = "text") -> DataFrame:
    """``docs`` with n_removed (words) and kept (string): each text without the runs of ``words``
    words or more that also stand anywhere else, from the first to the last of their words.

    A passage is judged by its words alone, whatever their bytes; blanks between them may differ.
    Words are parted by blanks, or are letters of ``UNSPACED``. Repeats of words are those of their
    codes' bytes, as codes have one width (words are compared by 36 bits of hash). A string that
    begins inside a code is repeated without the words around it only by chance of that size, and
    spans are narrowed to whole words. Columns of ``docs`` named like an output are replaced.
    """
    docs = docs.drop("n_removed", "kept")
    codes_, key, size, maybe_, spans_, r = free_names(docs, "_codes", "_key", "_bytes", "_maybe", "_spans", "_r")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for part in slices(batch, text_col, BLOCK):
                cells = pa.array([codes.of(x or "") for x in part.column(text_col).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, cells], names=[*part.schema.names, codes_])

    typed = docs.withColumn(text_col, F.col(text_col).cast("string"))
    schema = T.StructType([*typed.schema.fields, T.StructField(codes_, T.StringType())])
    keyed = typed.mapInArrow(lean(code), schema)
    spans = reliable(repeated_spans(typed.select(text_col).mapInArrow(lean(code), T.StructType([typed.schema[text_col], schema[codes_]])), length=words * CODE, text_col=codes_), SMALL_BATCH)
    keyed = keyed.withColumns({key: F.xxhash64(codes_), size: F.octet_length(codes_).cast("bigint")}).drop(codes_)
    own = spans.select(F.col("key").alias(key), F.col("n_bytes").alias(size), F.col("spans").alias(spans_))
    maybe = keyed.withColumn(maybe_, hash_filter(spans.select("key"), "key")(F.col(key)))

    def strip(text: str, found: list) -> tuple[int, str]:
        # first and last word; a repeat holds whole words, so touching ones are one run to remove
        runs = merged({"s": -(-int(x["s"]) // CODE), "e": int(x["e"]) // CODE} for x in found)
        places = [m.span() for m in WORD.finditer(text)] if runs else []
        at, parts = 0, []
        for a, b in runs:
            parts.append(text[at : places[a][0]])
            at = places[b - 1][1]
        return sum(b - a for a, b in runs), "".join([*parts, text[at:]])

    text = F.coalesce(F.col(text_col), F.lit(""))
    hit = spread_join(reliable(maybe.filter(F.col(maybe_)), SMALL_BATCH), own, [key, size], "left").withColumn(r, text)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    stripped = stripped_rows(hit.select(*columns, r, spans_), r, spans_, strip, "n_removed bigint, kept string")
    return stripped.union(maybe.filter(~F.col(maybe_)).select(*columns, F.lit(0).cast("bigint").alias("n_removed"), text.alias("kept")))


def inner(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The part of data[a:b] made of whole UTF-8 characters."""
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b
