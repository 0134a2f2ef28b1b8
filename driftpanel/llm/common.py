"""What several operators share: checkpoints, folds, word blocks and their dictionaries.

A *block* is a run of whole documents of one input partition, about ``block_bytes`` of text long.
Its tokens are stored once as positions in the block's own list of distinct words, so that what
crosses the network per word is one entry for each (block, distinct word) rather than one for each
occurrence, and no word - however common - has more entries than there are blocks.
"""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLOCK_BYTES = 8 << 20
BLOCK_SCHEMA = (
    "block bigint, ids array<bigint>, marks array<bigint>, lens array<int>, seq binary, dealt binary, "
    "sizes array<binary>, cells array<binary>, counts array<binary>"
)


#: Bytes of the batches that a job which holds texts in Python is sent at a time.
SMALL_BATCH = 4 << 20


def reliable(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, its lineage cut.

    With ``batch_bytes``, Python is sent at most about so many at a time (never fewer than a row).
    The folder is the one that the cluster names in ``spark.checkpoint.dir``. Where none is named, a
    session on one machine (``local[...]``) gets a folder beside its warehouse, any other fails.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex}")
    with shuffles_removed(spark), batches_of(spark, batch_bytes):
        return df.select("*").checkpoint()


def give_back() -> None:
    """Returns what a worker has freed to the machine: its allocators keep it otherwise, and workers
    stay from task to task and stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # not all C libraries have it
        trim(0)


def lean(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``fn`` of a task's batches, after which its memory is given back."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames made inside lose their shuffle files when their job ends, not when the driver next
    collects garbage: what they computed is stored by then. A stage that is needed again runs again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def batches_of(spark: SparkSession, batch_bytes: int | None) -> Iterator[None]:
    """Batches to Python of at most ``batch_bytes``, or the session's own limit where that is less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    own = int(before.rstrip("b")) if before.rstrip("b").isdigit() else None
    if batch_bytes is not None and (own is None or own > batch_bytes):
        spark.conf.set(name, str(batch_bytes))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: A key that holds more than one in HEAVY of the rows is heavy: of such there are at most HEAVY.
HEAVY = 1000


def spread_join(rows: DataFrame, marks: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``marks``, which has a row or a few for each key.

    Rows of heavy keys stay where they are and get their marks by broadcast, which is bounded by
    HEAVY keys; all others are shuffled as usual, so that no key takes a task's time. ``rows`` is read
    twice: give it as a file or a checkpoint. Null keys find no marks.
    """
    spark, total = rows.sparkSession, rows.count()
    heavy = rows.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") * HEAVY > total).select(*on).dropna().collect()
    if not heavy:
        return rows.join(marks, on, how)
    keys = F.broadcast(spark.createDataFrame(heavy, rows.select(*on).schema))
    few = rows.join(keys, on).join(F.broadcast(marks.join(keys, on)), on, how)
    return rows.join(keys, on, "left_anti").join(marks, on, how).unionByName(few)


def fold(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def py_fold(value: object, n: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def once(col: Column) -> Column:
    """``col``, computed once for each row. Spark copies the definition of a column into filters
    that use it, and with it a costly array into each step over another; it does not copy what it
    takes for non-deterministic, as this condition, which always holds."""
    return F.when(F.spark_partition_id() >= 0, col)


def ascii_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, as UTF-8."""
    return text.encode().translate(ASCII_LOWER).split()


def pack(a: np.ndarray) -> bytes:
    """Non-negative integers below 2**32 as zstd over byte planes."""
    planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` takes at most ``limit`` bytes, or one row."""
    size = batch.column(column)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(size), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_blocks(
    docs: DataFrame, words_of: Callable[[str], list], *, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None, block_bytes: int = BLOCK_BYTES, kept: bool = False,
) -> DataFrame:
    """Blocks of ``docs`` (see the module), shuffled by ``block``; with ``kept``, not shuffled but
    computed once into the checkpoint folder, for use in several jobs.

    ``words_of`` gives the words of one text (a null one is empty), as str or bytes. ``mark`` is a
    bigint carried with each document, 1 if not given. A block's distinct words are dealt by hash
    into as many parts as there are shuffle partitions; ``cells`` has each part's words, ``sizes``
    their lengths, and ``counts`` how often each stands in documents whose mark is not 0. Blocks
    hold whole documents, so one longer than ``block_bytes`` is a block of its own.

    ``docs`` should read the same in the same order each time (a file or a checkpoint does), as a
    lost task is computed again. A block is named by a hash of its content, so that one which does
    come out otherwise fails and is never mixed up.
    """
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                index: dict = defaultdict(itertools.count().__next__)
                seqs = []
                for x in part.column("text").to_pylist():
                    words = words_of(x or "")
                    seqs.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
                lens = np.array([len(s) for s in seqs], np.int32)
                seq, marks = np.concatenate(seqs), np.asarray(part.column("mark"))
                counts = np.bincount(seq[np.repeat(marks != 0, lens)], minlength=len(index))
                words = [w if isinstance(w, bytes) else w.encode() for w in index]
                dealt = np.fromiter((zlib.crc32(w) % ranges for w in words), np.int64, len(words))
                sizes, cells, sums = [], [], []
                for r in range(ranges):
                    at = np.flatnonzero(dealt == r)
                    own = [words[i] for i in at]
                    sizes.append(pack(np.array([len(w) for w in own], np.int64)))
                    cells.append(zstandard.compress(b"".join(own), 3))
                    sums.append(pack(counts[at]))
                packed = pack(seq)
                name = xxhash.xxh64(packed)
                for x in (lens.tobytes(), marks.tobytes(), str(part.column("id")).encode(), *cells):
                    name.update(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.intdigest() - (1 << 63)], pa.int64()), as_list(part.column("id"), pa.int64()), as_list(marks, pa.int64()), as_list(lens, pa.int32()), pa.array([packed], pa.binary()),
                     pa.array([pack(dealt)], pa.binary()), as_list(sizes, pa.binary()), as_list(cells, pa.binary()), as_list(sums, pa.binary())],
                    names=["block", "ids", "marks", "lens", "seq", "dealt", "sizes", "cells", "counts"],
                )

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.lit(1) if mark is None else mark, F.lit(0)).cast("bigint").alias("mark"), F.col(text_col).cast("string").alias("text")
    )
    blocks = rows.mapInArrow(lean(build), BLOCK_SCHEMA)
    return reliable(blocks) if kept else blocks.repartition(ranges, "block")


def as_list(values, kind: pa.DataType) -> pa.ListArray:
    """One list cell."""
    flat = values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def unpack_words(sizes: bytes, cell: bytes) -> list[bytes]:
    ends = np.cumsum(unpack(sizes).astype(np.int64)).tolist()
    data = zstandard.decompress(cell) if ends else b""
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def parts(blocks: DataFrame) -> DataFrame:
    """One row for each block and part, dealt so that all parts with a word come to one task. Even
    the commonest word is there once for each block. Exploded in Python, so that both uses of
    ``blocks`` read the same columns and Spark computes and shuffles them once."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                cells = [batch.column(c)[i].values for c in ("sizes", "cells", "counts")]
                n = len(cells[0])
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), *cells], names=["block", "part", "sizes", "cells", "counts"])

    ranges = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.mapInArrow(lean(explode), "block bigint, part int, sizes binary, cells binary, counts binary").repartition(ranges, "part")


def total_counts(batches: list[pa.RecordBatch]) -> dict[bytes, int]:
    """Counts over all blocks of the words of one task's parts: its share of the vocabulary."""
    total: dict[bytes, int] = defaultdict(int)
    for batch in batches:
        for sizes, cell, counts in zip(*(batch.column(c).to_pylist() for c in ("sizes", "cells", "counts"))):
            for w, n in zip(unpack_words(sizes, cell), unpack(counts).tolist()):
                total[w] += n
    return total


def corpus_counts(blocks: DataFrame) -> DataFrame:
    """block, part, n: the counts of each part's words over all blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # a task's compressed share of the vocabulary
        total = total_counts(held)
        for batch in held:
            out = [pack(np.fromiter(map(total.__getitem__, unpack_words(s, c)), np.int64)) for s, c in zip(batch.column("sizes").to_pylist(), batch.column("cells").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("part"), pa.array(out, pa.binary())], names=["block", "part", "n"])

    return parts(blocks).mapInArrow(lean(count), "block bigint, part int, n binary")


class Block:
    """A block put together again. ``values`` are its parts' rows; a missing part fails."""

    def __init__(self, same: pa.Table, values: pa.Table):
        self.copies = same.num_rows  # blocks of one name are equal in all
        self.ids, self.marks = same.column("ids")[0].values, np.asarray(same.column("marks")[0].values)
        self.lens = np.asarray(same.column("lens")[0].values).astype(np.int64)
        self.seq = unpack(same.column("seq")[0].as_py()).astype(np.int64)
        dealt = unpack(same.column("dealt")[0].as_py()).astype(np.int64)
        self.places = [np.flatnonzero(dealt == r) for r in range(len(same.column("sizes")[0]))]
        self.size = len(dealt)
        self._same, rows = same, values.to_pylist()
        self.rows = {x["part"]: x for x in rows}

    def words(self) -> list[bytes]:
        out = [b""] * self.size
        for at, sizes, cell in zip(self.places, self._same.column("sizes")[0].as_py(), self._same.column("cells")[0].as_py()):
            for i, w in zip(at.tolist(), unpack_words(sizes, cell)):
                out[i] = w
        return out

    def numbers(self, column: str) -> np.ndarray:
        """A packed column of the parts, by local word."""
        out = np.empty(self.size, np.int64)
        for r, at in enumerate(self.places):
            out[at] = unpack(self.rows[r][column])
        return out


def per_block(blocks: DataFrame, values: DataFrame, fn: Callable[[Block], pa.Table], schema: str) -> DataFrame:
    """``fn`` of each block with its parts' ``values``, at most ``block_bytes`` of text at a time."""

    def apply(same: pa.Table, rows: pa.Table) -> pa.Table:
        try:
            block = Block(same, rows)
            return pa.concat_tables([fn(block)] * block.copies)
        finally:
            give_back()

    return blocks.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(apply, schema)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """``df`` as Parquet in a new folder under the shared checkpoint folder, read again; see
    ``reliable`` for ``batch_bytes``."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        reliable(spark.range(1))
    path = f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark), batches_of(spark, batch_bytes):
        df.select("*").write.parquet(path)
    return spark.read.parquet(path)


#: Bits of ``hash_filter``: 8 MB whatever the input.
FILTER_BITS = 26


def hash_filter(keys: DataFrame, col: str) -> Callable[[str], Column]:
    """A filter of fixed size over bigint hashes: true for all of ``keys``, false for most others.

    It only keeps rows that cannot match out of a shuffle; the join that follows is exact.
    """
    low = F.col(col).bitwiseAND((1 << FILTER_BITS) - 1)
    bits = keys.groupBy(F.shiftright(low, 6).alias("k")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({col} & 63 as int))")).alias("b")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[bits["k"].to_numpy(np.int64)] = bits["b"].to_numpy(np.int64)
    sent = keys.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        x = np.asarray(h) & ((1 << FILTER_BITS) - 1)
        return pa.array((sent.value[x >> 6] >> (x & 63)) & 1 == 1)

    return maybe


def sum_tables(rows: DataFrame, dtype: str, salts: int = 64) -> dict[int, np.ndarray]:
    """The element-wise sums of ``rows`` (k int, data binary: zstd of an array of ``dtype``) by k.

    Each task adds up what it reads as it comes, first by k and a salt, then by k, so that neither
    a task nor the driver ever holds more than one array for each k. The k and their arrays' sizes
    are fixed by the caller.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("k").to_pylist(), batch.column("data").to_pylist()):
                x = np.frombuffer(zstandard.decompress(data), dtype)
                total[k] = total[k] + x if k in total else x
        yield table_rows(total)

    salted = rows.withColumn("salt", F.spark_partition_id() % salts).repartition("k", "salt").select("k", "data").mapInArrow(add, "k int, data binary")
    summed = salted.repartition("k").mapInArrow(add, "k int, data binary")
    return {r.k: np.frombuffer(zstandard.decompress(r.data), dtype) for r in summed.toLocalIterator()}


def table_rows(tables_: dict[int, np.ndarray]) -> pa.RecordBatch:
    cells = [zstandard.compress(np.ascontiguousarray(x).tobytes(), 1) for x in tables_.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(tables_), pa.int32()), pa.array(cells, pa.binary())], names=["k", "data"])
