"""Token ids in files: canonical length-limited Huffman codes in independent blocks.

``write_ids`` encodes each text with a tokenizer of the ``tokenizers`` library, appends an end id,
and writes the ids of all texts, in ascending order of their ids, as one sequence. ``read_ids``
gives them back, ``read_span`` any stretch of a block.

The format is a folder of two Parquet tables (a container that every store Spark knows can hold):

``codes``  id, bits: the length of each id's code. Codes are canonical: in order of (bits, id) they count
           up, so that lengths are all that is kept. At most ``max_bits`` long (package-merge over global counts).
``blocks`` one row for each block: part, block (their order is that of the ids), start (ids before it),
           doc_ids, sizes (ids of each document: ``common.pack``), every and marks (the bit at which each
           ``every``-th id begins: ``pack``), data (the codes, highest bit first, in 32-bit big-endian words).

Blocks hold whole documents, about ``block_ids`` ids, and need nothing but the codes to be decoded:
all checkpoints of all blocks at hand are decoded side by side by table, one id of each at a step.

The order is made by Spark's range partitioning; ties (one id on many rows) are ordered by the
text's hash and the text, a null id comes first. Null and empty texts are the end id alone. Texts of any length are
encoded whole, one at a time at least. Columns other than the id and the text are ignored; an
empty table gives empty files and no rows.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import LETTER
from .common import SMALL_BATCH, lean, pack, reliable, slices, sum_tables, table_rows, unpack, written
from .repeats import Hashes

BLOCK_IDS, EVERY, MAX_BITS = 1 << 16, 1 << 9, 18
TEXT = 1 << 20  # bytes of text at a time
JOINED = 256  # words encoded in one text
BLANK_LETTERS = re.compile(f" [{LETTER}]+")
KNOWN = 3 << 19  # words whose ids a Python worker keeps, in about 150 MB
#: Fixed value: the pattern of the library's byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Characters of texts that are split as bytes: below U+0080, or letters below U+0250.
UNUSUAL = re.compile(f"[^\0-\x7f{LETTER.removeprefix('A-Za-z')}]")
#: By byte: 0 for signs, 1 letters and the bytes of others, 2 digits, 3 white space.
KINDS = np.array([1 if b >= 0x80 or chr(b).isalpha() else 2 if 48 <= b <= 57 else 3 if b == 32 or 9 <= b <= 13 else 0 for b in range(256)], np.uint8)


def word_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the words of ``PATTERN`` begin in texts without ``UNUSUAL`` characters, joined in ``data``; ``first``
    marks where each text begins.

    Runs of one kind are words. Of white space before something else the last character stands alone, or, if
    it is a blank, belongs to what follows. A sign ' that begins a word takes s, t, m, d, re, ve or ll with it.
    """
    kind = KINDS[data]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~first[1:])
    start[last] = True
    start[last[data[last] == 32] + 1] = False
    quote = np.flatnonzero((data == 39) & start)
    padded, ends = np.concatenate([data, np.zeros(2, np.uint8)]), np.concatenate([first, [True, True]])
    one, two = padded[quote + 1], padded[quote + 2]
    here = ~ends[quote + 1]
    short = here & np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = here & ~ends[np.minimum(quote + 2, len(data))] & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
    start[quote[short | long] + 1] = False
    after = np.concatenate([quote[short] + 2, quote[long] + 3])
    start[after[after < len(data)]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts as the tokenizer gives them. Where it splits texts by ``PATTERN`` alone, texts are
    split as bytes, their words told apart by 64-bit hashes, and each word encoded once and then looked
    up; texts with unusual characters are encoded as a whole."""

    def __init__(self, path: str, known: int = KNOWN):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path) as f:
            settings = json.load(f)
        split = settings.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not settings.get("normalizer")
        self.splits = plain and all(not x.get("lstrip") and not x.get("rstrip") and x.get("special") for x in settings.get("added_tokens", []))
        self.size = self.tokenizer.get_vocab_size()
        self.width = np.zeros(self.size, np.int64)  # bytes of each token: byte-level tokens have a character for each
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self.known = known
        self.forget()

    def forget(self) -> None:
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and the words' numbers
        self.table, self.edge = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)  # word k has table[edge[k]:edge[k + 1]]

    def all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of single words. Those of a blank and letters are encoded many in one text, which
        the pattern splits before each blank, and told apart by the bytes of their tokens."""
        joins = np.fromiter(map(bool, map(BLANK_LETTERS.fullmatch, words)), bool, len(words))
        one, rest = [w for w, j in zip(words, joins) if j], [w for w, j in zip(words, joins) if not j]
        flat, _ = self.all(["".join(one[i : i + JOINED]) for i in range(0, len(one), JOINED)])
        stops = np.searchsorted(np.cumsum(self.width[flat]), np.cumsum([len(w.encode()) for w in one], dtype=np.int64), "left") + 1
        other, n = self.all(rest)
        size = np.zeros(len(words), np.int64)
        size[joins], size[~joins] = np.diff(stops, prepend=0), n
        out = np.zeros(int(size.sum()), np.uint32)
        own = np.repeat(joins, size)
        out[own], out[~own] = flat, other
        return out, size

    def learn(self, words: list[str]) -> None:
        """Encodes ``words``, which get the next numbers."""
        before = len(self.keys)
        now = before + len(words)
        ids, size = self.each(words)
        end = int(self.edge[before])
        if now >= len(self.edge):
            self.edge = np.concatenate([self.edge, np.zeros(max(now, len(self.edge)), np.int64)])
        if end + len(ids) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros(max(len(ids), len(self.table)), np.uint32)])
        self.table[end : end + len(ids)] = ids
        self.edge[before + 1 : now + 1] = end + np.cumsum(size)

    def looked_up(self, cells: list[bytes]) -> list[np.ndarray]:
        """The ids of texts without unusual characters, as UTF-8."""
        lens = np.array([len(c) for c in cells], np.int64)
        edge = np.concatenate([[0], np.cumsum(lens)])
        joined = b"".join(cells)
        if not joined:
            return [np.zeros(0, np.uint32) for _ in cells]
        data, first = np.frombuffer(joined, np.uint8), np.zeros(len(joined), bool)
        first[edge[:-1][lens > 0]] = True
        start = word_starts(data, first)
        stop = np.append(start[1:], len(data))
        hashed, at, inverse = np.unique(Hashes(data).of(start, stop), return_index=True, return_inverse=True)
        if len(self.keys) > self.known:
            self.forget()
        place = np.searchsorted(self.keys, hashed)
        new = np.ones(len(hashed), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != hashed[inside]
        number = np.empty(len(hashed), np.int64)
        number[~new] = self.numbers[place[~new]]
        if new.any():
            number[new] = len(self.keys) + np.arange(int(new.sum()))
            self.learn([joined[a:b].decode() for a, b in zip(start[at[new]].tolist(), stop[at[new]].tolist())])
            self.keys, self.numbers = np.insert(self.keys, place[new], hashed[new]), np.insert(self.numbers, place[new], number[new])
        seq = number[inverse]
        begin, size = self.edge[seq], self.edge[seq + 1] - self.edge[seq]
        ends = np.cumsum(size)
        flat = self.table[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]))]
        cut = np.concatenate([[0], ends])[np.searchsorted(start, edge)].tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        fast = [self.splits and not UNUSUAL.search(t) for t in texts]
        known = iter(self.looked_up([t.encode() for t, f in zip(texts, fast) if f]))
        other, n = self.all([t for t, f in zip(texts, fast) if not f])
        rest = iter(np.split(other, np.cumsum(n)[:-1])) if len(n) else iter(())
        return [next(known) if f else next(rest) for f in fast]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """Kept by a Python worker from task to task."""
    return Encoder(path)


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Bits of each symbol's code, 0 if it has no count: the least total of all prefix codes of at
    most ``max_bits``, by package-merge."""
    bits = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        bits[used] = 1
        return bits
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need codes of more than {max_bits} bits")
    symbols = used[np.argsort(counts[used], kind="stable")]
    weights = counts[symbols].astype(np.int64)
    packages, leaves = np.zeros(0, np.int64), []
    for _ in range(max_bits):
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        leaves.append(order < len(weights))
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(symbols) - 2
    for flags in reversed(leaves):
        own = int(flags[:take].sum())
        bits[symbols[:own]] += 1
        take = 2 * (take - own)
    return bits


class Codes:
    """Canonical codes of given lengths (0: no code)."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(np.int64)
        self.small = bits.astype(np.uint8)
        order = np.lexsort((np.arange(len(bits)), self.bits))
        self.order = order[self.bits[order] > 0]
        self.most = int(self.bits.max(initial=1))
        step = np.int64(1) << (self.most - self.bits[self.order])
        self.codes = np.zeros(len(bits), np.uint32)
        self.codes[self.order] = (np.cumsum(step) - step) >> (self.most - self.bits[self.order])

    @functools.cached_property
    def table(self) -> np.ndarray:
        """By the next ``most`` bits: the id, and in the low five bits its code's length."""
        out = np.zeros(1 << self.most, np.uint64)
        entries = np.repeat(self.order.astype(np.uint64) << np.uint64(5) | self.bits[self.order].astype(np.uint64), 1 << (self.most - self.bits[self.order]))
        out[: len(entries)] = entries
        return out

    def encode(self, ids: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
        """The bits of ``ids``, and the bit at which each ``every``-th begins."""
        size = self.small[ids]
        if len(ids) and not size.min():
            raise ValueError("an id has no code")
        ends = np.cumsum(size, dtype=np.int64)
        at = ends - size
        word, shift = at >> 5, (64 - (at & 31) - size).astype(np.uint64)
        shifted = self.codes[ids].astype(np.uint64) << shift
        out = np.zeros((int(ends[-1]) if len(ids) else 0) // 32 + 2, np.uint64)
        if len(ids):
            first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
            out[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
            out[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes(), at[::every]

    def decode(self, blocks: list[tuple[bytes, np.ndarray, int]], every: int) -> np.ndarray:
        """The ids of (data, marks, number of ids) one block after the other; a mark for each ``every`` ids."""
        words = np.frombuffer(b"".join(d for d, _, _ in blocks), ">u4").astype(np.uint64)
        pairs = words << np.uint64(32)
        pairs[:-1] |= words[1:]
        n = np.array([k for _, _, k in blocks], np.int64)
        lanes = -(-n // every)
        bit = np.cumsum([0, *(len(d) * 8 for d, _, _ in blocks)])[:-1]
        pos = np.concatenate([np.zeros(0, np.int64), *(m.astype(np.int64)[:k] for (_, m, _), k in zip(blocks, lanes))]) + np.repeat(bit, lanes)
        number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first = np.repeat(np.cumsum(n) - n, lanes) + number * every
        size = np.minimum(every, np.repeat(n, lanes) - number * every)
        order = np.argsort(-size, kind="stable")
        pos, first, size = pos[order].astype(np.uint64), first[order], size[order]
        live = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left")
        out = np.zeros(int(n.sum()), "<u4")
        five, low, top, mask = np.uint64(5), np.uint64(31), np.uint64(64 - self.most), np.uint64((1 << self.most) - 1)
        for step, k in enumerate(live.tolist()):
            p = pos[:k]
            entry = self.table[(pairs[p >> five] >> (top - (p & low))) & mask]
            out[first[:k] + step] = entry >> five
            p += entry & low
        return out


def ordered_ids(docs: DataFrame, path: str, *, end_id: int, id_col: str, text_col: str, block_ids: int) -> DataFrame:
    """part, block, at (ids of the part before it), n_ids, doc_ids, sizes, ids (``pack``): the ids of
    whole documents in ascending order of (part, block)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    kind = rows.schema["id"].dataType
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select(F.spark_partition_id().alias("part"), "id", "text")
    arrow = to_arrow_type(kind)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], np.uint32)
        part, block, at, held, who, total = 0, 0, 0, [], [], 0

        def done() -> pa.RecordBatch:
            cells = [pa.array([x], t) for x, t in ((part, pa.int32()), (block, pa.int64()), (at, pa.int64()), (total, pa.int64()))]
            cells.append(pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays(who)))
            packed = pack(np.array([len(x) + 1 for x in held], np.int64)), pack(np.concatenate([y for x in held for y in (x, end)]))
            return pa.RecordBatch.from_arrays([*cells, *(pa.array([x], pa.binary()) for x in packed)], names=ROWS)

        for batch in batches:
            for some in slices(batch, "text", TEXT):
                part = some.column("part")[0].as_py()
                first = 0
                for i, x in enumerate(enc.ids(some.column("text").to_pylist())):
                    held.append(x)
                    total += len(x) + 1
                    if total >= block_ids:
                        who.append(some.column("id").slice(first, i + 1 - first).cast(arrow))
                        yield done()
                        block, at, held, who, total, first = block + 1, at + total, [], [], 0, i + 1
                who.append(some.column("id").slice(first).cast(arrow))
        if held:
            yield done()

    schema = T.StructType.fromDDL("part int, block bigint, at bigint, n_ids bigint")
    schema.add("doc_ids", T.ArrayType(kind)).add("sizes", "binary").add("ids", "binary")
    return rows.mapInArrow(lean(build), schema)


ROWS = ["part", "block", "at", "n_ids", "doc_ids", "sizes", "ids"]


def id_counts(blocks: DataFrame, size: int) -> np.ndarray:
    """How often each id stands in all blocks: one array for each task, added up on the cluster. As
    long as the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                total += np.bincount(unpack(x), minlength=size)
        if total.any():
            yield table_rows({0: total})

    return sum_tables(blocks.select("ids").mapInArrow(count, "k int, data binary"), "int64").get(0, np.zeros(size, np.int64))


def write_ids(
    docs: DataFrame, path: str, to: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, block_ids: int = BLOCK_IDS, every: int = EVERY,
) -> None:
    """Writes the ids of ``docs`` to the folder ``to``, which must not exist. ``path`` names a
    tokenizer file that every machine has.

    The texts are shuffled once, by range, and encoded in order into a folder beside the checkpoints,
    as the codes need the counts of all of them; that folder goes when the files are written. What is
    broadcast is one number for each part of the range partitioning, and the codes.
    """
    spark = docs.sparkSession
    size = max(encoder(path).size, end_id + 1)
    blocks = written(ordered_ids(docs, path, end_id=end_id, id_col=id_col, text_col=text_col, block_ids=block_ids), "token-ids", SMALL_BATCH)
    codes = Codes(code_lengths(id_counts(blocks, size), max_bits))
    rows = [(i, int(codes.bits[i])) for i in np.flatnonzero(codes.bits).tolist()]
    spark.createDataFrame(rows, "id int, bits int").coalesce(1).write.parquet(f"{to}/codes")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, marks = codes.encode(unpack(batch.column("ids")[i].as_py()), every)
                new = [pa.array([every], pa.int32()), pa.array([pack(marks)], pa.binary()), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:-1], *new], names=[*ROWS[:-1], "every", "marks", "data"])

    fields = [*blocks.schema.fields[:-1], *T.StructType.fromDDL("every int, marks binary, data binary").fields]
    # the window is over one row for each part of the range partitioning
    before = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    coded = blocks.mapInArrow(encode, T.StructType(fields)).join(F.broadcast(before), "part")
    coded.select("part", "block", (F.col("before") + F.col("at")).alias("start"), "n_ids", "doc_ids", "sizes", "every", "marks", "data").write.parquet(f"{to}/blocks")
    discard(blocks)


def discard(df: DataFrame) -> None:
    """Removes the files of a frame that ``common.written`` gave."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def codes_of(spark: SparkSession, folder: str) -> Codes:
    """The codes of a folder of ids: no more rows than the vocabulary has."""
    rows = spark.read.parquet(f"{folder}/codes").collect()
    bits = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    bits[[r.id for r in rows]] = [r.bits for r in rows]
    return Codes(bits)


def read_ids(spark: SparkSession, folder: str, *, id_col: str = "doc_id", as_bytes: bool = False) -> DataFrame:
    """One row for each document of ``folder``: the id, start (ids of all documents before it),
    n_tokens and ids, an array or little-endian 32-bit integers."""
    codes, blocks = codes_of(spark, folder), spark.read.parquet(f"{folder}/blocks").select("start", "n_ids", "doc_ids", "sizes", "every", "marks", "data")
    kind = blocks.schema["doc_ids"].dataType.elementType

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "data", TEXT):
                sizes = [unpack(x).astype(np.int64) for x in some.column("sizes").to_pylist()]
                n, every = np.asarray(some.column("n_ids")), some.column("every")[0].as_py()
                ids = codes.decode([(d, unpack(m), k) for d, m, k in zip(some.column("data").to_pylist(), some.column("marks").to_pylist(), n.tolist())], every)
                size = np.concatenate(sizes)
                ends = np.cumsum(size)
                base = np.repeat(np.asarray(some.column("start")) - (np.cumsum(n) - n), [len(x) for x in sizes])
                edges = np.concatenate([[0], ends])
                if as_bytes:
                    cells = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((edges * 4).astype(np.int32)), pa.py_buffer(ids)])
                else:
                    cells = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([some.column("doc_ids").flatten(), pa.array(base + ends - size), pa.array(size), cells], names=[id_col, "start", "n_tokens", "ids"])

    out = T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL(f"start bigint, n_tokens bigint, ids {'binary' if as_bytes else 'array<int>'}").fields])
    return blocks.mapInArrow(decode, out)


def read_span(spark: SparkSession, folder: str, start: int, count: int) -> DataFrame:
    """start and ids (array) of the stretches, one from each block, that make up the ``count`` ids
    from ``start`` on. Only their blocks are read, each from the checkpoint before it."""
    codes, stop = codes_of(spark, folder), start + count
    blocks = spark.read.parquet(f"{folder}/blocks").filter((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, every, marks, data in zip(*(batch.column(c).to_pylist() for c in ("start", "n_ids", "every", "marks", "data"))):
                lo, hi = max(0, start - at), min(n, stop - at)
                mark = lo // every
                ids = codes.decode([(data, unpack(marks)[mark:], hi - mark * every)], every)[lo - mark * every :]
                yield pa.RecordBatch.from_arrays([pa.array([at + lo]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids.astype(np.int32)))], names=["start", "ids"])

    return blocks.select("start", "n_ids", "every", "marks", "data").mapInArrow(decode, "start bigint, ids array<int>")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that does not exist yet, beside the checkpoints."""
    if not spark.sparkContext.getCheckpointDir():
        reliable(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
