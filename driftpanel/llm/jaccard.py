"""N-gram Jaccard self-join by grouped prefixes.

A document's set holds its distinct shingles, as 64-bit hashes. Any two sets whose Jaccard
similarity reaches the threshold share k shingles within the first ``n - ceil(t n) + k`` of each,
in any common order; the order here puts shingles with the rarest word first, by exact counts of
words over all documents. Sets with the same prefix and size form one group. Groups meet on the
shingles of their prefixes.

Here k is one, and one more for each forty that sets must share (``least_shared``): long texts
meet on a few shingles by chance, the more texts there are the more of them, but not on so many.
Groups of fitting sizes that meet k times on short lists are joined; longer lists are not paired,
so groups that meet on one and share k shingles with any others are joined to its leader. The
connected clusters of groups hold every candidate pair. A cluster's sets go to one task, or, if it
is large, each pair of its parts does. There the groups' prefix lists are looked up: a pair of groups
passes that fits by size, and by the place of its first common shingle can still have enough in
common; the members of such a pair, and those within a group, are verified by whole overlap counts,
unless links found before connect them already. Only a spanning forest of the links comes out. So
no list and no group of near copies ever emits its pairs, and no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Block, ascii_words, corpus_counts, hash_filter, lean, per_block, reliable, spread_join, word_blocks
from .graph import components

#: Odd multipliers of the shingle hash.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


#: Sets that link share one more shingle of their prefixes for each so many that the smaller must share.
EXTRA = 40
#: Groups of a list whose pairs are counted; longer lists join theirs by a leader.
SHORT_LIST = 16
#: A task's share of a large cluster.
PART_SETS, PART_SHINGLES = 1024, 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD[3]
    return x ^ (x >> np.uint64(29))


def shingle(h: np.ndarray, lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of word hashes ``h`` of documents of ``lens`` words: each shingle's document, hash and first
    word. A document with fewer words has its whole sequence as one."""
    doc = np.repeat(np.arange(len(lens)), lens)
    start = np.cumsum(lens) - lens
    docs, hashes, firsts = [], [], []
    for w in range(1, width + 1):
        if w < width:  # documents of exactly w words
            at = start[lens == w]
        else:
            at = np.arange(max(0, len(h) - w + 1))
            at = at[doc[at] == doc[at + w - 1]] if len(at) else at
        total = np.full(len(at), w, np.uint64)
        for k in range(w):
            total = (total ^ (total >> np.uint64(27))) * ODD[k % 3] + h[at + k]
        docs.append(doc[at]), hashes.append(mix(total)), firsts.append(at)
    return np.concatenate(docs), np.concatenate(hashes), np.concatenate(firsts)


def quotient(a: Column | np.ndarray, b: int):
    return F.floor(a / b) if isinstance(a, Column) else a // b


def need(n: Column | np.ndarray, num: int, den: int):
    """ceil(num n / den)."""
    return quotient(num * n + den - 1, den)


def least_shared(n: Column | np.ndarray, num: int, den: int):
    """How many shingles of their prefixes a set of ``n`` and one of at least that many share if they link."""
    return quotient(need(n, num, den), EXTRA) + 1


def sum_by(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums (modulo 2**64) of runs of ``lens``, empty ones included."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    end = np.cumsum(lens)
    return total[end] - total[end - lens]


def document_sets(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """For each document: id, text_hash, n (set size), sid (hash of the set), gid (hash of prefix
    and size) and the prefix, rarest shingles first."""
    blocks = word_blocks(docs, ascii_words, id_col=id_col, text_col=text_col, mark=F.xxhash64(F.col(text_col)))

    def sets(block: Block) -> pa.Table:
        words = block.words()
        h, c = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)), block.numbers("n")
        seq, lens = block.seq, block.lens
        doc, hashed, first = shingle(h[seq], lens, width)
        rarity = c[seq]
        rare = rarity[first]
        for k in range(1, width):
            inside = k < lens[doc]
            rare[inside] = np.minimum(rare[inside], rarity[first[inside] + k])
        order = np.lexsort((hashed, rare, doc))
        doc, hashed = doc[order], hashed[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
        doc, hashed = doc[new], hashed[new]
        n = np.bincount(doc, minlength=len(lens))
        sid = mix(sum_by(mix(hashed), n) + n.astype(np.uint64))
        p = np.where(n > 0, n - need(n, num, den) + least_shared(n, num, den), 0)
        start = np.cumsum(n) - n
        flat = hashed[np.repeat(start - (np.cumsum(p) - p), p) + np.arange(p.sum())]
        gid = mix(sum_by(mix(flat ^ ODD[0]), p) + n.astype(np.uint64) * ODD[1])
        ends = pa.array(np.concatenate([[0], np.cumsum(p)]), pa.int32())
        return pa.table({
            "id": block.ids, "text_hash": pa.array(block.marks), "n": pa.array(n.astype(np.int64)),
            "sid": pa.array(sid.view(np.int64)), "gid": pa.array(gid.view(np.int64)), "prefix": pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64))),
        })

    return reliable(per_block(blocks, corpus_counts(blocks), sets, "id bigint, text_hash bigint, n bigint, sid bigint, gid bigint, prefix array<bigint>"))


class WordHashes(dict):
    """Hashes of words, kept for the words met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 16:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, 42)
        return out


def whole_sets(docs: DataFrame, wanted: DataFrame, text_col: str, width: int) -> DataFrame:
    """sid and its sorted shingle hashes (48 bits of each), for ``wanted`` (sid, text_hash): one text
    of each set is found by its hash, and its set computed again. A filter of fixed size keeps most
    other texts out of the shuffle; what it lets through wrongly, the join and the set's hash drop."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sids, cells = [], []
            for sid, text in zip(batch.column("sid").to_pylist(), batch.column("text").to_pylist()):
                words = ascii_words(text)
                hashed = np.unique(shingle(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), np.array([len(words)]), width)[1])
                own = mix(sum_by(mix(hashed), np.array([len(hashed)])) + np.uint64(len(hashed)))
                if int(own.view(np.int64)[0]) == sid:
                    sids.append(sid), cells.append(np.ascontiguousarray(hashed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(cells, pa.binary())], names=["sid", "cells"])

    texts = docs.select(F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    texts = texts.filter("text is not null").filter(hash_filter(wanted, "text_hash")(F.col("text_hash")))
    one = texts.dropDuplicates(["text_hash"])  # of copies of a text one is sent by each task
    return one.join(wanted, "text_hash").select("sid", "text").mapInArrow(lean(compute), "sid bigint, cells binary")


def cell_values(cell: bytes) -> np.ndarray:
    out = np.zeros((len(cell) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(cell, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def linked(gid: np.ndarray, prefix: list[np.ndarray], n: np.ndarray, cells: list[bytes], num: int, den: int, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(member, another of its component) for all but one member of each component under links of
    similarity num / den or more. With ``part``, only links between members of different parts are
    looked for."""
    values, root = [cell_values(c) for c in cells], np.arange(len(cells))
    _, first, group = np.unique(gid, return_index=True, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[by_group], np.arange(len(first) + 1))
    size, lens = n[first], np.array([len(prefix[i]) for i in first])
    token, owner = np.concatenate([prefix[i] for i in first]), np.repeat(np.arange(len(first)), lens)
    place = np.arange(len(token)) - np.repeat(np.cumsum(lens) - lens, lens)
    order = np.argsort(token, kind="stable")
    token, owner, place = token[order], owner[order], place[order]

    def verify(x: int, others: np.ndarray) -> None:
        many = 4
        while len(others := others[root[others] != root[x]]):
            some, others = others[:many], others[many:]
            flat, sizes = np.concatenate([values[y] for y in some]), n[some]
            at = np.searchsorted(values[x], flat)
            at[at == len(values[x])] = 0
            common = np.add.reduceat(values[x][at] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)
            for y in some[common * den >= num * (n[x] + sizes - common)]:
                root[root == root[y]] = root[x]
            many *= 4

    for g in range(len(first)):
        own, mine = by_group[ends[g] : ends[g + 1]], prefix[first[g]]
        low, high = np.searchsorted(token, mine), np.searchsorted(token, mine, "right")
        counts = high - low
        entry = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        at, other = np.repeat(np.arange(len(mine)), counts), owner[entry]
        after = other > g
        other, where = np.unique(other[after], return_index=True)  # each at the first common shingle
        at, there = at[after][where], place[entry][after][where]
        least, most = np.minimum(size[g], size[other]), np.maximum(size[g], size[other])
        bound = np.minimum(size[g] - at, size[other] - there)  # what they can have in common from there
        fits = (least * den >= num * most) & (bound * (num + den) >= num * (size[g] + size[other]))
        candidates = np.concatenate([np.empty(0, np.int64), *(by_group[ends[k] : ends[k + 1]] for k in other[fits])])
        for i, x in enumerate(own):
            those = np.concatenate([own[i + 1 :], candidates])
            verify(x, those if part is None else those[part[those] != part[x]])
    return [(k, int(r)) for k, r in enumerate(root) if r != k]


def links_in_clusters(members: DataFrame, sets: DataFrame, prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """``members`` has cluster, sid, gid, n; ``sets`` sid, cells; ``prefixes`` gid, prefix: edges u, v
    (sids) that connect what links connect.

    A cluster of at most PART_SETS sets and PART_SHINGLES shingles is one task's work. A larger one
    is cut into parts of about that size by a hash of the sid, and each pair of parts is one.
    """
    sizes = members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("total")).filter("m > 1")
    parts = F.greatest(F.ceil(F.col("m") / PART_SETS), F.ceil(F.col("total") / PART_SHINGLES)).cast("int")
    dealt = spread_join(members, reliable(sizes.select("cluster", parts.alias("parts"))), ["cluster"]).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("a"), F.greatest(k, F.col("part")).alias("b")))
    rows = spread_join(reliable(dealt), prefixes, ["gid"]).join(sets, "sid").select("cluster", "sid", "gid", "n", "prefix", "part", "cells", F.explode(pairs).alias("p"))
    rows = rows.select("cluster", "p.a", "p.b", "sid", "gid", "n", "prefix", "part", "cells").repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit of work."""
        key, held = None, []

        def flush() -> pa.RecordBatch:
            sid, gid, n, part, cells, prefix = zip(*held)
            found = linked(np.array(gid), list(prefix), np.array(n), list(cells), num, den, np.array(part) if key[1] != key[2] else None)
            return pa.RecordBatch.from_arrays([pa.array([sid[i] for i, _ in found], pa.int64()), pa.array([sid[r] for _, r in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            lists = batch.column("prefix")
            flat, ends = np.asarray(lists.values), np.asarray(lists.offsets)
            columns = (batch.column(c).to_pylist() for c in ("cluster", "a", "b", "sid", "gid", "n", "part", "cells"))
            for i, (*unit, sid, gid, n, part, cell) in enumerate(zip(*columns)):
                if unit != key:
                    if len(held) > 1:
                        yield flush()
                    key, held = unit, []
                held.append((sid, gid, n, part, cell, flat[ends[i] : ends[i + 1]]))
        if len(held) > 1:
            yield flush()

    return rows.mapInArrow(lean(solve), "u bigint, v bigint")


def paired(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Edges u, v between groups of fitting sizes that meet often enough on short lists alone.
    ``shared`` has a row for each group of a list: token, gid, n, groups (in the list)."""
    short = shared.filter(F.col("groups") <= SHORT_LIST)
    one, other = (short.select("token", F.col("gid").alias(k), F.col("n").alias(f"n_{k}")) for k in ("u", "v"))
    least, most = F.least("n_u", "n_v"), F.greatest("n_u", "n_v")
    met = one.join(other, "token").filter("u > v").filter(least * den >= num * most).select("u", "v", least.alias("n"))
    return met.groupBy("u", "v", "n").agg(F.count("*").alias("k")).filter(F.col("k") >= least_shared(F.col("n"), num, den)).select("u", "v")


def led(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Edges u, v that connect the groups that meet on a long list at fitting sizes, without those
    that share too little with all others together to link."""
    often = shared.groupBy("gid", "n").agg(F.count("*").alias("k")).filter(F.col("k") >= least_shared(need(F.col("n"), num, den), num, den))
    bucket = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * math.log(den / num))).cast("int")
    long = reliable(shared.filter(F.col("groups") > SHORT_LIST).join(often.select("gid"), "gid", "left_semi").select("token", "gid", bucket.alias("size")))

    # Fitting sizes fall into one bucket or two adjacent ones, so a leader for each list and bucket,
    # tied to that of the next, connects all that can link.
    leaders = reliable(long.groupBy("token", "size").agg(F.min("gid").alias("leader")))
    own = spread_join(long, leaders, ["token", "size"]).select(F.col("gid").alias("u"), F.col("leader").alias("v"))
    after = leaders.select("token", (F.col("size") - 1).alias("size"), F.col("leader").alias("v"))
    return own.union(leaders.join(after, ["token", "size"]).select(F.col("leader").alias("u"), "v"))


def similar_components(
    docs: DataFrame, *, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each document: ``id_col``, n_shingles and component_id, the least id reachable
    by links of similarity num / den or more between sets of distinct ``width``-word shingles.

    Words are runs of anything but ASCII white space, A-Z in lower case. Fewer words than
    ``width`` make one shingle; a null or empty text has none and links with nothing, so its
    component is its own id. A document with a null id takes part; its component is the least id
    reached, null if there is none. Repeated rows stay, and link as copies. Other columns are
    ignored; an empty table gives no rows. Sets and shingles are told apart by 64-bit hashes.
    """
    each = document_sets(docs, id_col, text_col, width, num, den)
    some = each.filter("n > 0")

    sets = reliable(some.groupBy("sid", "gid", "n").agg(F.min("id").alias("least_id"), F.min("text_hash").alias("text_hash")))
    groups = some.groupBy("gid", "n").agg(F.first("prefix").alias("prefix"))
    postings = groups.select("gid", "n", F.explode("prefix").alias("token"))
    lists = postings.groupBy("token").agg(F.count("*").alias("groups")).filter("groups > 1")
    shared = reliable(postings.join(lists.repartition("token"), "token").select("token", "gid", "n", "groups"))
    clusters = components(paired(shared, num, den).union(led(shared, num, den))).select(F.col("node").alias("gid"), "root")
    several = sets.groupBy("gid").agg(F.count("*").alias("members")).filter("members > 1").select("gid")
    marks = reliable(clusters.join(several, "gid", "full_outer").select("gid", F.coalesce("root", "gid").alias("cluster")))
    members = reliable(spread_join(sets, marks, ["gid"]).select("sid", "gid", "n", "text_hash", "cluster"))
    cells = whole_sets(docs, members.select("sid", "text_hash"), text_col, width)
    prefixes = some.filter(hash_filter(members.select("gid"), "gid")(F.col("gid"))).groupBy("gid").agg(F.first("prefix").alias("prefix"))
    roots = components(links_in_clusters(members.drop("text_hash"), cells, prefixes, num, den))

    base = sets.select("sid", "least_id").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least_id", F.coalesce("root", "sid").alias("root"))
    ids = base.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = reliable(base.join(ids, "root").select("sid", "component_id"))
    rows = spread_join(each.select("id", "n", "sid"), named, ["sid"], "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
