"""Runs of repeated words by branching tandem repeats in an enhanced suffix array.

A *run* is a stretch of consecutive words with smallest period q - words q apart are identical - of
``min_words`` words and ``min_repeats`` periods at least, that no neighbouring word extends.

The words of many texts form one sequence; the text's number is part of each word, so that no
match crosses texts and copies of a text cost nothing. Prefix doubling sorts the suffixes (only
those not yet told apart go on) and gives the inverse suffix array; the ranks of its steps tell in
one look whether two stretches of 2**k words are equal, which gives the common prefixes of
neighbours. A stack scan lists the common-prefix intervals; in one of depth d, each suffix i of all
children but the largest is tested: if i + d (or i - d) lies in the interval, but in another child,
a square of period d begins there that the next word does not continue. Every run ends in such a
square of its smallest period. The square is rotated left as far as the words go on to agree, and squares that cover
the same stretch are one run, of the least of their periods. No tree is built.

A run of L >= 2q words repeats its first L - q >= min_words / 2 words, so texts without a repeated stretch of
that length (told by hashes) have none and are left out of the sort.

Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are. Null texts are empty. Texts are worked on whole, of any
length, one or more at a time, in a task's memory of about 300 bytes a word; each row is on its own, so that
repeated rows and ties give the same runs, and an empty table no rows. Columns named like an output are replaced.
"""

from __future__ import annotations

import array
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices
from .repeats import mix

BLOCK = 1 << 20  # bytes of text at a time
TESTS = 1 << 19  # suffixes tested at a time
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
OUTPUTS = ("n_words", "runs", "collapsed")


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of each size, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def may_repeat(words: np.ndarray, lens: np.ndarray, width: int) -> np.ndarray:
    """Whether each text has a stretch of ``width`` words twice, or seems so by hash."""
    found = np.zeros(len(lens), bool)
    n = len(words) - width + 1
    doc = np.repeat(np.arange(len(lens)), lens)
    if n > 0:
        h = doc[:n].astype(np.uint64)
        for k in range(width):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n].astype(np.uint64))
        at = np.flatnonzero(doc[:n] == doc[width - 1 :])
        order = np.argsort(h[at], kind="stable")
        h, own = h[at][order], doc[at][order]
        found[own[1:][h[1:] == h[:-1]]] = True
    return found


def suffix_ranks(words: np.ndarray, doc: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """By step k: for each place the rank of its first 2**k words, the end of the text before all
    words. The last ranks are all different: the inverse suffix array."""
    n = len(words)
    key = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    u, rank = np.arange(n), np.zeros(n, np.int64)
    levels: list[np.ndarray] = []
    while True:
        order = np.argsort(key, kind="stable")
        u, key = u[order], key[order]
        group = rank[u]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        outer = np.concatenate([[True], group[1:] != group[:-1]])
        first = np.flatnonzero(new)
        at = first[np.cumsum(new) - 1]  # where the own key begins, and where the group of equal ranks does
        base = np.flatnonzero(outer)[np.cumsum(outer) - 1]
        rank = rank.copy()
        rank[u] = group + at - base
        levels.append(rank.astype(np.int32) if n < 1 << 31 else rank)
        u = u[np.repeat(np.diff(np.append(first, len(key))) > 1, np.diff(np.append(first, len(key))))]
        if not len(u):
            return levels
        after = u + (1 << (len(levels) - 1))
        inside = after < end[u]
        key = rank[u] * (n + 1) + np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` (different places) have in common."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(len(levels) - 1, -1, -1):
        x, y = a[live] + out[live], b[live] + out[live]
        ok = (x < end[a[live]]) & (y < end[b[live]])
        same = np.zeros(len(live), bool)
        same[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        out[live[same]] += 1 << k
    return out


def small_children(lcp: list[int]) -> np.ndarray:
    """The children of all common-prefix intervals but the largest of each, by one stack scan: rows of
    first and last place of the child, first and last place and depth of the interval."""
    out = array.array("q")
    depths: list[int] = []
    children: list[list[int]] = []
    for k, d in enumerate(itertools.chain(lcp, [0]), 1):  # between the suffixes at k - 1 and k
        left = k - 1
        while depths and depths[-1] > d:
            depth, starts = depths.pop(), children.pop()
            starts.append(left)
            sizes = [b - a for a, b in zip(starts, [*starts[1:], k])]
            skip = sizes.index(max(sizes))
            for i, (a, n) in enumerate(zip(starts, sizes)):
                if i != skip:
                    out.extend((a, a + n - 1, starts[0], k - 1, depth))
            left = starts[0]
        if d and depths and depths[-1] == d:
            children[-1].append(left)
        elif d:
            depths.append(d)
            children.append([left])
    return np.frombuffer(out, np.int64).reshape(-1, 5)


def branching_squares(suffix: np.ndarray, isa: np.ndarray, lcp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and period of all squares that the word behind them does not continue."""
    child = small_children(lcp.tolist())
    size = child[:, 1] - child[:, 0] + 1
    found: list[np.ndarray] = []
    cut = np.searchsorted(np.cumsum(size), np.arange(TESTS, size.sum() + TESTS, TESTS), "left") + 1 if len(child) else []
    for lo, hi in zip([0, *cut], [*cut, len(child)]):
        some, n = child[lo:hi], size[lo:hi]
        a, b, left, right, d = (np.repeat(x, n) for x in some.T)
        i = suffix[ranges(some[:, 0], n)]
        for other, place in ((i + d, i), (i - d, i - d)):
            ok = (other < end[i]) & (other >= begin[i])
            at = isa[np.where(ok, other, 0)]
            ok &= (at >= left) & (at <= right) & ((at < a) | (at > b))
            found.append(np.stack([place[ok], d[ok]]))
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    both = np.unique(both, axis=1)
    return both[0], both[1]


def find_runs(words: np.ndarray, lens: np.ndarray, min_words: int, min_repeats: int) -> tuple[np.ndarray, ...]:
    """Text, start in it, length and period of each run, by text, start and period. ``words`` are
    numbers, of ``lens`` words a text."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    base = np.cumsum(lens) - lens
    kept = np.flatnonzero(may_repeat(words, lens, max(1, -(-min_words // 2))))
    if not len(kept):
        return none
    words = words[ranges(base[kept], lens[kept])]
    lens = lens[kept]
    doc, ends = np.repeat(np.arange(len(lens)), lens), np.cumsum(lens)
    begin, end = np.repeat(ends - lens, lens), np.repeat(ends, lens)
    levels = suffix_ranks(words, doc, end)
    isa = levels[-1].astype(np.int64)
    suffix = np.empty_like(isa)
    suffix[isa] = np.arange(len(isa))
    start, period = branching_squares(suffix, isa, common_prefixes(levels, suffix[:-1], suffix[1:], end), begin, end)
    stop, first = start + 2 * period, begin[start]
    for k in range(len(levels) - 1, -1, -1):  # rotated left, 2**k words at a time
        to = start - (1 << k)
        ok = to >= first
        ok[ok] = levels[k][to[ok]] == levels[k][to[ok] + period[ok]]
        start = np.where(ok, to, start)
    long = stop - start >= np.maximum(min_words, min_repeats * period)
    start, stop, period = start[long], stop[long], period[long]
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    one = np.ones(len(start), bool)
    one[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])  # of one stretch the least period
    start, stop, period = start[one], stop[one], period[one]
    order = np.lexsort((period, start))
    start, stop, period = start[order], stop[order], period[order]
    return kept[doc[start]], start - begin[start], stop - start, period


def collapse_runs(docs: DataFrame, *, text_col: str = "text", min_words: int = 12, min_repeats: int = 2) -> DataFrame:
    """``docs`` with n_words, ``runs`` (array of start, length and period in words, by start, then
    period) and ``collapsed``: the words, joined by one space, without those that any run holds after
    its first period."""
    if min_words < 2 or min_repeats < 2:
        raise ValueError("a run has two periods and two words at least")
    docs = docs.drop(*OUTPUTS).withColumn(text_col, F.col(text_col).cast("string"))
    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, BLOCK):
                yield pa.RecordBatch.from_arrays([*part.columns, *collapsed(part.column(text_col).to_pylist(), min_words, min_repeats)], names=[*names, *OUTPUTS])

    added = T.StructType.fromDDL(f"n_words bigint, runs {RUNS}, collapsed string")
    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, *added.fields]))


def collapsed(texts: list[str | None], min_words: int, min_repeats: int) -> list[pa.Array]:
    """The output columns of a few texts."""
    split = [(t or "").encode().split() for t in texts]
    lens = np.array([len(w) for w in split], np.int64)
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for w in itertools.chain.from_iterable(split)), np.int64, int(lens.sum()))
    doc, start, length, period = find_runs(words, lens, min_words, min_repeats)
    step, base = np.zeros(len(words) + 1, np.int64), np.cumsum(lens) - lens  # words covered once more from here on
    np.add.at(step, base[doc] + start + period, 1)
    np.add.at(step, base[doc] + start + length, -1)
    keep = (np.cumsum(step) == 0).tolist()
    texts_out, cut = [], np.searchsorted(doc, np.arange(len(lens) + 1))
    for i, (w, b) in enumerate(zip(split, base.tolist())):
        texts_out.append(b" ".join(itertools.compress(w, keep[b : b + len(w)]) if cut[i] < cut[i + 1] else w).decode())
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
    return [pa.array(lens, pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), runs), pa.array(texts_out, pa.string())]
