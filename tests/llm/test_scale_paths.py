"""The ways that large or uneven data take, on small data: heavy keys, long lists, dense slots."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftpanel.llm import common, decontaminate, jaccard, licenses, repeats


def test_spread_join_is_a_join(spark):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 3000), (2, 1), (3, 2)) for i in range(n)] + [(None, 0)], "k int, i int")
    rows = rows.union(spark.range(4000).select((F.col("id") + 10).cast("int"), F.lit(0)))
    marks = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (11, "d")], "k int, m string")
    for how in ("inner", "left"):
        got, want = common.spread_join(rows, marks, ["k"], how), rows.join(marks, ["k"], how)
        assert collections.Counter(got.collect()) == collections.Counter(want.select(got.columns).collect())
    assert common.spread_join(rows.limit(0), marks, ["k"]).count() == 0


def brute(sets, num, den):
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if den * len(a & b) >= num * len(a | b):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


@pytest.mark.parametrize("parts", [False, True])
@pytest.mark.parametrize("num,den", [(9, 10), (4, 5), (1, 2)])
def test_linked_groups_against_all_pairs(num, den, parts):
    rng = np.random.default_rng(num)
    sets = []
    for k in range(25):
        base = rng.choice(4000, int(rng.integers(3, 60)), replace=False) + 1
        for _ in range(int(rng.integers(1, 6))):
            s = set(base.tolist())
            for x in rng.choice(base, int(rng.integers(0, 4))):
                s.discard(int(x))
                s.add(int(rng.integers(5000, 9000)))
            sets.append(s)
    sets = [set(x) for x in sorted({tuple(sorted(s)) for s in sets})]
    often = collections.Counter(x for s in sets for x in s)
    ordered = [sorted(s, key=lambda x: (often[x], x)) for s in sets]
    prefix = [np.array(o[: len(o) - -(-num * len(o) // den) + 1]) for o in ordered]
    gid = np.array([hash((len(o), tuple(p.tolist()))) % (1 << 60) for o, p in zip(ordered, prefix)])
    cells = [np.ascontiguousarray(np.array(sorted(s), "<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for s in sets]
    n, part = np.array([len(s) for s in sets]), np.arange(len(sets)) % 2
    found = jaccard.linked(gid, prefix, n, cells, num, den, part if parts else None)
    if parts:
        links = {(i, j) for i in range(len(sets)) for j in range(i) if part[i] != part[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])}
        root = list(range(len(sets)))
        for i, j in links:
            root = [root[j] if r == root[i] else r for r in list(root)]
    else:
        root = brute(sets, num, den)
    got = list(range(len(sets)))
    for i, j in found:
        got = [got[j] if r == got[i] else r for r in list(got)]
    same = lambda r: {tuple(i for i, x in enumerate(r) if x == v) for v in set(r)}
    assert same(got) == same(root) and len(found) == len(sets) - len(set(root))


def test_seeds_of_many_contexts_are_counted_by_windows(spark):
    """One seed in many contexts: the middle of every text is the same, what stands around differs."""
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    say = lambda n: rng.choice(letters, n).tobytes().decode()
    core, left, right = say(40), [say(30) for _ in range(4)], [say(30) for _ in range(4)]
    texts = [say(20) + left[int(rng.integers(4))] + core + right[int(rng.integers(4))] + say(20) for _ in range(40)] + [say(30) + core + say(30) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    seen = collections.Counter(t[k : k + 60] for t in texts for k in range(len(t) - 59))
    want = {}
    for i, t in enumerate(texts):
        hit = np.zeros(len(t), bool)
        for k in range(len(t) - 59):
            if seen[t[k : k + 60]] > 1:
                hit[k : k + 60] = True
        want[i] = int(hit.sum())
    for limit in (1, 3, 1000):
        got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(df, length=60, max_contexts=limit).collect()}
        assert got == want and sum(v > 0 for v in want.values()) >= 30


DENSE = "Start with 12 kg of sand, 7 m of rope, 250 ml of oil and 3 h of work on 4 days, then add 18 lb of nails for 90 dollars"


def test_items_dense_in_slots_are_found(spark):
    """Recall over items with a slot in every third word, as they are and with other values."""
    rng = np.random.default_rng(0)
    nouns = "sand rope oil work nails paint brick cloth grain salt water steel paper stone glass cable".split()
    items = [DENSE] + ["First " + " and ".join(f"{rng.integers(2, 900)} kg of {a} {b}" for a, b in zip(rng.choice(nouns, 7), rng.choice(nouns, 7))) for _ in range(60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    other = [__import__("re").sub(r"\d+", lambda m: str(int(m[0]) * 3 + 1), t) for t in items]
    rows = [(i, f"We read this. {t}. That was all.") for i, t in enumerate([*items, *other])] + [(999, "12 34 56 78 90 12 kg 4 m 5 s 7 8 9"), (1000, "1 2 3 " * 3000)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id int, text string"), bench).collect()}
    for base in (0, len(items)):
        assert sum((base + i, i) in got for i in range(len(items))) >= 0.9 * len(items)
    assert (0, 0) in got and (len(items), 0) in got and not any(d >= 999 for d, _ in got)


def test_runs_of_bare_numbers_need_their_values(spark):
    item = "1 22 3 44 5 66 7 88 9 10 11 12"
    bench = spark.createDataFrame([(0, item), (1, "one two three four five six")], "item_id int, text string")
    rows = [(0, f"table {item} end"), (1, "table 2 33 4 55 6 77 8 99 10 11 12 13 end"), (2, "so one two three four five six it is"), (3, "so one two three four five it is")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id int, text string"), bench).collect()}
    assert got == {(0, 0), (2, 1)}


def test_licences_that_extend_others(spark):
    s = licenses.SENTENCES
    bsd = [s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")]
    gpl2 = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty"
    texts = ["\n".join(f"{x}." for x in bsd), "\n".join(f"{x}." for x in [*bsd[:3], bsd[4]]), "\n".join(f"{x}." for x in bsd[:4]), gpl2, "\n".join(f"{s[k]}." for k in ("mit-title", "mit-grant", "mit-keep", "mit-as-is", "mit-liability"))]
    got = sorted((r.doc_id, r.rule, r.license) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect())
    assert got == [(0, "bsd3-whole", "BSD-3-Clause"), (1, "bsd2-whole", "BSD-2-Clause"), (2, "bsd3-text", "BSD-3-Clause"), (3, "gpl2-header-parted", "GPL-2.0-or-later"), (4, "mit-titled-whole", "MIT")]


def test_names_that_operators_use_inside_are_free(spark):
    text = "some words stand here and some more of them stand there"
    df = spark.createDataFrame([(1, text, 1, 2, 3, 4, 5, 6, 7, 8)], "doc_id int, text string, _key int, _maybe int, _spans int, _r int, _w int, _lines int, _row int, _codes int")
    from driftpanel.llm import rules

    assert set(df.columns) <= set(repeats.remove_repeats(df).columns) and repeats.remove_repeats(df).first()._key == 1
    assert repeats.remove_passages(df).first()._codes == 8
    assert rules.judge(df).first()._lines == 6
