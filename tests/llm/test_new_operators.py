"""Operators 11 to 13 against brute force, the library's own ids and exact round trips."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftpanel.llm import infill, periodic, queries, token_files
from tests.llm.test_operators import SCHEMA, make_texts

FILE = P.path("byte_bpe_50k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*make_texts(), "a b c " * 20 + "x", "tick " * 40, "<P> not a mark here\n", "$1 \\ {2}\n" * 5, "é😀\n😀 ü\n" * 9, "x\x00y\n\x85z \xa0 w"]
    rows = [(i * 3, t, "en", "s", 1, 1, "k", 2, 3, "b") for i, t in enumerate(texts)]
    rows += [rows[0], (None, rows[6][1], *[None] * 8), (None, None, *[None] * 8)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").cache()


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# Periodic runs


def brute_runs(words, min_words=12, min_repeats=2):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        start = 0
        while start < n - q:
            end = start
            while end < n - q and words[end] == words[end + q]:
                end += 1
            if end > start and end + q - start >= max(min_words, min_repeats * q):
                found.setdefault((start, end + q), q)
            start = max(end, start) + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=50), max_size=5), st.integers(2, 14), st.integers(2, 3))
def test_runs_are_those_of_brute_force(texts, min_words, min_repeats):
    lens = np.array([len(t) for t in texts], np.int64)
    words = np.array([w for t in texts for w in t], np.int64)
    got = collections.defaultdict(list)
    for d, *run in zip(*(x.tolist() for x in periodic.find_runs(words, lens, min_words, min_repeats))):
        got[d].append(tuple(run))
    for i, t in enumerate(texts):
        assert got[i] == brute_runs(t, min_words, min_repeats)


def test_collapsed_texts(docs):
    got = periodic.collapse_runs(docs.withColumn("runs", F.lit(1)))
    assert got.columns == [*docs.columns, "n_words", "runs", "collapsed"]
    some = 0
    for r in got.collect():
        words = WORD.findall(r.text or "")
        runs = brute_runs(words) if len(words) < 5000 else [(0, len(words), 1)]  # "ab " many times
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(words), runs)
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
        some += bool(runs)
    assert some >= 4
    assert periodic.collapse_runs(docs.limit(0)).count() == 0


def test_planted_digest(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    planted = 0
    for r in queries.op11_periodic(spark, str(tmp_path)).join(docs.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect():
        words, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)], planted + 1
        runs = brute_runs(words) if n < 5000 else [(0, n, 1)]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{k},{q}\n" for s, k, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    assert planted


def test_long_periodic_text():
    words = ["alpha", "beta", "gamma"] * 70_000  # over a MB
    n, runs, out = periodic.collapsed([" ".join(words), None], 12, 2)
    assert n.to_pylist() == [len(words), 0]
    assert runs.to_pylist() == [[{"start": 0, "length": len(words), "period": 3}], []]
    assert out.to_pylist() == ["alpha beta gamma", ""]


# Fill in the middle


def by_lists(text, doc_id, rate=100):
    h = sha(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in infill.MARKS) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate", [100, 40])
def test_infill_is_that_of_lists(docs, rate):
    got = infill.fill_in_middle(docs.withColumn("_n", F.lit(1)), rate=rate).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    assert got.columns == [*docs.columns, "_n", *infill.OUTPUTS, "back"]
    forms = collections.Counter()
    for r in got.collect():
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == by_lists(r.text or "", r.doc_id, rate)
        assert r.back == (r.text or "")
        forms[r.form] += 1
    assert min(forms["psm"], forms["spm"], forms["plain"]) >= 3
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_infill_of_long_texts_and_other_units(spark):
    rows = [(1, "x\n" * 300_000), (2, "ab" * 1_000_000), (3, "a\n\n\n" * 100_000 + "z"), (4, "one two  three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for unit in (infill.LINES, r"\S+|\s+"):
        got = infill.fill_in_middle(docs, unit=unit).withColumn("back", infill.restored(F.col("output"), F.col("form")))
        assert all(r.back == r.text and r.form != "plain" for r in got.collect())
    with pytest.raises(Exception, match="does not tile"):
        infill.fill_in_middle(docs, unit=r"\S+").collect()


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("<P<", "S", "M"), ("", "a", "b"), ("ab", "ba", "c")])
def test_marks_must_be_told_apart(marks):
    with pytest.raises(ValueError):
        infill.checked(marks)


def test_infill_marks_are_taken_literally(spark):
    marks = ("$1\\", "(?:", "[^]")
    docs = spark.createDataFrame([(k, "a\nb\nc$d\n") for k in range(20)], "doc_id long, text string")
    got = infill.fill_in_middle(docs, marks=marks).withColumn("back", infill.restored(F.col("output"), F.col("form"), marks))
    assert {r.back for r in got.collect()} == {"a\nb\nc$d\n"}


# Token files


def library_ids(texts):
    t = tokenizers.Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return [[*x.ids, 0] for x in t.encode_batch(texts, add_special_tokens=False)]


def test_files_hold_the_librarys_ids_in_order(spark, docs):
    folder = token_files.new_folder(spark, "test-ids")
    token_files.write_ids(docs, FILE, folder, block_ids=900, every=64)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in docs.collect())
    want = collections.Counter((k[1] if k[0] else None, tuple(ids)) for (k, _), ids in zip(rows, library_ids([t for _, t in rows])))
    got = sorted(token_files.read_ids(spark, folder).collect(), key=lambda r: r.start)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    assert spark.read.parquet(f"{folder}/blocks").count() > 3
    raw = token_files.read_ids(spark, folder, as_bytes=True).collect()
    assert {(r.start, bytes(r.ids)) for r in raw} == {(r.start, np.array(r.ids, "<u4").tobytes()) for r in got}
    all_ids = [i for r in got for i in r.ids]
    for start, count in ((0, 5), (890, 300), (len(all_ids) - 3, 100), (100, 0)):
        spans = sorted(token_files.read_span(spark, folder, start, count).collect(), key=lambda r: r.start)
        assert [i for r in spans for i in r.ids] == all_ids[start : start + count]


def test_files_of_awkward_tables(spark):
    none = token_files.new_folder(spark, "test-ids")
    token_files.write_ids(spark.createDataFrame([], "doc_id long, text string"), FILE, none)
    assert token_files.read_ids(spark, none).count() == 0
    empty = token_files.new_folder(spark, "test-ids")
    token_files.write_ids(spark.createDataFrame([("b", None, 1), ("a", "", 2), ("c", "<|endoftext|> is text", 3)], "key string, body string, part int"), FILE, empty, id_col="key", text_col="body", end_id=50256)
    got = token_files.read_ids(spark, empty, id_col="key").orderBy("start").collect()
    assert [(r.key, r.start, r.ids[-1]) for r in got] == [("a", 0, 50256), ("b", 1, 50256), ("c", 2, 50256)]
    assert 50256 not in got[2].ids[:-1]


def test_words_looked_up_are_those_of_the_library():
    texts = ["".join(map(chr, range(k, k + 40))) + " it's we'll\n\n x  y " for k in range(0, 0x250, 40)] + ["日本 x", "don't  stop\t\tnow", "\x1c\x1d 1a'sb", "l" * 200_000, ""]
    want = [x[:-1] for x in library_ids(texts)]
    for enc in (token_files.Encoder(FILE), token_files.Encoder(FILE, known=5)):
        assert [x.tolist() for x in enc.ids(texts)] == want
        assert [x.tolist() for t in texts for x in enc.ids([t])] == want
        assert enc.ids([]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60), st.integers(6, 12), st.integers(1, 9))
def test_codes_round_trip_and_are_short(counts, most, every):
    counts = np.array(counts, np.int64)
    bits = token_files.code_lengths(counts, most)
    used = counts > 0
    assert (bits[used] > 0).all() and (bits[~used] == 0).all() and bits.max(initial=0) <= most
    assert sum(2.0 ** -int(b) for b in bits[used]) <= 1
    if used.sum() > 1 and most == 12:
        assert (bits * counts).sum() <= entropy_bound(counts[used])
    codes = token_files.Codes(bits)
    ids = np.random.default_rng(0).permutation(np.repeat(np.flatnonzero(used), np.minimum(counts[used], 5)))
    cut = len(ids) // 3
    blocks = [(*codes.encode(part, every), len(part)) for part in (ids[:cut], ids[cut:], ids[:0])]
    assert codes.decode(blocks, every).tolist() == ids.tolist()


def entropy_bound(counts):
    """Huffman's total by merging the two least, which a limit of 12 bits and 60 symbols may exceed a little."""
    import heapq

    heap, total = list(counts.tolist()), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    return total * 1.02 + 4


def test_code_lengths_are_huffmans_where_the_limit_allows():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = rng.integers(1, 50, 40)
        bits = token_files.code_lengths(counts, 30)
        assert (bits * counts).sum() == (entropy_bound(counts) - 4) / 1.02
        assert sum(2.0 ** -int(b) for b in bits) == 1
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(100), 6)
