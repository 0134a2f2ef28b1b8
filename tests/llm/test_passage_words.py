"""Operator 3 counts the words of repeated passages beside the bytes that it removes."""

import numpy as np

from driftpanel.llm import queries, repeats

SCHEMA = "doc_id bigint, text string"


def words(rng, n, length):
    return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), length)) for _ in range(n)]


def test_short_passages_of_over_fifty_words_are_counted_and_stay(spark, tmp_path):
    """Under 400 bytes nothing is removed, as the contract says, but the passage's words are told."""
    rng = np.random.default_rng(2)
    over, under, long = words(rng, 51, 4), words(rng, 50, 4), words(rng, 90, 6)
    around = lambda p, by=" ": " ".join([*words(rng, 40, 5), by.join(p), *words(rng, 40, 5)])
    texts = [around(over), around(over, "\n"), around(under), around(under), around(long), around(long), around([]), " ".join(over[:50]), None, "", " \n"]
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_repeats(spark, str(tmp_path)).collect()}
    assert [got[k].n_passage_words for k in range(len(texts))] == [51, 51, 0, 0, 90, 90, 0, 0, 0, 0, 0]
    assert [got[k].n_removed > 0 for k in range(len(texts))] == [k in (4, 5) for k in range(len(texts))]
    assert all(got[k].text == (texts[k] or "") for k in got if k not in (4, 5))


def test_passage_words_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = list(rng.choice(list("abc") + ["dd", "eé", "漢字", "x—y", "n b"], 90))
    texts = [" ".join(base[a:b]) for a, b in ((0, 40), (5, 60), (30, 90), (0, 9))] + ["ab " * 30, "same " * 9, "\tsame\n" * 10, " ".join(base[0:12]) + "  z " + " ".join(base[10:30]), "漢字仮名" * 5]
    texts += [" ".join(rng.permutation(base)[: int(rng.integers(10, 80))]) for _ in range(10)] + [texts[1], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    cut = [repeats.BLANK_WORD.findall(t or "") for t in texts]
    every = [tuple(w[k : k + 10]) for w in cut for k in range(len(w) - 9)]
    want = {}
    for i, w in enumerate(cut):
        hit = np.zeros(len(w), bool)
        for k in range(len(w) - 9):
            if every.count(tuple(w[k : k + 10])) > 1:
                hit[k : k + 10] = True
        want[i] = int(hit.sum())
    assert 5 < sum(v > 0 for v in want.values()) < len(texts)
    plain = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs, length=60).collect()}
    for limit in (5000, 1):
        rows = repeats.remove_repeats(docs, length=60, max_contexts=limit, passage_words=10).collect()
        assert {r.doc_id: r.n_passage_words for r in rows} == want
        assert {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == plain
