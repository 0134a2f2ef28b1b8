"""Passages are judged by their words, whatever their bytes."""

import numpy as np
import pytest

from driftpanel.llm import repeats, stages

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, length):
    return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), length)) for _ in range(n)]


@pytest.mark.parametrize("length", [1, 3, 12])
def test_passages_of_over_fifty_words_go_and_shorter_ones_stay(spark, length):
    rng = np.random.default_rng(length)
    over, under = words(rng, 51, length), words(rng, 50, length)
    around = lambda k, p: " ".join([f"begin{k}", *words(rng, 30, 8), f"x{k}", *p, f"y{k}", *words(rng, 30, 8)])
    texts = [around(k, p) for k, p in enumerate([over, over, under, under])]
    texts[1] = texts[1].replace(" ".join(over), "\n".join(over))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(8, None, None, None, None), (9, "", "en", "s", 0)], SCHEMA)
    got = {r.doc_id: r for r in stages.repeated_passages(spark, docs, "").collect()}
    assert len(got) == 6 and got[8].text is None and got[9].text == ""
    assert got[0].text == texts[0].replace(" ".join(over), "") and got[1].text == texts[1].replace("\n".join(over), "")
    assert got[2].text == texts[2] and got[3].text == texts[3]
    assert all(got[k].n_chars == len(got[k].text) for k in range(4))


def test_passages_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = list(rng.choice(list("abc") + ["dd", "eé", "漢字"], 90))
    texts = [" ".join(base[a:b]) for a, b in ((0, 40), (5, 60), (30, 90), (0, 9))] + ["ab " * 30, "same " * 9, "same " * 10, " ".join(base[0:12]) + "  z " + " ".join(base[10:30]), "漢字仮名" * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.kept) for r in repeats.remove_passages(docs, words=10).collect()}
    cut = [repeats.WORD.findall(t) for t in texts]
    every = [tuple(w[k : k + 10]) for w in cut for k in range(len(w) - 9)]
    for i, (t, w) in enumerate(zip(texts, cut)):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 9):
            if every.count(tuple(w[k : k + 10])) > 1:
                gone[k : k + 10] = True
        assert got[i][0] == gone.sum()
        assert repeats.WORD.findall(got[i][1]) == [x for x, g in zip(w, gone) if not g]
