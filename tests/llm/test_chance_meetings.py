"""Long texts that meet on a few rare shingles by chance form no clusters; those that link still do."""

import collections

import numpy as np
import pytest

from driftpanel.llm import jaccard, stages


def brute(texts, width, num, den):
    words = [t.split() for t in texts]
    sets = [frozenset(zip(*(w[k:] for k in range(width)))) for w in words]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_chance_meetings_form_no_cluster(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [[f"t{i}w{k}" for k in rng.permutation(np.repeat(np.arange(150), 4))] for i in range(40)]
    for i in range(40):  # a ring of rare phrases, each in two texts
        words[i][100:103] = [f"p{i}a", f"p{i}b", f"p{i}c"]
        words[(i + 1) % 40][300:303] = [f"p{i}a", f"p{i}b", f"p{i}c"]
    copy = list(words[7])
    copy[500:503] = ["x", "y", "z"]
    texts = [" ".join(w) for w in [*words, copy]]
    sent = []
    links = jaccard.links_in_clusters
    monkeypatch.setattr(jaccard, "links_in_clusters", lambda members, *rest: sent.append(members.count()) or links(members, *rest))
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), width=3, num=9, den=10).collect()}
    assert got == {i: 7 if i == 40 else i for i in range(41)}
    assert sent == [2]


def test_near_copies_sends_no_texts_that_meet_by_chance(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [[f"t{i}w{k}" for k in rng.permutation(np.repeat(np.arange(150), 4))] for i in range(30)]
    for i in range(30):  # each phrase of five words in two texts
        for text, at in ((words[i], 100), (words[(i + 1) % 30], 300)):
            text[at : at + 5] = [f"p{i}{c}" for c in "abcde"]
    copy = list(words[7])
    copy[500:503] = ["x", "y", "z"]
    sent = []
    links = jaccard.links_in_clusters
    monkeypatch.setattr(jaccard, "links_in_clusters", lambda members, *rest: sent.append(members.count()) or links(members, *rest))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([*words, copy])], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in stages.near_copies(spark, docs, "").collect()) == list(range(30))
    assert sent == [2]


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 4, 5)])
@pytest.mark.parametrize("short", [1, 4, 16])
def test_longer_sets_against_all_pairs(spark, monkeypatch, width, num, den, short):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    rng = np.random.default_rng(short)
    texts = []
    for i in range(12):
        base = [f"b{i % 3}w{k}" for k in rng.integers(0, 150, int(rng.integers(90, 700)))]
        for _ in range(6):  # links within a few words of the threshold
            w = list(base)
            edits = int(len(w) * (den - num) / den / width / 1.9 * rng.uniform(0.5, 1.3))
            for at in rng.choice(len(w), edits, replace=False):
                w[at] = f"e{rng.integers(0, 40)}"
            texts.append(" ".join(w[: len(w) - int(rng.integers(0, 1 + len(w) // 12))]))
    want = brute(texts, width, num, den)
    assert len(set(want)) > 12 and max(collections.Counter(want).values()) > 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(df, width=width, num=num, den=den).collect()}
    assert [got[i] for i in range(len(texts))] == want
