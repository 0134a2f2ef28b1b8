"""Counts, sets and corrected popcounts of the language filter, and word vectors and pooling of the quality
classifier, against plain Python."""

import collections

import numpy as np
import xxhash

from driftpanel.llm import langid, quality
from tests.llm.test_operators import FREMD, WORDS, fold


def sample(spark):
    rng, rows = np.random.default_rng(21), []
    for i in range(60):
        lang = ("en", "de", None)[i % 3] if i % 10 else "xx"
        words = FREMD if lang == "de" else WORDS
        text = " ".join(rng.choice(words, int(rng.integers(1, 40)))) + ("!" * (i % 4)) + (" Ünï\n" if i % 5 == 0 else "")
        rows.append((i, text, lang))
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 !!", "en"), (None, "the and of", None), (7, rows[7][1], rows[7][2])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def grams(text):
    """Runs of four bytes of lower-case letters and blanks, without two blanks together."""
    data = b" " + bytes(b if b >= 0x80 or chr(b).isalpha() else 32 for b in text.lower().encode()) + b" "
    return [data[i : i + 4] for i in range(len(data) - 3) if b"  " not in data[i : i + 4]]


def test_language_filter_by_hand(spark):
    rows, df = sample(spark)
    counts = collections.defaultdict(collections.Counter)
    for i, text, lang in rows:
        if fold(i, 3) != 1 and text is not None and lang is not None:
            counts[lang].update(grams(text))
    langs = sorted(counts)
    totals = {k: sum(c.values()) for k, c in counts.items()}
    owned = collections.defaultdict(int)
    for g in set().union(*counts.values()):
        rate = {k: counts[k][g] / totals[k] for k in langs}
        for bit, k in enumerate(langs):
            if counts[k][g] >= langid.LEAST_COUNT and rate[k] >= langid.LEAST_RATE and rate[k] >= langid.SHARE * sum(rate.values()):
                owned[g] |= 1 << bit

    def places(g):
        return [int(x[0]) for x in langid.places(np.array([int.from_bytes(g, "little")], np.uint32))]

    filter_ = collections.defaultdict(int)
    for g, mask in owned.items():
        for p in places(g):
            filter_[p] |= mask
    got_langs, table, wrong, most = langid.train(df.filter("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"), "text", "lang")
    assert got_langs == langs and {int(p): int(table[p]) for p in np.flatnonzero(table)} == {p: m for p, m in filter_.items() if m}
    fill = [sum(m >> k & 1 for m in filter_.values()) / (1 << langid.PLACES) for k in range(len(langs))]
    assert np.allclose(wrong, np.array(fill) ** langid.HASHES) and langs[most] == max(langs, key=lambda k: totals[k])

    for r in langid.identify(df).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        found = grams(text or "")
        hits = []
        for k in range(len(langs)):
            n = sum(all(filter_[p] >> k & 1 for p in places(g)) for g in found)
            hits.append(max(0, (n - len(found) * wrong[k]) / (1 - wrong[k])))
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif sum(hits) == 0:
            assert (r.lang_pred, r.score) == (langs[most], 0)
        else:
            assert r.lang_pred == langs[int(np.argmax(hits))] and abs(r.score - max(hits) / sum(hits)) < 1e-12
        assert r.held_out == (fold(r.doc_id, 3) == 1)


def test_word_vectors_and_pooling_by_hand(spark):
    rows, df = sample(spark)
    place, sign = quality.index_vectors()
    bucket = lambda w: xxhash.xxh3_64_intdigest(w) % quality.BUCKETS
    table = np.zeros((quality.BUCKETS, quality.WIDTH))
    words = {}
    for n, (_, text, _) in enumerate(rows):
        words[n] = [bucket(w) for w in quality.TOKEN.findall((text or "").encode().lower() if (text or "").isascii() else (text or "").encode().translate(quality.ASCII_LOWER))]
        for i, b in enumerate(words[n]):
            for j in range(max(0, i - quality.REACH), min(len(words[n]), i + quality.REACH + 1)):
                if i != j:
                    for k in range(quality.NONZERO):
                        table[b, place[words[n][j], k]] += sign[words[n][j], k]
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    want = table / np.where(norm > 0, norm, 1)
    got = quality.word_vectors(df, "text")
    assert np.allclose(got, want, atol=1e-6) and np.abs(want).sum() > 0
    vectors = quality.pooled([t for _, t, _ in rows], got, quality.Buckets())
    for n, v in enumerate(vectors):
        mean = want[words[n]].mean(axis=0) if words[n] else np.zeros(quality.WIDTH)
        assert np.allclose(v[:-1], mean, atol=1e-5) and abs(v[-1] - np.log1p(len(words[n]))) < 1e-5


def test_temperature_is_the_best_of_its_grid():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, quality.WIDTH + 1)).astype(np.float32)
    y = (x[:, 0] + rng.normal(0, 0.3, 3000) > 0).astype(float)
    net = quality.Network(x, y)
    test = np.arange(3000) % 5 == 0
    loss = lambda s: np.mean(np.logaddexp(0, net.logit(x[test]) / s) - y[test] * net.logit(x[test]) / s)
    assert all(loss(net.temperature) <= loss(s) + 1e-12 for s in np.exp(np.linspace(np.log(0.25), np.log(8), 61)))
    p = net.probability(x[test])
    assert ((p > 0) & (p < 1)).all() and ((p > 0.5) == y[test]).mean() > 0.6
    assert (quality.Network(x[:3], np.ones(3)).probability(x) == 1).all()
