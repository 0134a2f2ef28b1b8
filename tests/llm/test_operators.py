"""Each operator against brute force or a held-out figure, on small tables with the awkward rows:
nulls, empty and long texts, repeated rows, ties, clashing column names, empty tables."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from driftpanel.llm import bpe, decontaminate, jaccard, langid, licenses, maxent, quality, repeats, rules, token_counts
from driftpanel.llm.common import ascii_words

PATH = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = "the of and to in that it was for on with as his they at be this from have or by one had not but what all were when we there can an your which".split()
FREMD = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, kept string, seed int, n int, block string"


def make_texts():
    rng = np.random.default_rng(11)
    say = lambda words, n: " ".join(w + ("%d" % rng.integers(60) if rng.random() < 0.5 else "") for w in rng.choice(words, n))
    base = say(WORDS, 150)
    passage = say(WORDS, 110)
    parts = base.split()
    texts = [base, base, " ".join([*parts[:70], "edited", *parts[71:]]), " ".join([*parts[:40], "one", "more", *parts[40:]])]
    texts += [say(WORDS, 80) + "\n" + passage + "\n" + say(WORDS, 60), passage + " " + say(FREMD, 50), say(FREMD, 200), say(FREMD, 90) + ". " + say(WORDS, 5)]
    texts += [None, "", " \t\n ", "one", "two words", "the the the", "12345 !!! 678", "Ünïcode “quotes” 😀 …    x²  ½ß\r\n\n  end  ", "a" * 5000, "ab " * 4000]
    texts += [say(WORDS, int(rng.integers(20, 200))) for _ in range(12)] + [say(FREMD, int(rng.integers(20, 200))) for _ in range(12)]
    texts += ["line again and again here\n" * 8 + say(WORDS, 30), "### %%% $$$ *** " * 30]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "de" if t and " der" in t else "en", "s", 1, 1, "k", 2, 3, "b") for i, t in enumerate(make_texts())]
    rows += [rows[0], (None, rows[6][1], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def same(a, b):
    assert collections.Counter(a) == collections.Counter(b)


def fold(i, n):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


def test_bpe_round_trip(docs, nothing):
    enc = bpe.encoding(PATH, P.PATTERN)
    got = bpe.encode(docs, PATH, P.PATTERN, block_bytes=3000)
    want = [(r.doc_id, tuple(enc.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect()]
    same([(r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got.collect()], want)
    again = bpe.decode(got.drop("decoded"), PATH, out_col="bytes")
    same([bytes(r.bytes) for r in again.collect()], [w[2] for w in want])
    assert bpe.encode(nothing, PATH, P.PATTERN).count() == 0


@pytest.mark.parametrize("text", ["it's  we'll\t\tx", "aɐb ć", "\x1c\x85\xa0 9\xb2\xbc", "  \n  lead", "日本語 テキスト １２"])
def test_pre_tokens_are_those_of_the_pattern(text):
    import regex

    assert bpe.pre_tokens(text, P.PATTERN) == regex.findall(P.PATTERN, text)


def test_token_counts_add_up_and_follow_the_rule(docs, nothing):
    enc = bpe.encoding(PATH, P.PATTERN)
    got = token_counts.count_tokens(docs, PATH, P.PATTERN, fields=("text", "source")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for r in docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        whole = (r.text or "") + "\n" + (r.source or "")
        secs = sorted(((x.start, x.end, x.n_tokens) for x in set(by[r.doc_id])))
        data = [len(whole[: s[0]].encode()) for s in secs] + [len(whole.encode())]
        count, at = [0] * len(secs), 0
        for t in enc.encode_ordinary(whole):
            n = len(enc.decode_single_token_bytes(t))
            held = [max(0, min(at + n, b) - max(at, a)) for a, b in zip(data, data[1:])]
            count[held.index(max(held))] += 1
            at += n
        assert count == [s[2] for s in secs]
    assert token_counts.count_tokens(nothing, PATH, P.PATTERN).count() == 0


def test_repeats_match_brute_force(docs, nothing):
    for limit in (5000, 1):
        got = repeats.remove_repeats(docs.drop("kept"), length=60, max_contexts=limit).withColumn("h", F.sha2("kept", 256))
        rows = docs.collect()
        texts = [(r.text or "").encode() for r in rows]
        seen = collections.Counter(t[k : k + 60] for t in texts for k in range(len(t) - 59))
        want = []
        for r, t in zip(rows, texts):
            m = np.zeros(len(t), bool)
            for k in range(len(t) - 59):
                if seen[t[k : k + 60]] > 1:
                    m[k : k + 60] = True
            runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
            want.append((r.doc_id, len(t), int(m.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()))
        same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.h) for r in got.collect()], want)
    assert repeats.remove_repeats(nothing).count() == 0


def test_maximal_repeats_hold_all_occurrences():
    contexts, at = [b"xxabcdefyy", b"zxabcdefyz", b"xxabcdefqq", b"1234cdef56"], [4, 4, 4, 4]
    got = list(repeats.maximal_repeats(contexts, at, 5))
    assert (4, 4, [0, 2]) in [(a, b, sorted(m)) for a, b, m in got]
    assert any(b == 6 - 1 or b >= 5 for _, b, m in got if set(m) >= {0, 1}) and not any(3 in m for _, _, m in got)


def test_whole_characters_stay_whole():
    data = "éaé".encode()
    assert repeats.inner(data, 1, 4) == (2, 3)


def components(sets, num, den):
    ids = list(range(len(sets)))
    root = list(ids)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in ids]


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_jaccard_components(docs, width, num, den):
    rows = docs.collect()
    sets = []
    for r in rows:
        w = ascii_words(r.text or "")
        sets.append(frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else []))
    root = components(sets, num, den)
    least = collections.defaultdict(list)
    for r, k in zip(rows, root):
        if r.doc_id is not None:
            least[k].append(r.doc_id)
    want = [(r.doc_id, len(s), r.doc_id if not s else min(least[k], default=None)) for r, s, k in zip(rows, sets, root)]
    got = jaccard.similar_components(docs, width=width, num=num, den=den)
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], want)


def test_jaccard_second_pass_finds_links_that_leaders_miss(spark):
    rng = np.random.default_rng(5)
    base, texts = [f"w{i}" for i in range(60)], []
    for k in range(40):  # a chain: each differs from the next by one word
        base = list(base)
        base[int(rng.integers(60))] = f"x{k}"
        texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    w = [t.split() for t in texts]
    sets = [frozenset(zip(x, x[1:], x[2:])) for x in w]
    want = components(sets, 9, 10)
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(df, width=3, num=9, den=10).collect()}
    assert [got[i] for i in range(40)] == want and len(set(want)) < 40


def test_jaccard_of_nothing(nothing):
    assert jaccard.similar_components(nothing).count() == 0


def test_language_model_scores(docs, nothing):
    rows = docs.collect()
    words = [maxent.words_and_end(r.text or "") for r in rows]
    count = collections.Counter(w for r, ws in zip(rows, words) if fold(r.doc_id, 5) != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    want = [(r.doc_id, fold(r.doc_id, 5) == 1, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for r, ws in zip(rows, words)]
    got = maxent.score(docs).collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], want)
    assert all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert maxent.score(nothing).count() == 0


def test_language_model_is_a_distribution():
    head = {b"the": 0, b"of": 1}
    mass = np.zeros(maxent.CLASSES)
    mass[0], mass[maxent.ending(b"cats")] = 12.0, 6.5
    mass[maxent.RARE] = 3.0
    vocab = maxent.Vocabulary(20, 5, 2, mass, head, np.array([7, 4]))
    model = maxent.Model(vocab, np.random.default_rng(0).normal(0, 0.3, 2 * maxent.ROWS * maxent.CLASSES + maxent.ROWS * maxent.MEMBERS).astype(np.float32))
    total = 0.0
    for cls in range(maxent.CLASSES):
        places = range(maxent.MEMBERS) if cls < maxent.HEADS else [0]
        code = np.array([[7, cls << 24 | p << 16 | 99] for p in places], np.uint32)
        total += sum(10 ** model.log10(c, np.array([2]))[1] for c in code)
    assert abs(total - 1) < 1e-4


def test_language_identification(docs, nothing):
    got = {(r.doc_id, r.lang_pred): r for r in langid.identify(docs).collect()}
    assert len(got) >= docs.count() - 1
    pred = {k[0]: k[1] for k in got if k[0] is not None}
    rows = [r for r in docs.collect() if r.doc_id is not None and fold(r.doc_id, 3) == 1 and r.text and len(r.text) > 300 and r.text.strip("ab ")]
    clear = [r for r in rows if "edited" not in r.text]
    assert sum(pred[r.doc_id] == r.lang for r in clear) >= 0.8 * len(clear)
    for r in docs.collect():
        if r.doc_id is not None and not any(c.isalpha() for c in r.text or ""):
            assert pred[r.doc_id] == "und"
    assert langid.identify(nothing).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_classifier(spark, docs, nothing):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, " ".join(w + (" |" if bad else "") for w in rng.choice(WORDS, 40))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(240)] + [(1, 1, None), (None, 1, 1), (2, None, 1)], "doc_id bigint, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 240 and sum(r.predicted == (r.doc_id % 4 != 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.classify(docs, labels).count() == docs.count()
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(nothing, labels).count() == 0


def test_quality_rules_count_and_keep(docs, nothing):
    rows = docs.collect()
    got = rules.judge(docs)
    assert set(docs.columns) - {"kept"} <= set(got.columns)
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r)
    for r in rows:
        text = r.text or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c = collections.Counter(g)
        rep = len({i + k for i, x in enumerate(g) if c[x] > 1 for k in range(5)})
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        want = (len(w), sum(map(len, w)), sum(text.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), rep, len(w) < 10 or 100 * rep > 20 * len(w))
        assert want in [(x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in by[r.doc_id]]
    assert all(not (x.kept and x.base_failed) for v in by.values() for x in v)
    assert rules.judge(nothing).count() == 0


def test_license_rules_match_in_order(spark, nothing):
    s = licenses.SENTENCES
    header = [s[k] for k in ("apache2-grant", "apache2-use", "apache2-copy", "apache2-basis", "apache2-limits")]
    texts = [". ".join(header), ". ".join(reversed(header)), "Words before.\nReleased under the MIT License.\nAll rights reserved.", s["mit-grant"] + "\n" + s["mit-keep"] + ".", None, "", "no licence here"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, "all RIGHTS reserved!!", 0)], "doc_id bigint, text string, first int")
    got = {(r.doc_id, r.rule, r.n_sentences) for r in licenses.scan(df).collect()}
    assert got == {(0, "apache2-header", 5), (1, "apache2-grant", 1), (2, "mit-notice", 1), (2, "reserved", 1), (3, "mit-text", 2), (None, "reserved", 1)}
    assert licenses.scan(nothing).count() == 0


def test_decontamination_by_templates(spark, docs, nothing):
    item = "A train from Boston travels 60 km in 2 hours, and then it goes on for another 60 km to the station of Smith before stopping there"
    bench = spark.createDataFrame([(1, item, 0), (2, "short one", 0), (3, None, 0), (None, item, 0)], "item_id bigint, text string, doc_id int")
    other = item.replace("60", "85").replace("Boston", "Madrid")
    mixed = item.replace("60 km in", "85 km in")
    texts = ["Before it. " + item + ". After it.", other, mixed, "nothing of the kind stands here at all, only words", None, ""]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0), (None, item, 0)], "doc_id bigint, text string, item_id int")
    got = {(r.doc_id, r.item_id): r.covered_words / r.item_words for r in decontaminate.leaks(df, bench).collect()}
    assert got[0, 1] > 0.8 and got[1, 1] == got[0, 1] and set(got) <= {(0, 1), (1, 1), (2, 1)}
    assert got.get((2, 1), 0) < got[0, 1]  # one value of the item stands for two of the document
    assert decontaminate.leaks(nothing, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
