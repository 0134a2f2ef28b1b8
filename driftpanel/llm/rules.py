"""Quality rules under weak supervision, in DataFrame expressions only.

Each rule votes keep (1) or reject (-1) on a document, or abstains (0). Expectation-maximisation
over the counts of vote patterns estimates how common good documents are, how often each rule that
votes on a good document says keep, and how often on a bad one it says reject. A document is kept
if the posterior probability that it is good is at least one half. The patterns are at most
3 ** rules, whatever the number of documents, so the estimation is one expression over one row.

Null texts have no words; texts of any length are counted whole. Repeated rows and null ids are
scored one by one; a posterior of exactly one half keeps. Other columns pass through untouched,
whatever their names, but for those named like an output, which are replaced. An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, once, reliable

WINDOW = 5
ROUNDS = 25
#: name -> (condition to reject, condition to keep); SQL that Spark and DuckDB read alike.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols * 10 > n_words * 3", "n_symbols * 50 <= n_words"),
    "letters": ("n_letters * 100 < word_chars * 75", "n_letters * 100 >= word_chars * 90"),
    "repeats": ("n_repeat_words * 100 > n_words * 15", "n_repeat_words * 100 <= n_words * 5"),
    "lines": ("n_dup_lines * 10 > n_lines * 3", "n_dup_lines = 0"),
    "word_length": ("word_chars < n_words * 3 or word_chars > n_words * 11", "word_chars >= n_words * 4 and word_chars <= n_words * 9"),
    "length": ("n_words < 20", "n_words >= 50"),
}
STATS = ["n_words", "word_chars", "n_letters", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Start and bounds of the estimates: prior of good, P(keep | good), P(reject | bad).
START, BOUNDS = (0.9, 0.95, 0.5), ((0.05, 0.99), (0.5, 0.999), (0.01, 0.99))
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of STATS, bigint, from the whole text."""
    w, lines, h, g, s_, p = free_names(docs, "_w", "_lines", "_h", "_g", "_s", "_p")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spaces = r"[\x20\x09-\x0D]+"
    one = docs.withColumns({
        w: once(F.array_remove(F.split(text, spaces), "")),
        lines: once(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))),
        "word_chars": F.length(F.regexp_replace(text, spaces, "")).cast("bigint"),
        "n_letters": F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint"),
    })
    two = one.withColumns({
        "n_words": F.size(w).cast("bigint"),
        h: once(F.transform(w, lambda x: F.xxhash64(x))),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
    }).drop(w, lines)
    last = F.size(h) - WINDOW
    window = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    three = two.withColumn(g, once(F.when(last >= 0, window).otherwise(F.array().cast("array<bigint>")))).drop(h)
    # Only a text with some window twice needs its positions.
    four = three.withColumn(s_, once(F.when(F.size(F.array_distinct(g)) < F.size(g), F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))).drop(g)
    twice = F.filter(s_, lambda s, k: (s["h"].eqNullSafe(F.get(s_, k - 1)["h"])) | (s["h"].eqNullSafe(F.get(s_, k + 1)["h"])))
    five = four.withColumn(p, once(F.array_sort(F.transform(twice, lambda s: s["i"])))).drop(s_)
    covered = F.aggregate(
        p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"],
    )
    return five.withColumn("n_repeat_words", once(F.coalesce(covered, F.lit(0)).cast("bigint"))).drop(p)


def votes() -> str:
    return "array(" + ", ".join(f"case when {reject} then -1 when {keep} then 1 else 0 end" for reject, keep in RULES.values()) + ")"


def estimates(patterns: DataFrame) -> DataFrame:
    """``patterns`` has votes array<int> and n. Returns votes and posterior, one row for each."""
    n, (pi, q, r) = len(RULES), START
    (pi0, pi1), (q0, q1), (r0, r1) = BOUNDS
    good = "aggregate(zip_with(p.votes, s.q, (v, x) -> case v when 1 then x when -1 then 1D - x else 1D end), s.pi, (a, x) -> a * x)"
    bad = "aggregate(zip_with(p.votes, s.r, (v, x) -> case v when 1 then 1D - x when -1 then x else 1D end), 1D - s.pi, (a, x) -> a * x)"
    weighed = f"transform(pats, p -> named_struct('v', p.votes, 'n', p.n, 'w', {good} / ({good} + {bad})))"

    def total(what: str) -> str:
        return f"aggregate(t, 0D, (a, x) -> a + {what})"

    def rates(vote: int, weight: str, low: float, high: float) -> str:
        hit, all_ = total(f"if(x.v[j] = {vote}, x.n * {weight}, 0D)"), total(f"if(x.v[j] <> 0, x.n * {weight}, 0D)")
        return f"transform(sequence(0, {n - 1}), j -> greatest({low}D, least({high}D, ({hit} + 1D) / ({all_} + 2D))))"

    step = f"""transform(array({weighed}), t -> named_struct(
        'pi', greatest({pi0}D, least({pi1}D, try_divide({total("x.n * x.w")}, {total("x.n")}))),
        'q', {rates(1, "x.w", q0, q1)}, 'r', {rates(-1, "(1D - x.w)", r0, r1)}))[0]"""
    start = f"named_struct('pi', {pi}D, 'q', array_repeat({q}D, {n}), 'r', array_repeat({r}D, {n}))"
    row = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("pats"))
    fitted = row.selectExpr("pats", f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> {step}) as s")
    return fitted.selectExpr(f"inline({weighed})").select(F.col("v").alias("votes"), F.round("w", 6).alias("posterior"))


def judge(docs: DataFrame, *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with STATS, votes, posterior (of a good document), base_failed and kept; without its
    text column if ``keep_text`` is false: then counts are computed once into the checkpoint folder,
    and else twice, as a copy of all texts would fill it."""
    scored = text_stats(docs, text_col).withColumn("votes", F.expr(votes())).withColumn("base_failed", F.expr(BASE_FAILED))
    scored = scored if keep_text else reliable(scored.drop(text_col))
    patterns = scored.groupBy("votes").agg(F.count("*").alias("n"))
    # One row for each pattern that occurs: at most 3 ** len(RULES).
    (own,) = free_names(scored, "_votes")
    known = F.broadcast(estimates(patterns).withColumnRenamed("votes", own))
    out = scored.drop("posterior", "kept").join(known, scored["votes"] == known[own]).drop(own)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def oracle_sql() -> str:
    """The same as DuckDB SQL, with the rounds of estimation as one table each."""
    names = list(RULES)
    cols = ", ".join(f"case when {no} then -1 when {yes} then 1 else 0 end as v_{k}" for k, (no, yes) in RULES.items())
    votes_ = ", ".join(f"v_{k}" for k in names)
    (pi0, pi1), (q0, q1), (r0, r1) = BOUNDS
    good = " * ".join(["pi", *(f"(case v_{k} when 1 then q_{k} when -1 then 1 - q_{k} else 1 end)" for k in names)])
    bad = " * ".join(["(1 - pi)", *(f"(case v_{k} when 1 then 1 - r_{k} when -1 then r_{k} else 1 end)" for k in names)])
    parts = [f"par0 as materialized (select {START[0]}::double as pi, {', '.join(f'{START[1]}::double as q_{k}, {START[2]}::double as r_{k}' for k in names)})"]
    for i in range(1, ROUNDS + 1):
        parts.append(f"post{i} as materialized (select {votes_}, n, {good} / ({good} + {bad}) as w from pats, par{i - 1})")
        rate = ", ".join(
            f"greatest({q0}, least({q1}, (sum(case when v_{k} = 1 then n * w else 0 end) + 1) / (sum(case when v_{k} <> 0 then n * w else 0 end) + 2))) as q_{k}, "
            f"greatest({r0}, least({r1}, (sum(case when v_{k} = -1 then n * (1 - w) else 0 end) + 1) / (sum(case when v_{k} <> 0 then n * (1 - w) else 0 end) + 2))) as r_{k}"
            for k in names
        )
        parts.append(f"par{i} as materialized (select greatest({pi0}, least({pi1}, sum(n * w) / sum(n))) as pi, {rate} from post{i})")
    space = r"[\x20\x09-\x0D]+"
    return f"""
with w as (select doc_id, word, row_number() over (partition by doc_id order by i) as i from (
    select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from (select doc_id, string_split_regex(coalesce(text, ''), '{space}') as ws from documents)) where word <> ''),
g as (select doc_id, i, {" || ' ' || ".join(["word"] + [f"lead(word, {k}) over d" for k in range(1, WINDOW)])} as g from w window d as (partition by doc_id order by i)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g where g is not null) where c > 1),
rep as (select doc_id, count(distinct i + k) as n_repeat_words from twice, range({WINDOW}) as t(k) group by doc_id),
ln as (select doc_id, line, count(*) as c from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by all),
lines as (select doc_id, sum(c)::bigint as n_lines, sum(c - 1)::bigint as n_dup_lines from ln group by doc_id),
n as (select doc_id, count(*) as n_words from w group by doc_id),
stats as (select d.doc_id, coalesce(n_words, 0) as n_words, length(regexp_replace(coalesce(text, ''), '{space}', '', 'g')) as word_chars,
    length(regexp_replace(coalesce(text, ''), '\\P{{L}}+', '', 'g')) as n_letters, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) as n_symbols,
    coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
    from documents d left join n using (doc_id) left join lines using (doc_id) left join rep using (doc_id)),
voted as (select *, {cols} from stats),
pats as materialized (select {votes_}, count(*) as n from voted group by all),
{", ".join(parts)},
last as (select {votes_}, round({good} / ({good} + {bad}), 6) as posterior from pats, par{ROUNDS})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) as base_failed, posterior, not ({BASE_FAILED}) and posterior >= 0.5 as kept
from voted join last using ({votes_})"""
