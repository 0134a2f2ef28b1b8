"""Fill-in-the-middle transformation by a counted-quantifier pattern.

``regexp_count`` gives a text's units (lines, unless another pattern is given), the id's hash draws
two cuts between them, and one match of a pattern made for the row - ``a`` units, ``b - a`` units,
the rest, each group possessive, so that it neither backtracks nor nests - captures prefix, middle
and suffix. All of it is Spark's own functions; no row leaves its task.

A unit pattern tiles the text and has no capturing groups; a row that it does not tile fails. Null texts are empty. A text
that is empty, holds one of the marks, or is not drawn stays as it is (form ``plain``). A null id
draws as the empty text. Rows of one id and text are cut alike; texts of any length are worked on
whole; other columns are carried along, those named like an output are replaced; an empty table
gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

#: A line with its end, or the last one without.
LINES = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
OUTPUTS = ("n_units", "form", "prefix_chars", "middle_chars", "output")


def checked(marks: tuple[str, str, str]) -> None:
    """A mark's first character may stand nowhere else in the marks: so none can arise between a
    text's end and a mark."""
    joined = "".join(marks)
    if len(marks) != 3 or not all(marks) or len(set(marks)) < 3 or any(m[0] in m[1:] or joined.count(m[0]) != sum(x[0] == m[0] for x in marks) for m in marks):
        raise ValueError("marks must be three different texts whose first characters stand only there")


def quoted(text: str) -> str:
    """As part of a replacement."""
    return re.sub(r"([\\$])", r"\\\1", text)


def literal(text: str) -> str:
    """As part of a pattern."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def draw(digest: Column, k: int) -> Column:
    """The k-th (from 0) group of eight hex digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def fill_in_middle(
    docs: DataFrame, *, unit: str = LINES, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``docs`` with n_units, form (psm, spm or plain), prefix_chars and middle_chars (code points, null if
    plain) and output: the text with prefix, middle and suffix in the form's order behind their ``marks``.

    Of a hundred texts ``rate`` are transformed and ``spm_rate`` of those have the suffix first.
    """
    checked(marks)
    p, s, m = marks
    docs = docs.drop(*OUTPUTS)
    text, digest, n, a, b = free_names(docs, "_text", "_digest", "_n", "_a", "_b")
    rows = docs.withColumns({
        text: F.coalesce(F.col(text_col).cast("string"), F.lit("")),
        digest: F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256),
    })
    rows = rows.withColumn(n, F.regexp_count(F.col(text), F.lit(unit)).cast("bigint"))
    cuts = [draw(F.col(digest), k) % (F.col(n) + 1) for k in (0, 1)]
    marked = F.greatest(*[F.contains(F.col(text), F.lit(x)) for x in marks])
    plain = (F.col(text) == "") | marked | (draw(F.col(digest), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(F.col(digest), 3) % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.withColumns({a: F.least(*cuts), b: F.greatest(*cuts), "form": form})

    counted = [F.concat(F.lit(f"((?:{unit}){{"), k.cast("string"), F.lit("}+)")) for k in (F.col(a), F.col(b) - F.col(a))]
    pattern = F.concat(F.lit(r"(?s)\A"), *counted, F.lit(r"(.*)\z"))
    p_, s_, m_ = map(quoted, marks)
    to = F.when(F.col("form") == "spm", F.lit(f"{s_}$3{p_}$1{m_}$2")).otherwise(F.lit(f"{p_}$1{s_}$3{m_}$2"))
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", F.col(text)).otherwise(F.regexp_replace(F.col(text), pattern, to)))

    own = F.col("form") != "plain"
    at = {x: F.instr(F.col("output"), F.lit(x)) for x in marks}
    at[m] = F.when(at[m] > 0, at[m]).otherwise(F.raise_error(F.lit("the unit pattern does not tile a text")).cast("int"))
    prefix = F.when(F.col("form") == "spm", at[m]).otherwise(at[s]) - at[p] - len(p)
    middle = F.length("output") - at[m] - len(m) + 1
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col(n).alias("n_units"), "form", F.when(own, prefix).cast("bigint").alias("prefix_chars"), F.when(own, middle).cast("bigint").alias("middle_chars"), "output",
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made of."""
    checked(marks)
    p, s, m = map(literal, marks)
    back = {"psm": (rf"(?s)\A{p}(.*){s}(.*){m}(.*)\z", "$1$3$2"), "spm": (rf"(?s)\A{s}(.*){p}(.*){m}(.*)\z", "$2$3$1")}
    out = F.when(form == "plain", output)
    for name, (pattern, to) in back.items():
        out = out.when(form == name, F.regexp_replace(output, F.lit(pattern), F.lit(to)))
    return out


def oracle_sql() -> str:
    """The digest of ``op12_infill`` by list functions."""
    return r"""
with d as (
  select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u from documents),
r as (
  select doc_id, t, u, len(u) as n, cast('0x' || substr(h, 1, 8) as bigint) % (len(u) + 1) as h1, cast('0x' || substr(h, 9, 8) as bigint) % (len(u) + 1) as h2,
    cast('0x' || substr(h, 17, 8) as bigint) % 100 as h3, cast('0x' || substr(h, 25, 8) as bigint) % 100 as h4 from d),
c as (
  select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 100 then 'plain' when h4 < 50 then 'spm' else 'psm' end as form,
    coalesce(array_to_string(u[1:least(h1, h2)], ''), '') as p, coalesce(array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], ''), '') as m,
    coalesce(array_to_string(u[greatest(h1, h2) + 1:], ''), '') as s from r)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(case form when 'plain' then t else p || m || s end) as restored_sha256
from c"""
