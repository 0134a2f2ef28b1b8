"""Token counts by field and section, attributed by character offsets.

The text columns of a row are joined into one document, which is encoded once, as a whole, so that
tokens are those that the model will see. Each token's characters are a span, as is each section
(a run of a field up to and including a separator). The two lists of spans of a document are in
order, and joined by their intervals. A token that crosses boundaries counts whole for the section
that holds most of its bytes; of equals, the first. So the sections' counts add up to the
document's.

A null or empty field has one empty section with no tokens, but the separator between fields
belongs to the field before it. Repeated rows each give their sections; null ids stay null; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoding, token_bytes
from .common import slices

BLOCK = 1 << 20
SCHEMA = "field string, section int, start int, end int, n_tokens bigint"


def sections(fields: Sequence[str], separator: bytes, between: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The document's bytes, where each section starts in them, and its field's number."""
    parts, starts, own, at = [], [], [], 0
    for k, field in enumerate(fields):
        data = field.encode() + (between if k < len(fields) - 1 else b"")
        cut, edge = [0], data.find(separator)
        while 0 <= edge and edge + len(separator) < len(data):
            cut.append(edge + len(separator))
            edge = data.find(separator, cut[-1])
        starts += [at + c for c in cut]
        own += [k] * len(cut)
        parts.append(data)
        at += len(data)
    return b"".join(parts), np.array(starts), np.array(own)


def allocate(token_ends: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The section of each token: an interval join of two ordered lists of spans."""
    begin = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, token_ends - 1, "right") - 1
    ends = np.append(starts[1:], size)
    for t in np.flatnonzero(first != last).tolist():
        s = np.arange(first[t], last[t] + 1)
        held = np.minimum(ends[s], token_ends[t]) - np.maximum(starts[s], begin[t])
        first[t] = s[held.argmax()]
    return first


def count_tokens(
    docs: DataFrame, path: str, pattern: str, *, fields: Sequence[str] = ("text",), id_col: str = "doc_id", separator: str = "\n", between: str = "\n"
) -> DataFrame:
    """One row for each section: the id, field, section (from 0 in its field), start and end in
    characters of the joined document, and n_tokens. ``path`` names a rank file on every machine."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = encoding(path, pattern), token_bytes(path)
        width = np.array([len(b or b"") for b in table])
        for batch in batches:
            for part in slices(batch, "f0", BLOCK):
                rows: list[list] = [[] for _ in range(6)]
                columns = [part.column(f"f{k}").to_pylist() for k in range(len(fields))]
                for i, cells in zip(part.column("id").to_pylist(), zip(*columns)):
                    data, starts, own = sections([c or "" for c in cells], separator.encode(), between.encode())
                    ids = np.array(enc.encode_ordinary(data.decode()), np.int64)
                    n = np.bincount(allocate(np.cumsum(width[ids]), starts, len(data)), minlength=len(starts)) if len(ids) else np.zeros(len(starts), np.int64)
                    follows = np.frombuffer(data, np.uint8) & 0xC0 == 0x80
                    chars = np.concatenate([[0], np.cumsum(~follows)])[np.append(starts, len(data))]
                    number = np.arange(len(own)) - np.searchsorted(own, own)
                    for to, x in zip(rows, ([i] * len(own), [fields[k] for k in own], number, chars[:-1], chars[1:], n)):
                        to.extend(x)
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], names=[id_col, "field", "section", "start", "end", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), *[F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)])
    return rows.mapInArrow(count, f"`{id_col}` bigint, {SCHEMA}")
