"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into pre-tokens by the tokenizer's pattern and exploded with their positions into
blocks of whole documents. The distinct pre-tokens of all blocks are shuffled by word, each
is encoded once wherever it occurs, and its ids go back to the blocks, where the documents are put
together by position. Decoding joins the table of each token's bytes.

Empty or null texts have no tokens and decode to no bytes. Repeated rows stay repeated, null ids
stay null, columns other than the id and the text are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, Block, lean, pack, parts, per_block, unpack, unpack_words, word_blocks

#: The classes of the pattern for characters below U+0250, where the standard library's faster
#: matcher can stand in for \p{L}, \p{N} and \s.
LETTER, NUMBER, SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
OTHER = re.compile("[^\x00-ɏ]")


@functools.lru_cache(maxsize=2)
def matchers(pattern: str) -> tuple[regex.Pattern, re.Pattern | None]:
    """The pattern itself, and the same for texts below U+0250 if all its classes have a stand-in."""
    plain = pattern
    for old, new in ((r"[^\s\p{L}\p{N}]", f"[^{SPACE}{LETTER}{NUMBER}]"), (r"\p{L}", f"[{LETTER}]"), (r"\p{N}", f"[{NUMBER}]"), (r"\s", f"[{SPACE}]"), (r"\S", f"[^{SPACE}]")):
        plain = plain.replace(old, new)
    return regex.compile(pattern), None if "\\" in plain.replace("\\u", "") else re.compile(plain)


def pre_tokens(text: str, pattern: str) -> list[str]:
    full, plain = matchers(pattern)
    return (plain if plain and not OTHER.search(text) else full).findall(text)


@functools.lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes | None]:
    """The token-byte table by id; as large as the vocabulary, whatever the corpus."""
    ranks = ranks_of(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: the id, ``ids`` array<int> and ``decoded`` binary.

    ``path`` names a rank file that every machine has. The decoded bytes come from the ids, by the
    token-byte table, not from the text. For ``docs`` see ``common.word_blocks``.
    """
    blocks = word_blocks(docs, functools.partial(pre_tokens, pattern=pattern), id_col=id_col, text_col=text_col, block_bytes=block_bytes)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All parts with a word come to one task, which encodes the word when it first meets it."""
        enc, known = encoding(path, pattern), {}
        for batch in batches:
            out_n, out_ids = [], []
            for sizes, cell in zip(batch.column("sizes").to_pylist(), batch.column("cells").to_pylist()):
                ids = []
                for word in unpack_words(sizes, cell):
                    if word not in known:
                        known[word] = tuple(enc.encode_ordinary(word.decode()))
                    ids.append(known[word])
                out_n.append(pack(np.fromiter(map(len, ids), np.int64, len(ids))))
                out_ids.append(pack(np.fromiter(itertools.chain.from_iterable(ids), np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("part"), pa.array(out_n, pa.binary()), pa.array(out_ids, pa.binary())], names=["block", "part", "n", "ids"])

    encoded = parts(blocks).mapInArrow(lean(once), "block bigint, part int, n binary, ids binary")

    def assemble(block: Block) -> pa.Table:
        size, first, flat, base = block.numbers("n"), np.empty(block.size, np.int64), [], 0
        for r, at in enumerate(block.places):
            first[at] = base + np.cumsum(size[at]) - size[at]
            flat.append(unpack(block.rows[r]["ids"]).astype(np.int32))
            base += len(flat[-1])
        flat = np.concatenate(flat)
        table, ids_list = token_bytes(path), flat.tolist()
        as_bytes = [b"".join(map(table.__getitem__, ids_list[a : a + k])) for a, k in zip(first.tolist(), size.tolist())]
        n = size[block.seq]  # ids of each pre-token
        at = np.repeat(first[block.seq] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cut = np.concatenate([[0], np.cumsum(block.lens)])
        ends = np.concatenate([[0], np.cumsum(n)])[cut]
        seq, cut = block.seq.tolist(), cut.tolist()
        decoded = [b"".join(map(as_bytes.__getitem__, seq[a:b])) for a, b in zip(cut, cut[1:])]
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[at], pa.int32()))
        return pa.table({id_col: block.ids, "ids": ids, "decoded": pa.array(decoded, pa.binary())})

    return per_block(blocks, encoded, assemble, f"`{id_col}` bigint, ids array<int>, decoded binary")


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col``, the bytes of ``ids_col``. A null list gives null, an id that
    the table lacks fails."""

    @F.pandas_udf("binary")
    def join(ids):
        table = token_bytes(path)
        return ids.map(lambda x: None if x is None else b"".join(map(table.__getitem__, x)))

    return encoded.withColumn(out_col, join(ids_col))
