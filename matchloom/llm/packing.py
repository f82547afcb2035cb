"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Attention costs LINEAR * n + QUADRATIC * n * n for a piece of n tokens, since a token attends only to its own
piece. A document's whole multiples of the sequence length are sequences of their own. The rests are packed chunk by
chunk: a chunk has exactly as much room as tokens, in sequences of full length and, for what is over, of powers of two,
which need no padding. The rests go in descending order, each to the sequence of least cost that has room
for it; what fits nowhere whole is cut over the sequences of least cost that have any room left. So a chunk pads nothing.

Each partition is packed by itself as it is read: no shuffle, and memory bounded by a chunk.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.store import small_batches

#: Tokens of a sequence.
LENGTH = 1024
#: A chunk ends after so many documents or tokens.
CHUNK_DOCS, CHUNK_TOKENS = 4096, 4_000_000
#: Cost of a token and of a pair of tokens of a piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: The id after each document.
END = 0

SCHEMA = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a text to its ids, by the byte-level BPE of a tokenizers JSON file: the file's vocabulary and split rule, run by tiktoken, which is several times faster.

    A special token's string in a text is that token, as in the tokenizers library by default: its ids are the library's (tested). Special
    tokens whose flags take in white space or whole words only are not written that way, and are refused."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # Byte-level BPE writes each byte as a printable character: those that print stand for themselves, the others follow from 256 on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    if any(x.get(flag) for x in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError("a special token with lstrip, rstrip or single_word")
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    bpe = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if any(x in text for x in special):
            return bpe.encode(text, allowed_special="all")
        return bpe.encode_ordinary(text)

    return encode


def place(rests: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, from, tokens, sequence, offset) for rests of fewer than `length` tokens; sequences are numbered from 0 and all are full."""
    total = int(rests.sum())
    room = [length] * (total // length)
    over = total % length
    room += [1 << k for k in reversed(range(length.bit_length())) if over >> k & 1]
    left, cost = np.array(room, np.int64), np.zeros(len(room))
    used = np.zeros(len(room), np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    uncut: list[int] = []

    def put(doc: int, begin: int, n: int, s: int) -> None:
        out.append((doc, begin, n, s, int(used[s])))
        used[s] += n
        left[s] -= n
        cost[s] += LINEAR * n + QUADRATIC * n * n

    for doc in np.argsort(-rests, kind="stable").tolist():
        n = int(rests[doc])
        if not n:
            break
        s = int(np.argmin(np.where(left >= n, cost, np.inf)))
        if left[s] >= n:
            put(doc, 0, n, s)
        else:
            uncut.append(doc)
    for doc in uncut:
        begin, n = 0, int(rests[doc])
        while n:
            s = int(np.argmin(np.where(left > 0, cost, np.inf)))
            m = min(n, int(left[s]))
            put(doc, begin, m, s)
            begin, n = begin + m, n - m
    return out


def pack_chunk(docs: list[tuple[object, np.ndarray]], first_sequence: int, length: int = LENGTH) -> tuple[list[tuple], int]:
    """Pieces (doc_id, start, length, crc, tokens, sequence, offset) of a chunk, and the next free sequence."""
    rows, nxt = [], first_sequence

    def row(doc_id: object, ids: np.ndarray, start: int, n: int, s: int, at: int) -> tuple:
        return doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), s, at

    for doc_id, ids in docs:
        for k in range(len(ids) // length):
            rows.append(row(doc_id, ids, k * length, length, nxt, 0))
            nxt += 1
    placed = place(np.array([len(ids) % length for _, ids in docs], np.int64), length)
    for i, begin, n, s, at in placed:
        doc_id, ids = docs[i]
        rows.append(row(doc_id, ids, len(ids) // length * length + begin, n, nxt + s, at))
    return rows, nxt + (max(p[3] for p in placed) + 1 if placed else 0)


def _pack(path: str, length: int, kind: pa.DataType):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = encoder(path), TaskContext.get().partitionId() << 32
        chunk: list[tuple[object, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, held
            rows, first = pack_chunk(chunk, first, length)
            chunk.clear()
            held = 0
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for rb in it:
            for doc_id, text in zip(rb.column(0), rb.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                chunk.append((doc_id.as_py(), ids))
                held += len(ids)
                if len(chunk) >= CHUNK_DOCS or held >= CHUNK_TOKENS:
                    yield flush()
        if chunk:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row a piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its token ids and then id 0; a null or empty text is id 0 alone. Each id lies in exactly one
    piece. Sequences have `length` tokens, or a power of two, and no padding. Repeated rows and ids are
    documents of their own, null ids stay null, ties of length keep their order in the partition. A very long text is
    cut into whole sequences and a rest. An empty table gives no rows. sequence_id is the partition's number and a
    counter; a partition computed again gives the same rows for the same input.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))
    return rows.mapInArrow(_pack(tokenizer, length, to_arrow_type(kind)), SCHEMA.format(kind=kind.simpleString()))
