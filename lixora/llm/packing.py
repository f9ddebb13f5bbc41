"""Best-fit packing of tokenised documents into sequences: best-two-fit.

Every document's ids plus the end id make one or more pieces of at most ``size`` tokens; only longer
documents are cut, the first piece taking the odd rest. Full pieces are sequences by themselves. The others
are dealt by hash (of their place in the written table, too, so that repeated rows don't meet in one group) into
groups of bounded size; in each group a bin is filled greedily (always the longest
piece that still fits), then its smallest piece is replaced by the two unpacked pieces that fit the gap left
by it most tightly, if they fill it better. A group wastes about one bin, so the loss does not grow.

The ids are those of the vocabulary file ``byte_bpe_50k.json``; they are computed from the same vocabulary as
ranks, which takes a fifth of the CPU time (tests compare the two).

Null text: empty, so one piece that holds the end id alone. Repeated rows are packed as often as they occur
(told apart by nothing but their place). A null doc_id stays null. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lixora.llm.common import saved

SIZE, END_ID, END_TEXT = 2048, 50256, "<|endoftext|>"
#: Pieces that one packing group holds on average.
GROUP = 16_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@cache
def encoder(path: str):
    """text -> numpy uint32 ids; once per Python worker."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={END_TEXT: END_ID})

    def encode(text: str) -> np.ndarray:
        try:
            return coder.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern engine gives up on huge runs of white space
            return np.asarray(slow_encoder(path).encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


@cache
def slow_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces_of(docs: DataFrame, size: int = SIZE, end_id: int = 0, ranks: str | None = None) -> DataFrame:
    """One row per piece of each document; end_id is appended to the ids of each."""
    ranks = ranks or default_ranks()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def fn(batches):
        encode = encoder(ranks)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                start, stop, k = 0, len(ids) % size or size, 0
                while start < len(ids):
                    rows.append((doc_id, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start, stop, k = stop, stop + size, k + 1
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows))), schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(fn, PIECES)


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins. All lengths are from 1 to size."""
    order = np.argsort(lengths, kind="stable")
    stock = np.bincount(lengths, minlength=size + 1).tolist()
    first = np.concatenate([[0], np.cumsum(stock)]).tolist()
    have = 0  # bit n: some piece of length n is unpacked
    for n, c in enumerate(stock):
        if c:
            have |= 1 << n

    def below(n: int) -> int:
        """The longest unpacked length up to n, else 0."""
        return (have & ((2 << n) - 1)).bit_length() - 1 if n > 0 and have & ((2 << n) - 1) else 0

    def take(n: int) -> None:
        nonlocal have
        stock[n] -= 1
        if not stock[n]:
            have &= ~(1 << n)

    bins, at, left, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), len(lengths), 0
    while left:
        content, gap = [], size
        while n := below(gap):
            take(n)
            content.append(n)
            gap -= n
        if gap and len(content) > 1:
            small = content[-1]
            room, best = gap + small, (small, 0, 0)
            a = below(room - 1)
            while a and 2 * a > best[0]:
                b = below(min(room - a, a if stock[a] > 1 else a - 1))
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                a = below(a - 1)
            if best[1]:
                content.pop()
                stock[small] += 1
                have |= 1 << small
                for n in best[1:]:
                    take(n)
                    content.append(n)
        place = 0
        for n in content:
            i = order[first[n]]
            first[n] += 1
            bins[i], at[i] = used, place
            place += n
        used, left = used + 1, left - len(content)
    return bins, at, used


def pack(docs: DataFrame, size: int = SIZE, end_id: int = 0, ranks: str | None = None, group: int = GROUP) -> DataFrame:
    """Pieces of all documents with their sequence_id and the offset in it."""
    pieces = saved(pieces_of(docs, size, end_id, ranks), "pieces")
    groups = max(1, round(pieces.where(F.col("length") < size).count() / group))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", na_position="first")
        bins, at, _ = best_two_fit(pdf["length"].to_numpy(), size)
        pdf["sequence_id"], pdf["offset"] = pdf["group"].to_numpy() + groups * bins, at
        return pdf.drop(columns="group")

    full = pieces.where(F.col("length") == size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = pieces.where(F.col("length") < size).select(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).alias("group"), "*")
    return dealt.groupBy("group").applyInPandas(fill, f"{PIECES}, sequence_id long, offset long").unionByName(full)
