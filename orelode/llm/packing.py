"""Texts, measured in tokens, put together into containers of a fixed capacity.

Sum-of-squares packing: each piece goes where the sum over all levels of the squared number of open containers at that
level becomes least, so that no level of filling piles up and later pieces find a fitting rest. The pieces of a group
come by falling size. A container is never filled beyond its capacity.

A text that fits into one container is never cut. A longer one is cut into pieces that fill a container each, and the rest
is packed with the other texts; a cut never parts the bytes of a character.
Only ids and sizes are shuffled. Each group of about GROUP pieces is packed by itself, so no task grows with the data;
a group leaves a few containers open at its end. Defined cases: null and empty texts have no tokens and get no
row; copies count each for themselves; very long texts are tokenized in whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.session import spread

#: The rank file of the public tokenizer, and the pieces packed together in one task.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
GROUP = 100_000
PIECES = "doc_id bigint, piece_no int, token_start bigint, n_tokens int"
PACKED = "container_id bigint, doc_id bigint, piece_no int, token_start bigint, n_tokens int"


@cache
def encoding() -> tiktoken.Encoding:
    """The public tokenizer; one for each worker."""
    import public_tokenizers
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(public_tokenizers.path(VOCABULARY))
    return tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(tokens: list[int], capacity: int) -> list[tuple[int, int]]:
    """(start, size) of each piece of a text, in tokens."""
    out, start = [], 0
    while len(tokens) - start > capacity:
        end = start + capacity
        while end > start + 1 and encoding().decode_single_token_bytes(tokens[end])[0] & 0xC0 == 0x80:
            end -= 1
        out.append((start, end - start))
        start = end
    if len(tokens) > start:
        out.append((start, len(tokens) - start))
    return out


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Container of each piece, numbered from 0, the pieces taken in the given order."""
    if any(not 0 < s <= capacity for s in sizes):
        raise ValueError("a piece must have from 1 to capacity tokens")
    open_at: dict[int, list[int]] = defaultdict(list)
    n = np.zeros(capacity + 1, np.int64)  # open containers by level; full ones leave, so that n[capacity] stays 0
    out, containers = [], 0
    for s in sizes:
        # half the change of the sum of squares, less one: a container at level h moves to h + s; at capacity it leaves
        change = (n[s:] - n[: capacity + 1 - s]).astype(np.float64)
        change[-1] -= 0.5
        change[0] = n[s] - 0.5 if s < capacity else -1.0  # a new container
        usable = n[: capacity + 1 - s] > 0
        usable[0] = True
        change[~usable] = np.inf
        h = len(change) - 1 - int(np.argmin(change[::-1]))  # of equal ones the fullest
        if h:
            k = open_at[h].pop()
            n[h] -= 1
        else:
            k, containers = containers, containers + 1
        if h + s < capacity:
            open_at[h + s].append(k)
            n[h + s] += 1
        out.append(k)
    return out


def _measure(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding().encode_ordinary
        for b in batches:
            rows = [(i, k, s, n) for i, t in zip(b.column(0).to_pylist(), b.column(1)) for k, (s, n) in enumerate(cuts(encode(t.as_py()), capacity))]
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "piece_no", "token_start", "n_tokens"])

    return run


def _fill(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece_no", "ascending")])
        base = group.column("packed_with")[0].as_py() << 32
        ids = pa.array([base + k for k in pack(group.column("n_tokens").to_pylist(), capacity)], pa.int64())
        return group.drop_columns(["packed_with"]).add_column(0, "container_id", ids)

    return run


def pack_texts(documents: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(container_id, doc_id, piece_no, token_start, n_tokens): the container of each text, or of each piece of a text beyond the capacity."""
    if capacity < 4:
        raise ValueError("a character may take four tokens")
    need = documents.where(f"{text} is not null and {text} <> '' and {key} is not null").select(documents[key].cast("bigint").alias("doc_id"), text)
    groups = -(-documents.count() // group) or 1
    pieces = spread(need).mapInArrow(_measure(capacity), PIECES)
    where = F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(groups)).alias("packed_with")
    return pieces.select("*", where).groupBy("packed_with").applyInArrow(_fill(capacity), PACKED)
