"""Token sequences packed by Karmarkar-Karp multiway differencing.

Documents are cut into whole windows of the full length, and the rest of each into short
pieces. Pieces gather into blocks that hold a little less than a fixed number of windows.
Inside a block every piece starts as a partial partition: one window with the piece, the
others empty. The two partial partitions with the largest differences between their fullest
and emptiest window are merged, the fullest window of one with the emptiest of the other,
until one is left. Should a window exceed the capacity, the block is packed again into one
window more. Blocks never leave their task, so nothing is shuffled and memory is a block.

Defined cases: a null or empty text is the end id alone; a text of any length is encoded whole,
in one task, also one of millions of blanks; an empty table gives no rows; ties partial partitions go to the older one; repeated rows are packed as often as they
occur; the end text ``<|endoftext|>`` in a text is spelled out in ordinary ids, or with
``special`` is the vocabulary's one id for it; a null id is carried through; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 1024
WINDOWS = 64
PIECE = 128
SLACK = 4
END = 0
SPECIAL = {"<|endoftext|>": 50256}
# the tokenizer's pattern steps back through a run of white space and gives up on a very long one
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


@cache
def encoder(vocabulary: str, special: bool = False):
    """The byte-level vocabulary: a tokenizers file, or the same ranks for tiktoken.

    ``special`` takes a special token's text as its id, as tokenizers does by default.
    """
    if vocabulary.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens={})
        return lambda text: _encode(encoding, text, special)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = not special
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def _encode(encoding, text: str, special: bool) -> list[int]:
    """Ids of a text; special texts are cut out first, and long runs of white space by hand.

    The pattern takes such a run as one piece, but for its last character where more follows.
    """
    parts = re.split("(" + "|".join(map(re.escape, SPECIAL)) + ")", text) if special else [text]
    ids = []
    for part in parts:
        if special and part in SPECIAL:
            ids.append(SPECIAL[part])
            continue
        at = 0
        for run in LONG_BLANK.finditer(part):
            end = run.end() - (run.end() < len(part))
            ids += encoding.encode_ordinary(part[at:run.start()])
            ids += encoding._encode_single_piece(part[run.start():end].encode())
            at = end
        ids += encoding.encode_ordinary(part[at:])
    return ids


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` in each of ``windows`` groups of near-equal total.

    A partial partition lists its windows from fullest to emptiest as (total, tree), where a
    tree is an index or a pair of trees, so that a merge copies nothing.
    """
    empty = [(0, None)] * (windows - 1)
    heap = [(-size, i, [(size, i), *empty]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    for order in range(len(sizes), 2 * len(sizes) - 1):
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = [(x + y, u if v is None else v if u is None else (u, v))
                  for (x, u), (y, v) in zip(a, reversed(b))]
        merged.sort(key=_total, reverse=True)
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], order, merged))
    return [_leaves(tree) for _, tree in heap[0][2]] if heap else []


def _total(window: tuple) -> int:
    return window[0]


def _leaves(tree) -> list[int]:
    found, waiting = [], [] if tree is None else [tree]
    while waiting:
        node = waiting.pop()
        if isinstance(node, tuple):
            waiting += node
        else:
            found.append(node)
    return found


def fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows, as few as hold everything: one more while any is too full."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, windows)
        if all(sum(sizes[i] for i in group) <= capacity for group in groups):
            return groups
        windows += 1


def pack(documents: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id",
         length: int = LENGTH, windows: int = WINDOWS, piece: int = PIECE, special: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence, at what offset."""
    room = windows * (length - SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, special)
        sequence = TaskContext.get().partitionId() << 40
        waiting, held, out = [], 0, []

        def close() -> None:
            nonlocal sequence, waiting, held
            for group in fit([row[2] for row in waiting], length):
                at = 0
                for i in sorted(group):
                    out.append((*waiting[i], sequence, at))
                    at += waiting[i][2]
                sequence += bool(group)
            waiting, held = [], 0

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(body), END], "<u4")
                whole = len(ids) // length * length
                for at in range(0, whole, length):
                    out.append((*_piece(key, ids, at, at + length), sequence, 0))
                    sequence += 1
                parts = -(-(len(ids) - whole) // piece)
                cuts = [whole + (len(ids) - whole) * i // parts for i in range(parts)] + [len(ids)]
                for start, end in zip(cuts, cuts[1:]):
                    while start < end:
                        take = min(end - start, room - held)
                        waiting.append(_piece(key, ids, start, start + take))
                        held, start = held + take, start + take
                        if held == room:
                            close()
            if len(out) >= 20_000:
                yield _rows(out)
                out = []
        close()
        if out:
            yield _rows(out)

    rows = documents.select(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit("")))
    return rows.mapInArrow(run, PIECES)


def _piece(key: int | None, ids: np.ndarray, start: int, end: int) -> tuple:
    return key, start, end - start, zlib.crc32(ids[start:end].tobytes()), len(ids)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
