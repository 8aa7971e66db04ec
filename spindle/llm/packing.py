"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Lengths are small integers, so the open sequences of a packer are described by one array: how many have each residual
gap. A piece goes where the sum of the squared counts becomes smallest; ties go to the tightest gap. Pieces come longest
first, and once the open gaps can hold all that is still to come, a new sequence is opened only where nothing fits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import checkpointed

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one packer places; more pieces make more packers, each with a bounded table.
PACKER = 12_000


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length (1 to capacity), in the order given.

    Empty input gives empty arrays. Equal lengths take the sequences with the tightest suitable gap in order of opening.
    """
    n = len(lengths)
    sequence, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    count = np.zeros(capacity + 1, np.int64)
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    left, gaps, used = int(np.sum(lengths)), 0, 0
    for i, size in enumerate(lengths.tolist()):
        fits = np.flatnonzero(count[size:])
        best, gap = None, capacity
        if len(fits):
            there = count[size:][fits]
            change = -2 * there + np.where(fits > 0, 2 * count[fits] + 2, 1)
            k = int(np.argmin(change))
            best, gap = int(change[k]), int(fits[k]) + size
        if best is None or (gaps < left and size < capacity and 2 * int(count[capacity - size]) + 1 < best):
            bin_, gap = used, capacity
            used += 1
        else:
            bin_ = opened[gap].pop()
            count[gap] -= 1
            gaps -= gap
        sequence[i], offset[i] = bin_, capacity - gap
        left -= size
        if gap > size:
            count[gap - size] += 1
            opened[gap - size].append(bin_)
            gaps += gap - size
    return sequence, offset


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """Tokenised pieces of documents: doc_id, piece, start, length, ids_crc32.

    A null text counts as empty and has the separator alone; a document of more than `capacity` ids is cut into pieces of
    `capacity`, of which the first may be shorter. Null doc_ids and repeated rows are packed like any others; other
    columns are not read.
    """
    end = separator.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe.load(tokenizer_path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = table.ids(text.as_py() or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    for column, value in zip(rows, (doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, per_packer: int = PACKER) -> DataFrame:
    """Pieces of documents placed into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are dealt evenly over packers of about `per_packer` pieces whatever their keys, so no hot key, source or
    group of copies gathers in one task. The tokenised pieces are checkpointed: what a lost executor placed is placed
    again from the same rows. An empty table gives no rows.
    """
    cut = checkpointed(pieces(docs, tokenizer_path, capacity))
    packers = -(-cut.count() // per_packer) or 1

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        whole = whole.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = place(whole.column("length").to_numpy(), capacity)
        whole = whole.append_column("sequence_id", pa.array(sequence + (TaskContext.get().partitionId() << 40)))
        yield from whole.append_column("offset", pa.array(offset)).to_batches()

    return cut.repartition(packers).mapInArrow(fill, PIECES + ", sequence_id long, offset long")
