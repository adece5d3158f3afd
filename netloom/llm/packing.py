"""Best-fit packing of token sequences by the sum-of-squares rule.

Only lengths decide, so token ids never move: texts are encoded where they are
read, the pieces' digests are a small table, and groups of pieces of bounded
size are packed independently.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.encoding import encoder
from netloom.llm.spans import lean, lean_group
from netloom.plans.shared import materialize

#: Pieces packed together; the loss is a few open sequences for each group.
GROUP_PIECES = 65_536


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and cut the long ones into pieces of ``capacity`` ids.

    Returns ``doc_id, piece, start, length, ids_crc32``.  A null or empty text
    is one piece that holds the end id alone.  When a document is longer than
    ``capacity``, its first piece takes the remainder, all others are full.
    Repeated rows and null keys are packed like any other row.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch.column(1)
            for low in range(0, len(texts), 2000):
                keys = batch.column(0).slice(low, 2000)
                rows, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(enc.encode(texts.slice(low, 2000).to_pylist())):
                    ids += tail
                    total = len(ids) // 4
                    at, k = 0, 0
                    while at < total:
                        size = min(total, (total % capacity or capacity)) if not k else capacity
                        rows.append(i), piece.append(k), start.append(at), length.append(size)
                        crc.append(zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)]))
                        at, k = at + size, k + 1
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lean(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, items taken from the largest down.

    N[g] counts the open bins with gap g.  An item goes into the open bin for
    which the sum of N[g]**2 becomes smallest; a new bin is opened only when
    none fits.  Ties go to the smallest gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    never, used = np.int64(1) << 60, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        own = count[s:capacity]
        k, fits = 0, False
        if len(own):
            change = 2 * (count[: capacity - s] - own) + 2
            change[0] = 1 - 2 * own[0]
            change[own == 0] = never
            k = int(change.argmin())
            fits = change[k] < never
        if fits:
            gap = s + k
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, used
            used += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_bins[gap - s].append(b)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of :func:`cut_pieces`.

    Groups are dealt by the row's number in ``pieces``, which should be a written
    table, so equal rows spread like any others.  A group's sequences have ids of
    their own; every piece is placed exactly once.
    """
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    names = pieces.columns

    def place(table: pa.Table) -> pa.Table:
        bins, offsets = sum_of_squares(table.column("length").to_numpy(), capacity)
        ids = bins + (table.column("pack_group")[0].as_py() << 36)
        return table.select(names).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    grouped = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return grouped.groupBy("pack_group").applyInArrow(lean_group(place), f"{schema}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, cut and pack all rows of ``docs``; one row for each piece.

    An empty table gives an empty result.
    """
    pieces = materialize(cut_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    return pack(pieces, capacity)
