"""Best-fit packing into several permitted sequence lengths.

Documents longer than the largest permitted length are cut into pieces of that length and a rest; no word is dropped.
Pieces are dealt to groups by hash. In a group, the longest piece goes first, into the open bin with the least room
that still holds it. If none does, the bin length is opened that costs least for each token it can be expected to
hold: a length c costs c + overhead + c^2 / square (its tokens, a fixed price, and attention), and can hold the piece
and what remains unpacked, up to its length.
At the end each bin shrinks to the smallest permitted length that holds its contents.

Group sizes are bounded by ``group_pieces`` on average whatever the table holds, since equal rows are told apart by
their position. Defined results: a null or empty text is one piece of just the end token; an empty table gives an
empty table; repeated rows are packed each for itself; ties in length go by doc_id, then by piece.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmscope.llm.storage import save

PERMITTED = (512, 1024, 2048, 4096)
OVERHEAD = 64
SQUARE = 16384


def pack(lengths: np.ndarray, permitted: tuple[int, ...], overhead: int, square: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces sorted from long to short: each one's bin and offset, and each bin's final length."""
    largest = permitted[-1]
    by_room: list[list[int]] = [[] for _ in range(largest + 1)]
    rooms = 0  # bit r: some open bin has room r
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened: list[int] = []
    room_of: list[int] = []
    rest = int(lengths.sum())
    for i, n in enumerate(lengths.tolist()):
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b = len(opened)
            choices = permitted[bisect_left(permitted, n) :]
            room = min(choices, key=lambda c: ((c + overhead + c * c / square) / min(c, rest), c))
            opened.append(room)
            room_of.append(room)
        bins[i], offsets[i] = b, opened[b] - room
        room_of[b] = room - n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
        rest -= n
    held = np.array(opened, np.int64) - np.array(room_of, np.int64)
    sizes = np.array(permitted, np.int64)
    return bins, offsets, sizes[np.searchsorted(sizes, held)]


def pack_documents(
    docs: DataFrame, length: Column, permitted: tuple[int, ...] = PERMITTED, overhead: int = OVERHEAD, square: int = SQUARE, group_pieces: int = 50_000
) -> DataFrame:
    """doc_id, piece (from 0), start and n_tokens (in the document), sequence (an id), offset in it, and sequence_length.

    ``length``: a document's tokens, at least 1, e.g. its words and an end.
    """
    permitted = tuple(sorted(permitted))
    largest = permitted[-1]
    narrow = save(docs.select("doc_id", length.cast("long").alias("n"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "pack-lengths")
    pieces = narrow.agg(F.coalesce(F.sum(F.ceil(F.col("n") / largest)), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-int(pieces) // group_pieces))
    cut = narrow.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / largest) - 1)).alias("piece"))
    cut = cut.select(
        "doc_id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * largest).alias("n_tokens"),
        F.pmod(F.xxhash64("at", "piece"), F.lit(groups)).alias("group"),
    )

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, sizes = pack(rows["n_tokens"].to_numpy(), permitted, overhead, square)
        return rows.assign(sequence=bins * groups + rows["group"].to_numpy(), offset=offsets, sequence_length=sizes[bins])[
            ["doc_id", "piece", "start", "n_tokens", "sequence", "offset", "sequence_length"]
        ]

    schema = "doc_id long, piece long, start long, n_tokens long, sequence long, offset long, sequence_length long"
    return cut.groupBy("group").applyInPandas(packed, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: its length, what it holds, and its pieces in order."""
    held = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "n_tokens")))
    return pieces.groupBy("sequence", "sequence_length").agg(F.sum("n_tokens").alias("n_tokens"), held.alias("pieces"))
