"""Packing token sequences into windows of a fixed size, bounded-space online.

Each partition keeps a fixed number of open windows.  A sequence goes to the
fullest window that still has room (best fit); when none has, the fullest is
emitted and a new one opened.  A sequence longer than a window is cut into
full windows and a rest.  Windows still open when a partition ends are
leftovers: they are merged in groups of partitions, by the same rule, so the
shuffle holds no more than the open windows of each partition.

A window is a row: `doc_ids`, and for each the place `starts` in its document
and the number `lengths` of its ids; `n_tokens`; and `ids`, the ids of all
pieces as little-endian unsigned integers of `id_bytes` bytes (2 where the
vocabulary allows it, else 4).

Defined results: null and empty texts hold no tokens and are in no window;
repeated rows are packed as often as they occur; a null doc_id is packed and
stays null; an empty table gives no windows; further columns are not read.
Pieces of a window are in the order in which they were placed.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import bpe, shared
from loomspark.llm.vec import lean, pieces, utf8

WINDOW = 4096
OPEN = 64
#: Partitions whose leftovers are merged together.
FAN_IN = 64
SCHEMA = "doc_ids array<bigint>, starts array<int>, lengths array<int>, n_tokens int, id_bytes int, ids binary"


class BestFit:
    """At most `most` open windows, in order of the room they have left."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.rooms: list[tuple[int, int]] = []
        self.open: dict[int, list] = {}
        self.next = 0

    def add(self, items: list, size: int) -> list[list]:
        """Places items of that total size together; returns the windows that this emits."""
        out = []
        i = bisect.bisect_left(self.rooms, (size, -1))
        if i < len(self.rooms):
            room, k = self.rooms.pop(i)
            self.open[k].extend(items)
        else:
            if len(self.rooms) >= self.most:
                out.append(self.open.pop(self.rooms.pop(0)[1]))
            room, k = self.window, self.next
            self.next += 1
            self.open[k] = list(items)
        if room > size:
            bisect.insort(self.rooms, (room - size, k))
        else:
            out.append(self.open.pop(k))
        return out

    def close(self) -> list[list]:
        out = [self.open[k] for _, k in self.rooms]
        self.rooms, self.open = [], {}
        return out


def _rows(windows: list[list], whole: bool, kind: np.dtype, most: int = 512):
    """Record batches of windows; an item is (doc_id, start, ids)."""
    for i in range(0, len(windows), most):
        part = windows[i : i + most]
        flat = [x for w in part for x in w]
        off = np.zeros(len(part) + 1, np.int32)
        np.cumsum([len(w) for w in part], out=off[1:])
        lengths = np.array([len(x[2]) for x in flat], np.int32)
        tokens = np.concatenate([[0], np.cumsum(lengths)])[off]
        data = np.concatenate([x[2] for x in flat]).astype(kind)
        yield pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(off, pa.array([x[0] for x in flat], pa.int64())),
            pa.ListArray.from_arrays(off, pa.array([x[1] for x in flat], pa.int32())),
            pa.ListArray.from_arrays(off, pa.array(lengths)),
            pa.array(np.diff(tokens).astype(np.int32)),
            pa.array(np.full(len(part), kind.itemsize, np.int32)),
            pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((tokens * kind.itemsize).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]),
            pa.array([whole] * len(part)),
        ], names=["doc_ids", "starts", "lengths", "n_tokens", "id_bytes", "ids", "whole"])


def pack(df: DataFrame, path: str = bpe.DEFAULT_VOCABULARY, window: int = WINDOW, open_windows: int = OPEN, fan_in: int = FAN_IN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encodes `text` and packs it; one row a window."""
    spark = df.sparkSession
    key, tables = bpe.vocabulary(spark, path)
    kind = np.dtype("<u2" if len(tables.value.length) <= 1 << 16 else "<u4")
    schema = SCHEMA + ", whole boolean"

    def place(batches):
        e, fit = bpe.encoder(key, tables), BestFit(window, open_windows)
        for batch in batches:
            for b in pieces(batch, "text", bpe.PIECE):
                values, offsets = e.encode(*utf8(b.column(1)))
                offsets, done = offsets.tolist(), []
                for d, a, z in zip(b.column(0).to_pylist(), offsets, offsets[1:]):
                    for at in range(a, z, window):
                        ids = values[at : min(at + window, z)].astype(kind)
                        done += fit.add([(d, at - a, ids)], len(ids))
                yield from _rows(done, True, kind)
        yield from _rows(fit.close(), False, kind)

    def merge(batches):
        fit = BestFit(window, open_windows)
        for b in batches:
            columns, done = [b.column(i).to_pylist() for i in (0, 1, 2, 5)], []
            for doc_ids, starts, lengths, raw in zip(*columns):
                ids, at, items = np.frombuffer(raw, kind), 0, []
                for d, s, n in zip(doc_ids, starts, lengths):
                    items.append((d, s, ids[at : at + n]))
                    at += n
                done += fit.add(items, at)
            yield from _rows(done, True, kind)
        yield from _rows(fit.close(), True, kind)

    placed = shared.store(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(place), schema).withColumn("part", F.spark_partition_id()), "packing")
    parts = placed.agg(F.max("part")).first()[0]
    group = F.floor(F.col("part") / fan_in)
    whole = placed.where("whole").drop("whole", "part")
    if parts is None:
        return whole
    # the fullest first, which is best fit decreasing; the rest of the order makes the result repeatable
    left = placed.where("not whole").repartition(parts // fan_in + 1, group).sortWithinPartitions(group, F.desc("n_tokens"), "doc_ids", "starts")
    return whole.unionByName(left.drop("part", "whole").mapInArrow(lean(merge), schema).drop("whole"))
