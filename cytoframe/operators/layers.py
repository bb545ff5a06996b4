"""Layers of reads for display: each read gets the lowest row that is free where it begins.

A row is free again two covered places after its last read has ended; rows above the highest one in use at a place are given up there. Reads of a chromosome stream by in
order of place, and a task holds those that cover it: what happens between the begins and ends of reads is counted, not walked.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Covered places after a read's last one from which on its row is free.
GAP = 2


class Rows:
    """Rows in use and free at the place that was come to last."""

    def __init__(self) -> None:
        self.place, self.covered, self.top = -1, 0, 0
        self.ends: list[tuple[int, int]] = []  # (last place, row) of reads over the place or further on
        self.free: list[int] = []
        self.waiting: list[tuple[int, int]] = []  # (covered places from which on a row is free, row)

    def step(self, place: int, ends: list[int]) -> list[int]:
        """Rows of the reads that begin at a place, by their last places; the place is covered by these or others."""
        if self.ends:
            self.covered += place - self.place - 1
        self.place, self.covered = place, self.covered + 1
        for due, row in self.waiting:
            if due <= self.covered:
                insort(self.free, row)
        self.waiting = [x for x in self.waiting if x[0] > self.covered]
        out = []
        for end in ends:
            if self.free:
                row = self.free.pop(0)
            else:
                self.top += 1
                row = self.top
            out.append(row)
            heappush(self.ends, (end, row))
        self.top = max(row for _, row in self.ends)
        while self.ends and self.ends[0][0] <= place:
            self.waiting.append((self.covered + GAP, heappop(self.ends)[1]))
        del self.free[bisect_right(self.free, self.top) :]
        self.waiting = [x for x in self.waiting if x[1] <= self.top]
        return out

    def advance(self, to: int) -> None:
        """Goes through the places before another one at which something changes."""
        while self.ends and self.place < to - 1:
            # the place after the last step may have lost its highest row
            after = self.place + 1
            nearest = min(self.ends[0][0], to - 1)
            self.step(after if self.changed else nearest, [])

    @property
    def changed(self) -> bool:
        return bool(self.waiting) and any(due == self.covered + GAP for due, _ in self.waiting)


def read_layers(reads: DataFrame, *, group: str = "tid", start: str = "pos", end: str = "ref_end", order: list[str]) -> DataFrame:
    """reads with layer (from 1), given out chromosome by chromosome in the order of begins and then of ``order``; reads without a place have none."""
    placed = reads.where(f"{start} is not null and {end} >= {start}")
    dealt = placed.repartition(group).sortWithinPartitions(group, start, *order)
    schema = T.StructType([*reads.schema, T.StructField("layer", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = Rows(), None
        held: list[int] = []  # last places of reads that begin at one place, which may go on in the next batch
        at, waiting = None, []  # that place, and batches whose layers aren't all known

        def settle(layers: list[int]) -> None:
            if held:
                rows.advance(at)
                layers += rows.step(at, held)
                held.clear()

        layers: list[int] = []
        for batch in batches:
            waiting.append(batch)
            for g, s, e in zip(batch.column(group).to_pylist(), batch.column(start).to_pylist(), batch.column(end).to_pylist()):
                if g != now or s != at:
                    settle(layers)
                    if g != now:
                        rows, now = Rows(), g
                    at = s
                held.append(e)
            while waiting and len(layers) >= waiting[0].num_rows:
                first = waiting.pop(0)
                yield _with(first, layers[: first.num_rows], schema.names)
                del layers[: first.num_rows]
        settle(layers)
        for batch in waiting:
            yield _with(batch, layers[: batch.num_rows], schema.names)
            del layers[: batch.num_rows]

    return dealt.mapInArrow(run, schema)


def _with(batch: pa.RecordBatch, layers: list[int], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(layers, np.int32))], names=names)
