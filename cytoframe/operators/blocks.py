"""Reads dealt to blocks of places: all bases of a place come to one task without any base being shuffled.

Only reads are shuffled, a row for each block that one reaches; a task takes its blocks one after the other, and a block's reads a batch at a time, as arrays.
What a block keeps is bounded by its places, not by its reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoframe.functions.arrays import Places
from cytoframe.functions.columns import parse_cigar

#: Places of a block, and reads taken at a time.
WIDTH, STEP = 500, 4_000
#: What tells a batch's bases: (batch, read, place in the read) to (letter: 0 to 3, or 4 if unknown; quality).
Look = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class Block(Protocol):
    """What a block's reads come to."""

    def add(self, batch: pa.RecordBatch, places: Places, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        """places of the batch's reads that lie in the block, and at which of its places, from 0."""

    def end(self) -> Iterator[pa.RecordBatch]: ...


def dealt(reads: DataFrame, columns: dict[str, Column], *, width: int = WIDTH, fold: int | None = None, order: list[str] | None = None) -> DataFrame:
    """tid, block, pos, cigar (text) and columns of each read for every block it reaches, blocks side by side and within one by order. fold: places are taken modulo it (a multiple of width)."""
    ops = parse_cigar(F.col("cigar"))
    reach = F.aggregate(ops, F.lit(0), lambda a, x: a + F.when(x["op"].isin("M", "D", "N", "S"), x["len"]).otherwise(0))
    first = F.floor(F.col("pos") / width)
    touched = F.sequence(first, F.floor((F.col("pos") + F.greatest(reach - 1, F.lit(0))) / width))
    if fold is not None:
        if fold % width:
            raise ValueError(f"{fold} places aren't whole blocks of {width}")
        touched = F.array_distinct(F.transform(touched, lambda b: b % (fold // width)))
    rows = reads.where("cigar is not null").select("tid", "pos", "cigar", *[c.alias(n) for n, c in columns.items()], F.explode(touched).alias("block"))
    return rows.repartition("tid", "block").sortWithinPartitions("tid", "block", *(order or []))


def run_blocks(rows: DataFrame, begin: Callable[[int, int], Block], schema: str, *, ops: str, width: int = WIDTH, fold: int | None = None) -> DataFrame:
    """What begin(tid, block) makes of the reads of each block (rows of ``dealt``, of the same width and fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple[int, int] | None = None
        block: Block | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tid, number = batch.column("tid").to_numpy(), batch.column("block").to_numpy()
            cuts = np.flatnonzero((tid[1:] != tid[:-1]) | (number[1:] != number[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                key = int(tid[a]), int(number[a])
                if key != here:
                    if block is not None:
                        yield from block.end()
                    here, block = key, begin(*key)
                for at in range(a, b, STEP):
                    some = batch.slice(at, min(STEP, b - at))
                    places = Places.of(some.column("cigar"), ops)
                    on = some.column("pos").to_numpy()[places.read] + places.offset
                    on = (on if fold is None else on % fold) - key[1] * width
                    inside = (on >= 0) & (on < width)
                    yield from block.add(some, places.where(inside), on[inside])
        if block is not None:
            yield from block.end()

    return rows.mapInArrow(run, schema)


class CellCounts:
    """Bases of each place by cell: quality * 8 + reverse * 4 + letter. Gives tid, place, _n and _cells as ``calling`` has them."""

    SCHEMA = "tid int, place bigint, _n bigint, _cells array<struct<cell:smallint,c:bigint>>"

    def __init__(self, tid: int, block: int, *, look: Look, least: int, qualities: tuple[int, int], width: int = WIDTH):
        self.tid, self.first, self.look, self.least, self.qualities, self.width = tid, block * width, look, least, qualities, width
        self.cells = 8 * (qualities[1] + 1)
        self.counts = np.zeros(width * self.cells, np.int64)

    def add(self, batch: pa.RecordBatch, places: Places, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        cell, keep = cells_of(batch, places, self.look, self.least, self.qualities)
        self.counts += np.bincount(at[keep] * self.cells + cell[keep], minlength=len(self.counts))
        return iter(())

    def end(self) -> Iterator[pa.RecordBatch]:
        by_place = self.counts.reshape(self.width, -1)[:, ::-1]
        place, cell = np.nonzero(by_place)
        number = np.bincount(place, minlength=self.width)
        seen = np.flatnonzero(number)
        structs = pa.StructArray.from_arrays([pa.array((self.cells - 1 - cell).astype(np.int16)), pa.array(by_place[place, cell])], names=["cell", "c"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number[seen])]).astype(np.int32)), structs)
        columns = [pa.array(np.full(len(seen), self.tid, np.int32)), pa.array(self.first + seen), pa.array(by_place.sum(1)[seen]), lists]
        if len(seen):
            yield pa.RecordBatch.from_arrays(columns, names=["tid", "place", "_n", "_cells"])


def cells_of(batch: pa.RecordBatch, places: Places, look: Look, least: int, qualities: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of bases, and which count: known letters of a quality of at least ``least``. Qualities beyond a read's ``cap``, if the batch has one, count as that."""
    letter, quality = look(batch, places.read, places.query)
    keep = (letter < 4) & (quality >= least)
    if "cap" in batch.schema.names:
        quality = np.minimum(quality, batch.column("cap").to_numpy()[places.read])
    reverse = (batch.column("flag").to_numpy() & 16 != 0)[places.read]
    return np.clip(quality, *qualities).astype(np.int64) * 8 + reverse * 4 + letter, keep
