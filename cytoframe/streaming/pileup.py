"""Allele counts of a stream of alignments ordered by position: a place is given out as soon as no read to come can cover it.

State is one row a chromosome: where the stream has come to, and counts of the places that are still open, which reach as far as the reads that cover
the last position. A chromosome's rows of one batch may come in any order; only from batch to batch must reads go on. Bases of a read that comes late are given out at
once with ``late``, for the places already given out, so that sums by place stay whole; its other places count as ever.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from cytoframe.functions.arrays import Places
from cytoframe.operators.blocks import Look

NAMES = ["n_a", "n_c", "n_g", "n_t", "r_a", "r_c", "r_g", "r_t"]
OUT = "tid int, ref_pos bigint, " + ", ".join(f"{n} bigint" for n in NAMES) + ", late boolean"
#: Places of a chromosome that are open at once, at most: as far as one read reaches.
MOST_OPEN = 1 << 24
#: Places with counts that wait at least before they are added up.
ADDED_UP = 1 << 18


def _summed(places: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and their counts by base, and by base on the reverse strand. cells: base (0 to 3), 4 more on the reverse strand."""
    at, number = np.unique(places, return_inverse=True)
    by = np.bincount(number * 8 + cells, minlength=8 * len(at)).reshape(-1, 8)
    return at, np.concatenate([by[:, :4] + by[:, 4:], by[:, 4:]], axis=1)


def _added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of all parts, and the sums of their counts."""
    places = np.concatenate([x for x, _ in parts])
    order = np.argsort(places, kind="stable")
    places, counts = places[order], np.concatenate([x for _, x in parts])[order]
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])[: len(places)])
    return places[first], np.add.reduceat(counts, first, axis=0) if len(first) else counts


def _cells_of_rows(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places and cells of rows of bases (ref_pos, cell)."""
    rows = rows[rows.cell >= 0]
    return rows.ref_pos.to_numpy(np.int64), rows.cell.to_numpy(np.int64)


class OpenPlaces(StatefulProcessor):
    """Rows tid, start (of the read), final (the chromosome ends) and what cells_of turns into places and cells, to rows of OUT."""

    def __init__(self, cells_of: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]] = _cells_of_rows):
        self.cells_of = cells_of

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", StructType([StructField("frontier", LongType()), StructField("places", BinaryType()), StructField("counts", BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frontier, at, counts = -1, np.zeros(0, np.int64), np.zeros((0, 8), np.int64)
        if self.state.exists():
            frontier, places, numbers = self.state.get()
            at, counts = np.frombuffer(places, np.int64), np.frombuffer(numbers, np.int64).reshape(-1, 8)
        come, ends = frontier, False
        held, waiting = [(at, counts)], 0
        for some in rows:
            ends |= bool(some.final.any())
            some = some[some.start >= 0]
            place, cell = self.cells_of(some)
            if not len(place):
                continue
            come = max(come, int(some.start.max()))
            late = place < frontier
            if late.any():
                yield self.rows(key, *_summed(place[late], cell[late]), True)
            held.append(_summed(place[~late], cell[~late]))
            waiting += len(held[-1][0])
            # added up when there is as much as there has been, not for each batch
            if waiting > max(len(held[0][0]), ADDED_UP):
                held, waiting = [_added_up(held)], 0
        at, counts = _added_up(held)
        closed = np.ones(len(at), bool) if ends else at < come
        if closed.any():
            yield self.rows(key, at[closed], counts[closed], False)
        at, counts = at[~closed], counts[~closed]
        if len(at) > MOST_OPEN:
            raise ValueError(f"chromosome {key[0]} has {len(at)} open places")
        self.state.update((max(come, int(1 << 62)) if ends else come, at.tobytes(), counts.tobytes()))

    def rows(self, key, at: np.ndarray, counts: np.ndarray, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"tid": np.full(len(at), key[0], np.int32), "ref_pos": at, **{n: counts[:, i] for i, n in enumerate(NAMES)}, "late": late})

    def close(self) -> None:
        pass


def streamed_counts(bases: DataFrame) -> DataFrame:
    """tid, ref_pos, counts by base and on the reverse strand, and late, of a stream of bases.

    bases: tid, start (the read's first place), ref_pos, base, reverse, and final: true in a row (whatever its other columns) after which a chromosome has no more reads.
    Needs a state store of column families (spark.sql.streaming.stateStore.providerClass: RocksDB).
    """
    known = F.when(F.col("base").isin(*"ACGT"), F.instr(F.lit("ACGT"), F.col("base")) - 1 + F.when(F.col("reverse"), 4).otherwise(0)).otherwise(-1)
    rows = bases.select("tid", F.coalesce("start", F.lit(-1)).cast("bigint").alias("start"), F.coalesce("ref_pos", F.lit(-1)).cast("bigint").alias("ref_pos"), F.coalesce(known, F.lit(-1)).cast("int").alias("cell"), F.coalesce("final", F.lit(False)).alias("final"))
    return rows.groupBy("tid").transformWithStateInPandas(OpenPlaces(), outputStructType=OUT, outputMode="append", timeMode="None")


def streamed_read_counts(reads: DataFrame, columns: list[str], look: Look) -> DataFrame:
    """The same of a stream of reads (tid, pos, flag, least: the quality from which its bases count, cigar as text, final), whose bases never become rows; columns: what look needs."""
    names = list(dict.fromkeys(["flag", "least", *columns]))

    def cells(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
        places = Places.of(batch.column("cigar"), "MS")
        letter, quality = look(batch, places.read, places.query)
        reverse = (batch.column("flag").to_numpy() & 16 != 0)[places.read]
        keep = (letter < 4) & (quality >= batch.column("least").to_numpy()[places.read])
        on = batch.column("start").to_numpy()[places.read] + places.offset
        return on[keep].astype(np.int64), (letter + 4 * reverse)[keep].astype(np.int64)

    rows = reads.select("tid", F.coalesce("pos", F.lit(-1)).cast("bigint").alias("start"), F.coalesce("cigar", F.lit("")).alias("cigar"), F.coalesce("final", F.lit(False)).alias("final"), *[F.coalesce(F.col(c), F.lit(0).cast(reads.schema[c].dataType)).alias(c) for c in names])
    return rows.groupBy("tid").transformWithStateInPandas(OpenPlaces(cells), outputStructType=OUT, outputMode="append", timeMode="None")
