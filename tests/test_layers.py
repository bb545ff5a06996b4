"""Layers of reads against a sweep from place to place."""

import numpy as np
import pytest

from cytoframe.operators.layers import Rows, read_layers


def sweep(reads):
    """Layer of each read (begin, end), in order of begins, by walking every place with a list of free rows and how long they must wait."""
    layer, free, top = {}, [], 0
    for place in range(min(b for b, _ in reads), max(e for _, e in reads) + 1):
        over = [i for i, (b, e) in enumerate(reads) if b <= place <= e]
        if not over:
            continue
        free = [[max(wait - 1, 0), row] for wait, row in free]
        free.sort()
        for i in over:
            if reads[i][0] == place:
                if free and free[0][0] == 0:
                    layer[i] = free.pop(0)[1]
                else:
                    top += 1
                    layer[i] = top
        for i in over:
            if reads[i][1] == place:
                free.append([2, layer[i]])
        top = max(layer[i] for i in over)
        free = [x for x in free if x[1] <= top]
    return [layer[i] for i in range(len(reads))]


@pytest.mark.parametrize("seed", range(40))
def test_layers_equal_the_sweep(seed):
    rng = np.random.default_rng(seed)
    begins = np.sort(rng.integers(0, int(rng.integers(5, 120)), int(rng.integers(1, 60))))
    reads = [(int(b), int(b + rng.integers(0, int(rng.integers(1, 25))))) for b in begins]
    rows, out, i = Rows(), [], 0
    while i < len(reads):
        j = i
        while j < len(reads) and reads[j][0] == reads[i][0]:
            j += 1
        rows.advance(reads[i][0])
        out += rows.step(reads[i][0], [e for _, e in reads[i:j]])
        i = j
    assert out == sweep(reads)


def test_table_in_small_batches(spark):
    rng = np.random.default_rng(1)
    rows = [(int(t), k, int(b), int(b + rng.integers(0, 30))) for t in range(3) for k, b in enumerate(rng.integers(0, 300, 200))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = read_layers(spark.createDataFrame([*rows, (1, 999, None, 5), (2, 998, 9, 3)], "tid int, k int, pos int, ref_end int"), order=["k"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for t in range(3):
        mine = sorted((r.pos, r.k, r.ref_end, r.layer) for r in got if r.tid == t)
        assert [x[3] for x in mine] == sweep([(x[0], x[2]) for x in mine])
