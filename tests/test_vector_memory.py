"""What a vector search holds at once, and that blocks change no result."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute

from curul.operators import vectors


class Rows:
    def mapInArrow(self, function, schema):
        return function


def test_a_large_batch_is_scored_in_blocks():
    draws = np.random.default_rng(4)
    rows, asked = vectors.unit(draws.normal(size=(10_000, 8))), vectors.unit(draws.normal(size=(1024, 8)))
    rows[7_000:7_005] = rows[1_000:1_005]
    rows = vectors.unit(rows)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(rows.tolist()), pa.array(np.arange(10_000) % 3)], names=["id", "v", "list"])
    for into in (None, draws.random((1024, 3)) < 0.7):
        score = vectors._scan(Rows(), "id", np.arange(1024), asked, 5, into)
        tracemalloc.start()
        (found,) = score(iter([batch]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100e6
        for query in range(0, 1024, 93):
            open_rows = np.arange(10_000) if into is None else np.flatnonzero(into[query, np.arange(10_000) % 3])
            order = sorted(open_rows, key=lambda i: (-round(float(asked[query] @ rows[i]), 12), i))[:5]
            got = found.filter(pa.compute.equal(found["query_id"], query)).column(1).to_pylist()
            assert sorted(got) == sorted(order)
