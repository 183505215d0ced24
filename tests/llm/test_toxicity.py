"""What training the toxicity model holds in the driver."""

import tracemalloc

import numpy as np
import pyarrow as pa

from claimweave.llm import toxicity


def test_training_memory_stays_near_its_input():
    draw = np.random.default_rng(3)
    n, each = 4_000, 4_000
    flat = draw.integers(100, 200_000, n * each, np.int32)
    labels = np.arange(n) % 4 == 0
    flat.reshape(n, each)[labels, 0] = 7
    tracemalloc.start()
    model = toxicity.fit_arrays(flat, np.full(n, each), labels.astype(float), [])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * flat.nbytes and model.weights[7] > 0


def test_rows_are_gathered_in_the_order_of_their_ids():
    kinds = {"doc_id": pa.int64(), "toxic": pa.int32(), "slots": pa.list_(pa.int32()), "others": pa.list_(pa.list_(pa.int32()))}
    rows = [(9, 1, [4, 5], [[4, 6], [4]]), (2, 0, [], []), (5, 0, [1, 2, 3], [[1, 2, 3]]), (-1, 1, [8], [])]
    parts = [pa.table({name: pa.array([row[i] for row in part], kind) for i, (name, kind) in enumerate(kinds.items())}) for part in (rows[:1], rows[1:1], rows[1:])]
    flat, lengths, labels, changes = toxicity._gathered(pa.concat_tables(parts))
    assert flat.tolist() == [8, 1, 2, 3, 4, 5] and lengths.tolist() == [1, 0, 3, 2] and labels.tolist() == [1, 0, 0, 1]
    assert [sorted(change) for change in changes] == [[], [(5, 1.0), (6, -1.0)], [(5, 1.0)]]
    assert all(not len(part) for part in toxicity._gathered(pa.concat_tables(parts).slice(0, 0)))
