"""Python workers live on between tasks, so every step gives its memory back when its rows have been read."""

import pyarrow as pa
import pytest

from claimweave.llm import common, suffix, windows

BATCH = pa.RecordBatch.from_pydict({"x": [1, 2]})


class Rows:
    """Stands for a table and keeps what is to run in the tasks."""

    sparkSession = None

    def __init__(self):
        self.runs = []

    def __getattr__(self, name):
        return lambda *args, **kwargs: self

    def mapInArrow(self, run, schema):
        self.runs.append(run)
        return self


@pytest.fixture
def given_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release_memory", lambda: calls.append(1))
    return calls


def test_memory_goes_after_the_last_row(given_back):
    found = common.releasing(lambda batches: (batch.slice(1) for batch in batches))(iter([BATCH, BATCH]))
    assert [next(found).num_rows, next(found).num_rows, given_back] == [1, 1, []]
    assert next(found, None) is None and given_back == [1]


def test_steps_of_the_windows_and_plain_steps_give_it_back(spark, given_back):
    rows, units = Rows(), suffix.units(100)
    windows.outline(rows, units)
    windows.compare(rows, False)
    windows.resolve(rows, units, suffix.dictionary_repeats(100))
    windows.packed_texts(rows)
    done = []
    common.mapped(rows, lambda batch: [], "x long", lambda: done.append(1))
    for run in rows.runs:
        assert list(run(iter(()))) == []
    assert len(rows.runs) == len(given_back) == 5 and done == [1]
