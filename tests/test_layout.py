"""Encodings leave the worker in slices, whatever the length of an Arrow batch."""

import pyarrow as pa
import pytest

from quillon.functions import layout
from quillon.plans import vocabularies as V


@pytest.mark.parametrize("cut", [False, True])
def test_slices(monkeypatch, cut):
    monkeypatch.setattr(layout, "arrow_udf", lambda returns: lambda f: lambda *columns: list(f(zip(*columns) if len(columns) > 1 else columns[0])))
    monkeypatch.setattr(layout, "SLICE_BYTES", 1000, raising=False)
    texts = [None, "", "the cat é " * 150, *["hello  world " * 20] * 30, "x"]
    parts = [None if t is None else t.split(" ") for t in texts]
    run = lambda rows: layout.lay_out([pa.array([texts[i] for i in rows], pa.string())], V.BPE, [pa.array([parts[i] for i in rows], pa.list_(pa.string()))] if cut else None)
    got = run(range(len(texts)))
    assert len(got) > 8 and sum(map(len, got)) == len(texts)
    rows = [r for x in got for r in x.to_pylist()]
    assert rows == [r for i in range(len(texts)) for x in run([i]) for r in x.to_pylist()]
    assert rows[0] is None and rows[1] == {"ids": [], "tokens": [], "words": [], "offsets": []} and rows[2]["offsets"][0]["start"] == 0
    assert len({len(v) for v in rows[3].values()}) == 1 and len(rows[3]["ids"]) > 0
