"""Converters hold few texts of a batch as Python strings."""

import pyarrow as pa

from scriptorium.functions import convert


def test_converter_takes_arrow_slices(monkeypatch):
    sizes = []
    monkeypatch.setitem(convert.CONVERTERS, "html-to-markdown", lambda s: sizes.append(len(s)) or s.upper())
    run = convert.column_udf("html-to-markdown").func
    values = pa.array([None if i % 50 == 7 else "x" * i for i in range(3 * convert._AT_ONCE + 5)])
    assert run(values).to_pylist() == [None if v is None else v.upper() for v in values.to_pylist()] and len(sizes) == sum(v is not None for v in values.to_pylist())
    assert run(pa.array([], pa.string())).to_pylist() == []
