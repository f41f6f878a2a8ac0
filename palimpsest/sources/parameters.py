"""Statement parameters: Python values, JSON-LD values, and Arrow tables for batches."""

from __future__ import annotations

from typing import Any

from palimpsest.dialect.lexer import SqlError


def numbered(params: Any) -> dict:
    """Parameters by number or name."""
    if params is None:
        return {}
    if isinstance(params, dict):
        return dict(params)
    if isinstance(params, (list, tuple)):
        return dict(enumerate(params))
    raise SqlError("Parameters must be an array or an object")


def batches(params: Any) -> list[dict]:
    """One set of parameters per row of a list, an Arrow table, or the bytes of an Arrow file or stream."""
    import pyarrow as pa

    if isinstance(params, (bytes, bytearray)):
        reader = pa.ipc.open_file if bytes(params[:6]) == b"ARROW1" else pa.ipc.open_stream
        params = reader(pa.BufferReader(bytes(params))).read_all()
    if isinstance(params, pa.RecordBatch):
        params = pa.Table.from_batches([params])
    if isinstance(params, pa.Table):
        return params.to_pylist()
    if not isinstance(params, (list, tuple)):
        raise SqlError("Many parameters must be an array")
    return [numbered(p) for p in params]
