"""Arrow arrays to numpy and back, for functions over rows that hold a whole chunk: no number becomes an object of Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_TYPES = {"double": pa.float64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}


def cut(lists: pa.ListArray) -> list[np.ndarray]:
    """The numbers of each list; null as NaN."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    numbers = lists.flatten().to_numpy(zero_copy_only=False)
    return [numbers[a:b] for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0])]


def joined(found: list[dict[str, np.ndarray]], added: dict[str, str]) -> pa.StructArray:
    """A struct a chunk, of a list a name with a value a row; `added` has the type of these values. NaN becomes null."""
    fields = []
    for name, kind in added.items():
        parts = [np.asarray(f[name]) for f in found]
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        if not parts:
            values = pa.array([], _TYPES[kind])
        elif kind == "array<double>":
            flat = np.concatenate(parts)
            width = flat.shape[1]
            inner = pa.array(flat.ravel().astype(float), from_pandas=True)
            values = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * width, inner)
        else:
            values = pa.array(np.concatenate(parts), from_pandas=True).cast(_TYPES[kind])
        fields.append(pa.ListArray.from_arrays(ends, values))
    return pa.StructArray.from_arrays(fields, names=list(added))
