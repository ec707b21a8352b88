"""Arrow batches of packed blocks as flat NumPy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Flat:
    """The items of several list columns of a batch, one after another within each row.

    ``seg`` is the row of each item, ``role`` the list column it comes from;
    fields are float or int arrays, null floats are NaN.
    """

    def __init__(self, batch: pa.RecordBatch, columns: list[str], ints: list[str], floats: list[str]) -> None:
        seg, role, cols = [], [], {n: [] for n in (*ints, *floats)}
        for k, name in enumerate(columns):
            a = batch.column(batch.schema.get_field_index(name))
            if a.null_count:
                a = a.fill_null([])
            sizes = np.diff(a.offsets.to_numpy(zero_copy_only=False))
            items = a.flatten()
            seg.append(np.repeat(np.arange(len(a)), sizes))
            role.append(np.full(len(items), k, np.int8))
            for n in ints:
                x = items.field(n)
                cols[n].append(x.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64))
            for n in floats:
                cols[n].append(items.field(n).to_numpy(zero_copy_only=False).astype(np.float64))
        s = np.concatenate(seg) if seg else np.zeros(0, np.int64)
        order = np.argsort(s, kind="stable")
        self.seg = s[order]
        self.role = np.concatenate(role)[order]
        self.fields = {n: np.concatenate(v)[order] for n, v in cols.items()}
        self.rows = batch.num_rows

    def __getitem__(self, name: str) -> np.ndarray:
        return self.fields[name]

    def __len__(self) -> int:
        return len(self.seg)


def breaks(*arrays: np.ndarray) -> np.ndarray:
    """True where any of the arrays differs from its previous element, and at the first."""
    n = len(arrays[0])
    out = np.zeros(n, bool)
    if n:
        out[0] = True
        for a in arrays:
            out[1:] |= a[1:] != a[:-1]
    return out
