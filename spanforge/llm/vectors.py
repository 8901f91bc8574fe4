"""Vector columns as bytes, with a fingerprint for equal vectors."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import columns_once

VALID = "vec_id long, dim int, fp binary, vec binary"


def valid_vectors(df: DataFrame, keep_invalid: bool = False, label: str | None = None) -> DataFrame:
    """(vec_id, dim, fp, vec[, label]): vec holds doubles; fp is null where the vector is null, zero or holds null or non-finite components."""
    df = columns_once(df, "vec_id", "embedding", *([label] if label else []))
    cols = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    cols += [F.col(label).cast("string").alias("label")] if label else []

    def convert(batches):
        for batch in batches:
            fps, vecs, dims = [], [], []
            for x in batch.column(1):
                v = None
                if x.is_valid and not x.values.null_count and len(x.values):
                    v = x.values.to_numpy() + 0.0  # -0.0 becomes 0.0
                    v = v if np.isfinite(v).all() and v.any() else None
                raw = None if v is None else v.astype("<f8").tobytes()
                vecs.append(raw)
                dims.append(None if v is None else len(v))
                fps.append(None if v is None else hashlib.blake2b(raw, digest_size=16).digest())
            arrays = [batch.column(0), pa.array(dims, pa.int32()), pa.array(fps, pa.binary()), pa.array(vecs, pa.binary())] + ([batch.column(2)] if label else [])
            out = pa.RecordBatch.from_arrays(arrays, ["vec_id", "dim", "fp", "vec"] + (["label"] if label else []))
            yield out if keep_invalid else out.filter(out.column(2).is_valid())

    return df.select(*cols).mapInArrow(convert, VALID + (", label string" if label else ""))


def matrix(raws) -> np.ndarray:
    """Rows of equal dimension from their bytes."""
    raws = list(raws)
    return np.frombuffer(b"".join(raws), "<f8").reshape(len(raws), -1) if raws else np.zeros((0, 0))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, summed in one order whatever the rows' places."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total
