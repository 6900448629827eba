"""Greedy cosine matching of two sets of token vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE = "struct<precision:double,recall:double,f1:double>"


def embedding_match_score(pred_vecs: Column, ref_vecs: Column) -> Column:
    """Each token takes its best cosine on the other side: precision averages
    over ``pred_vecs``, recall over ``ref_vecs`` (``array<array<float>>``).
    A zero vector is
    like none: its cosine with any other is 0. NULL when a side has no vectors."""

    def unit(vectors: pa.ListScalar) -> np.ndarray | None:
        if not vectors.is_valid or not len(vectors.values):
            return None
        # the row's part of the flat buffer, seen as a matrix
        flat = vectors.values.flatten().to_numpy(zero_copy_only=False)
        m = flat.astype(np.float64).reshape(len(vectors.values), -1)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm == 0, 1.0, norm)

    @F.arrow_udf(SCORE)
    def scored(preds: pa.Array, refs: pa.Array) -> pa.Array:
        rows = []
        for p, r in zip(map(unit, preds), map(unit, refs)):
            if p is None or r is None:
                rows.append(None)
                continue
            cosine = p @ r.T
            precision = float(cosine.max(axis=1).mean())
            recall = float(cosine.max(axis=0).mean())
            both = precision + recall
            f1 = 2 * precision * recall / both if both else 0.0
            rows.append({"precision": precision, "recall": recall, "f1": f1})
        kinds = [(name, pa.float64()) for name in ("precision", "recall", "f1")]
        return pa.array(rows, pa.struct(kinds))

    return scored(pred_vecs, ref_vecs)
