"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Minimum-hash signatures deal the texts to regions (see ``forest``), and every link is one that a BK-tree of SimHashes gave and both shingle sets confirmed.  First the trees of
runs of a region's texts link most copies; then a tree of each region that still has several classes gives the pairs that are worth a check.  Crowded regions are dealt anew by more and deeper signatures.  So any two similar
texts are joined, and rows follow the texts of a region, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import forest as N
from lumenframe.llm.simhash import BKTree

SHINGLE = 5
#: Two texts at 0.8 differ in 10 bits (12 where there are few shingles) on average, with a deviation of 3.
RADIUS = 26


def near_trees(group: pa.RecordBatch) -> np.ndarray:
    """Rows (distance, i, j) of the pairs of different classes within RADIUS bits, found with a BK-tree."""
    roots, values, tree, out = group.column("root").to_pylist(), group.column("fp").to_numpy().view(np.uint64).tolist(), BKTree(), []
    for i, value in enumerate(values):
        out += [((value ^ values[j]).bit_count(), i, j) for j in tree.within(value, RADIUS) if roots[i] != roots[j]]
        tree.add(value)
    return np.array(out, np.int64).reshape(-1, 3)


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each group of texts joined by checked links, the one with the smallest id, with all its columns.

    Texts are lower-cased (A-Z only) and cut into words at ASCII white space; a text of fewer than five words is one
    shingle, and texts without words (null too) are alike.  Null ids come last; rows that are alike in id and text all stay if one does.
    """
    found = N.similar_groups(df, id_col, text_col, SHINGLE, near_trees, RADIUS, empty_alike=True)
    kept = found.filter(F.col("id").eqNullSafe(F.col("least_id")) & (F.col("t") == F.col("least_t"))).select(F.col("id").alias("keep"), F.col("t").alias("kept_t")).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), N.text_name(text).alias("t"))
    return whole.join(kept, F.col("id").eqNullSafe(F.col("keep")) & (F.col("t") == F.col("kept_t")), "left_semi").select("row.*")
