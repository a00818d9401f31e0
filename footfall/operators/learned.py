"""Learned inputs: hashed text vectors and a query projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.text import or_empty
from footfall.functions.vectors import matrix
from footfall.plans.scratch import materialise

# Partial matrices added up by one task of a round.
FAN = 16


def hashed_text_vectors(df: DataFrame, key: str, text: str, dimensions: int = 256, prefix: str = "") -> DataFrame:
    """``key, vec``: L2-normalised TF-IDF over hashed words of the whole text, as ``array<float>``.

    Stands in where no external encoder is given to ``map_texts``. The fitted state is one
    number per dimension.
    """
    source = df.select(key, F.concat(F.lit(prefix), or_empty(F.col(text))).alias("_text"))
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\s+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit"),
    ]
    encoded = Pipeline(stages=stages).fit(source).transform(source)
    return encoded.select(key, vector_to_array("_unit", "float32").alias("vec"))


def summed_matrices(partials: DataFrame, fan: int = FAN, nodes: int | None = None) -> DataFrame:
    """``i, v``: the sum over all nodes of ``node, i, v``, where ``v`` is the array of matrix row ``i`` of that node.

    Nodes are numbered from 0 and combined in a tree, ``fan`` at a time: a task of a round adds at most ``fan``
    arrays per row and node, and each node sends its rows once. The sum is taken in the order of nodes. There is
    always one round, so that rows which a node holds twice are added too.
    """
    if nodes is None:
        nodes = (partials.agg(F.max("node")).first()[0] or 0) + 1
    nodes = max(2, nodes)
    level = partials
    while nodes > 1:
        group = F.floor(F.col("node") / fan).cast("int").alias("node")
        total = F.aggregate(F.slice("vs", F.lit(2), F.size("vs")), F.get("vs", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
        met = level.select(group, F.col("node").alias("_n"), "i", "v").groupBy("node", "i")
        level = met.agg(F.sort_array(F.collect_list(F.struct("_n", "v")))["v"].alias("vs")).select("node", "i", total.alias("v"))
        nodes = -(-nodes // fan)
    return level.select("i", "v")


def gram_parts(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """``node, i, v``: the rows of [X'X X'Y] of each task, X and Y being its vectors; null vectors are left out."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, node = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, node = matrix(batch.column(0)), matrix(batch.column(1)), batch.column(2)[0]
            part = x.T @ np.hstack([x, y])
            total = part if total is None else total + part
        if total is not None:
            offsets = np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]
            rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([node.as_py()] * len(total), pa.int32()), pa.array(np.arange(len(total), dtype=np.int32)), rows], names=["node", "i", "v"])

    known = pairs.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    named = known.select(F.col(source).alias("_x"), F.col(target).alias("_y"), F.spark_partition_id().alias("_node"))
    return named.mapInArrow(gram, "node int, i int, v array<double>")


def ridge_projection(pairs: DataFrame, source: str, target: str, penalty: float = 1.0, fan: int = FAN) -> np.ndarray:
    """The matrix W minimising |XW - Y|^2 + penalty |W|^2 over all rows of ``pairs``.

    Each task adds up its own X'X and X'Y and emits them as one array per matrix row; these are stored
    and combined in a tree (:func:`summed_matrices`), and only the (d, d + k) total, whose size does not depend on
    the rows, reaches the driver. Rows with a null vector teach nothing; with none left it raises ``ValueError``.
    """
    total = summed_matrices(materialise(gram_parts(pairs, source, target), "gram-parts"), fan).orderBy("i").toArrow()
    if not total.num_rows:
        raise ValueError("no pairs to learn a projection from")
    both = matrix(total["v"])
    d = len(both)
    return np.linalg.solve(both[:, :d] + penalty * np.eye(d), both[:, d:])


def project(df: DataFrame, vector: str, weights: np.ndarray, out: str) -> DataFrame:
    """Add ``out = vector @ weights``; the weights are d x k numbers shipped with the function."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def apply(column: pa.Array) -> pa.Array:
        product = matrix(column) @ weights if len(column) else np.empty((0, weights.shape[1]))
        offsets = np.arange(len(product) + 1, dtype=np.int32) * weights.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(product.ravel()))

    return df.withColumn(out, apply(vector))
