"""Scores of a tree ensemble that comes as a node table, with Arrow batches over broadcast arrays.

Node table: tree, node, class_id, feature (-1 in a leaf), threshold, left, right, value, and for contributions cover,
the weight of training rows that came by. A row goes left where its feature is less than the threshold. Margins are
the sums of leaf values by class.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Nodes of an ensemble that may be broadcast.
MOST_NODES = 5_000_000


def _arrays(nodes: DataFrame) -> dict[str, np.ndarray]:
    table = nodes.limit(MOST_NODES + 1).toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    if len(table) > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")
    at = {(t, n): i for i, (t, n) in enumerate(zip(table.tree, table.node, strict=True))}
    go = lambda side: np.array([at.get((t, n), 0) for t, n in zip(table.tree, table[side], strict=True)])
    roots = table.drop_duplicates("tree").index.to_numpy()
    cover = table.cover.to_numpy(float) if "cover" in table else np.ones(len(table))
    return {"cover": cover, "feature": table.feature.to_numpy(int), "threshold": table.threshold.to_numpy(float), "value": table.value.to_numpy(float), "left": go("left"), "right": go("right"), "root": roots, "class_id": table.class_id.to_numpy(int)[roots]}


def tree_margins(rows: DataFrame, features: str, nodes: DataFrame, classes: int) -> DataFrame:
    """rows with margins, an array by class; `features` is an array column in the order of the node table."""
    sent = rows.sparkSession.sparkContext.broadcast(_arrays(nodes))
    index = rows.columns.index(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for batch in batches:
            x = np.array(batch.column(index).to_pylist(), float).reshape(batch.num_rows, -1)
            margins = np.zeros((batch.num_rows, classes))
            for root, c in zip(t["root"], t["class_id"], strict=True):
                at = np.full(batch.num_rows, root)
                while (live := np.flatnonzero(t["feature"][at] >= 0)).size:
                    here = at[live]
                    left = x[live, t["feature"][here]] < t["threshold"][here]
                    at[live] = np.where(left, t["left"][here], t["right"][here])
                margins[:, c] += t["value"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(margins))], names=[*batch.schema.names, "margins"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("margins", ArrayType(DoubleType()))]))


def predicted(margins: DataFrame) -> DataFrame:
    return margins.withColumn("class_id", F.array_position("margins", F.array_max("margins")).cast("int") - 1)


def leaf_paths(t: dict[str, np.ndarray]) -> list[tuple[int, float, list[tuple[int, list[tuple[float, bool]], float]]]]:
    """Class and value of each leaf, and for each feature on the way: its splits, and the share of cover they keep."""
    out = []
    for root, c in zip(t["root"], t["class_id"], strict=True):
        todo = [(int(root), {})]
        while todo:
            n, path = todo.pop()
            f = int(t["feature"][n])
            if f < 0:
                out.append((int(c), float(t["value"][n]), [(k, splits, share) for k, (splits, share) in path.items()]))
                continue
            for left, child in ((True, int(t["left"][n])), (False, int(t["right"][n]))):
                splits, share = path.get(f, ([], 1.0))
                kept = t["cover"][child] / t["cover"][n] if t["cover"][n] else 0.0
                todo.append((child, path | {f: ([*splits, (float(t["threshold"][n]), left)], share * kept)}))
    return out


def shapley(x: np.ndarray, leaves: list, classes: int) -> np.ndarray:
    """Path-dependent Shapley values, rows by classes by features, with the base value in one more place.

    A leaf is a game of the features on its way: one that is known counts 1 or 0 as the row passes its splits, one
    that is not counts its share of cover, and the leaf's value is multiplied by all of them. Of such a product the
    coefficients of prod(share + passes * s) give the sums over coalitions by size.
    """
    out = np.zeros((len(x), classes, x.shape[1] + 1))
    for c, value, path in leaves:
        d = len(path)
        passes = [np.logical_and.reduce([(x[:, f] < at) == left for at, left in splits]).astype(float) for f, splits, _ in path]
        shares = [share for _, _, share in path]
        out[:, c, -1] += value * np.prod(shares)
        for i in range(d):
            sums = np.zeros((len(x), d))
            sums[:, 0] = 1
            for j in range(d):
                if j != i:
                    known = sums * passes[j][:, None]
                    sums *= shares[j]
                    sums[:, 1:] += known[:, :-1]
            weights = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
            out[:, c, path[i][0]] += value * (passes[i] - shares[i]) * (sums @ weights)
    return out


def tree_contributions(rows: DataFrame, features: str, nodes: DataFrame, classes: int) -> DataFrame:
    """rows with contributions, an array by class of arrays by feature, and base_values, an array by class."""
    t = _arrays(nodes)
    sent = rows.sparkSession.sparkContext.broadcast(leaf_paths(t))
    index = rows.columns.index(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                part = batch.slice(start, 1_000)
                found = shapley(np.array(part.column(index).to_pylist(), float).reshape(part.num_rows, -1), sent.value, classes)
                made = [pa.array(found[:, :, :-1].tolist()), pa.array(found[:, :, -1].tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "contributions", "base_values"])

    floats = ArrayType(DoubleType())
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("contributions", ArrayType(floats)), StructField("base_values", floats)]))
