"""Classifiers over feature tables: balanced random forest and a perceptron, cross-validated on given folds.

Spark's forest shuffles the statistics of every node of every tree at every level, which for 200 trees down to leaves of two rows takes minutes a fold even on small tables. Up to ``LOCAL`` rows
each task grows whole trees instead, on a byte a value (Spark's 32 bins from the training rows alone), with Spark's rules: Poisson bootstrap, four of fourteen features a node, Gini impurity over weighted
classes, leaves of two rows or more. Larger tables go to Spark's. Both grow the same kind of forest from other random draws; the local one doesn't depend on how the table is partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..sources.tables import materialize

#: Rows of which every task can hold the values, as a byte each.
LOCAL = 2_000_000
#: Bins of a feature, as Spark's ``maxBins``.
BINS = 32
#: Counters of the histograms that are made at once.
CELLS = 1 << 22
#: A vote of 1: votes are added as whole numbers, so that their order makes no difference.
VOTE = 1 << 40


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with weight n / (k * n_c), so that every class weighs the same."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_c"))
    one = Window.partitionBy(F.lit(1))
    weights = sizes.select(label, (F.sum("_c").over(one) / (F.count("*").over(one) * F.col("_c"))).alias("weight"))
    return df.join(F.broadcast(weights), label)  # one row a class


def standardize(train: DataFrame, rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` with each column less the mean over the population deviation of ``train`` (0 where that is 0)."""
    fit = train.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    return rows.withColumns({c: F.lit(0.0) if not fit[c]["s"] else (F.col(c) - F.lit(fit[c]["m"])) / F.lit(fit[c]["s"]) for c in columns})


def forest(trees: int = 200, depth: int = 30) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, weightCol="weight", seed=L.SEED, featuresCol="features", labelCol="label", predictionCol="prediction")


def perceptron(inputs: int, classes: int = 3, hidden: int = 256) -> MultilayerPerceptronClassifier:
    """One hidden layer; Spark's uses sigmoid units and L-BFGS."""
    return MultilayerPerceptronClassifier(layers=[inputs, hidden, classes], maxIter=200, blockSize=64, seed=L.SEED, featuresCol="features", labelCol="label", predictionCol="prediction")


def cross_validated(df: DataFrame, columns: tuple[str, ...], trees: int = 200, depth: int = 30) -> DataFrame:
    """(doc_id, language, fold, y_true, y_pred): out-of-fold predictions of a forest on ``columns`` of ``df`` (doc_id, language, label from 0, fold and the columns). Without rows in other folds
    there is no prediction."""
    table = materialize(df.select("doc_id", "language", "fold", F.col("label").cast("double").alias("label"), *columns, F.monotonically_increasing_id().alias("row")), "model-rows")
    if table.limit(LOCAL + 1).count() > LOCAL:
        return _cross_validated_by_spark(table, columns, trees, depth)
    votes = materialize(_votes(table, columns, trees, depth), "forest-votes")
    best = votes.groupBy("row", "label").agg(F.sum("vote").alias("vote")).groupBy("row").agg(F.max_by("label", F.struct("vote", -F.col("label"))).alias("y_pred"))
    return table.join(best, "row", "left").select("doc_id", "language", "fold", F.col("label").cast("int").alias("y_true"), "y_pred")


def _cross_validated_by_spark(df: DataFrame, columns: tuple[str, ...], trees: int, depth: int) -> DataFrame:
    table = VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)
    out = None
    for fold in range(L.FOLDS):  # five models, each trained on the cluster, classes balanced within its training rows
        model = forest(trees, depth).fit(balanced(table.where(F.col("fold") != fold)))
        part = model.transform(table.where(F.col("fold") == fold)).select("doc_id", "language", "fold", F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))
        out = part if out is None else out.unionByName(part)
    return out


def _cuts(table: DataFrame, columns: tuple[str, ...]) -> np.ndarray:
    """The upper ends of all bins but the last of each column, over the rows of all folds but the first, the second and so on: (folds, columns, BINS - 1)."""
    at = [k / BINS for k in range(1, BINS)]
    ends = table.agg(*[F.percentile_approx(F.when(F.col("fold") != fold, F.col(c)), at, 10_000) for fold in range(L.FOLDS) for c in columns]).first()
    return np.array([x if x else [0.0] * len(at) for x in ends], np.float64).reshape(L.FOLDS, len(columns), len(at))


def _coded(batches: Iterator[pa.RecordBatch], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(row, fold, label, doc_id, codes): the bins of each row's values by the cuts of each fold, a byte each."""
    for batch in batches:
        values = [np.asarray(batch.column(k), np.float64) for k in range(4, batch.num_columns)]
        codes = np.array([[np.searchsorted(c, v, "left") for c, v in zip(of, values)] for of in cuts], np.uint8)  # folds, columns, rows
        raw = np.ascontiguousarray(codes.transpose(2, 0, 1)).reshape(batch.num_rows, -1)
        size = raw.shape[1]
        flat = raw.tobytes()
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array([flat[k * size : (k + 1) * size] for k in range(batch.num_rows)], pa.binary())], ["row", "fold", "label", "doc_id", "codes"])


def _votes(table: DataFrame, columns: tuple[str, ...], trees: int, depth: int) -> DataFrame:
    """(row, label, vote): what the trees of each task say of the rows of the fold that they haven't seen, a row for each label."""
    spark, cuts = table.sparkSession, _cuts(table, columns)
    values = table.select("row", "fold", "label", "doc_id", *[F.col(c).cast("double") for c in columns])
    rows = values.mapInArrow(partial(_coded, cuts=cuts), "row bigint, fold int, label double, doc_id bigint, codes binary").toArrow()
    row, fold, label, doc = (rows.column(k).to_numpy() for k in range(4))
    codes = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint8).reshape(len(row), L.FOLDS, len(columns))
    # The order of the rows is that of their contents, however the table is stored.
    order = np.lexsort((*codes.reshape(len(row), -1).T[::-1], label, fold, doc))
    held = spark.sparkContext.broadcast((row[order], fold[order], label[order].astype(np.int64), codes[order]))
    slots = spark.sparkContext.defaultParallelism
    parts = max(1, min(trees, -(-2 * slots // L.FOLDS)))
    tasks = [(k, trees * p // parts, trees * (p + 1) // parts) for k in range(L.FOLDS) for p in range(parts)]
    todo = spark.createDataFrame(spark.sparkContext.parallelize(tasks, len(tasks)), "fold int, low int, high int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, low, high in zip(*(batch.column(c).to_pylist() for c in range(3))):
                row, fold, label, codes = held.value
                seen, own = fold != k, fold == k
                if not seen.any() or not own.any():
                    continue
                found = sum(grow(codes[seen, k], label[seen], codes[own, k], depth, np.random.default_rng((L.SEED, k, tree))) for tree in range(low, high))
                n, classes = found.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row[own], classes)), pa.array(np.tile(np.arange(classes, dtype=np.int32), n)), pa.array(found.ravel())], ["row", "label", "vote"])

    return todo.mapInArrow(run, "row bigint, label int, vote bigint")


def grow(codes: np.ndarray, label: np.ndarray, others: np.ndarray, depth: int, rng: np.random.Generator, least: int = 2) -> np.ndarray:
    """The votes, by class, of one tree grown on ``codes`` (a bin for each row and feature) for the rows of ``others``, which go down the tree as it grows."""
    classes, features = int(label.max()) + 1, codes.shape[1]
    tried = int(np.ceil(np.sqrt(features)))
    sizes = np.bincount(label, minlength=classes)
    weight = len(label) / ((sizes > 0).sum() * np.maximum(sizes, 1))
    bag = rng.poisson(1.0, len(label)).astype(np.float64)
    votes, rows, asked = np.zeros((len(others), classes), np.int64), np.flatnonzero(bag), np.arange(len(others))
    if not len(rows):
        return votes
    # Values are taken from flat arrays, and counters have the classes first: both several times as fast as indexing by pairs and sums over a last axis of few places.
    value_of, asked_of, by_class = np.ascontiguousarray(codes).ravel(), np.ascontiguousarray(others).ravel(), weight[:, None, None]
    # A group of nodes of one level: the training rows and the rows asked about, the node of each, the number of nodes and the level.
    groups = [(rows, np.zeros(len(rows), np.int64), asked, np.zeros(len(asked), np.int64), 1, 0)]
    most = max(1, CELLS // (BINS * classes))
    while groups:
        rows, node, asked, place, n, level = groups.pop()
        if n > most:
            for low in range(0, n, most):
                a, b = (node >= low) & (node < low + most), (place >= low) & (place < low + most)
                groups.append((rows[a], node[a] - low, asked[b], place[b] - low, min(most, n - low), level))
            continue
        total = np.bincount(label[rows] * n + node, bag[rows], n * classes).reshape(classes, n)
        weighed = total * weight[:, None]
        every = weighed.sum(0)
        feature, cut, split = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        if level < depth:
            choice = np.argsort(rng.random((n, features)), 1)[:, :tried]
            # Nodes of one class, and those too small for two leaves, can't be split and aren't counted.
            open_ = np.flatnonzero(((total > 0).sum(0) > 1) & (total.sum(0) >= 2 * least))
            number = np.full(n, -1)
            number[open_] = np.arange(len(open_))
            node = number[node]
            rows, node = rows[node >= 0], node[node >= 0]
            m, total_, choice = len(open_), total[:, open_, None], choice[open_]
            best, chosen, at_bin = np.full(m, -1.0), np.zeros(m, np.int64), np.zeros(m, np.int64)
            count, start, cell = bag[rows], rows * features, (label[rows] * m + node) * BINS
            for k in range(tried if m else 0):
                column = choice[:, k]
                left = np.cumsum(np.bincount(cell + value_of[start + column[node]], count, classes * m * BINS).reshape(classes, m, BINS), 2)[:, :, :-1]
                right = total_ - left
                sound = (left.sum(0) >= least) & (right.sum(0) >= least)
                left, right = left * by_class, right * by_class
                score = np.where(sound, (left**2).sum(0) / np.maximum(left.sum(0), 1e-300) + (right**2).sum(0) / np.maximum(right.sum(0), 1e-300), -1.0)
                at = score.argmax(1)
                value = score[np.arange(m), at]
                better = value > best
                best[better], chosen[better], at_bin[better] = value[better], column[better], at[better]
            feature[open_], cut[open_], split[open_] = chosen, at_bin, best > (weighed[:, open_] ** 2).sum(0) / every[open_] * (1 + 1e-12)
            node = open_[node]
        ends = ~split[place]
        votes[asked[ends]] = np.rint((weighed / every)[:, place[ends]] * VOTE).T
        asked, place = asked[~ends], place[~ends]
        if len(asked):
            new = 2 * (np.cumsum(split) - 1)
            going = split[node]
            rows, node = rows[going], node[going]
            node = new[node] + (value_of[rows * features + feature[node]] > cut[node])
            place = new[place] + (asked_of[asked * features + feature[place]] > cut[place])
            # Nodes that no asked row reaches say nothing.
            used = np.zeros(2 * int(split.sum()), bool)
            used[place] = True
            number = np.cumsum(used) - 1
            keep = used[node]
            groups.append((rows[keep], number[node[keep]], asked, number[place], int(used.sum()), level + 1))
    return votes


def _perceptron_part(train: DataFrame, rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(doc_id, language, fold, y_true, y_pred) of ``rows`` by a perceptron trained on ``train``, both scaled by ``train`` alone."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features")
    model = perceptron(len(columns)).fit(vectors.transform(standardize(train, train, columns)))
    told = model.transform(vectors.transform(standardize(train, rows, columns)))
    return told.select("doc_id", "language", "fold", F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))


def perceptron_cross_validated(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Out-of-fold predictions of a perceptron on ``columns`` of ``df`` (doc_id, language, label from 0, fold and the columns)."""
    table = materialize(df.select("doc_id", "language", "fold", F.col("label").cast("double").alias("label"), *columns), "model-rows")
    out = None
    for fold in range(L.FOLDS):  # five models, each trained on the cluster
        part = _perceptron_part(table.where(F.col("fold") != fold), table.where(F.col("fold") == fold), columns)
        out = part if out is None else out.unionByName(part)
    return out


def transferred(train: DataFrame, rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Predictions for ``rows`` of languages that ``train`` doesn't have (both with doc_id, language, label from 0, fold and the columns)."""
    keep = lambda df: df.select("doc_id", "language", "fold", F.col("label").cast("double").alias("label"), *columns)
    return _perceptron_part(materialize(keep(train), "model-rows"), keep(rows), columns)
