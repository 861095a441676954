"""Boosted regression trees, trained where the rows are.

The method, settings and model class are MLlib's ``GBTRegressor`` (squared error, variance, every
feature continuous, no subsampling). Only the passes differ: rows are binned once into bytes,
eight or so per row, and a level of a tree is one numpy pass over them that adds up counts and
sums per node and bin; where MLlib keeps an object per row and walks it feature by feature.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, functions as F

from ..session import findable, materialize, scratch_path

WIDTH = 64  # codes of a group of features
ROWS_A_BLOCK = 500_000
ROWS_A_CHUNK = 65_536  # rows whose keys stay in a core's cache
KEPT_TREES = 50  # after so many the rows' predictions are written, so that no lineage grows on
SAMPLED = 10_000  # MLlib's least number of rows from which it draws thresholds


def thresholds(values: np.ndarray, rows: float, bins: int) -> np.ndarray:
    """MLlib's candidate thresholds of one feature, from the values of ``rows`` sampled rows."""
    found, counts = np.unique(values, return_counts=True)
    if len(found) and rows > len(values):  # rows that the sample lacks count as zeros there
        found, back = np.unique(np.append(found, 0.0), return_inverse=True)
        counts = np.bincount(back, weights=np.append(counts, rows - len(values)))
    middle = (found[:-1] + found[1:]) / 2
    if len(middle) <= bins - 1:
        return middle
    stride = rows / bins
    out, current, target = [], float(counts[0]), stride
    for i in range(1, len(found)):
        before, current = current, current + float(counts[i])
        if abs(before - target) < abs(current - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


class Layout:
    """Features in groups; a row has one code below ``WIDTH`` per group, which tells the bins of all its features."""

    def __init__(self, cuts: Sequence[np.ndarray]):
        self.cuts, self.bins = list(cuts), [len(c) + 1 for c in cuts]
        self.groups: list[list[int]] = []
        self.widths: list[int] = []
        for f in sorted(range(len(cuts)), key=lambda f: self.bins[f]):
            if self.groups and self.widths[-1] * self.bins[f] <= WIDTH:
                self.groups[-1].append(f)
                self.widths[-1] *= self.bins[f]
            else:
                self.groups.append([f])
                self.widths.append(self.bins[f])
        self.group = np.zeros(len(cuts), np.intp)
        self.bin_of = np.zeros((len(cuts), WIDTH), np.intp)  # of a feature, by its group's code
        self.to_bins: list[np.ndarray | None] = [None] * len(cuts)  # adds up codes; none where they are the bins
        for g, features in enumerate(self.groups):
            code = np.arange(WIDTH)
            for f in features:
                self.group[f], self.bin_of[f] = g, code % self.bins[f]
                code = code // self.bins[f]
                if len(features) > 1:
                    self.to_bins[f] = np.eye(self.bins[f])[self.bin_of[f, : self.widths[g]]]

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.groups), len(x)), np.uint8)
        for g, features in enumerate(self.groups):
            factor = 1
            for f in features:
                out[g] += (np.searchsorted(self.cuts[f], x[:, f], side="left") * factor).astype(np.uint8)
                factor *= self.bins[f]
        return out

    def of_feature(self, f: int, sums: np.ndarray) -> np.ndarray:
        """Sums by the bin of a feature, from sums by the code of its group (last axis)."""
        return sums if self.to_bins[f] is None else sums @ self.to_bins[f]


class Way:
    """The way of rows through the first levels of a tree, as sent to the tasks."""

    def __init__(self, tree: Tree, layout: Layout, levels: int):
        self.levels, self.inner = levels, (tree.feature[: 2**levels - 1] >= 0).nonzero()[0]
        feature = tree.feature[self.inner]
        self.group = layout.group[feature].astype(np.int16)
        self.right = layout.bin_of[feature] > tree.bin[self.inner, None]

    def nodes(self, chunks: list[np.ndarray]) -> Iterator[np.ndarray]:
        """The node of every row, chunk by chunk; rows stay at leaves."""
        size = 2**self.levels - 1
        group, down = np.zeros(2 * size + 1, np.intp), np.repeat(np.arange(2 * size + 1), WIDTH).reshape(-1, WIDTH)
        group[self.inner], down[self.inner] = self.group, 2 * self.inner[:, None] + 1 + self.right
        down = down.ravel()
        for codes in chunks:
            n = codes.shape[1]
            at, flat = np.arange(n), codes.ravel()
            node = down[:WIDTH].take(codes[group[0]]) if self.levels else np.zeros(n, np.intp)
            for _ in range(1, self.levels):
                code = flat.take(group.take(node) * n + at)
                node = down.take(node * WIDTH + code)
            yield node


class Tree:
    """A growing tree; node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, depth: int):
        n = 2 ** (depth + 1) - 1
        self.feature, self.bin, self.cut = np.full(n, -1), np.zeros(n, np.intp), np.zeros(n)
        self.gain = np.full(n, -1.0)
        self.stats = np.zeros((n, 3))  # count, sum, sum of squares

    def value(self) -> np.ndarray:
        return self.stats[:, 1] / np.maximum(self.stats[:, 0], 1)


@dataclass
class Block:
    """Rows of one task: codes in chunks, and residuals (labels before the first tree)."""

    codes: list[np.ndarray]
    left: np.ndarray

    def sums(self, way: Way, slots: np.ndarray, open_: int, widths: Sequence[int]) -> np.ndarray:
        """Counts, sums and sums of squares of the residuals, per node that has a slot and code of every group."""
        out = [[np.zeros(open_ * w) for w in widths] for _ in range(3)]
        begin = 0
        for codes, node in zip(self.codes, way.nodes(self.codes), strict=True):
            r = self.left[begin : begin + len(node)]
            begin += len(node)
            slot = slots.take(node)
            rows = (slot >= 0).nonzero()[0]
            every = len(rows) == len(node)
            slot, r = (slot, r) if every else (slot.take(rows), r.take(rows))
            squares = r * r
            for g, w in enumerate(widths):
                key = slot * w
                key += codes[g] if every else codes[g].take(rows)
                out[0][g] += np.bincount(key, minlength=open_ * w)
                out[1][g] += np.bincount(key, weights=r, minlength=open_ * w)
                out[2][g] += np.bincount(key, weights=squares, minlength=open_ * w)
        return np.concatenate([x for kind in out for x in kind])

    def after(self, way: Way, value: np.ndarray, first: bool) -> Block:
        """What is left by a tree: the gradient of the squared error, twice the difference."""
        step = np.concatenate([value.take(node) for node in way.nodes(self.codes)])
        return Block(self.codes, 2.0 * (self.left - step) if first else self.left - 2.0 * step)

    def packed(self) -> tuple:
        return len(self.left), len(self.codes[0]), b"".join(c.tobytes() for c in self.codes), self.left.tobytes()


def unpacked(row) -> Block:
    n, groups, codes, left = row
    flat, begin, chunks = np.frombuffer(codes, np.uint8), 0, []
    while begin < n:
        end = min(n, begin + ROWS_A_CHUNK)
        chunks.append(flat[begin * groups : end * groups].reshape(groups, end - begin))
        begin = end
    return Block(chunks, np.frombuffer(left))


PACKED = "n long, groups int, codes binary, left_ binary"


def _blocks(data: DataFrame, layout: Layout) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("n", pa.int64()), ("groups", pa.int32()), ("codes", pa.binary()), ("left_", pa.binary())])

        def block(codes: list[np.ndarray], y: list[np.ndarray]) -> pa.RecordBatch:
            all_codes = np.concatenate(codes, axis=1)
            cut = [np.ascontiguousarray(all_codes[:, b : b + ROWS_A_CHUNK]) for b in range(0, all_codes.shape[1], ROWS_A_CHUNK)]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, Block(cut, np.concatenate(y)).packed(), strict=True))], schema=schema)

        codes, y, held = [], [], 0
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            codes.append(layout.codes(np.stack(columns[:-1], axis=1)))
            y.append(columns[-1])
            held += batch.num_rows
            if held >= ROWS_A_BLOCK:
                yield block(codes, y)
                codes, y, held = [], [], 0
        if held:
            yield block(codes, y)

    return data.mapInArrow(run, PACKED)


def _dealt(blocks: DataFrame, parts: int) -> RDD:
    """The written blocks, evenly over the tasks."""
    return blocks.rdd.map(tuple).zipWithIndex().map(lambda x: (x[1], x[0])).partitionBy(parts, int).map(lambda x: unpacked(x[1]))


def _split(tree: Tree, layout: Layout, nodes: np.ndarray, sums: list[list[np.ndarray]]) -> None:
    """Split the open nodes at the best gain: of equal gains the first feature's and least threshold's, as MLlib does."""
    a = len(nodes)
    if nodes[0] == 0:
        tree.stats[0] = [kind[0].sum() for kind in sums]
    best, every = np.zeros(a), np.arange(a)
    feature, place, lower, upper = np.full(a, -1), np.zeros(a, np.intp), np.zeros((a, 3)), np.zeros((a, 3))
    for f, cuts in enumerate(layout.cuts):
        if not len(cuts):
            continue
        run = [np.cumsum(layout.of_feature(f, kind[layout.group[f]]), axis=1) for kind in sums]
        left, whole = [x[:, :-1] for x in run], [x[:, -1:] for x in run]
        n, s = whole[0] - left[0], whole[1] - left[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left[1] ** 2 / left[0] + s**2 / n - whole[1] ** 2 / whole[0]) / whole[0]
        gain = np.where((left[0] >= 1) & (n >= 1), gain, -np.inf)
        cut = gain.argmax(axis=1)
        i = (gain[every, cut] > best).nonzero()[0]  # equal gains stay with the feature before
        best[i], feature[i], place[i] = gain[i, cut[i]], f, cut[i]
        for k, x in enumerate(left):
            lower[i, k], upper[i, k] = x[i, cut[i]], whole[k][i, 0] - x[i, cut[i]]
    i = (feature >= 0).nonzero()[0]
    node = nodes[i]
    tree.feature[node], tree.bin[node], tree.gain[node] = feature[i], place[i], best[i]
    tree.cut[node] = [layout.cuts[f][c] for f, c in zip(feature[i], place[i], strict=True)]
    tree.stats[2 * node + 1], tree.stats[2 * node + 2] = lower[i], upper[i]


def _grown(blocks: RDD, layout: Layout, depth: int, parts: int) -> Tree:
    """One pass per level, over the rows of the smaller child of each node; the other child has the rest."""
    tree, nodes = Tree(depth), np.zeros(1, np.intp)
    sums: list[list[np.ndarray]] = []
    for level in range(depth):
        passed = np.ones(len(nodes), bool)
        if level:
            smaller = tree.stats[nodes[0::2], 0] <= tree.stats[nodes[1::2], 0]
            passed[0::2], passed[1::2] = smaller, ~smaller
        asked = nodes[passed]
        slots = np.full(2 ** (level + 1) - 1, -1, np.intp)
        slots[asked] = np.arange(len(asked))
        sent = (Way(tree, layout, level), slots, len(asked), layout.widths)
        flat = blocks.map(lambda b, sent=sent: b.sums(*sent)).treeReduce(np.add, 1 if parts <= 24 else 2)
        found = np.split(flat, np.cumsum([len(asked) * w for w in layout.widths * 3])[:-1])
        found = [x.reshape(len(asked), -1) for x in found]
        groups = len(layout.widths)
        now = [found[k * groups : (k + 1) * groups] for k in range(3)]
        if level:
            for k in (0, 1, 2):
                for g in range(groups):
                    both = np.empty((len(nodes), layout.widths[g]))
                    both[passed], both[~passed] = now[k][g], sums[k][g][parents] - now[k][g]
                    now[k][g] = np.where(now[0][g] > 0, both, 0) if k else both  # nothing is left where no rows are
        sums = now
        _split(tree, layout, nodes, sums)
        parents = (tree.feature[nodes] >= 0).nonzero()[0]
        nodes = nodes[parents]
        nodes = np.sort(np.concatenate([2 * nodes + 1, 2 * nodes + 2]))
        if not len(nodes):
            break
    return tree


def _saved(spark, trees: Sequence[tuple[Tree, float]], settings: dict, features: int) -> GBTRegressionModel:
    """The trees as a model of MLlib, by way of its own file format."""
    rows = []
    for t, (tree, _) in enumerate(trees):
        used = np.zeros(len(tree.feature), bool)
        used[0] = True
        for i in (tree.feature >= 0).nonzero()[0]:
            used[[2 * i + 1, 2 * i + 2]] = True
        ids = np.cumsum(used) - 1
        for i in used.nonzero()[0]:
            n, s, q = tree.stats[i].tolist()
            inner = tree.feature[i] >= 0
            impurity = max(0.0, (q - s * s / n) / n) if n else 0.0
            rows.append((
                t, int(ids[i]), s / n if n else 0.0, impurity, [n, s, q], int(n), float(tree.gain[i]),
                int(ids[2 * i + 1]) if inner else -1, int(ids[2 * i + 2]) if inner else -1, int(tree.feature[i]), [float(tree.cut[i])] if inner else [],
            ))
    names = ["treeID", "id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "featureIndex", "leftCategoriesOrThreshold"]
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    split = F.struct("featureIndex", "leftCategoriesOrThreshold", F.lit(-1).alias("numCategories")).alias("split")

    def described(kind: str, params: dict, **more) -> str:
        return json.dumps({
            "class": f"org.apache.spark.ml.regression.{kind}Model", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
            "uid": f"{kind}_{uuid.uuid4().hex[:12]}", "paramMap": params, "defaultParamMap": {"impurity": "variance"}, **more,
        })

    path = scratch_path(spark, "trees")
    data = spark.createDataFrame(table)
    data.select("treeID", F.struct(*names[1:9], split).alias("nodeData")).write.parquet(f"{path}/data")
    one = described("DecisionTreeRegression", {"maxDepth": settings["maxDepth"], "seed": settings["seed"]})
    spark.createDataFrame([(t, one, float(w)) for t, (_, w) in enumerate(trees)], "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    whole = described("GBTRegression", {**settings, "impurity": "variance"}, numFeatures=features, numTrees=len(trees))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return GBTRegressionModel.load(path)


def fit(
    rows: DataFrame, features: Sequence[str], target: str, maxIter: int = 20, stepSize: float = 0.1, maxDepth: int = 5, seed: int = 42, maxBins: int = 32
) -> GBTRegressionModel:
    """Train on all rows. As in MLlib, features that are null or not finite and targets that are null or NaN are an error."""
    spark = rows.sparkSession
    findable(spark)

    def checked(name: str, bad, says: str):
        value = F.col(name).cast("double")
        return F.when(value.isNull() | bad(value), F.raise_error(F.lit(f"{says}: {name}"))).otherwise(value)

    data = rows.select(
        *[checked(f, lambda v: F.isnan(v) | (F.abs(v) == float("inf")), "Features MUST NOT be Null, NaN or Infinity").alias(f"x{i}") for i, f in enumerate(features)],
        checked(target, F.isnan, "Labels MUST NOT be Null or NaN").alias("y"),
    )
    count = data.count()
    if not count:
        raise ValueError("there are no rows to train on")
    needed = max(maxBins**2, SAMPLED)
    drawn, fraction = data, min(1.0, needed / count)
    if needed < count:  # the rows that MLlib draws with this seed
        draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        drawn = DataFrame(spark._jsparkSession.createDataFrame(data._jdf.toJavaRDD().sample(False, fraction, draw), data._jdf.schema()), spark)
    sample = np.array([tuple(r) for r in drawn.collect()], np.float64).reshape(-1, len(features) + 1)
    layout = Layout([thresholds(x[x != 0], fraction * count, min(maxBins, count)) for x in sample.T[:-1]])
    blocks = materialize(_blocks(data, layout), "blocks")
    parts = blocks.count()
    held = _dealt(blocks, parts).persist(StorageLevel.MEMORY_AND_DISK)
    trees: list[tuple[Tree, float]] = []
    old: RDD | None = None
    try:
        while len(trees) < maxIter:
            tree, weight = _grown(held, layout, maxDepth, parts), stepSize if trees else 1.0
            trees.append((tree, weight))
            if old is not None:
                old.unpersist()  # what is held now has been read
                old = None
            if len(trees) < maxIter:
                step = (Way(tree, layout, maxDepth), weight * tree.value(), len(trees) == 1)
                after = held.map(lambda b, step=step: b.after(*step))
                if len(trees) % KEPT_TREES == 0:
                    after = _dealt(materialize(spark.createDataFrame(after.map(Block.packed), PACKED, verifySchema=False), "blocks"), parts)
                old, held = held, after.persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        for rdd in (old, held):
            if rdd is not None:
                rdd.unpersist()
    settings = {"maxIter": maxIter, "stepSize": stepSize, "maxDepth": maxDepth, "seed": seed, "maxBins": maxBins, "labelCol": target, "featuresCol": "features"}
    return _saved(spark, trees, settings, len(features))
