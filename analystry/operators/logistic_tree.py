"""Logistic model tree: every node is a logistic regression on its most correlated feature.

The tree grows breadth first. Rows carry the number of their node, so one grouped pass serves all
nodes of a level: one for the correlations, then one per Newton step for the sums that the
two-parameter fits need. Only per-node numbers reach the driver. Without `maxDepth` a node is split until it is
pure or its fit puts all rows on one side, so nodes are numbered as they come and their paths are kept as text.
"""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from analystry.session import cut_lineage

NODE_SCHEMA = ("node_id long, parent long, depth int, type string, index int, coef double, intercept double, "
               "value double, rows long, path string, left long")

NO_LIMIT = -1


def _probability(z):
    return 1 / (1 + F.exp(-z))


class _Columns(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    pass


class LogisticTree(Estimator, _Columns):
    """Two-class tree; `maxDepth` (no limit by default) and `minRows` bound it, C is the usual inverse L2 strength of a node's fit."""

    maxDepth = Param(Params._dummy(), "maxDepth", "deepest level, -1 for no limit", TypeConverters.toInt)
    minRows = Param(Params._dummy(), "minRows", "nodes with fewer rows are not split", TypeConverters.toInt)
    c = Param(Params._dummy(), "c", "inverse L2 strength", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability", maxDepth=NO_LIMIT, minRows=2, c=1.0):
        super().__init__()
        self._setDefault(maxDepth=NO_LIMIT, minRows=2, c=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "LogisticTreeModel":
        deepest, fewest, c = self.getOrDefault("maxDepth"), self.getOrDefault("minRows"), self.getOrDefault("c")
        rows = cut_lineage(dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y"),
            F.lit(1).cast("long").alias("node")))
        nodes, unconverged, depth = [], [], 0
        known = {1: (None, "1")}  # of the nodes of this level: parent and path
        following = 2
        while True:
            counts = {r["node"]: (r["n"], r["s"]) for r in
                      rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).collect()}
            if not counts:
                break
            mixed = {k: v for k, v in counts.items() if 0 < v[1] < v[0]}
            chosen = self._chosen_features(rows, mixed)
            fits, open_ = self._fit_nodes(rows, chosen, c)
            unconverged += open_
            sides = self._predicted_ones(rows, fits)
            splits, below = {}, {}
            for node, (n, s) in sorted(counts.items()):
                parent, path = known[node]
                if node not in fits:
                    nodes.append((node, parent, depth, "constant", None, None, None, s / n, n, path, None))
                    continue
                index, w, b = fits[node]
                splittable = (deepest == NO_LIMIT or depth < deepest) and n >= fewest and 0 < sides[node] < n
                left = following if splittable else None
                nodes.append((node, parent, depth, "partial" if splittable else "complete", index, w, b, None, n, path, left))
                if splittable:
                    splits[node] = (*fits[node], left)
                    below |= {left: (node, path + "0"), left + 1: (node, path + "1")}
                    following += 2
            if not splits:
                break
            rows = cut_lineage(self._with_fit(rows, splits).select(
                "x", "y", (F.col("left") + (F.col("z") > 0).cast("long")).alias("node")))
            known, depth = below, depth + 1
        model = LogisticTreeModel(sorted(nodes))
        model.unconverged = sorted(unconverged)
        return self._copyValues(model)

    @staticmethod
    def _with_fit(rows: DataFrame, fits: dict) -> DataFrame:
        """Rows of the given nodes with z = w * x[index] + b, and the first child's number where there is one."""
        spark = rows.sparkSession
        table = spark.createDataFrame([(k, *f, *[None] * (4 - len(f))) for k, f in fits.items()],
                                      "node long, _i int, _w double, _b double, left long")
        joined = rows.join(F.broadcast(table), "node")  # one row per node of the level
        value = F.get("x", F.col("_i"))
        return joined.select("x", "y", "node", value.alias("v"), (F.col("_w") * value + F.col("_b")).alias("z"), "left")

    @staticmethod
    def _chosen_features(rows: DataFrame, mixed: dict) -> dict[int, int]:
        """Most correlated feature per node; none where every feature is constant."""
        if not mixed:
            return {}
        long = rows.select("node", F.col("y").cast("double").alias("y"), F.posexplode("x").alias("pos", "v"))
        r = F.abs(F.try_divide(F.covar_pop("v", "y"), F.stddev_pop("v") * F.stddev_pop("y")))
        strength = long.groupBy("node", "pos").agg(r.alias("r")).where(F.col("r").isNotNull())
        best = strength.groupBy("node").agg(F.max_by("pos", F.struct("r", "pos")).alias("pos")).collect()
        return {b["node"]: b["pos"] for b in best if b["node"] in mixed}

    def _fit_nodes(self, rows: DataFrame, chosen: dict[int, int], c: float, steps: int = 40) -> tuple[dict, list[int]]:
        """Newton's method for all nodes at once; the L2 term leaves the intercept free. Also the nodes still moving at the end."""
        ridge = 1.0 / c
        trial = {k: (i, 0.0, 0.0) for k, i in chosen.items()}
        best: dict = {}
        pending = dict(trial)
        # the steps need the chosen feature only: its values are written once a level
        narrow = cut_lineage(self._with_fit(rows, trial).select("node", "y", "v")) if trial else None
        for _ in range(steps):
            if not pending:
                break
            now = rows.sparkSession.createDataFrame([(k, w, b) for k, (_, w, b) in pending.items()], "node long, _w double, _b double")
            placed = narrow.join(F.broadcast(now), "node").withColumn("z", F.col("_w") * F.col("v") + F.col("_b"))  # one row per node of the level
            p = _probability(F.col("z"))
            curve = p * (1 - p)
            # log(1 + e^z) - y z without overflow
            loss = F.greatest(F.col("z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("y") * F.col("z")
            sums = placed.groupBy("node").agg(
                F.sum(loss).alias("loss"), F.sum((p - F.col("y")) * F.col("v")).alias("gw"), F.sum(p - F.col("y")).alias("gb"),
                F.sum(curve * F.col("v") * F.col("v")).alias("hww"), F.sum(curve * F.col("v")).alias("hwb"),
                F.sum(curve).alias("hbb")).collect()
            following = {}
            for r in sums:
                node = r["node"]
                index, w, b = pending[node]
                loss_here = r["loss"] + 0.5 * ridge * w * w
                if node in best and loss_here > best[node][3] + 1e-12 * abs(best[node][3]):
                    _, bw, bb, _ = best[node]  # went too far: try half the step
                    if abs(w - bw) + abs(b - bb) > 1e-10:
                        following[node] = (index, (w + bw) / 2, (b + bb) / 2)
                    continue
                best[node] = (index, w, b, loss_here)
                gw, gb = r["gw"] + ridge * w, r["gb"]
                hww, hwb, hbb = r["hww"] + ridge, r["hwb"], r["hbb"] + 1e-12
                det = hww * hbb - hwb * hwb
                if det <= 0 or math.hypot(gw, gb) < 1e-9:
                    continue
                following[node] = (index, w - (hbb * gw - hwb * gb) / det, b - (hww * gb - hwb * gw) / det)
            pending = following
        return {k: (i, w, b) for k, (i, w, b, _) in best.items()}, list(pending)

    @classmethod
    def _predicted_ones(cls, rows: DataFrame, fits: dict) -> dict[int, int]:
        if not fits:
            return {}
        ones = F.sum((F.col("z") > 0).cast("long")).alias("ones")
        return {r["node"]: r["ones"] for r in cls._with_fit(rows, fits).groupBy("node").agg(ones).collect()}


class LogisticTreeModel(Model, _Columns):
    """A fitted tree; `nodes` are the rows of its node table, `unconverged` the nodes whose fit met the step limit."""

    def __init__(self, nodes: list[tuple] | None = None):
        super().__init__()
        self.nodes = nodes or []
        self.unconverged: list[int] = []

    def node_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE_SCHEMA)

    def tree_lines(self, spark) -> DataFrame:
        """(path, line): the tree as text, parents before children."""
        table = self.node_table(spark)
        path = F.col("path")
        text = F.concat(
            F.lpad(F.lit(""), F.col("depth") * 2, " "), F.when(F.col("node_id") == 1, "root").otherwise(
                F.concat(F.lit("level"), F.right("path", F.lit(1)))), F.lit(" type="), F.col("type"),
            F.when(F.col("index").isNotNull(), F.concat(F.lit(" index="), F.col("index"))).otherwise(
                F.concat(F.lit(" value="), F.round("value", 6))))
        return table.select(path.alias("path"), text.alias("line")).orderBy("path")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark, names = dataset.sparkSession, dataset.columns
        table = self.node_table(spark)
        out = dataset.select("*", vector_to_array(self.getFeaturesCol()).alias("_x"), F.lit(1).cast("long").alias("_at"),
                             F.lit(None).cast("double").alias("_p1"))
        for depth in range(max(n[2] for n in self.nodes) + 1):
            if depth and depth % 16 == 0:
                out = cut_lineage(out)  # deep trees: keep plans short
            level = table.where(F.col("depth") == depth).select(
                F.col("node_id").alias("_at"), "type", "index", "coef", "intercept", "value", "left")
            out = out.join(F.broadcast(level), "_at", "left")  # one row per node of the level
            p = _probability(F.col("coef") * F.get("_x", F.col("index")) + F.col("intercept"))
            reached = F.when(F.col("type") == "constant", F.col("value")).when(F.col("type") == "complete", p)
            step = F.col("left") + (p > 0.5).cast("long")
            out = out.select(*names, "_x", F.coalesce("_p1", reached).alias("_p1"),
                             F.when(F.col("type") == "partial", step).otherwise(F.lit(0).cast("long")).alias("_at"))
        one = F.col("_p1")
        return out.select(
            *names, array_to_vector(F.array(1 - one, one)).alias(self.getProbabilityCol()),
            (one > 0.5).cast("double").alias(self.getPredictionCol()))
