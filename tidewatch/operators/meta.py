"""Learned fusion: which entities look like the known ones, by models' scores.

Two learners, a forest and boosted trees, are compared by average precision over
out-of-fold probabilities. What is returned for the entities at hand are those
probabilities too, so that none is scored by a model that saw its label. The
better learner fitted to all of them can be saved, loaded and put to other data.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.lineage import cut
from tidewatch.operators.features import LOGGED
from tidewatch.operators.fusion import borda

#: Hash cells in which entities of a class are numbered side by side.
CELLS = 4096
#: Cells of probability that average precision is taken over.
STEPS = 10_000
#: Entities a task of a fit. A learner starts some hundred jobs, one for each level
#: of its trees, so that tasks of few entities are mostly starts of tasks.
SHARE = 65_536


@dataclass(frozen=True)
class Learners:
    """Sizes of both learners. Boosting makes its trees one after the other."""

    trees: int = 100
    forest_depth: int = 6
    rounds: int = 20
    boost_depth: int = 4
    rate: float = 0.1
    seed: int = 42

    def all(self) -> dict:
        names = {"labelCol": "label", "featuresCol": "vector", "weightCol": "weight", "seed": self.seed}
        forest = RandomForestClassifier(numTrees=self.trees, maxDepth=self.forest_depth, **names)
        boosted = GBTClassifier(maxIter=self.rounds, maxDepth=self.boost_depth, stepSize=self.rate, subsamplingRate=0.9, **names)
        return {"forest": forest, "boosted": boosted}


def inputs(scores: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """(entity_id, a column for each of the models ``names``, features): a model
    that did not score an entity gives 0, amounts and gaps enter by their log."""
    wide = scores.groupBy("entity_id").pivot("model", names).agg(F.max("score")).na.fill(0.0, names)
    plain = [F.coalesce(F.log1p(F.greatest(F.col(c), F.lit(0.0))) if c in LOGGED else F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features.columns if c != "entity_id"]
    return wide.join(features.select("entity_id", *plain), "entity_id", "left").na.fill(0.0)


def dealt(rows: DataFrame, folds: int, seed: int = 0) -> DataFrame:
    """``rows`` with ``fold``: each class's entities in hash order, in turn. Numbers
    run within cells of hashes, so that no task orders a whole class."""
    place = F.xxhash64("entity_id", F.lit(seed))
    celled = rows.withColumn("place", place).withColumn("cell", F.pmod(F.col("place"), F.lit(CELLS)))
    counts = celled.groupBy("label", "cell").agg(F.count("*").alias("k"))  # at most 2 * CELLS rows
    before = Window.partitionBy("label").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("label", "cell", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("label", "cell").orderBy("place", "entity_id")) - 1
    met = celled.withColumn("nth", nth).join(F.broadcast(starts), ["label", "cell"])
    return met.withColumn("fold", F.pmod(F.col("start") + F.col("nth"), F.lit(folds)).cast("int")).drop("place", "cell", "start", "nth")


def average_precision(rows: DataFrame) -> float:
    """Mean precision at the recall steps of (p, label); equal probabilities, to
    one in ``STEPS``, are one step, so that at most ``STEPS + 1`` counts are read."""
    counted = rows.groupBy(F.round(F.col("p") * STEPS).alias("step")).agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
    seen, hits, total = 0, 0.0, 0.0
    for row in sorted(counted.collect(), key=lambda r: -r["step"]):
        seen, hits = seen + row["n"], hits + row["hits"]
        total += row["hits"] * hits / seen
    return total / hits if hits else 0.0


@dataclass
class Fitted:
    """``held`` is (entity_id, score) out of fold; ``model`` saw all entities."""

    model: PipelineModel
    names: list[str]
    precision: dict[str, float]
    held: DataFrame


def _probability(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("entity_id", "label", vector_to_array("probability")[1].alias("p"))


def _partitions(n: int) -> int:
    return max(1, -(-n // SHARE))


@dataclass
class Crossed:
    """Both learners out of fold: what ``fit`` and ``learned`` go on from. ``ready``
    is kept by the executors until ``release``."""

    ready: DataFrame
    assembler: VectorAssembler
    names: list[str]
    precision: dict[str, float]
    held: DataFrame
    best: str

    def release(self) -> None:
        self.ready.unpersist()


def cross(scores: DataFrame, features: DataFrame, truth: DataFrame, learners: Learners = Learners(), folds: int = 5) -> Crossed | None:
    """Both learners over stratified folds, classes weighed alike; None with fewer
    than twelve entities or two of a class.

    Entities are dealt to tasks by their number alone and ordered there. Learners
    draw by task and place, so that the cluster's settings don't change the draws."""
    names = [r["model"] for r in scores.select("model").distinct().orderBy("model").collect()]
    known = truth.select("entity_id").distinct().withColumn("label", F.lit(1.0))
    rows = cut(inputs(scores, features, names).join(known, "entity_id", "left").na.fill(0.0, ["label"]))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    least, n = min(counts.get(0.0, 0), counts.get(1.0, 0)), sum(counts.values())
    if least < 2 or n < 12:
        return None
    folds = min(folds, least)
    weight = F.when(F.col("label") == 1, n / (2 * counts[1.0])).otherwise(n / (2 * counts[0.0]))
    assembler = VectorAssembler(inputCols=[c for c in rows.columns if c not in ("entity_id", "label")], outputCol="vector")
    ready = assembler.transform(dealt(rows, folds, learners.seed).withColumn("weight", weight)).select("entity_id", "label", "weight", "fold", "vector")
    tasks = _partitions(n)
    # The second count holds where a session deals keys to more tasks than asked.
    ready = ready.repartition(tasks, "entity_id").coalesce(tasks).sortWithinPartitions("entity_id").persist()

    def one(task: tuple[str, int]) -> DataFrame:
        name, fold = task
        model = learners.all()[name].fit(ready.where(F.col("fold") != fold))
        return cut(_probability(model, ready.where(F.col("fold") == fold)))

    # Boosting has the longest row of jobs and starts first; all fits run side by side.
    fits = [(name, fold) for name in reversed(learners.all()) for fold in range(folds)]
    try:
        ready.count()
        with ThreadPoolExecutor(len(fits)) as pool:
            parts = dict(zip(fits, pool.map(one, fits), strict=True))
        held = {name: reduce(DataFrame.union, [parts[name, f] for f in range(folds)]) for name in learners.all()}
        precision = {name: average_precision(rows) for name, rows in held.items()}
    except BaseException:
        ready.unpersist()
        raise
    best = max(precision, key=lambda name: (precision[name], name))
    return Crossed(ready, assembler, names, precision, held[best].select("entity_id", F.col("p").alias("score")), best)


def fit(scores: DataFrame, features: DataFrame, truth: DataFrame, learners: Learners = Learners(), folds: int = 5) -> Fitted | None:
    """``cross``, and the better learner fitted to all entities."""
    found = cross(scores, features, truth, learners, folds)
    if not found:
        return None
    try:
        model = PipelineModel([found.assembler, learners.all()[found.best].fit(found.ready)])
    finally:
        found.release()
    return Fitted(model, found.names, found.precision, found.held)


def learned(scores: DataFrame, features: DataFrame, truth: DataFrame, learners: Learners = Learners(), folds: int = 5) -> DataFrame:
    """(entity_id, score): out-of-fold probability of the better learner; Borda
    points where too little is known to learn from. No model of all is fitted."""
    found = cross(scores, features, truth, learners, folds)
    if not found:
        return borda(scores)
    found.release()
    return found.held


def apply(model: PipelineModel, scores: DataFrame, features: DataFrame) -> DataFrame:
    """(entity_id, score) of entities that the model has not seen. Models that it
    knows and that are missing here count as silent; others are ignored."""
    wanted = model.stages[0].getInputCols()
    names = [c for c in wanted if c not in features.columns]
    rows = inputs(scores, features, names).withColumn("label", F.lit(0.0))
    return _probability(model, rows).select("entity_id", F.col("p").alias("score"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> PipelineModel | None:
    """A saved model, or None where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return PipelineModel.load(path)


def apply_saved(scores: DataFrame, features: DataFrame, path: str) -> DataFrame:
    """The saved model's scores; Borda points where none is saved."""
    model = load(scores.sparkSession, path)
    return apply(model, scores, features) if model else borda(scores)
