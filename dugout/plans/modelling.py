"""Fitting, tuning, applying and storing the tree models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from dugout.operators.joins import left_join
from dugout.params import CELL, FOLDS, REPEATS, SEED
from dugout.plans import boosting
from dugout.plans.evaluation import show_best
from dugout.plans.features import OUTCOME, Recipe, fit_recipe, resample_moments
from dugout.plans.tuning import KEPT, ResultStore, Task
from dugout.sources.scratch import FOLDED_FILE_ROWS, materialize, scratch_dir

#: Depth and learning rate the boosting library uses unless told otherwise.
BOOST_DEPTH = 6
BOOST_RATE = 0.3

#: Rows that fits running side by side hold in memory, all together.
ROWS_AT_ONCE = 10_000_000
#: Training rows up to which tuning grows a fit within one task, which holds some 350 bytes of each; fits on more are spread over
#: the executors.
TASK_ROWS = 2_000_000
#: Resamples whose fits are under way at once where a fit is a task: while one's last fits run, the next is prepared.
RESAMPLES_AT_ONCE = 2


@dataclass(frozen=True)
class Point:
    """One setting of the tuned parameters; ``trees`` may list several lengths of one fit."""

    min_n: int = 1
    mtry: int = 50
    trees: tuple[int, ...] = (20,)


def boosted_trees(point: Point) -> GBTRegressor:
    return GBTRegressor(
        labelCol=OUTCOME,
        featuresCol="features",
        maxIter=max(point.trees),
        maxDepth=BOOST_DEPTH,
        stepSize=BOOST_RATE,
        minInstancesPerNode=point.min_n,
        featureSubsetStrategy=str(point.mtry),
        maxMemoryInMB=512,
        seed=SEED,
    )


def screening_forest(trees: int = 500, depth: int = 12) -> RandomForestRegressor:
    return RandomForestRegressor(
        labelCol=OUTCOME,
        featuresCol="features",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=5,
        featureSubsetStrategy="sqrt",
        maxMemoryInMB=512,
        seed=SEED,
    )


def prepared(df: DataFrame, recipe: Recipe) -> DataFrame:
    return recipe.assembled(df)


def fit(train: DataFrame, estimator: Estimator, recipe: Recipe | None = None) -> PipelineModel:
    """Learn recipe and model on stored training rows; the result carries both."""
    recipe = recipe or fit_recipe(train)
    model = estimator.fit(prepared(train, recipe).select("features", OUTCOME))
    return PipelineModel(stages=[*recipe.stages(), model])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """All input columns plus ``prediction``; nothing is matched by position."""
    return model.transform(df).select(*df.columns, "prediction")


def variable_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Importances on a scale with the largest at 100; one row per model input."""
    names = model.stages[-2].getInputCols()
    scores = model.stages[-1].featureImportances.toArray()
    top = max(scores.max(), 1e-300)
    rows = [(name.removeprefix("z_"), float(100 * score / top)) for name, score in zip(names, scores)]
    return spark.createDataFrame(rows, "variable string, importance double").orderBy(F.col("importance").desc())


def regular_grid(levels: int = 10, min_n=(1, 100), mtry=(1, 50), trees=(1, 100)) -> list[Point]:
    """Every combination of evenly spaced whole values, lengths of one fit kept together."""
    lengths = tuple(_spaced(*trees, levels))
    return [Point(n, m, lengths) for n, m in product(_spaced(*min_n, levels), _spaced(*mtry, levels))]


def _spaced(low: int, high: int, levels: int) -> list[int]:
    if levels == 1:
        return [low]
    return sorted({low + (high - low) * i // (levels - 1) for i in range(levels)})


def prefix_predictions(model: GBTRegressionModel, rows: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Each row once per length n, with the prediction of the first n trees (columns trees and prediction).

    Boosting adds trees one by one, so the first n of a long fit are the fit of length n.
    """
    scored, weights = rows, model.treeWeights
    for t, tree in enumerate(model.trees):
        scored = tree.setFeaturesCol("features").setPredictionCol(f"tree_{t}").transform(scored)
    total, found = F.lit(0.0), {0: F.lit(0.0)}
    for t, weight in enumerate(weights):
        total = total + F.col(f"tree_{t}") * float(weight)
        found[t + 1] = total
    each = [F.struct(F.lit(n).alias("trees"), found[min(n, len(weights))].alias("prediction")) for n in lengths]
    return scored.select(*rows.columns, F.explode(F.array(*each)).alias("of")).select(*rows.columns, "of.*")


def tasks_of(grid: Sequence[Point], resamples: Sequence[tuple[int, int]] | None = None) -> list[Task]:
    """The fits of a grid, on all resamples of the usual folds unless others are named."""
    usual = [(repeat, fold) for repeat in range(1, REPEATS + 1) for fold in range(FOLDS)]
    return [Task(repeat, fold, p.min_n, p.mtry) for repeat, fold in resamples or usual for p in grid]


def tune_grid(
    train: DataFrame,
    folds: DataFrame,
    grid: Sequence[Point],
    parallelism: int = 8,
    store: ResultStore | None = None,
) -> DataFrame:
    """Metrics of every grid point on every resample: (min_n, mtry, trees, repeat, fold, metric, estimate).

    ``folds`` says which fold a row is held out in, per repeat; the rows are stored once with all their folds. The
    recipe is learned anew on each resample's own analysis rows, so nothing leaks from the rows it is judged on; the
    moments it takes come from one pass for all resamples. A resample's prepared rows are held in memory while its points
    are fitted, and read again where there is no room. Up to ``TASK_ROWS`` they are held as bins, and each
    fit is one task that grows the library's trees; the tasks of all points run side by side. Fits on more rows are
    the library's own jobs, resamples side by side, fewer the more rows there are. Each fit writes its predictions to
    the store; fits that are there are not run again. The metrics come from the stored predictions. The driver
    holds the list of fits and cut points only.
    """
    spark = train.sparkSession
    store = store or ResultStore(spark, scratch_dir(spark, "tuning"))
    resamples = [tuple(r) for r in folds.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()]
    points = {(p.min_n, p.mtry): p for p in grid}
    tasks = tasks_of(grid, resamples)
    todo = store.missing(tasks)
    wanted = sorted({(t.repeat, t.fold) for t in todo})
    fold_of = {repeat: f"fold_{repeat}" for repeat in sorted({r for r, _ in wanted})}

    def run(resample: tuple[int, int]) -> None:
        repeat, fold = resample
        mine = moments.where((F.col("repeat") == repeat) & (F.col("fold") == fold))
        recipe = fit_recipe(marked, moments=mine)
        held_out = F.col(fold_of[repeat]) == fold
        # Rows are chosen before they are prepared, since a filter need not pass below the assembling.
        judged = prepared(marked.where(held_out), recipe).select(*KEPT, "features")
        analysis = prepared(marked.where(~held_out), recipe).select(*KEPT, "features")
        fits = [(t, points[t.min_n, t.mtry]) for t in todo if (t.repeat, t.fold) == resample]
        (_fit_in_tasks if in_tasks else _fit_by_library)(analysis, judged, fits, store, parallelism)

    if wanted:
        marked = with_folds(train, folds, fold_of)
        moments = resample_moments(marked, fold_of)
        n = marked.count()
        in_tasks = n <= TASK_ROWS
        at_once = RESAMPLES_AT_ONCE if in_tasks else parallelism
        _side_by_side(spark, run, wanted, min(at_once, ROWS_AT_ONCE // max(1, n)))
    return store.metrics(tasks).select("min_n", "mtry", "trees", "repeat", "fold", "metric", "estimate")


def _side_by_side(spark: SparkSession, run, items: Sequence, at_once: int) -> None:
    pool = ThreadPool(max(1, at_once))
    try:
        pool.map(inheritable_thread_target(spark)(run), items, chunksize=1)
    finally:
        pool.close()


def _fit_by_library(analysis: DataFrame, judged: DataFrame, fits: Sequence[tuple[Task, Point]], store: ResultStore, parallelism: int) -> None:
    """The fits of a resample, one after the other, each spread over the executors."""
    judged = judged.persist(StorageLevel.MEMORY_ONLY)
    analysis = analysis.select("features", OUTCOME).persist(StorageLevel.MEMORY_ONLY)
    try:
        for task, point in fits:
            model = boosted_trees(point).fit(analysis)
            scored = prefix_predictions(model, judged, point.trees)
            store.add(task, scored.select(*KEPT, "trees", "prediction"))
    finally:
        analysis.unpersist()
        judged.unpersist()


def _fit_in_tasks(analysis: DataFrame, judged: DataFrame, fits: Sequence[tuple[Task, Point]], store: ResultStore, parallelism: int) -> None:
    """The fits of a resample side by side, each in one task."""
    spark = analysis.sparkSession
    cuts = boosting.learn_cuts(analysis, analysis.count(), SEED)
    both = analysis.withColumn("held_out", F.lit(False)).unionAll(judged.withColumn("held_out", F.lit(True)))
    rows = boosting.binned(both, cuts).persist(StorageLevel.MEMORY_ONLY)

    def run(fit: tuple[Task, Point]) -> None:
        task, point = fit
        setting = {"min_n": point.min_n, "mtry": point.mtry, "depth": BOOST_DEPTH, "rate": BOOST_RATE, "seed": SEED}
        store.add(task, boosting.predictions(rows, OUTCOME, KEPT, point.trees, **setting))

    try:
        rows.count()
        _side_by_side(spark, run, fits, min(len(fits), max(parallelism, spark.sparkContext.defaultParallelism)))
    finally:
        rows.unpersist()


def with_folds(train: DataFrame, folds: DataFrame, fold_of: dict[int, str]) -> DataFrame:
    """The training rows, stored once with one column per repeat that says in which fold a row is held out."""
    mine = {name: F.max(F.when(F.col("repeat") == repeat, F.col("fold"))).alias(name) for repeat, name in fold_of.items()}
    wide = folds.groupBy(*CELL).agg(*mine.values())
    return materialize(left_join(train, wide, CELL), "folded", FOLDED_FILE_ROWS)


def best_point(summary: DataFrame) -> Point:
    """Setting with the highest mean rsq."""
    best = show_best(summary, "rsq", ["min_n", "mtry", "trees"], 1).first()
    return Point(best.min_n, best.mtry, (best.trees,))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
