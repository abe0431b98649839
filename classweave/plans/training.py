"""From a raw labelled table to one saved model that scores raw rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classweave.functions.quantiles import quantiles
from classweave.operators import categories, clean, features, sampling
from classweave.operators.models import logistic_regression
from classweave.spec import FeatureSpec

DECILES = tuple(i / 10 for i in range(1, 10))
SKETCHED = tuple(sorted({0.25, 0.5, 0.75, *DECILES}))
SMALL_TASK_ROWS = 100_000
LARGE_TASK_ROWS = 2_000_000


@dataclass(frozen=True)
class Prep:
    """Fitted preparation: raw row in, ``selectedFeatures`` out."""

    spec: FeatureSpec
    fences: clean.Fences
    fills: clean.Fills
    learned: features.Learned = field(repr=False)
    slots: tuple[str, ...]
    selected: tuple[int, ...]
    stages: tuple[Transformer, ...] = field(repr=False)

    @property
    def selected_slots(self) -> list[str]:
        return [self.slots[i] for i in self.selected]

    def transform(self, df: DataFrame) -> DataFrame:
        return PipelineModel(list(self.stages)).transform(df)

    def with_model(self, model: Model) -> PipelineModel:
        return PipelineModel([*self.stages, model])


def fit_prep(train: DataFrame, spec: FeatureSpec, *,
             relative_error: float = 0.01, skip_flat: bool = False,
             unseen: str = "keep", top: int = features.TOP_SLOTS,
             max_categories: int = features.MAX_CATEGORIES,
             binned: bool = True) -> Prep:
    """Learn fences, fills, encoders, scaler and slots from training rows.

    Two narrow scans. The first sketches quartiles, medians and deciles of the
    raw columns. The second groups the rows inside the fences by bin or
    category; its counts give category order, value ranges, class totals and
    the chi-square tests, so no stage is fitted on the rows again.

    A column with more than ``max_categories`` categories is not listed in any
    stage: its categories are a written table (``learned.table``) and only the
    selected ones reach the model. ``slots`` then names the best of them.

    ``binned=False`` tests the scaled values themselves, each value a category
    of its own, as a third scan that only a small table can take.
    """
    rows = spec.with_label(train).select(*spec.inputs, "label")
    found = quantiles(rows, spec.numeric, SKETCHED, relative_error)
    at = {p: i for i, p in enumerate(SKETCHED)}
    fences = clean.fences_from(
        found, spec.numeric, skip_flat, low=at[0.25], high=at[0.75])
    fills = clean.fills_from({
        c: found[c][at[0.5]] if found[c] else None for c in spec.numeric})
    cuts = {
        c: sorted({found[c][at[p]] for p in DECILES}) if found[c] else []
        for c in spec.numeric
    }
    first = features.clean_stage(fills, fences)
    inside = (
        first.transform(rows)
        .filter(~F.col("is_outlier") & F.col("label").isNotNull())
    )
    learned = features.learn(
        inside, cuts, spec.categorical, "label", max_categories, top)
    if learned.best and (unseen == "error" or not binned):
        raise ValueError(
            f"{sorted(learned.best)} have more than {max_categories} categories: "
            "their values are neither checked nor tested one by one")
    fitted = features.feature_stages(inside, learned, unseen)
    layout = features.slot_layout(learned, fitted.slots, spec.categorical)
    if binned:
        selected = features.select_slots(learned, layout, top)
    else:
        selected = features.select_slots_by_value(
            fitted.transform(inside), top=top)
    chosen = features.selection_stages(learned, fitted.slots, layout, selected)
    return Prep(spec, fences, fills, learned, tuple(layout), tuple(selected),
                (first, *fitted.stages, *chosen))


def all_features(df: DataFrame, prep: Prep, extra: Sequence[str] = ()) -> DataFrame:
    """``extra`` and ``features`` with a slot for every category, as sparse vectors.

    For columns with more categories than the model's stages list: numbers
    scaled as in training, then the categories of every column in the order of
    the category table, which is joined. The result is written.
    """
    table, categorical = prep.learned.table, prep.spec.categorical
    if table is None:
        return prep.transform(df).select(*extra, "features")
    ranges = {features.numeric_name(c): r for c, r in prep.learned.ranges.items()}
    typed = prep.stages[0].transform(df)
    scaled = features.min_max_columns(typed, list(ranges), ranges)
    slots = categories.sparse_slots(list(scaled.values()), table, categorical)
    indexed = categories.with_indices(typed, table, categorical)
    return categories.as_vectors(
        indexed.select(*extra, slots.alias("features")), "features")


def prepare(df: DataFrame, prep: Prep, drop_outliers: bool = True,
            extra: Sequence[str] = ()) -> DataFrame:
    """Key, label and both vectors, ready to fit or evaluate."""
    labelled = prep.spec.with_label(df)
    if drop_outliers:
        labelled = prep.fences.filter(labelled)
    return prep.transform(labelled.filter(F.col("label").isNotNull())).select(
        *prep.spec.key, *extra, "features", "selectedFeatures", "label")


@dataclass(frozen=True)
class TrainingSet:
    """Balanced training rows, and all labelled test rows, both prepared."""

    prep: Prep
    train: DataFrame
    test: DataFrame
    balance: sampling.Balance
    source: DataFrame = field(repr=False)

    def release(self) -> None:
        for held in (self.train, self.source):
            held.unpersist()


def spread_small(df: DataFrame) -> DataFrame:
    """Deal out and hold an input that has fewer splits than there are cores.

    Such an input is small, at most one split per core, and would otherwise
    be read by a few tasks in every pass. A larger one is returned untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)


def partitions_for(rows: int, cores: int) -> int:
    """Enough tasks to use the cores, none of them tiny or huge.

    Iterative training starts a task per partition in every step, so a small
    set gets few; a large one gets partitions that fit in memory.
    """
    most = -(-rows // SMALL_TASK_ROWS)
    least = -(-rows // LARGE_TASK_ROWS)
    return max(1, min(most, max(cores, least)))


def build_training_set(df: DataFrame, spec: FeatureSpec, *,
                       folds: int | None = None, **options) -> TrainingSet:
    """Split first, learn preparation on the training part, balance only it.

    ``df`` should come from storage, so that counting its splits runs nothing.

    Iterative training reads its rows many times, so they are persisted: a
    ten-slot vector and a label each. They are a pure function of the input,
    and a lost block is computed again the same. Balancing leaves partitions
    uneven, so these narrow rows are dealt out once before the many passes.
    The test rows are read once, when the models are compared.
    """
    source = spread_small(df.select(*spec.columns))
    raw_train, raw_test = sampling.split(source, spec.key)
    prep = fit_prep(raw_train, spec, **options)
    balance = sampling.balance_of({
        0.0: prep.learned.class_counts[0], 1.0: prep.learned.class_counts[1]})
    # chosen before they are prepared: Spark moves no filter below the vector stages
    chosen = sampling.balance_classes(
        spec.with_label(raw_train), spec.key, balance=balance)
    train = prepare(chosen, prep)
    if folds:
        train = sampling.with_fold(train, spec.key, folds)
    kept = ["selectedFeatures", "label", *(["fold"] if folds else [])]
    train = train.select(*kept)
    # outliers and filled rows are judged too: every labelled test row stays
    test = prepare(raw_test, prep, drop_outliers=False).select(
        "selectedFeatures", "label")
    cores = df.sparkSession.sparkContext.defaultParallelism
    made = TrainingSet(prep, train, test, balance, source)
    train = train.repartition(partitions_of(made, cores)).persist(
        StorageLevel.MEMORY_AND_DISK)
    return replace(made, train=train)


def partitions_of(data: TrainingSet, cores: int) -> int:
    return partitions_for(2 * data.balance.minority_count, cores)


def train_model(df: DataFrame, spec: FeatureSpec,
                estimator: Estimator | None = None,
                **options) -> PipelineModel:
    """A model that takes raw rows, ready to save."""
    data = build_training_set(df, spec, **options)
    try:
        model = (estimator or logistic_regression()).fit(data.train)
        return data.prep.with_model(model)
    finally:
        data.release()


def final_stages(model: PipelineModel) -> tuple[VectorSlicer, Model]:
    return model.stages[-2], model.stages[-1]
