"""Training of the models a dataset is served with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from flowlens.operators import cleaning, labeling, models, splits
from flowlens.operators.scoring import BINARY, MULTI
from flowlens.schemas import CLASS_NAMES, UNSW_FEATURES
from flowlens.sources.flows import write_metadata
from flowlens.sources.models import save_classes, save_model


@dataclass(frozen=True)
class Fit:
    """One model of a suite; ``name`` is what a served detector looks for. ``classes`` names
    the label space of a multiclass model."""

    name: str
    kind: str
    preset: str
    label: str
    weight: str
    prefix: str
    classes: str | None = None

    @property
    def binary(self) -> bool:
        return self.prefix == BINARY


SUITES = {
    "cic": [
        Fit("rf_binary", "rf", "rf_binary_cic", "binary_label", "sample_weight", BINARY),
        Fit("gbt_binary", "gbt", "gbt_binary_cic", "binary_label", "sample_weight", BINARY),
        Fit("rf_multiclass", "rf", "rf_multiclass_cic", "unified_label", "multiclass_weight", MULTI,
            "cic_unified"),
        Fit("rf_multiclass_improved", "rf", "rf_multiclass_cic_improved", "unified_label", "improved_weight", MULTI,
            "cic_unified"),
    ],
    "unsw": [
        Fit("unsw_rf_binary", "rf", "rf_binary_unsw", "binary_label", "binary_weight", BINARY),
        Fit("unsw_gbt_binary", "gbt", "gbt_binary_unsw", "binary_label", "binary_weight", BINARY),
        Fit("unsw_multiclass", "rf", "rf_multiclass_unsw_fixed", "multiclass_label", "multiclass_weight", MULTI, "unsw"),
    ],
}


def with_weights(train: DataFrame, label: str, scheme: str, output: str) -> DataFrame:
    return labeling.attach_weights(train, labeling.class_weights(train, label, scheme), label, output)


def cic_training_rows(harmonized: DataFrame, key: list[str], train_percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Split of the harmonised table; the training side also gets the smoothed class weights."""
    train, test = splits.hash_split(harmonized, key, train_percent)
    return with_weights(train, "unified_label", "sqrt", "improved_weight"), test


def unsw_training_rows(train: DataFrame, test: DataFrame, key: list[str], rebalance: bool = True,
                       features: list[str] = UNSW_FEATURES) -> tuple[DataFrame, DataFrame]:
    """Labels, zero-filled features and smoothed weights for given train and test sets.

    With ``rebalance``, half of the test rows of classes that train lacks move to train.
    """
    train, test = labeling.normalize_attack_cat(train), labeling.normalize_attack_cat(test)
    if rebalance:
        train, test = splits.rebalance_missing(train, test, key, "attack_cat")
    train, test = (cleaning.mask_numeric(labeling.prepare_unsw_labels(f), [c for c in features if c in f.columns])
                   for f in (train, test))
    train = with_weights(train, "binary_label", "sqrt2", "binary_weight")
    return with_weights(train, "multiclass_label", "sqrt", "multiclass_weight"), test


def train_suite(train: DataFrame, test: DataFrame, features, suite: str, folder: str | None = None,
                overrides: dict[str, dict] | None = None) -> DataFrame:
    """Fit and evaluate every model of a suite; with ``folder``, save the models, the class
    names of the multiclass ones and the metrics.

    Returns the metrics in long form. ``overrides`` holds parameters by model name. Both
    sides are kept, with the columns the models need, while the models read them.
    """
    vector = [features] if isinstance(features, str) else list(features)
    fits = SUITES[suite]
    labels = {f.label for f in fits}
    spark = train.sparkSession
    kept = train.select(*sorted({*vector, *labels, *(f.weight for f in fits)})).persist()
    held_out = test.select(*sorted({*vector, *labels})).persist()
    try:
        sizes, results = (kept.count(), held_out.count()), {}
        for fit in fits:
            params = (overrides or {}).get(fit.name, {})
            model = models.train(kept, fit.kind, features, fit.label, fit.weight, fit.prefix, fit.preset, **params)
            if folder is not None:
                save_model(model, folder, fit.name)
                if fit.classes is not None:
                    save_classes(spark, folder, fit.name, CLASS_NAMES[fit.classes])
            results[fit.name] = models.evaluate(model, held_out, fit.label, fit.prefix, fit.binary)
        table = models.results_table(spark, results, *sizes)
        if folder is not None:
            write_metadata(table, f"{folder.rstrip('/')}/{suite}_training_results")
        return table
    finally:
        kept.unpersist()
        held_out.unpersist()
