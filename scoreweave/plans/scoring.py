"""One scoring interface over both model kinds, used by monitoring and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ID
from ..functions.rules import business_features
from ..models.logistic import LogisticModel, score_features
from ..models.trees import TreeModel, score_tree_features, tree_contributions
from ..operators import explain

Model = LogisticModel | TreeModel


def probability(features: DataFrame, model: Model, keep=(ID,), name: str = "p") -> DataFrame:
    """``keep`` columns plus the model probability."""
    score = score_features if isinstance(model, LogisticModel) else score_tree_features
    return score(features, model, keep).select(*keep, F.col("predicted_bad_probability").alias(name))


def raw_probability(raw: DataFrame, model: Model, keep=(ID,), name: str = "p") -> DataFrame:
    return probability(business_features(raw, tuple(keep)), model, keep, name)


def contributions(features: DataFrame, model: Model, keep=(ID,)) -> DataFrame:
    """Additive log-odds terms; the two kinds have different reference points."""
    if isinstance(model, LogisticModel):
        return explain.linear_contributions(features, model, keep)
    return tree_contributions(features, model, keep)


def unknown_selected(model: Model):
    """Unknown-bin count per row; trees use no bins, so it does not apply."""
    return model.unknown_selected() if isinstance(model, LogisticModel) else None
