"""Classifiers of variants on feature rows: gradient boosting and AdaBoost, their importances, and repeated hold-outs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.expressions import SUBSTITUTIONS
from callweave.operators.trees import Ensemble, doubles, grow

LABEL = "TrueVariant_or_False"
#: Columns that no model is trained on.
NON_FEATURES = ("CHROM", "POS", "ID", "REF", "ALT", "Strelka_QSS", "Strelka_TQSS", "if_COSMIC", "COSMIC_CNT", LABEL)
#: Trees trained, trees that score, and levels of a tree, by loss.
TRAINED_TREES, SCORING_TREES, DEPTHS = 500, {"logistic": 100, "exponential": 300}, {"logistic": 8, "exponential": 16}


def feature_columns(features: DataFrame, excluded: tuple[str, ...] = ()) -> list[str]:
    """The numeric columns that a model is trained on, without the fixed and the user's exclusions."""
    gone = {*NON_FEATURES, "SCORE", *excluded}
    return [f.name for f in features.schema.fields if f.name not in gone and f.dataType.simpleString() in ("int", "bigint", "double", "float")]


def _prepared(features: DataFrame) -> DataFrame:
    """``features`` with the six kinds of base changes, as a model sees them."""
    change = F.upper(F.concat("REF", "ALT"))
    return features.withColumns({k: F.coalesce(change.isin(*v), F.lit(False)).cast("double") for k, v in SUBSTITUTIONS.items()})


@dataclass
class TreeClassifier:
    """Grown trees with the columns that they were trained on."""

    model: Ensemble

    @property
    def columns(self) -> list[str]:
        return [c for c in self.model.features if c not in SUBSTITUTIONS]

    def predict(self, features: DataFrame, iterations: int | None = None) -> DataFrame:
        """``features`` with SCORE, the probability of a true variant by the first ``iterations`` trees.

        Unless given, these are as many as the reference pipelines score with; a null or NaN goes the way that training found better.
        """
        model, first = self.model, SCORING_TREES[self.model.loss] if iterations is None else iterations
        names = model.features
        rows = _prepared(features.withColumn("__row", F.struct("*"))).select("__row", *[F.col(f"`{n}`").cast("double").alias(f"f{i}") for i, n in enumerate(names)])

        def score(batches: Iterable[pa.RecordBatch]):
            for batch in batches:
                given = model.probability(model.binned(doubles(batch, [f"f{i}" for i in range(len(names))])), first)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("__row")), pa.array(given)], ["__row", "SCORE"])

        scored = rows.mapInArrow(score, f"__row {rows.schema['__row'].dataType.simpleString()}, SCORE double")
        return scored.select("__row.*", "SCORE")

    def importance(self) -> DataFrame:
        """Each used feature's mean gain, number of splits (WEIGHT), mean cover, total gain and total cover."""
        return SparkSession.active().createDataFrame(self.model.importance(), "FEATURE string, GAIN double, WEIGHT long, COVER double, TOTAL_GAIN double, TOTAL_COVER double")

    def save(self, path: str) -> None:
        SparkSession.active().createDataFrame([(self.model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> TreeClassifier:
        return cls(Ensemble.from_json(SparkSession.active().read.text(path, wholetext=True).first()[0]))


def train_classifier(tables: list[DataFrame], rounds: int = TRAINED_TREES, depth: int | None = None, excluded: tuple[str, ...] = (), loss: str = "logistic", **options: float) -> TreeClassifier:
    """Boosted trees on labelled feature tables; rows without a label are left out.

    ``loss``: ``logistic`` for gradient boosting (8 levels), ``exponential`` for AdaBoost (16).  Both classes must be there.  Columns that only some
    tables have are null in the others; nulls and NaN are missing values, for which every split learns a side.
    """
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).where(F.col(LABEL).isin(0, 1))
    seen = {r[0] for r in every.select(F.col(LABEL).cast("int")).distinct().collect()}
    if seen != {0, 1}:
        raise ValueError("training needs both true and false variants")
    columns = feature_columns(every, excluded)
    return TreeClassifier(grow(_prepared(every), [*columns, *SUBSTITUTIONS], LABEL, loss, rounds, DEPTHS[loss] if depth is None else depth, **options))


def score_metrics(scored: DataFrame, passes: float = 0.5, rejects: float = 0.1) -> DataFrame:
    """Precision, sensitivity and F1 of calls with a SCORE above ``passes``, and how many true and false variants lie below ``rejects``."""
    true, positive = F.col(LABEL) == 1, F.col("SCORE") > passes
    got = scored.agg(
        F.count_if(positive & true).alias("tp"), F.count_if(positive & ~true).alias("fp"), F.count_if(~positive & true).alias("fn"),
        F.count_if((F.col("SCORE") < rejects) & true).alias("rejected_true"), F.count_if((F.col("SCORE") < rejects) & ~true).alias("rejected_false"),
    )
    got = got.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "sensitivity": F.try_divide("tp", F.col("tp") + F.col("fn"))})
    return got.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def repeated_holdout(features: DataFrame, times: int = 10, seed: int = 0, **options: float) -> DataFrame:
    """``score_metrics`` of halves that a model fitted on the other half scores, one row for each time."""
    rows = []
    for k in range(times):
        half = F.pmod(F.xxhash64(F.lit(seed + k), "CHROM", "POS", "REF", "ALT"), F.lit(2)) == 0
        model = train_classifier([features.where(half)], **options)
        rows.append(score_metrics(model.predict(features.where(~half))).withColumn("round", F.lit(k)))
    return reduce(lambda a, b: a.unionByName(b), rows)
