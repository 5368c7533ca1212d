"""The app's "get recommendations" flow as one Spark plan.

audience rows -> label codes (saved encoders) -> min-max scaling (refitted on
the batch, as the app does, or the saved ranges) -> model score -> top-k per
customer -> purchase history -> report.  Rows never leave the cluster; the
caller persists the audience if it also needs its size (the app's emptiness
check) -- ``DataFrame.isEmpty()`` is cheaper than a count for that.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from menurec.operators.dlrm import DLRMConfig, dlrm_score
from menurec.operators.preprocess import (ENCODED_SUFFIX, PreprocessState,
                                          apply_label_encoders, apply_min_max, fit_min_max)
from menurec.operators.recommend import recommendations


def prepare_features(df: DataFrame, state: PreprocessState,
                     refit_scaler: bool = True) -> DataFrame:
    """Encode with the saved classes (``_encoded`` columns) and scale.

    ``refit_scaler=True`` refits min/max on ``df`` itself (the app's
    behaviour); ``False`` uses the ranges saved at training time.
    """
    encoded = apply_label_encoders(df, state.encoders, state.categorical, in_place=False)
    ranges = fit_min_max(encoded, state.numeric) if refit_scaler else state.ranges
    return apply_min_max(encoded, ranges)


def recommend_audience(audience: DataFrame, interactions: DataFrame,
                       state: PreprocessState, params: dict[str, np.ndarray],
                       cfg: DLRMConfig, k: int = 3, refit_scaler: bool = True,
                       null_codes: str = "error", partitions: int | None = None) -> DataFrame:
    """Top-``k`` items, city and purchase history for every audience customer."""
    ready = prepare_features(audience, state, refit_scaler)
    scored = dlrm_score(ready, params, cfg,
                        sparse=[c + ENCODED_SUFFIX for c in state.categorical],
                        dense=state.numeric, null_codes=null_codes, partitions=partitions)
    return recommendations(scored, interactions, k)


def evaluate_sample(test: DataFrame, state: PreprocessState, params: dict[str, np.ndarray],
                    cfg: DLRMConfig, n: int | None = None,
                    keys: tuple[str, ...] = ("customer_id", "menu_item_name"),
                    threshold: float = 0.5, null_codes: str = "error",
                    label: str = "purchased") -> dict[str, float]:
    """The notebook's evaluation: all test rows, or with ``n`` an exact ``n``-row
    sample of them (smallest key hashes), transformed with the saved state, scored, and
    summarised as AUC, precision, recall and F1 (scalars, ready for
    :func:`menurec.sinks.log_metrics`)."""
    from menurec.operators.evaluate import binary_metrics, roc_auc
    from menurec.operators.split import sample_n
    sample = test if n is None else sample_n(test, list(keys), n)
    ready = state.transform(sample, in_place=False)
    scored = dlrm_score(ready, params, cfg,
                        sparse=[c + ENCODED_SUFFIX for c in state.categorical],
                        dense=state.numeric, null_codes=null_codes)
    scored = scored.select(label, "prediction").checkpoint(eager=True)
    m = binary_metrics(scored, label, "prediction", threshold).first()
    auc = roc_auc(scored, label, "prediction").first()["auc"]
    return {"AUC": auc, "Precision": m["precision"], "Recall": m["recall"], "F1_Score": m["f1"]}
