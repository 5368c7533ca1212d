"""menurec: menu-item recommendation analytics as Spark DataFrame operators.

The most used entry points, re-exported::

    from menurec import (load_domain, orders_v, interactions, customer_features,
                         menu_features, purchase_averages, never_visited, audience,
                         filter_options, top_k, recommendations, roc_auc,
                         binary_metrics, Preprocessor, FeatureStore, Entity)
"""

__version__ = "0.1.0"

from menurec.operators.audience import audience, filter_options, never_visited  # noqa: E402
from menurec.operators.evaluate import binary_metrics, roc_auc  # noqa: E402
from menurec.operators.feature_store import Entity, FeatureStore, retrieve  # noqa: E402
from menurec.operators.features import (customer_features, menu_features,  # noqa: E402
                                        purchase_averages)
from menurec.operators.harmonize import orders_v  # noqa: E402
from menurec.operators.interactions import interactions  # noqa: E402
from menurec.operators.preprocess import Preprocessor  # noqa: E402
from menurec.operators.recommend import recommendations, top_k  # noqa: E402
from menurec.operators.split import hash_split, sample_n  # noqa: E402
from menurec.sources.load import load_domain  # noqa: E402

__all__ = [
    "Entity", "FeatureStore", "Preprocessor", "audience", "binary_metrics",
    "customer_features", "filter_options", "hash_split", "interactions", "load_domain",
    "menu_features", "never_visited", "orders_v", "purchase_averages", "recommendations",
    "retrieve", "roc_auc", "sample_n", "top_k",
]
