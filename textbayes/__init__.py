"""Interpretable text classification on Spark: cleaning, character n-grams, nested naive Bayes models, evaluation and evidence."""

from importlib import import_module

__version__ = "0.1.0"

#: Public names and where they are defined; they are imported when first used, so workers load no more than they need.
_PUBLIC = {
    "Config": "config", "load_config": "config", "normalize": "functions.text", "duplicate_key": "functions.text", "ngrams": "functions.text",
    "read_split": "sources.tables", "standardize": "sources.tables", "write_split": "sources.tables", "verify_checksum": "sources.tables", "verify_pinned": "sources.tables", "clean": "operators.cleaning", "ready": "operators.cleaning", "summary": "operators.cleaning",
    "Model": "plans.analyzer", "fit": "plans.analyzer", "run": "plans.analyzer", "significance": "plans.analyzer",
    "metrics": "operators.evaluation", "confusion": "operators.evaluation", "auc": "operators.evaluation", "mcnemar": "operators.evaluation", "bootstrap": "operators.evaluation",
    "top_features": "operators.explain", "top_dependencies": "operators.explain", "redundancy_relations": "operators.explain", "release": "storage", "score_stream": "streaming.scoring",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name in _PUBLIC:
        return getattr(import_module(f"{__name__}.{_PUBLIC[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
