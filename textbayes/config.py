"""The frozen configuration. Its values are the defaults everywhere."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path

#: The class of characters that scripts features are made of, by default Han.
HAN = "㐀-䶿一-鿿"


@dataclass(frozen=True)
class Config:
    random_seed: int = 42
    # features
    ngram_range: tuple[int, int] = (2, 2)
    min_df: int = 2
    max_features: int | None = 50_000
    script_class: str = HAN
    # naive Bayes
    alpha: float = 0.05
    # mutual information weights
    minimum_weight: float = 0.25
    maximum_boost: float = 0.5
    gamma: float = 1.0
    # redundancy
    candidate_feature_count: int = 2000
    maximum_features_per_document: int = 80
    redundancy_minimum_pair_df: int = 20
    minimum_jaccard: float = 0.03
    top_k: int = 3
    redundancy_support_tau: float = 30.0
    redundancy_strength: float = 1.0
    redundancy_gamma: float = 0.5
    direction_smoothing: float = 0.5
    # dependencies
    dependency_minimum_pair_df: int = 8
    dependency_support_tau: float = 30.0
    dependency_smoothing: float = 0.5
    delta_clip: float = 4.0
    dependency_pair_count: int = 1000
    dependency_strength: float = 1.0
    maximum_pairs_per_document: int = 30
    # final test
    train_dev_merge: bool = True
    bootstrap_resamples: int = 5000
    bootstrap_seed_offset: int = 100

    def __post_init__(self):
        low, high = self.ngram_range
        if low < 1 or high < low:
            raise ValueError("ngram_range must be (low, high) with 1 <= low <= high")
        if self.alpha <= 0:
            raise ValueError("alpha must be positive")
        if not 0 <= self.minimum_weight <= 1 or self.maximum_boost < 0 or self.gamma <= 0:
            raise ValueError("weights need 0 <= minimum_weight <= 1, maximum_boost >= 0 and gamma > 0")
        if self.dependency_pair_count < 0:
            raise ValueError("dependency_pair_count can't be negative")

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=2)

    @classmethod
    def of(cls, values: dict) -> Config:
        """From flat names, or from the nested sections of a configuration file."""
        known, flat = {f.name for f in fields(cls)}, {}
        renamed = {
            "dfwnb_v2": {"minimum_pair_df": "redundancy_minimum_pair_df", "support_tau": "redundancy_support_tau"},
            "sdfwnb": {"minimum_pair_df": "dependency_minimum_pair_df", "support_tau": "dependency_support_tau", "smoothing": "dependency_smoothing"},
        }
        for key, value in values.items():
            for name, x in value.items() if isinstance(value, dict) else [(key, value)]:
                flat[renamed.get(key, {}).get(name, name)] = tuple(x) if isinstance(x, list) else x
        if unknown := flat.keys() - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**flat)


def load_config(path: str | None = None) -> Config:
    """The frozen configuration, or that of a JSON file, which must exist."""
    return Config() if path is None else Config.of(json.loads(Path(path).read_text(encoding="utf-8")))
