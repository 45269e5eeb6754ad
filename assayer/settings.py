"""Settings of every operator, checked when they are made."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class NullGateSettings:
    enabled: bool = True
    threshold: float = 0.4
    per_column: bool = True


@dataclass(frozen=True)
class SchemaGateSettings:
    enabled: bool = True
    allow_extra_columns: bool = False
    strict_dtypes: bool = True


@dataclass(frozen=True)
class DriftGateSettings:
    enabled: bool = True
    method: str = "psi"
    psi_threshold: float = 0.25
    ks_p_value_threshold: float = 0.05
    psi_bins: int = 10

    def __post_init__(self):
        _need(self.method in ("psi", "ks"), f"drift method must be psi or ks: {self.method!r}")


@dataclass(frozen=True)
class ImputeSettings:
    enabled: bool = True
    method: str = "mice"
    mice_max_iter: int = 25
    mice_tol: float = 1e-2
    knn_n_neighbors: int = 5
    categorical_strategy: str = "most_frequent"

    def __post_init__(self):
        _need(self.method in ("mice", "knn"), f"unknown imputation method: {self.method!r}")
        _need(
            self.categorical_strategy == "most_frequent",
            f"unknown categorical strategy: {self.categorical_strategy!r}",
        )


@dataclass(frozen=True)
class OutlierSettings:
    enabled: bool = True
    method: str = "isolation_forest"
    contamination: float = 0.05
    n_estimators: int = 100
    lof_n_neighbors: int = 20

    def __post_init__(self):
        _need(
            self.method in ("isolation_forest", "lof", "none"),
            f"unknown outlier method: {self.method!r}",
        )
        _need(0 < self.contamination < 0.5, "contamination must lie in (0, 0.5)")


# Fixed value: the model family names users select by.
FAMILIES = ("xgboost", "lightgbm", "random_forest", "linear")


@dataclass(frozen=True)
class SearchSettings:
    enabled: bool = True
    n_trials: int = 30
    cv_folds: int = 5
    families: tuple[str, ...] = FAMILIES
    stacking_folds: int = 5
    seed: int = 42
    parallelism: int = 4

    def __post_init__(self):
        object.__setattr__(self, "families", tuple(self.families))
        unknown = [f for f in self.families if f not in FAMILIES]
        _need(not unknown, f"unknown model families: {unknown}")
        _need(self.n_trials >= 1, "n_trials must be at least 1")
        _need(self.cv_folds >= 2 and self.stacking_folds >= 2, "folds must be at least 2")


@dataclass(frozen=True)
class PolicySettings:
    alpha: float = 0.1
    gamma: float = 0.9
    epsilon: float = 0.3
    epsilon_decay: float = 0.98
    min_epsilon: float = 0.01
    reward_mode: str = "full_stack"

    def __post_init__(self):
        _need(0 < self.alpha <= 1, "alpha must lie in (0, 1]")
        for name in ("gamma", "epsilon", "min_epsilon"):
            _need(0 <= getattr(self, name) <= 1, f"{name} must lie in [0, 1]")
        _need(0 < self.epsilon_decay <= 1, "epsilon_decay must lie in (0, 1]")
        _need(
            self.reward_mode in ("full_stack", "fast_surrogate"),
            f"unknown reward mode: {self.reward_mode!r}",
        )


@dataclass(frozen=True)
class MaskSearchSettings:
    enabled: bool = True
    population_size: int = 30
    n_generations: int = 20
    crossover_rate: float = 0.7
    mutation_rate: float = 0.05
    tournament_size: int = 3
    elitism_count: int = 2
    min_features: int = 1

    def __post_init__(self):
        _need(self.population_size >= 2, "population_size must be at least 2")
        _need(self.n_generations >= 1, "n_generations must be at least 1")
        for name in ("crossover_rate", "mutation_rate"):
            _need(0 <= getattr(self, name) <= 1, f"{name} must lie in [0, 1]")
        _need(self.tournament_size >= 1, "tournament_size must be at least 1")
        _need(
            0 <= self.elitism_count < self.population_size,
            "elitism_count must be smaller than the population",
        )
        _need(self.min_features >= 1, "min_features must be at least 1")


@dataclass(frozen=True)
class AdaptSettings:
    enabled: bool = True
    hidden_dim: int = 0
    inner_lr: float = 0.01
    outer_lr: float = 0.001
    inner_steps: int = 5
    n_outer_steps: int = 100
    meta_batch_size: int = 4
    adapt_steps: int = 5
    seed: int = 42

    def __post_init__(self):
        _need(self.hidden_dim == 0, "only the linear head is built (hidden_dim = 0)")
        for f in fields(self):
            if f.name not in ("enabled", "hidden_dim", "seed"):
                _need(getattr(self, f.name) > 0, f"{f.name} must be positive")


@dataclass(frozen=True)
class ClaimSettings:
    high_max_relative_width: float = 0.15
    inconclusive_min_relative_width: float = 0.40
    relative_tolerance: float = 0.02

    def __post_init__(self):
        _need(
            0 < self.high_max_relative_width < self.inconclusive_min_relative_width,
            "the high bound must be positive and below the inconclusive bound",
        )
        _need(0 < self.relative_tolerance < 1, "the tolerance must lie in (0, 1)")


# Fixed value: section name in a settings file -> settings class.
SECTIONS = {
    "max_null_rate_gate": NullGateSettings,
    "schema_conformance_gate": SchemaGateSettings,
    "drift_gate": DriftGateSettings,
    "imputation": ImputeSettings,
    "outlier_detection": OutlierSettings,
    "estimation": SearchSettings,
    "rl_optimizer": PolicySettings,
    "genetic_selector": MaskSearchSettings,
    "maml": AdaptSettings,
}


@dataclass(frozen=True)
class Settings:
    max_null_rate_gate: NullGateSettings = field(default_factory=NullGateSettings)
    schema_conformance_gate: SchemaGateSettings = field(default_factory=SchemaGateSettings)
    drift_gate: DriftGateSettings = field(default_factory=DriftGateSettings)
    imputation: ImputeSettings = field(default_factory=ImputeSettings)
    outlier_detection: OutlierSettings = field(default_factory=OutlierSettings)
    estimation: SearchSettings = field(default_factory=SearchSettings)
    rl_optimizer: PolicySettings = field(default_factory=PolicySettings)
    genetic_selector: MaskSearchSettings = field(default_factory=MaskSearchSettings)
    maml: AdaptSettings = field(default_factory=AdaptSettings)

    @classmethod
    def of(cls, sections: dict | None) -> Settings:
        """From nested dicts; absent sections and keys take defaults, an unknown key is an error."""
        flat = dict(sections or {})
        flat.update(flat.pop("meta_learning", None) or {})
        search = dict(flat.get("estimation") or {})
        if "tree_model_families" in search or "include_linear_family" in search:
            trees = search.pop("tree_model_families", FAMILIES[:3])
            linear = ("linear",) if search.pop("include_linear_family", True) else ()
            search["families"] = (*trees, *linear)
        if "stacking_cv_folds" in search:
            search["stacking_folds"] = search.pop("stacking_cv_folds")
        for inert in ("n_startup_trials", "n_warmup_steps"):  # belong to the sampler not built here
            search.pop(inert, None)
        flat["estimation"] = search
        return cls(**{name: kind(**(flat.get(name) or {})) for name, kind in SECTIONS.items()})

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """From a JSON file, or YAML where PyYAML is installed; a missing file is an error."""
        text = Path(path).read_text()
        if str(path).lower().endswith((".yaml", ".yml")):
            import yaml

            return cls.of(yaml.safe_load(text))
        return cls.of(json.loads(text))

    def as_dict(self) -> dict:
        return asdict(self)
