"""Fixed schemas of files, and the settings of the pipeline in one place."""

from __future__ import annotations

from dataclasses import dataclass

ARGUMENTS_RAW = "argument string, topic string, `set` string, WA double, `MACE-P` double, stance_WA int, stance_WA_conf double"
ARGUMENTS = "arg_id string, policy string, text string, stance int, stance_label string, stance_confidence double, embedding array<float>, pagerank_score double, is_distractor boolean, distractor_source_policy string, distractor_source_id string"
POLICIES = "policy string, n_arguments int, cluster_id int, metapolicy_id int, metapolicy_name string"
RETRIEVAL = "pool int, k int, system string, policy string, stance int, rank int, arg_id string, text string"
METRICS = "pool int, k int, system string, policy string, metric string, value double"
MANIFEST = "policy string, stance int, text string"


@dataclass(frozen=True)
class Settings:
    """Thresholds and sizes; pass a changed copy to run with others."""

    floor_contradicts: float = 0.70
    floor_equivalent: float = 0.75
    tau_contradicts: float = 0.90
    tau_entails: float = 0.60
    uncertain_low: float = 0.40
    uncertain_high: float = 0.70
    pools: tuple[int, ...] = (20, 50, 100, 200)
    ks: tuple[int, ...] = (5, 10, 15, 20, 30)
    mmr_lambda: float = 0.5
    damping: float = 0.85
    tolerance: float = 1e-10
    iterations: int = 200
    relevant_grade: int = 2
    match_floor: float = 0.75
    sibling_policies: int = 4
    levels: tuple[int, ...] = (0, 50, 100, 200, -1)
    seed: int = 42
    vector_size: int = 64

    def grid(self) -> list[tuple[int, int]]:
        """The (pool, k) configurations with k <= pool."""
        return [(p, k) for p in self.pools for k in self.ks if k <= p]


DEFAULTS = Settings()
