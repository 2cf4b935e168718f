"""Configurations: YAML files over the default values."""

from __future__ import annotations

import copy
from pathlib import Path

import yaml

#: The snapshots, shares, caps and limits of the standard evaluation.
DEFAULTS = {
    "name": "small",
    "seed": 42,
    "horizon_days": 1080,
    "banks": {"A": 0.5, "B": 0.3, "C": 0.2},
    "fraud": {"holdout_scenarios": ["complicit_merchant"]},
    "graph": {"projection_degree_cap": 30, "merchant_degree_cap": 15, "similarity_threshold": 85},
    "evaluation": {
        "train_snapshots": [180, 300, 420, 540], "label_cutoff": 720, "test_snapshots": [720, 810, 900], "max_tenure_days": 730, "test_group_share": 0.5, "val_group_share": 0.25,
        "alert_budget_share": 0.02, "target_prevalence": 0.01,
    },
    "privacy": {"paillier_bits": 3072, "slot_bits": 16, "decoy_ratio": 0.5, "encrypted_scoring_sample": 40},
    "go_no_go": {"min_pr_auc_gain_vs_best_baseline": 0.0, "min_ring_recall_before_bust_out": 0.5, "min_lead_time_days": 30, "max_encrypted_score_abs_error": 0.000001},
}


def merged(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``, section by section; neither is changed."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load_config(path: str | Path) -> dict:
    """A YAML file's sections over the defaults; an empty file gives the defaults."""
    return merged(DEFAULTS, yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def snapshot_days(config: dict) -> list[int]:
    """All days of the evaluation, once each, in order."""
    e = config["evaluation"]
    return sorted({*e["train_snapshots"], *e["test_snapshots"]})
