"""Parameters of the pipeline.

Fixed values: these defaults equal the reference configuration so that the
features, thresholds and flags mean the same thing.
    rolling window 7 days; KPI rolling window 30 days
    isolation forest: 500 trees, 256 rows per tree ("auto"), 80 % of features
        per tree, bootstrap sampling, contamination 0.07, seed 42
    autoencoder 128-64-32-8 (ReLU, dropout 0.3, Adam 5e-4, batch 64, 150 epochs,
        patience 15); default model is its 8-component linear counterpart
    ensemble weights 0.5 / 0.5; anomaly score threshold 0.2;
        agreement threshold factor 0.7
    reconstruction threshold: max(90th percentile, mean + 2 population std)
    test size 0.2 (time-ordered split); alert cooldown 30 minutes; top-k 5
"""

from __future__ import annotations

from dataclasses import dataclass, field, asdict


@dataclass(frozen=True)
class Params:
    rolling_window_days: int = 7
    kpi_rolling_window_days: int = 30

    n_trees: int = 500
    max_samples: int = 256
    max_features: float = 0.8
    bootstrap: bool = True
    contamination: float = 0.07
    seed: int = 42

    n_components: int = 8
    recon_model: str = "pca"            # "pca" (linear autoencoder) or "mlp"
    ae_epochs: int = 150
    ae_patience: int = 15
    ae_batch_size: int = 64
    ae_learning_rate: float = 0.0005
    ae_dropout: float = 0.3
    recon_percentile: float = 0.90
    recon_std_factor: float = 2.0

    if_weight: float = 0.5
    ae_weight: float = 0.5
    anomaly_score_threshold: float = 0.2
    agreement_factor: float = 0.7
    blend_mode: str = "confidence"      # "confidence" (reference default) or "static"
    normalize_mode: str = "fit"         # "fit": min/max saved at fit; "batch": per batch

    test_size: float = 0.2
    alert_cooldown_minutes: int = 30
    top_k: int = 5
    fill_key: str | None = None         # column whose last value fills a gap before 0 does; None: 0 alone

    # largest side (bytes, estimated) we are willing to broadcast after checking
    broadcast_limit_bytes: int = 64 * 1024 * 1024
    extra: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self)
