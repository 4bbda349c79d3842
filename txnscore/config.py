"""Job settings: plain values, overridable from the process environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

ENV_PREFIX = "TXNSCORE_"


@dataclass(frozen=True)
class Settings:
    fraud_threshold: float = 0.7
    fraud_label_ratio: float = 0.15
    test_size: float = 0.2
    random_state: int = 42
    home_radius_km: float = 10.0
    model_name: str = "fraud-detection-model"
    num_trees: int = 100
    max_depth: int = 10
    retention_hours: int = 24
    # Partitions of the stored serving tables; a table keeps the number it was written with.
    user_buckets: int = 64

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Settings":
        """Defaults, with ``TXNSCORE_<FIELD>`` taking precedence where set."""
        env = dict(os.environ) if env is None else env
        base = cls()
        given = {}
        for f in fields(cls):
            raw = env.get(ENV_PREFIX + f.name.upper())
            if raw is not None:
                given[f.name] = type(getattr(base, f.name))(raw)
        return replace(base, **given)


DEFAULTS = Settings()
