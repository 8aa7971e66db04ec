"""Settings of the engine: weights, scoring constants, typo limits, site settings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default weights, constants and limits.
ZONE_WEIGHTS = {"title": 8.0, "sku": 6.0, "code": 6.0, "attr": 3.0, "phrase": 4.0, "content": 1.0}
KIND_WEIGHTS = {"lower": 1.0, "original": 1.0, "fold": 1.0, "code_exact": 1.0, "code_digits": 0.85, "code_letters": 0.85, "bigram": 0.7, "code_prefix": 0.35, "stem": 0.5}
STRENGTHS = {"light": 0.04, "medium": 0.10, "strong": 0.25}
POOL = 500


@dataclass(frozen=True)
class EngineConfig:
    zone_weights: dict[str, float] = field(default_factory=dict)
    kind_weights: dict[str, float] = field(default_factory=dict)
    k1: float = 1.2
    b: float = 0.75
    typo: bool = True
    typo_max_docs: int | None = None  # corrections are off for indexes of more documents; None: never
    typo_vocab_cap: int | None = None  # most terms of a first character that are candidates; None: all
    typo_min_freq: int = 2

    def zone_weight(self, zone: Column) -> Column:
        """A user's weight, else the default, else 1."""
        return _lookup(ZONE_WEIGHTS | self.zone_weights, zone, 1.0)

    def kind_weight(self, kind: Column) -> Column:
        """A user's weight, else the default, else 0.5."""
        return _lookup(KIND_WEIGHTS | self.kind_weights, kind, 0.5)


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*map(F.lit, chain(*table.items())))[key], F.lit(default))


@dataclass(frozen=True)
class Settings:
    """What a site sets; made of raw input by sanitized()."""

    enabled: bool = True
    post_types: tuple[str, ...] = ("product", "post", "page")
    recency_mode: str = "medium"
    recency_basis: str = "created"
    recency_halflife: int = 180

    @classmethod
    def sanitized(cls, raw: dict) -> "Settings":
        """Raw input with unknown values replaced by defaults and the half-life cut to 1 to 3650 days.

        An absent `enabled` means off and absent types mean products alone, unlike the defaults of settings never saved.
        """
        mode = str(raw.get("recency_mode", "medium"))
        life = raw.get("recency_halflife", "")
        digits = re.match(r"\s*[+-]?\d+", str(life))
        life = 180 if isinstance(life, str) and not life.strip() else int(digits[0]) if digits else 0
        return cls(
            enabled=bool(raw.get("enabled")),
            post_types=tuple(t for t in raw.get("post_types", ["product"]) if t),
            recency_mode=mode if mode in ("off", "date", *STRENGTHS) else "medium",
            recency_basis="modified" if raw.get("recency_basis") == "modified" else "created",
            recency_halflife=min(3650, life if life >= 1 else 180),
        )
