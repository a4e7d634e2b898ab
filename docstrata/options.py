"""Run options: one frozen record, validated once, passed to every operator."""

from __future__ import annotations

from dataclasses import dataclass, field

REDACT_POLICIES = ("all", "pii", "off")
REDACT_MODES = ("strict", "balanced")


@dataclass(frozen=True)
class ProfileOptions:
    sample_size: int = 100
    # Caps are off unless they are asked for.
    max_depth: int | None = None
    max_keys_per_doc: int | None = None
    max_array_sample: int | None = None
    optional_threshold: float = 0.95
    examples_per_type: int = 3
    variant_top: int = 10
    redact: str = "pii"
    redact_mode: str = "balanced"
    pii_patterns: tuple[str, ...] = field(default_factory=tuple)
    mask_short: bool = False
    typed_decimals: bool = False

    def __post_init__(self) -> None:
        for name in ("max_depth", "max_keys_per_doc", "max_array_sample"):
            cap = getattr(self, name)
            if cap is not None and cap < 1:
                raise ValueError(f"{name} must be positive or None, got {cap}")
        _within("optional_threshold", self.optional_threshold, 0, 1)
        for name in ("sample_size", "examples_per_type", "variant_top"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.redact not in REDACT_POLICIES:
            raise ValueError(f"redact must be one of {REDACT_POLICIES}")
        if self.redact_mode not in REDACT_MODES:
            raise ValueError(f"redact_mode must be one of {REDACT_MODES}")


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in [{low}, {high}], got {value}")
