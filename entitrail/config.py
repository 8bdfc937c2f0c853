"""Matching parameters and the edit budget rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from .schema import BUDGETS, BY_NAME, EXTRA_WEIGHTS


@dataclass(frozen=True)
class MatchingConfig:
    # Names and defaults of the parameters.
    fuzzy_enabled: bool = True
    max_errors: int = 1
    min_fuzzy_pattern_length: int = 4
    acceptance_threshold: float = 0.60
    ambiguity_margin: float = 0.08
    evidence_bonus: float = 0.25
    evidence_window: int = 80
    max_separator_gap: int = 4
    field_weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.min_fuzzy_pattern_length < 1:
            raise ValueError("min_fuzzy_pattern_length must be at least 1")
        for name in ("max_errors", "evidence_window", "max_separator_gap"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        for name in ("acceptance_threshold", "ambiguity_margin", "evidence_bonus"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        for name, weight in self.field_weights.items():
            if name not in BY_NAME and name not in EXTRA_WEIGHTS:
                raise ValueError(f"unknown field in field_weights: {name}")
            if not 0 <= weight <= 1:
                raise ValueError(f"the weight of {name} must be between 0 and 1")


def allowed_distance(entity_type: str, field_name: str, value: str, length: int, config: MatchingConfig) -> int:
    """Edits that an alias may have in text; ``length`` is that of its normalized form."""
    if not config.fuzzy_enabled or length < config.min_fuzzy_pattern_length:
        return 0
    if field_name in ("full_name", "previous_full_name") and "." in value:
        return 0  # initials leave too little to tell names apart
    rule = BUDGETS.get((entity_type, field_name), "none")
    most = {
        "none": 0,
        "four": 1 if length >= 4 else 0,
        "six": 1 if length >= 6 else 0,
        "eight": 1 if length >= 8 else 0,
        "surname": 2 if length >= 10 else 1 if length >= 4 else 0,
    }[rule]
    return min(config.max_errors, most)
