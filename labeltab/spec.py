"""`TableSpec`: the description of a labelled table that every operator receives.

It replaces module-level constants (feature order, target, bounds, label fixes, class list)
with one value that travels with the DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class TableSpec:
    features: tuple[str, ...]
    target: str
    key: str | None = None
    # feature -> (min or None, max or None); a rule exists only for a bound that is set
    bounds: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    # wrong spelling -> right spelling
    label_fixes: dict[str, str] = field(default_factory=dict)
    # the closed class domain, if known; keeps pivots, grids and encoders free of a discovery job
    expected_classes: tuple[str, ...] | None = None
    seed: int = 42
    test_fraction: float = 0.2
    n_folds: int = 5
    name: str = "table"

    def with_(self, **kw) -> "TableSpec":
        return replace(self, **kw)

    @property
    def columns(self) -> list[str]:
        return [*self.features, self.target]
