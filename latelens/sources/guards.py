"""Column checks that run before any job starts."""

from __future__ import annotations

from latelens.schemas import AFTER_PURCHASE_COLUMNS, LABELS


class MissingColumns(ValueError):
    pass


class LeakingFeature(ValueError):
    pass


def require_columns(available: list[str], required: list[str], where: str = "table") -> None:
    missing = sorted(set(required) - set(available))
    if missing:
        raise MissingColumns(f"columns missing in {where}: {missing}")


def forbid_late_knowledge(features: list[str]) -> None:
    """No label and nothing learned after the purchase may be a feature."""
    leaking = sorted(set(features) & (set(LABELS) | set(AFTER_PURCHASE_COLUMNS)))
    if leaking:
        raise LeakingFeature(f"only known after the purchase: {leaking}")
