"""What history to keep: roles of columns, entities and label rates."""

from __future__ import annotations

from dataclasses import dataclass, field

DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Roles:
    """Which columns play the roles every operator needs."""

    id: str = "BusinessKey"
    ts: str = "TransactionDate"
    amount: str = "TransactionAmount"
    label: str = "IsFraudTransaction"


@dataclass(frozen=True)
class LabelRate:
    """Label rate over rows older than ``lag_days`` (and younger than ``window_days`` before that)."""

    lag_days: int = 7
    strength: float = 50.0
    window_days: int | None = None
    suffix: str = ""


@dataclass(frozen=True)
class Entity:
    """Statistics to keep for one key column; output columns start with ``name``."""

    name: str
    key: str
    count: bool = False
    windows: tuple[int, ...] = ()
    distinct: tuple[tuple[str, str], ...] = ()
    age: bool = False
    first_flag: bool = False
    amounts: bool = False
    gap: bool = False
    rates: tuple[LabelRate, ...] = field(default=())
