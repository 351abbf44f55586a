"""The policy sheet: activity ranks, duty pairs, flows, limits and prices, from YAML or JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Policy:
    """All activity names are parameters, so the rules run on any log's alphabet."""

    activity_rank: dict[str, int] = field(default_factory=dict)
    clear: str = "Clear Invoice"
    invoice: str = "Record Invoice Receipt"
    receipts: tuple[str, ...] = ("Record Goods Receipt", "Record Service Entry Sheet")
    remove_block: str = "Remove Payment Block"
    set_block: str = "Set Payment Block"
    delete: str = "Delete Purchase Order Item"
    gr_required_flows: tuple[str, ...] = ()
    invoice_matching_not_applicable_flows: tuple[str, ...] = ()
    duties_enforced: bool = True
    conflicting_pairs: tuple[tuple[str, str], ...] = ()
    tolerance_abs_eur: float = 50
    tolerance_pct: float = 2.0
    gr_quantity_tolerance_pct: float = 5.0
    clearing_auto_approve_limit_eur: float = 10000
    approval_limits_eur: dict[str, float] = field(default_factory=dict)
    payment_terms_days: int = 30
    early_payment_discount_days: int = 10
    duplicate_invoice_window_days: int = 90
    duplicate_invoice_value_tolerance_eur: float = 1
    #: Model name to dollars per million input and output tokens.
    prices: dict[str, tuple[float, float]] = field(default_factory=dict)
    cache_read_multiplier: float = 0.1
    cache_write_multiplier: float = 1.25

    @classmethod
    def load(cls, path: str) -> Policy:
        """A sheet with this class's keys; duty pairs may stand under ``segregation_of_duties``, unknown keys are passed over."""
        with open(path) as f:
            text = f.read()
        if path.endswith(".json"):
            sheet = json.loads(text)
        else:
            import yaml

            sheet = yaml.safe_load(text)
        duties = sheet.pop("segregation_of_duties", None)
        if duties is not None:
            sheet["duties_enforced"] = bool(duties.get("enforced"))
            sheet["conflicting_pairs"] = duties.get("conflicting_pairs", [])
        known = {f.name: sheet[f.name] for f in fields(cls) if f.name in sheet}
        freeze = lambda v: tuple(map(freeze, v)) if isinstance(v, list) else v
        return cls(**{k: freeze(v) for k, v in known.items()})
