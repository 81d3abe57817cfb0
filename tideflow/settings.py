"""Thresholds with their defaults, merged and validated on the driver; values enter plans as literals."""

from __future__ import annotations

import copy
from typing import Any

# The default thresholds.
DEFAULTS: dict[str, Any] = {
    "profitable_wallet": {"pnl_30d": 4000.0, "min_trades": 8, "min_win_rate": 0.35, "min_realized": 1000.0, "min_avg_trade_size": 50.0},
    "rules": {
        "A": {"min_wallets": 20, "watch_min_wallets": 10, "min_buy_volume": 25000.0, "max_sold_pct": 30.0, "mcap_min": 100000.0, "mcap_max": 5000000.0, "min_liquidity": 20000.0, "max_age_days": 7.0, "spike_mult": 3.0},
        "B": {"base_wallets": 20, "target_wallets": 40, "max_expansion": 2.0, "max_sell_to_buy_pct": 25.0},
        "C": {"min_human_ratio": 0.7, "max_bot_ratio": 0.2, "max_block_pct": 30.0},
        "D": {"whale_usd": 10000.0, "min_wallets": 15, "min_ratio": 3.0},
        "E": {"min_delay_min": 5.0, "max_delay_min": 120.0, "mcap_max": 5000000.0, "min_pct": 30.0, "max_pct": 110.0},
        "F": {"min_profit": 500.0, "transfer_hours": 24.0, "min_match_pct": 80.0, "max_match_pct": 105.0, "buy_min": 60.0, "mcap_max": 5000000.0},
        "G": {"min_exited_pct": 30.0, "liquidity_drop_pct": 30.0, "pump_pct": 100.0, "max_new_smart": 3, "min_top_exits": 3},
    },
    "graph": {"max_depth": 3, "min_usd": 100.0, "max_nodes": 5000, "max_edges": 25000, "per_node": 500},
    "cluster_threshold": 61,
    "cooldown_min": 30,
    "spam": {"authors": 3, "posts": 5, "chars": 12, "lookback_min": 360, "weights": {"copypasta": 80, "repeat_author": 60, "low_content": 50}, "hide": 70},
    "velocity_windows_min": [60, 360, 1440],
    "liquidity_bands": [10000.0, 50000.0, 250000.0],
    "ratio_bands": [0.02, 0.05, 0.15],
}


def deep_merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """base with over's values; dicts are merged, everything else is replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def validated(over: dict[str, Any] | None = None) -> dict[str, Any]:
    """The defaults with over's values; unknown names and values of another kind are errors."""

    def check(base: Any, value: Any, path: str) -> None:
        if isinstance(base, dict):
            if not isinstance(value, dict):
                raise ValueError(f"{path} must be a table")
            for k, v in value.items():
                if k not in base:
                    raise ValueError(f"unknown setting {path}.{k}".replace("..", "."))
                check(base[k], v, f"{path}.{k}")
        elif isinstance(base, list):
            if not isinstance(value, list) or not value:
                raise ValueError(f"{path} must be a list")
        elif isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"{path} must be a number")

    check(DEFAULTS, over or {}, "")
    return deep_merge(DEFAULTS, over or {})
