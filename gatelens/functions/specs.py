"""Texts of a configuration: quantile ranges and lists, rule lists, and the quantiles that follow from them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

# Rule keys in their order, and other names they go by.
RULES = ("output", "direction", "length", "diff_resid", "delta_ridge_ens", "sim_conflict", "discourse_instability", "contradiction", "self_contradiction")
SEMANTIC = ("discourse_instability", "contradiction", "self_contradiction")
ALIASES = {
    "diff_residual": "diff_resid", "delta_ridge": "delta_ridge_ens", "delta_ridge_ensemble": "delta_ridge_ens", "similar_input_conflict": "sim_conflict",
    "semantic_contradiction": "contradiction", "selfcontradiction": "self_contradiction",
}
RANGE = re.compile(r"\s*(\d*\.?\d+)\s*~\s*(\d*\.?\d+)\s*\(\s*step\s*(\d*\.?\d+)\s*\)\s*")


def _share(x: float, text: str) -> float:
    if not 0 < x < 1:
        raise ValueError(f"quantiles lie between 0 and 1: {text}")
    return round(x, 6)


def quantile_range(text: str) -> list[float]:
    """The quantiles of a range such as 0.70~0.99(step 0.01), both ends included."""
    m = RANGE.fullmatch(text)
    if not m:
        raise ValueError(f"not a range of quantiles: {text}")
    low, high, step = map(float, m.groups())
    _share(low, text), _share(high, text)
    if high < low or step <= 0:
        raise ValueError(f"an empty range: {text}")
    return sorted({_share(low + i * step, text) for i in range(int((high - low) / step + 1e-9) + 1)})


def quantile_list(text: str) -> list[float]:
    """The distinct quantiles of a comma-separated list, in order."""
    out = sorted({_share(float(t), t) for t in text.split(",") if t.strip()})
    if not out:
        raise ValueError("no quantiles")
    return out


def rule_key(name: str) -> str:
    key = re.sub(r"[\s-]+", "_", name.strip().lower())
    return ALIASES.get(key, key)


def rule_list(text: str, default: Iterable[str] | None = None) -> list[str]:
    """The distinct rules of a comma-separated list under any of their names, in the order given; an empty one is the default, if there is one."""
    out = list(dict.fromkeys(k for k in map(rule_key, text.split(",")) if k))
    unknown = [k for k in out if k not in RULES]
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(unknown)}")
    if not out and default is None:
        raise ValueError("no rules")
    return out or list(default)


def rule_quantiles(rules: Iterable[str], text: str = "", usual: float = 0.99, semantic: float = 0.95) -> dict[str, float]:
    """Each rule's quantile: the usual one, a lower one for semantic rules, or what a JSON object says."""
    said = {rule_key(k): _share(float(v), k) for k, v in json.loads(text or "{}").items()}
    return {r: said.get(r, semantic if r in SEMANTIC else usual) for r in rules}


def warn_quantiles(fail: dict[str, float], rules: Iterable[str], text: str = "", usual: float = 0.95) -> dict[str, float]:
    """Each rule's quantile of warnings, below that of failures."""
    said = {rule_key(k): _share(float(v), k) for k, v in json.loads(text or "{}").items()}
    out = {}
    for r in rules:
        f, w = fail.get(r, 0.99), said.get(r, usual)
        out[r] = w if w < f else max(0.0001, round(f - 0.01, 6))
    return out
