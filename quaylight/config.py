"""Settings as frozen dataclasses, read from YAML if a file is given."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

import yaml


class ConfigError(Exception):
    """A configuration file is missing, empty or invalid."""


# The reporting jurisdictions, country tiers and thresholds of the rules.
GCC = ("United Arab Emirates", "Saudi Arabia", "Qatar", "Kuwait", "Bahrain", "Oman")
JURISDICTIONS = {"US": ("United States",), "IN": ("India",), "GCC": GCC}
THRESHOLDS_USD = {"US": 10000.0, "IN": 12000.0, "GCC": 15000.0, "DEFAULT": 10000.0}
TIERS = {
    "sanctioned": (1.00, ("North Korea", "Iran", "Myanmar")),
    "grey_list": (
        0.65,
        ("Nigeria", "South Africa", "Philippines", "Vietnam", "Syria", "Yemen", "Kenya", "Mali", "Haiti", "South Sudan", "Mozambique", "Senegal",
         "Tanzania", "Venezuela", "Democratic Republic of the Congo", "Monaco", "Namibia", "Croatia", "Bulgaria", "Cameroon", "Burkina Faso"),
    ),
    "moderate": (0.45, ("China", "Hong Kong")),
    "gcc_baseline": (0.35, GCC),
}
CONFIRMATION_RATES = {"sanctions_country": 0.08, "structuring_flag": 0.08, "geo_velocity": 0.03, "corridor_velocity": 0.03, "amount_frequency": 0.03, "device_geo_risk": 0.05}
FUSION_WEIGHTS = {"rules": 0.30, "xgboost": 0.30, "unsupervised": 0.20, "statistical": 0.10, "random_forest": 0.10}
SEVERITY = {"low": 0.30, "medium": 0.60, "high": 0.80, "critical": 1.00}


@dataclass(frozen=True)
class Thresholds:
    large_transaction: float = 1_000_000.0
    jurisdictions: dict = field(default_factory=lambda: dict(JURISDICTIONS))
    thresholds_usd: dict = field(default_factory=lambda: dict(THRESHOLDS_USD))
    tiers: dict = field(default_factory=lambda: dict(TIERS))
    baseline_score: float = 0.20
    near_ratio: float = 0.90
    corridor_quantile: float = 0.90
    frequency_24h: float = 10.0
    frequency_7d: float = 70.0
    velocity_cutoff: float = 0.80
    ip_risk: float = 0.70
    account_age_days: int = 30
    zscore: float = 3.0
    iqr_multiplier: float = 1.5
    mad: float = 3.5
    contamination: float = 0.10
    missing_ratio: float = 0.30
    random_seed: int = 42
    false_negative_rate: float = 0.0015
    confirmation_rates: dict = field(default_factory=lambda: dict(CONFIRMATION_RATES))
    fusion_weights: dict = field(default_factory=lambda: dict(FUSION_WEIGHTS))
    severity: dict = field(default_factory=lambda: dict(SEVERITY))

    def __post_init__(self):
        if abs(sum(self.fusion_weights.values()) - 1.0) > 1e-6:
            raise ConfigError(f"fusion weights must sum to 1, not {sum(self.fusion_weights.values())}")

    def threshold_by_country(self) -> dict[str, float]:
        return {c: self.thresholds_usd[j] for j, countries in self.jurisdictions.items() for c in countries}

    def tier_by_country(self) -> dict[str, str]:
        """Later tiers win where lists overlap."""
        return {c: tier for tier, (_, countries) in self.tiers.items() for c in countries}


@dataclass(frozen=True)
class JdbcConfig:
    server: str = "localhost"
    database: str = "payments"
    table: str = "dbo.modeling_dataset"
    driver: str = "com.microsoft.sqlserver.jdbc.SQLServerDriver"
    trusted_connection: bool = True
    amount_unit_multiplier: float = 1000.0
    fetch_size: int = 10_000


@dataclass(frozen=True)
class CsvConfig:
    path: str
    delimiter: str = ","
    encoding: str = "UTF-8"
    header: bool = True
    split_bytes: int | None = None


@dataclass(frozen=True)
class ApiConfig:
    url: str
    headers: dict[str, str] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)
    timeout: int = 30
    retries: int = 3
    backoff_factor: float = 0.3
    data_key: str | None = None


def load_yaml(path: str | Path) -> dict[str, Any]:
    """The mapping of a YAML file; ConfigError if there is none."""
    path = Path(path)
    if not path.is_file():
        raise ConfigError(f"no such configuration file: {path}")
    try:
        found = yaml.safe_load(path.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise ConfigError(f"invalid YAML in {path}: {e}") from e
    if not found:
        raise ConfigError(f"empty configuration file: {path}")
    if not isinstance(found, dict):
        raise ConfigError(f"not a mapping: {path}")
    return found


def load(kind: type, path: str | Path, section: str | None = None):
    """A settings object of the given dataclass from a YAML file or one section of it; unknown keys are an error."""
    found = load_yaml(path)
    if section is not None:
        if section not in found:
            raise ConfigError(f"no section {section} in {path}")
        found = found[section]
    unknown = set(found) - {f.name for f in fields(kind)}
    if unknown:
        raise ConfigError(f"unknown settings in {path}: {sorted(unknown)}")
    return kind(**found)


def override(settings, **changes):
    """A copy with some settings changed."""
    return replace(settings, **changes)
