"""Strict readers of durations, memory sizes, CPU counts and INTERVAL literals."""

from __future__ import annotations

import math
import re

from ..errors import ConfigError, SqlError

LONG_MAX = (1 << 63) - 1
MILLIS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
BYTES = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40}
INTERVAL_UNITS = {
    "millisecond": 1, "milliseconds": 1, "second": 1_000, "seconds": 1_000, "minute": 60_000, "minutes": 60_000,
    "hour": 3_600_000, "hours": 3_600_000, "day": 86_400_000, "days": 86_400_000,
}


def duration_ms(raw: str) -> int:
    """A whole number with one of ms, s, m, h, d, over zero. A day has 24 hours."""
    m = re.fullmatch(r"([0-9]+)(ms|s|m|h|d)", str(raw).strip())
    if not m:
        raise ConfigError(f"duration '{raw}' must be a whole number followed by ms, s, m, h or d")
    value = int(m[1]) * MILLIS[m[2]]
    if int(m[1]) == 0:
        raise ConfigError(f"duration '{raw}' must be over 0")
    if value > LONG_MAX:
        raise ConfigError(f"duration '{raw}' does not fit in 64-bit milliseconds")
    return value


def memory_bytes(raw: str) -> int:
    """A whole number of bytes, with K, M, G, T (1000) or Ki, Mi, Gi, Ti (1024)."""
    m = re.fullmatch(r"([0-9]+)([kmgt]i?)?", str(raw).strip(), re.I)
    if not m:
        raise ConfigError(f"memory '{raw}' must be a whole number followed by K, M, G, T, Ki, Mi, Gi or Ti")
    value = int(m[1]) * BYTES[(m[2] or "").lower()]
    if value == 0:
        raise ConfigError(f"memory '{raw}' must be over 0")
    if value >= 1 << 64:
        raise ConfigError(f"memory '{raw}' does not fit in 64 bits")
    return value


def cpu_cores(raw: str) -> int:
    """Cores ('4', '1.5') or thousandths ('500m'), rounded up, one at least."""
    text = str(raw).strip()
    try:
        value = float(text[:-1]) / 1000 if text.endswith("m") else float(text)
    except ValueError:
        raise ConfigError(f"deployment.resources.cpu '{raw}' is neither cores nor thousandths of a core") from None
    if not math.isfinite(value) or value <= 0:
        raise ConfigError(f"deployment.resources.cpu '{raw}' must be over 0")
    return max(1, math.ceil(value))


def interval_ms(number: str, unit: str) -> int:
    """Milliseconds of ``INTERVAL 'number' unit``: a whole number over zero."""
    factor = INTERVAL_UNITS.get(unit.lower())
    if factor is None:
        raise SqlError(f"INTERVAL unit '{unit}' is not one of millisecond, second, minute, hour, day")
    if not re.fullmatch(r"\s*[0-9]+\s*", number):
        raise SqlError(f"INTERVAL '{number}' must be a whole number")
    value = int(number) * factor
    if value <= 0:
        raise SqlError(f"INTERVAL '{number}' must be over 0")
    if value > LONG_MAX:
        raise SqlError(f"INTERVAL '{number}' {unit} does not fit in 64-bit milliseconds")
    return value
