"""JSON payloads read one way by every operator."""

from __future__ import annotations

import hashlib
import json


def _no_constant(name: str):
    raise ValueError(name)


def read(payload: str | None):
    """The parsed payload, or None where it is null, empty or not JSON (a byte order mark is allowed, NaN isn't)."""
    if not payload:
        return None
    try:
        return json.loads(payload.lstrip("﻿"), parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None


def kind(value) -> str | None:
    """JSON type of a value; null has none."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "number"
    if isinstance(value, str):
        return "string"
    return "object" if isinstance(value, dict) else "array"


def canonical(value) -> str:
    """One text for equal values, whatever the order of their keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(values: list) -> str:
    """96 bits of a hash of the values."""
    return hashlib.blake2b(canonical(values).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
