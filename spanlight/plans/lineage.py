"""Content addresses of datasets: what a node was computed by, and with which tracked options."""

from __future__ import annotations

import base64
import hashlib
import json
import re


def plain(x):
    """``x`` in types that JSON has, with one form for equal values."""
    if isinstance(x, dict):
        return {str(k): plain(x[k]) for k in sorted(x, key=str)}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, (set, frozenset)):
        return sorted((plain(v) for v in x), key=str)
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    if hasattr(x, "item"):
        return x.item()
    return str(x)


def short_hash(x) -> str:
    """Ten characters that depend on the value alone."""
    digest = hashlib.sha1(json.dumps(plain(x), sort_keys=True).encode()).digest()
    return base64.b32encode(digest)[:10].decode().lower()


def flatten_dict(nested: dict, separator: str = ":") -> dict:
    """One level, with the keys on the way joined."""
    out = {}
    for key, value in nested.items():
        if isinstance(value, dict):
            out |= {f"{key}{separator}{k}": v for k, v in flatten_dict(value, separator).items()}
        else:
            out[key] = value
    return out


def camel_to_snake(name: str) -> str:
    """HitPeaks and hitPeaks to hit_peaks; runs of capitals are one word."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()
