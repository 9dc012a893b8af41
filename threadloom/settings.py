"""A reader's settings: validated, clamped, and carried over as a small JSON text."""

from __future__ import annotations

import json
import unicodedata

FORMAT, VERSION, MOST_BYTES, MOST_NAMES = "threadloom-settings", 1, 65_536, 64
# Bounds of the settings.
BOUNDS = {"refresh_minutes": (15, 1_440), "full_days": (1, 30), "reply_days": (7, 90)}


def blocked_names(names: list[str]) -> list[str]:
    """Names in one form, without repeats; raises for names that are empty, too long or hold control characters."""
    out: dict[str, str] = {}
    for n in names:
        plain = unicodedata.normalize("NFKC", n).strip() if isinstance(n, str) else ""
        if not 1 <= len(plain) <= 64 or any(unicodedata.category(c) == "Cc" for c in plain):
            raise ValueError(f"invalid name: {n!r}")
        out.setdefault(plain.lower(), plain)
    if len(out) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return list(out.values())


def clamped(values: dict[str, int]) -> dict[str, int]:
    """Known settings within their bounds; unknown ones are dropped."""
    return {k: max(lo, min(hi, int(values.get(k, lo)))) for k, (lo, hi) in BOUNDS.items()}


def dump(names: list[str], values: dict[str, int]) -> str:
    return json.dumps({"format": FORMAT, "version": VERSION, "blocked": blocked_names(names), "settings": clamped(values)}, sort_keys=True, separators=(",", ":"))


def load(text: str) -> tuple[list[str], dict[str, int]]:
    """Names and settings; raises for texts that are too large, of another format or version, or invalid."""
    if len(text.encode()) > MOST_BYTES:
        raise ValueError("the text is too large")
    raw = json.loads(text)
    if not isinstance(raw, dict) or (raw.get("format"), raw.get("version")) != (FORMAT, VERSION):
        raise ValueError("unknown format or version")
    for k, v in raw.get("settings", {}).items():
        if k in BOUNDS and (not isinstance(v, int) or not BOUNDS[k][0] <= v <= BOUNDS[k][1]):
            raise ValueError(f"{k} is out of bounds")
    return blocked_names(raw.get("blocked", [])), clamped(raw.get("settings", {}))


def search_identity(query: str, scopes: list[str]) -> str:
    """Under which a recent search counts as the same."""
    return query.strip().lower() + "\0" + ",".join(sorted(set(scopes)))


def recent_searches(entries: list[dict], now: float, most: int = 10, days: int = 30) -> list[dict]:
    """The newest entry of each search (query, scopes, at), newest first; old, future and malformed ones are dropped."""
    kept: dict[str, dict] = {}
    for e in entries:
        if isinstance(e.get("query"), str) and e["query"].strip() and isinstance(e.get("at"), (int, float)) and now - days * 86_400 <= e["at"] <= now:
            key = search_identity(e["query"], e.get("scopes", []))
            if key not in kept or kept[key]["at"] < e["at"]:
                kept[key] = e
    return sorted(kept.values(), key=lambda e: -e["at"])[:most]
