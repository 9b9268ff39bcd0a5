"""Answers of a language model as requests: keywords, criteria, JSON inside text. Parsing only; no model is called here."""

from __future__ import annotations

import json
import re

CATEGORIES = ("method", "material", "theory", "application", "data", "phenomenon", "other")
_ALIASES = {"methods": "method", "technique": "method", "techniques": "method", "materials": "material", "theories": "theory", "applications": "application", "dataset": "data", "datasets": "data", "phenomena": "phenomenon"}


def extract_json(content: str) -> str:
    """From the first opening bracket to the last closing one of its kind; the text itself if there is none."""
    found = min((i for i in (content.find("["), content.find("{")) if i >= 0), default=-1)
    if found < 0:
        return content
    end = content.rfind("]" if content[found] == "[" else "}")
    return content[found : end + 1] if end > found else content[found:]


def parse_keywords(content: str) -> list[str]:
    """Keywords of a JSON list, of an object's ``keywords``, or of lines (bullets and numbers go); each once, in order."""
    try:
        value = json.loads(extract_json(content))
        value = value.get("keywords", []) if isinstance(value, dict) else value
        words = [str(v) for v in (value if isinstance(value, list) else [value])]
    except (ValueError, AttributeError):
        words = [re.sub(r"^\s*(?:[-*•]|\d+[.)])\s*|^\s*keywords?\s*:\s*", "", line, flags=re.I) for line in content.splitlines()]
    return list(dict.fromkeys(w.strip().strip("\"'") for w in words if w.strip()))


def parse_criteria(content: str) -> list[dict]:
    """Criteria with positive weights that sum to one (four places)."""
    try:
        value = json.loads(extract_json(content))
    except ValueError:
        return []
    rows = value.get("criteria", []) if isinstance(value, dict) else value
    kept = [(str(r.get("name") or r.get("criterion") or ""), float(r.get("weight") or 0)) for r in rows if isinstance(r, dict)]
    kept = [(n, w) for n, w in kept if n and w > 0]
    total = sum(w for _, w in kept)
    return [{"name": n, "weight": round(w / total, 4)} for n, w in kept]


def category(value: object) -> str:
    """A known category, by name or alias; ``other`` for the rest."""
    name = re.sub(r"[^a-z]+", "", str(value or "").lower())
    name = _ALIASES.get(name, name)
    return name if name in CATEGORIES else "other"
