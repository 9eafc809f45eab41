"""Terms as text, for people."""

from __future__ import annotations

import datetime as dt
from typing import Any


def show_term(value: Any, is_iri: bool = False) -> str:
    """IRIs in angle brackets, strings in quotes, numbers with a point where they are not integers, null as UNBOUND."""
    if value is None:
        return "UNBOUND"
    if hasattr(value, "asDict"):
        entry = value.asDict()
        if set(entry) == {"kind", "lex", "dt"}:
            if entry["kind"] == "iri":
                return f"<{entry['lex']}>"
            return f'"{entry["lex"]}"' if (entry["dt"] or "").endswith("#string") else str(entry["lex"])
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.1f}" if value == value and abs(value) < 1e16 and value == int(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, str):
        return f"<{value}>" if is_iri else f'"{value}"'
    return str(value)
