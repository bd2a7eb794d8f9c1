"""Templates of TO_CHAR as patterns of date_format."""

from __future__ import annotations

#: Template tokens and the pattern that stands for each. Longer tokens are tried first.
TOKENS = {
    "YYYY": "yyyy", "YY": "yy",
    "MONTH": "MMMM", "Month": "MMMM", "month": "MMMM",
    "MON": "MMM", "Mon": "MMM", "mon": "MMM",
    "MM": "MM", "MI": "mm",
    "DDD": "DDD", "DD": "dd",
    "DAY": "EEEE", "Day": "EEEE", "day": "EEEE",
    "DY": "EEE", "Dy": "EEE", "dy": "EEE",
    "HH24": "HH", "HH12": "hh", "HH": "hh",
    "SS": "ss",
    "AM": "a", "PM": "a", "am": "a", "pm": "a",
    "TZ": "zzz",
    "FM": "",
}

_BY_LENGTH = sorted(TOKENS, key=len, reverse=True)


def java_pattern(template: str) -> str:
    """The pattern of a template; what is no token stands for itself, FM for nothing."""
    out, plain, at = [], "", 0

    def flush() -> None:
        nonlocal plain
        if plain:
            quoted = plain.replace("'", "''")
            out.append(f"'{quoted}'" if any(c.isalpha() or c in "'[]{}#" for c in plain) else plain)
            plain = ""

    while at < len(template):
        token = next((t for t in _BY_LENGTH if template.startswith(t, at)), None)
        if token is None:
            plain += template[at]
            at += 1
            continue
        flush()
        out.append(TOKENS[token])
        at += len(token)
    flush()
    return "".join(out)
