"""Values as text, in the form that clients of the dialect expect."""

from __future__ import annotations

import datetime
import decimal
import math


def text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        if math.isinf(value):
            return "inf" if value > 0 else "-inf"
        return repr(value)
    if isinstance(value, datetime.datetime):
        base = value.strftime("%Y-%m-%d %H:%M:%S")
        return base + (f".{value.microsecond:06d}".rstrip("0") if value.microsecond else "")
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, (bytes, bytearray)):
        return "\\x" + bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return "{" + ",".join("NULL" if v is None else text(v) for v in value) + "}"
    return str(value)
