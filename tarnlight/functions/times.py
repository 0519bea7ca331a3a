"""Times and durations in text."""

from __future__ import annotations

import re
from datetime import datetime, timezone, tzinfo

_UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
_LONG = {"d": 24, "w": 7 * 24}
_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)")
_RFC = re.compile(r"(\d{4}-\d\d-\d\d)[Tt](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|z|[+-]\d\d:\d\d)$")
_LOOSE = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d")


def duration_ns(text: str) -> int:
    """Nanoseconds of a duration like 1h30m, 250ms or -1.5s."""
    sign, rest = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    if rest == "0":
        return 0
    parts = _PART.findall(rest)
    if not parts or "".join(n + u for n, u in parts) != rest:
        raise ValueError(f"not a duration: {text!r}")
    return sign * sum(int(float(n) * _UNITS[u]) if "." in n else int(n) * _UNITS[u] for n, u in parts)


def since_ns(text: str) -> int:
    """duration_ns, with whole days (7d) and weeks (2w) besides."""
    text = text.strip()
    if text[-1:] in _LONG:
        if not re.fullmatch(r"[+-]?\d+", text[:-1]):
            raise ValueError(f"not a duration: {text!r}")
        return int(text[:-1]) * _LONG[text[-1]] * _UNITS["h"]
    return duration_ns(text)


def rfc3339_ns(text: str) -> int:
    """Nanoseconds since 1970 of a time with its offset, exact to the last digit."""
    m = _RFC.match(text)
    if not m:
        raise ValueError(f"not an RFC 3339 time: {text!r}")
    day, clock, fraction, zone = m.groups()
    whole = datetime.fromisoformat(f"{day}T{clock}{'+00:00' if zone in 'Zz' else zone}")
    return int(whole.timestamp()) * 1_000_000_000 + int((fraction or "0").ljust(9, "0"))


def time_ns(text: str, zone: tzinfo = timezone.utc) -> int:
    """rfc3339_ns, or a time without an offset, down to a mere day, in the given zone."""
    text = text.strip()
    try:
        return rfc3339_ns(text)
    except ValueError:
        pass
    for layout in _LOOSE:
        try:
            return int(datetime.strptime(text, layout).replace(tzinfo=zone).timestamp()) * 1_000_000_000
        except ValueError:
            continue
    raise ValueError(f"not a time: {text!r}")


def end_ms(text: str) -> int:
    """Milliseconds since 1970 of a whole number, which they are, or of an RFC 3339 time."""
    return int(text) if re.fullmatch(r"[+-]?\d+", text) else rfc3339_ns(text) // 1_000_000


def resolve_range(since: str = "", start: str = "", end: str = "", now_ns: int = 0, zone: tzinfo = timezone.utc) -> tuple[int | None, int | None]:
    """The two ends of a range, None where it is open; since, back from now, and start exclude each other."""
    if since and start:
        raise ValueError("since and start exclude each other")
    first = now_ns - since_ns(since) if since else time_ns(start, zone) if start else None
    return first, time_ns(end, zone) if end else None
