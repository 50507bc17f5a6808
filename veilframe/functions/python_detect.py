"""The detectors in plain Python: for single snippets, and as a second opinion on the Column expressions."""

from __future__ import annotations

import re
from functools import lru_cache

from veilframe.functions import patterns as P
from veilframe.kinds import BY_NAME, Settings


@lru_cache(maxsize=64)
def _compiled(settings: Settings) -> list[tuple[P.Detector, re.Pattern]]:
    return [(d, re.compile(d.python())) for d in P.detectors(settings)]


_EMAIL, _PLACEHOLDER = re.compile(P.EMAIL), re.compile(P.PLACEHOLDER)


def _digits(value: str) -> str:
    return "".join(c for c in value if c in "0123456789")


def luhn_valid(value: str) -> bool:
    d = [int(c) for c in reversed(_digits(value))]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def tckn_valid(value: str) -> bool:
    d = [int(c) for c in _digits(value)]
    return len(d) == 11 and d[0] != 0 and d[9] == (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10 and d[10] == sum(d[:10]) % 10


def is_placeholder(value: str) -> bool:
    return bool(_PLACEHOLDER.fullmatch(value))


def _credential(value: str) -> bool:
    v = value.rstrip(P.TRIM_END).lstrip(P.TRIM_START)
    if len(v) < 6 or "://" in v or v.lower().startswith("www.") or is_placeholder(v) or _EMAIL.search(v):
        return False
    return any(c.isalpha() for c in v) and bool(_digits(v)) and any(c in P.CREDENTIAL_SPECIALS for c in v)


_VALID = {
    "labelled_password": lambda v: len(v.strip("\"'")) >= 3,
    "credential": _credential,
    "credit_card": luhn_valid,
    "national_id": tckn_valid,
    "phone": lambda v: 10 <= len(_digits(v)) <= 12,
    "phone_international": lambda v: 9 <= len(_digits(v)) <= 14,
}


def detect(text: str, settings: Settings | None = None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of each match in order, overlaps resolved."""
    found = []
    for d, pattern in _compiled(settings or Settings()):
        for m in pattern.finditer(text):
            value, start, end = m[d.group], m.start(d.group), m.end(d.group)
            if not value or not _VALID.get(d.name, bool)(value) or is_placeholder(value):
                continue
            if d.kind == "phone" and _digits(text[max(0, start - 1):start] + text[end:end + 1]):
                continue
            found.append((start, start - end, BY_NAME[d.kind].order, d.kind, value))
    kept, reached = [], 0
    for start, neg_length, _, kind, value in sorted(found):
        if start >= reached:
            reached = start - neg_length
            kept.append((start, reached, kind, value))
    return kept
