"""Title rules as portable expression text and keyword tables."""

from __future__ import annotations

import re

GENDER_STRICT = "(CASE WHEN lower(query) LIKE '%womens%' THEN 'womens' WHEN lower(query) LIKE '%mens%' THEN 'mens' END)"
GENDER_LOOSE = "(CASE WHEN lower(query) LIKE '%women%' THEN 'womens' WHEN lower(query) LIKE '%men%' THEN 'mens' END)"

#: small keyword tables of our own; production lists are the caller's configuration
EXCLUDED = ("gizmo", "hot", "rod")
KEYWORDS = (("red", "bright"), ("blue", "cool"), ("plate", "metal"), ("ring", "metal"), ("economy", "grade"))


def keyword_pattern(words: tuple[str, ...], escape: bool = True) -> str:
    """An alternation between word boundaries, longest first."""
    return r"(?i)\b(" + "|".join((re.escape(w) if escape else w) for w in sorted(words, key=lambda w: (-len(w), w))) + r")\b"
