"""Remembering what was computed for texts that recur."""

from __future__ import annotations

import functools
from collections.abc import Callable

#: Texts remembered at a time, and the longest one that is, so that a worker holds a few MB at most.
TEXTS, LONGEST = 1024, 4096


def remembered(f: Callable) -> Callable:
    """``f`` of one text, computed once for recent texts that aren't long."""
    known = functools.lru_cache(maxsize=TEXTS)(f)

    @functools.wraps(f)
    def told(text):
        return known(text) if text is None or len(text) <= LONGEST else f(text)

    return told
