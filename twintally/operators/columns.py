"""Column names of untidy deliveries. Names are few, so this is plain Python."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence

from twintally.functions.text import VALUE_PREFIXES

# Shares from which a prefix is taken to belong to all names or values.
PREFIX_NAME_SHARE = 0.30
PREFIX_VALUE_SHARE = 0.50


def generated_names(n: int) -> list[str]:
    return [f"Col_{i}" for i in range(1, n + 1)]


def dedup_columns(names: Iterable[str]) -> list[str]:
    """Second ``X`` becomes ``X_1``, third ``X_2``, or the next that no column has; names
    that differ in case only count as equal, since Spark resolves columns that way."""
    names = list(names)
    taken = {name.lower() for name in names}
    seen: set[str] = set()
    times: Counter[str] = Counter()
    result = []
    for name in names:
        own = name
        while own.lower() in seen or (own != name and own.lower() in taken):
            times[name.lower()] += 1
            own = f"{name}_{times[name.lower()]}"
        seen.add(own.lower())
        result.append(own)
    return result


def is_artifact(name: str) -> bool:
    """Names that a stray separator leaves behind: blank, no word character, 'Unnamed: 3'."""
    return not re.search(r"\w", name) or re.fullmatch(r"unnamed:\s*\d+", name.strip().lower()) is not None


def prefix_chars(names: Sequence[str], marked_values: Mapping[str, int], n_values: int, sep: str) -> str:
    """Characters to strip from the left of names and values.

    They are the special characters of the separator, plus one known prefix that
    enough names carry, plus one that enough of all ``n_values`` values of the first
    column carry; ``marked_values`` counts these by prefix.
    """
    chars = {c for c in sep if not c.isalnum() and c != "_"}
    on_names = Counter(n[0] for n in names if n and n[0] in VALUE_PREFIXES and n[0] not in chars)
    for counts, enough in ((on_names, max(1, len(names) * PREFIX_NAME_SHARE)), (marked_values, n_values * PREFIX_VALUE_SHARE)):
        mark = max(counts, key=lambda c: (counts[c], -ord(c)), default=None)
        if mark is not None and counts[mark] >= enough:
            chars.add(mark)
    return "".join(sorted(chars))
