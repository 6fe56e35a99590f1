"""Taxon column names."""

from __future__ import annotations

import re
from collections.abc import Sequence

# Fixed value: characters a valid column name may hold besides letters and digits.
_INVALID = re.compile(r"[^\w.]")


def normalise_names(names: Sequence[str]) -> list[str]:
    """Cut each name at its first dot, make it a valid identifier, number the repeats.

    The first occurrence keeps its name, later ones get the suffixes ``.1``, ``.2``, ...
    """
    seen: dict[str, int] = {}
    out = []
    for raw in names:
        name = _INVALID.sub(".", raw.split(".")[0])
        if not name or not (name[0].isalpha() or name[0] == "."):
            name = f"X{name}"
        count = seen.get(name, 0)
        seen[name] = count + 1
        out.append(f"{name}.{count}" if count else name)
    return out
