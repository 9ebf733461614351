"""Forms of text that keys and names are made of."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a name that a descriptor keeps.
NAME_CAP = 96


def squeezed(text: Column, cap: int = NAME_CAP) -> Column:
    """A text with runs of white space as one blank and none at its ends, cut after ``cap`` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")), 1, cap)


def canonical_map(entries: Column) -> Column:
    """JSON of a map of strings with its keys in byte order, so that order of writing makes no difference."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def canonical_json(value: Any) -> str:
    """JSON of any value with the keys of all objects in order and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
