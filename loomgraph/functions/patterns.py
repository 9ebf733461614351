"""The five glob dialects, as anchored regular expressions for ``rlike``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_glob(pattern: str) -> str:
    """``*`` is any run of characters, ``?`` one; slashes mean nothing."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def path_glob(pattern: str) -> str:
    """``**/`` is any number of folders, ``**`` anything, ``*`` and ``?`` stay within a segment."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return "^" + out + "$"


def config_glob(pattern: str) -> str:
    """As ``path_glob``; a pattern whose last segment has neither star nor dot names a folder and all below it."""
    last = pattern.rstrip("/").rpartition("/")[2]
    return path_glob(pattern.rstrip("/") + "/**/*" if not re.search(r"[*?.]", last) else pattern)


def starred(pattern: str) -> str:
    """A mapping with one star: the text before and after it is literal."""
    return "^" + "(.*)".join(map(re.escape, pattern.split("*", 1))) + "$"


def any_of(column: Column, regexes: list[str]) -> Column:
    out = F.lit(False)
    for r in regexes:
        out = out | column.rlike(r)
    return out


def globbed(column: Column, include: list[str], exclude: list[str], files: list[str] = ()) -> Column:
    """Whether a configuration takes a path in: listed, or included and not excluded."""
    return column.isin(*files) | (any_of(column, [config_glob(p) for p in include]) & ~any_of(column, [config_glob(p) for p in exclude]))
