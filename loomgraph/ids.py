"""Symbol ids: ``loom <manager> <package> <version> <file>/<descriptors>``.

Descriptor suffixes: ``/`` namespace, ``#`` type, ``.`` term, ``().`` method. A name of word
characters, ``$``, ``+`` and ``-`` stands bare; any other is in backticks, a backtick in it twice.
A space in a header field is written twice. Parsed parts are stored as columns, so queries never
parse; ``parse_column`` is for facts that come with ids only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEME = "loom"
SUFFIX = {"function": "().", "method": "().", "class": "#", "interface": "#", "typeAlias": "#", "enum": "#", "variable": ".", "namespace": "/"}
_BARE = re.compile(r"^[\w$+-]+$", re.ASCII)
_PART = re.compile(r"(?:`((?:[^`]|``)*)`|([\w$+-]+))(\(\)\.|[/#.])", re.ASCII)


def escape(name: str) -> str:
    return name if _BARE.match(name) else "`" + name.replace("`", "``") + "`"


def descriptor(name: str, kind: str) -> str:
    return escape(name) + SUFFIX[kind]


def build(manager: str, package: str, version: str, path: str, descriptors: str) -> str:
    head = " ".join(x.replace(" ", "  ") or "." for x in (SCHEME, manager, package, version))
    return f"{head} {'/'.join(escape(p) for p in path.split('/'))}/{descriptors}"


_PARTS = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "descriptors", "qualified", "shorthand")])


@dataclass(frozen=True)
class Parsed:
    manager: str
    package: str
    version: str
    path: str
    descriptors: str
    names: tuple[str, ...]

    @property
    def dotted(self) -> str:
        return ".".join(self.names)

    @property
    def shorthand(self) -> str:
        return f"{self.path}#{self.dotted}" if self.names else self.path


def parse(symbol: str) -> Parsed | None:
    """None for anything that isn't an id. The file is all path parts up to the first with a file extension."""
    head = re.match(r"^((?:[^ ]|  )+) ((?:[^ ]|  )+) ((?:[^ ]|  )+) ((?:[^ ]|  )+) (.*)$", symbol, re.S)
    if not head or head[1] != SCHEME:
        return None
    text, at, parts = head[5], 0, []
    segment = re.compile(r"(?:`((?:[^`]|``)*)`|([^`/]+))/")
    while m := segment.match(text, at):
        parts.append(m[1].replace("``", "`") if m[1] is not None else m[2])
        at = m.end()
        if re.search(r"\.[A-Za-z0-9]+$", parts[-1]):
            break
    rest, names, k = text[at:], [], 0
    while k < len(rest):
        m = _PART.match(rest, k)
        if not m:
            return None
        names.append(m[1].replace("``", "`") if m[1] is not None else m[2])
        k = m.end()
    plain = [h.replace("  ", " ") for h in (head[2], head[3], head[4])]
    return Parsed(*["" if h == "." else h for h in plain], "/".join(parts), rest, tuple(names)) if parts else None


@F.pandas_udf(_PARTS)
def parse_column(ids: pd.Series) -> pd.DataFrame:
    """path, descriptors, dotted name and shorthand of ids; nulls for what isn't an id."""
    found = [parse(x) if isinstance(x, str) else None for x in ids]
    return pd.DataFrame([(p.path, p.descriptors, p.dotted, p.shorthand) if p else (None,) * 4 for p in found], columns=["path", "descriptors", "qualified", "shorthand"])


def shorthand(path: Column, qualified: Column) -> Column:
    return F.when(F.coalesce(qualified, F.lit("")) == "", path).otherwise(F.concat_ws("#", path, qualified))
