"""Configuration files: JSON with comments and trailing commas, and projects that extend others."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable


def read_jsonc(text: str) -> object:
    """Parses JSON with ``//`` and ``/* */`` comments and trailing commas; strings are left alone."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else n
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            if end < 0:
                raise ValueError("comment without an end")
            i = end + 2
        elif c in "}]":
            k = len(out) - 1
            while k >= 0 and not out[k].strip():
                k -= 1
            if k >= 0 and out[k] == ",":
                out[k] = " "
            out.append(c)
            i += 1
        else:
            out.append(c)
            i += 1
    return json.loads("".join(out))


def read_project(path: str, load: Callable[[str], str]) -> dict:
    """A project file with what it extends merged in: options by key, file lists replaced as wholes."""

    def visit(at: str, seen: tuple[str, ...]) -> dict:
        if at in seen:
            raise ValueError(f"{at} extends itself")
        own = read_jsonc(load(at))
        bases = own.get("extends") or []
        merged: dict = {"compilerOptions": {}}
        for base in [bases] if isinstance(bases, str) else bases:
            target = posixpath.normpath(posixpath.join(posixpath.dirname(at), base if base.endswith(".json") else base + ".json"))
            got = visit(target, (*seen, at))
            merged["compilerOptions"] |= got.get("compilerOptions", {})
            merged |= {k: v for k, v in got.items() if k in ("files", "include", "exclude")}
        merged["compilerOptions"] |= own.get("compilerOptions", {})
        return merged | {k: v for k, v in own.items() if k not in ("extends", "compilerOptions")}

    return visit(path, ())
