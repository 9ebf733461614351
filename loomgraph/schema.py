"""Schemas of the fact relations, and the closed lists in their order of precedence."""

from __future__ import annotations

SCHEMA_VERSION = 1

SCHEMAS: dict[str, str] = {
    "meta": "key string, value string",
    "project": "config_path string, fidelity string, root_file_count int, analysed_at string, fingerprint string, cause string, postinstall boolean",
    "file": "path string, content_hash string, size long, mtime_ms double, export_shape_hash string",
    "seen_file": "path string",
    "file_import": "from_path string, specifier string, to_path string",
    "file_project": "path string, project string, canonical boolean",
    "symbol": "id string, path string, descriptors string, qualified string, name string, kind string, start int, line int, durable boolean, callable boolean, collisions int",
    "declaration": "path string, start int, id string",
    "call_edge": "from_id string, to_id string, attribution string, path string, line int, provenance string, derivation string",
    "reference_edge": "from_id string, to_id string, kind string, path string, line int, provenance string, derivation string",
    "label": "node string, axis string, value string, provenance string, derivation string",
    "unresolved_call": "path string, line int, cause string, name string",
    "unresolved_specifier": "path string, specifier string, line int, cause string",
}

#: Keys, and whether the first or the last of equal ones stays.
KEYS: dict[str, tuple[list[str], str]] = {
    "meta": (["key"], "last"), "project": (["config_path"], "last"), "file": (["path"], "last"), "seen_file": (["path"], "first"), "file_import": (["from_path", "specifier"], "last"), "file_project": (["path", "project"], "first"),
    "symbol": (["id"], "first"), "declaration": (["path", "start"], "first"), "label": (["node", "axis", "derivation"], "last"),
}

ENUMS: dict[str, tuple[str, ...]] = {
    "kind": ("function", "class", "interface", "typeAlias", "enum", "variable", "method", "namespace"),
    "attribution": ("symbol", "variable", "file"),
    "provenance": ("deterministic", "syntactic", "inferred"),
    "call_cause": ("external", "unresolvable", "dynamic"),
    "reference_kind": ("references", "extends", "implements", "typeReferences"),
    "role": ("source", "test", "config"),
    "authorship": ("authored", "generated"),
    "fidelity": ("typed", "syntactic"),
    "precondition": ("unprepared", "missing-generated", "unmapped", "broken"),
    "terminus": ("leaf", "depth", "cycle"),
    "change": ("added", "changed", "removed"),
    "verdict": ("verified", "contradicted", "potentially-stale", "unable-to-verify"),
}
