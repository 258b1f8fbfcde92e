"""Compiler configurations, path aliases and rule-set look-up: written lists of a project, read on the driver.

Texts come as a mapping from path to content, so any reader of files can feed them.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Mapping

from weftline.sources.symbols import without_comments


def parsed(text: str | None) -> dict | None:
    """A configuration with comments and trailing commas; None if it is missing or no object."""
    import re

    if text is None:
        return None
    try:
        found = json.loads(re.sub(r",(\s*[}\]])", r"\1", without_comments(text)))
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def parent_of(path: str, specifier: str, texts: Mapping[str, str]) -> str | None:
    """Path of the configuration that another extends: relative, else a package's, by itself, with .json or as its folder's."""
    here = posixpath.dirname(path)
    if specifier.startswith(("./", "../")):
        base = posixpath.normpath(posixpath.join(here, specifier))
        options = [base] if base.endswith(".json") else [base + ".json", base]
    else:
        base = posixpath.join(here, "node_modules", specifier)
        options = [posixpath.join(base, "tsconfig.json"), base, base + ".json"]
    return next((p for p in options if p in texts), None)


def inherited(path: str, texts: Mapping[str, str]) -> dict | None:
    """base_dir and paths of a configuration and those it extends; the nearer wins, paths key by key.

    A cycle ends the chain.  None if the file is missing or broken.
    """
    chain, seen = [], set()
    while path is not None and path not in seen:
        seen.add(path)
        found = parsed(texts.get(path))
        if found is None:
            break
        chain.append((path, found.get("compilerOptions") or {}))
        path = parent_of(path, found["extends"], texts) if isinstance(found.get("extends"), str) else None
    if not chain:
        return None
    out = {"base_url": None, "paths": {}}
    for _, options in reversed(chain):
        out["base_url"] = options.get("baseUrl") or out["base_url"]
        out["paths"] |= options.get("paths") or {}
    out["base_dir"] = posixpath.normpath(posixpath.join(posixpath.dirname(chain[0][0]), out.pop("base_url") or "."))
    return out


def nearest(folder: str, texts: Mapping[str, str], name: str = "tsconfig.json") -> str | None:
    """Path of the configuration in a folder or the closest one above it."""
    folder = posixpath.normpath(folder)
    while True:
        path = posixpath.join(folder, name) if folder != "." else name
        if path in texts:
            return path
        if folder in (".", "/", ""):
            return None
        folder = posixpath.dirname(folder) or "."


def aliases(folders: list[str], texts: Mapping[str, str]) -> list[tuple[str, str]]:
    """(pattern, target) of the configurations nearest to component folders, each read once; targets from the root.

    The first target of a pattern counts, as `symbols.resolved_aliases` takes one.
    """
    out, seen = [], set()
    for folder in folders:
        path = nearest(folder, texts)
        if path is None or path in seen:
            continue
        seen.add(path)
        found = inherited(path, texts)
        for pattern, targets in (found or {"paths": {}})["paths"].items():
            if targets:
                out.append((pattern, posixpath.normpath(posixpath.join(found["base_dir"], targets[0]))))
    return out


def ruleset(name: str, texts: Mapping[str, str], built_in: Mapping[str, str], folder: str = ".") -> str | None:
    """Text of a rule set: a path, a built-in name, then the folder's file of that name, with and without .md."""
    if name in texts:
        return texts[name]
    if name in built_in:
        return built_in[name]
    for path in (posixpath.normpath(posixpath.join(folder, name)), posixpath.normpath(posixpath.join(folder, name + ".md"))):
        if path in texts:
            return texts[path]
    return None


def layered(deps: Mapping[str, list[str]]) -> str:
    """Components in layers by their longest chain of dependencies, one line each with what they need; a cycle comes last."""
    rest, level, depth = set(deps), 0, {}
    while rest:
        free = {c for c in rest if all(d not in rest or d == c for d in deps[c])}
        for c in free or rest:
            depth[c] = level if free else None
        rest -= free or set(rest)
        level += 1
    lines = []
    for c in sorted(deps, key=lambda c: (depth[c] is None, depth[c] or 0, c)):
        needs = ", ".join(sorted(set(deps[c]) - {c}))
        lines.append(f"{'  ' * (depth[c] or 0)}{'(cycle) ' if depth[c] is None else ''}{c}{' <- ' + needs if needs else ''}")
    return "\n".join(lines)
