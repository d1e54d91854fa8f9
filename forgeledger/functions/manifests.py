"""Readers for structured dependency manifests. One call handles the text of one file."""

from __future__ import annotations

import ast
import tomllib

STRUCTURED = ("pyproject.toml", "pipfile", "setup.py")

Entry = tuple[str, str | None]


class Unreadable(ValueError):
    """The file cannot be read; the message says why."""


def structured_entries(file_name: str, text: str | None) -> tuple[list[Entry], str | None]:
    """Entries as (requirement line, None) or (name, spec), and why the file was rejected, if it was.

    A rejected file has no entries; no text, however odd, raises.
    """
    try:
        if text is None:
            raise Unreadable("no text")
        return _READERS[file_name.lower()](text), None
    except Unreadable as why:
        return [], str(why)
    except (RecursionError, MemoryError):
        return [], "nested too deeply"


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except ValueError:
        raise Unreadable("not valid TOML") from None


def _table(parent: dict, name: str) -> dict:
    found = parent.get(name, {})
    if not isinstance(found, dict):
        raise Unreadable(f"{name} is not a table")
    return found


def _pipfile(text: str) -> list[Entry]:
    packages = _table(_toml(text), "packages")
    return [(name, "" if s == "*" else _spec(s)) for name, s in packages.items()]


def _pyproject(text: str) -> list[Entry]:
    data = _toml(text)
    project = _table(data, "project")
    if "dependencies" in project:
        listed = project["dependencies"]
        if not isinstance(listed, list) or not all(isinstance(line, str) for line in listed):
            raise Unreadable("dependencies is not a list of texts")
        return [(line, None) for line in listed]
    table = _table(_table(_table(data, "tool"), "poetry"), "dependencies")
    return [(name, _spec(s)) for name, s in table.items() if name != "python"]


def _spec(value: object) -> str:
    if isinstance(value, dict):
        value = value.get("version", "")
    return value if isinstance(value, str) else ""


def _setup_call(text: str) -> list[Entry]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        raise Unreadable("not valid Python") from None
    calls = (n for n in ast.walk(tree) if isinstance(n, ast.Call) and getattr(n.func, "id", None) == "setup")
    lists = (k.value for call in calls for k in call.keywords if k.arg == "install_requires")
    items = (item for found in lists if isinstance(found, ast.List) for item in found.elts)
    return [(i.value, None) for i in items if isinstance(i, ast.Constant) and isinstance(i.value, str)]


_READERS = {"pyproject.toml": _pyproject, "pipfile": _pipfile, "setup.py": _setup_call}
