"""Settings: defaults, then a file, then the environment, then arguments; and checks of paths."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from pathlib import PurePosixPath

#: Names of the environment begin with this: SIEVEWORK_MODEL, SIEVEWORK_EXCLUDE=a,b.
PREFIX = "SIEVEWORK_"
#: Files that are looked for, in order.
NAMES = ("sievework.toml", ".sievework.toml", "sievework.json", ".sievework.json")


@dataclass(frozen=True)
class Settings:
    """What plans need besides data."""

    model: str = "claude"
    form: str = "xml"
    budget: int = 100_000
    preset: str = "accurate"
    include: tuple[str, ...] = field(default=())
    exclude: tuple[str, ...] = field(default=())
    tests: bool = True
    docs: bool = True
    redact: bool = True
    strategy: str = "line"

    def as_dict(self) -> dict:
        return asdict(self)


def _typed(name: str, value: object) -> object:
    """A value as its field's type; an error if it is none."""
    default = getattr(Settings(), name)
    if isinstance(default, bool):
        if isinstance(value, str):
            if value.lower() not in ("true", "false", "1", "0", "yes", "no"):
                raise ValueError(f"{name}: {value!r} is neither true nor false")
            return value.lower() in ("true", "1", "yes")
        return bool(value)
    if isinstance(default, int):
        return int(value)
    if isinstance(default, tuple):
        return tuple(v for v in value.split(",") if v) if isinstance(value, str) else tuple(value)
    return str(value)


def read_file(path: str) -> dict:
    """The settings in a TOML or JSON file."""
    with open(path, "rb") as file:
        return tomllib.load(file) if path.endswith(".toml") else json.load(file)


def settings(folder: str | None = None, environment: Mapping[str, str] | None = None, **given: object) -> Settings:
    """The merged settings; unknown names are an error, and None counts as not given."""
    environment = os.environ if environment is None else environment
    known = {f.name for f in fields(Settings)}
    merged: dict[str, object] = {}
    found = next((f"{folder}/{n}" for n in NAMES if folder and os.path.exists(f"{folder}/{n}")), None)
    named = {k.removeprefix(PREFIX).lower(): v for k, v in environment.items() if k.startswith(PREFIX)}
    for values in (read_file(found) if found else {}, named, {k: v for k, v in given.items() if v is not None}):
        if unknown := set(values) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        merged |= {k: _typed(k, v) for k, v in values.items()}
    return Settings(**merged)


def template() -> str:
    """A TOML file with all defaults."""
    return "".join(f"{k} = {json.dumps(list(v) if isinstance(v, tuple) else v)}\n" for k, v in Settings().as_dict().items())


def inside(root: str, path: str) -> str:
    """``path`` below ``root``; an error if it leads out of it."""
    parts: list[str] = []
    for part in PurePosixPath(path).parts:
        if part == "..":
            if not parts:
                raise ValueError(f"{path!r} leads out of {root!r}")
            parts.pop()
        elif part == "/":
            raise ValueError(f"{path!r} is not below {root!r}")
        elif part != ".":
            parts.append(part)
    return "/".join([root.rstrip("/"), *parts])
