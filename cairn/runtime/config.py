"""Layered configuration: a profile, files and overrides merged over defaults that name every key there is."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

#: Keys whose values are never shown.
SECRET = ("secret", "token", "password", "api_key")


class ConfigError(ValueError):
    """All problems of a configuration at once, by path."""

    def __init__(self, problems: list[str]) -> None:
        super().__init__("; ".join(problems))
        self.problems = problems


def merge(base: Mapping[str, Any], over: Mapping[str, Any], path: str = "", problems: list[str] | None = None) -> dict[str, Any]:
    """``base`` with the values of ``over``, section by section. Keys that ``base`` has not, and values of another kind than its, are
    problems; where it has None anything goes, and an int goes for a float."""
    found = [] if problems is None else problems
    out = dict(base)
    for key, value in over.items():
        at = f"{path}.{key}" if path else key
        if key not in base:
            found.append(f"{at}: no such key")
        elif isinstance(base[key], Mapping):
            if isinstance(value, Mapping):
                out[key] = merge(base[key], value, at, found)
            else:
                found.append(f"{at}: a section is expected")
        elif base[key] is not None and value is not None and type(value) is not type(base[key]) and not (isinstance(base[key], float) and type(value) is int):
            found.append(f"{at}: {type(base[key]).__name__} is expected, not {type(value).__name__}")
        else:
            out[key] = value
    if problems is None and found:
        raise ConfigError(found)
    return out


def parse_override(text: str) -> dict[str, Any]:
    """``a.b=value`` as nested sections; the value is JSON, or else text."""
    path, equals, value = text.partition("=")
    if not equals or not all(path.split(".")):
        raise ConfigError([f"{text!r}: an override is path=value"])
    try:
        found: Any = json.loads(value)
    except ValueError:
        found = value
    for key in reversed(path.split(".")):
        found = {key: found}
    return found


def load(defaults: Mapping[str, Any], profile: Mapping[str, Any] | None = None, files: list[str] | None = None, overrides: list[str] | None = None) -> dict[str, Any]:
    """The effective configuration: ``defaults``, then the profile, the JSON files and the overrides in turn, the later ones stronger."""
    out = merge(defaults, profile or {})
    for name in files or []:
        out = merge(out, json.loads(Path(name).read_text()))
    for text in overrides or []:
        out = merge(out, parse_override(text))
    return out


def digest(config: Any) -> str:
    """Of the configuration as canonical JSON, the same in whatever order its keys come."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def redacted(config: Any) -> Any:
    """The configuration to be shown: values of secret keys are replaced at whatever depth."""
    if isinstance(config, Mapping):
        return {k: "[redacted]" if any(s in str(k).lower() for s in SECRET) and v is not None else redacted(v) for k, v in config.items()}
    if isinstance(config, list | tuple):
        return [redacted(v) for v in config]
    return config
