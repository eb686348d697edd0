"""Options from command lines and dictionaries, for any of the frozen dataclasses of options."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence


def described(options: type) -> str:
    """A line per option: its flag, kind and default."""
    return "\n".join(f"--{f.name.replace('_', '-')} ({f.type}, default {f.default})" for f in dataclasses.fields(options))


def from_args(options: type, args: Sequence[str]):
    """An options object; flags as --name value or --name=value, unknown ones raise ValueError."""
    fields = {f.name: f for f in dataclasses.fields(options)}
    found, k = {}, 0
    while k < len(args):
        flag, _, value = args[k].partition("=")
        name = flag.removeprefix("--").replace("-", "_")
        if not flag.startswith("--") or name not in fields:
            raise ValueError(f"no option {flag}; there are\n{described(options)}")
        if not _:
            k += 1
            value = args[k] if k < len(args) else ""
        found[name] = _parsed(value, fields[name].default)
        k += 1
    return options(**found)


def _parsed(value: str, default):
    if isinstance(default, bool):
        return value.lower() in ("1", "true", "yes", "on")
    if isinstance(default, int):
        return int(value)
    if isinstance(default, float):
        return float(value)
    if default is None or isinstance(default, tuple):
        return tuple(int(v) for v in value.split(","))
    return value
