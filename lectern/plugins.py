"""Registries of named parts (rules, validators, classifiers, splitters, readers, repairers) and their settings."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from difflib import get_close_matches
from typing import Any

HIDDEN = "<set>"
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off", "")


class SettingsError(Exception):
    """A mistake in a name or a setting, told to the person who made it."""


@dataclass(frozen=True)
class Setting:
    name: str
    kind: type = str
    default: Any = None
    required: bool = False
    secret: bool = False


class Registry(dict):
    """Parts by name; a name is given once, and a part may name the document types that it is for."""

    def __init__(self, what: str):
        super().__init__()
        self.what = what

    def register(self, name: str, applies_to: Iterable[str] = (), settings: Iterable[Setting] = ()) -> Callable:
        if name in self:
            raise SettingsError(f"{self.what} {name!r} is registered already")

        def keep(part):
            part.applies_to, part.settings = tuple(applies_to), tuple(settings)
            self[name] = part
            return part

        return keep

    def pick(self, name: str):
        if name not in self:
            raise SettingsError(f"no {self.what} {name!r}{_hint(name, self)}")
        return self[name]

    def enabled(self, switches: Mapping[str, bool] | None = None, doc_type: str = "") -> dict[str, Any]:
        """Parts in the order of their names: all but those switched off or for other types; an unknown name is an error."""
        switches = dict(switches or {})
        for name in switches:
            self.pick(name)
        return {n: self[n] for n in sorted(self) if switches.get(n, True) and (not doc_type or not self[n].applies_to or doc_type in self[n].applies_to)}


def _hint(name: str, known: Iterable[str]) -> str:
    near = get_close_matches(name, list(known), n=1, cutoff=0.7)
    return f"; did you mean {near[0]!r}?" if near else ""


def variable(plugin: str, setting: str, prefix: str = "DI") -> str:
    return "_".join((prefix, re.sub("[^A-Za-z0-9]+", "_", plugin).strip("_"), setting)).upper()


def bind(plugin: str, settings: Iterable[Setting], block: Mapping | None = None, env: Mapping | None = None, overrides: Mapping | None = None) -> dict[str, Any]:
    """Values of a part's settings.  A default yields to the manifest's block, that to the environment, that to an override.

    `${NAME}` in the block stands for a variable; empty variables and overrides count as unset.
    """
    settings, env, block = tuple(settings), os.environ if env is None else env, block or {}
    known = [s.name for s in settings]
    for name in block:
        if name not in known:
            raise SettingsError(f"{plugin} has no setting {name!r}{_hint(name, known)}")
    out = {}
    for s in settings:
        layers = [(overrides or {}).get(s.name), env.get(variable(plugin, s.name))]
        value = next((v for v in layers if v not in (None, "")), None)
        if value is None:
            value = block.get(s.name, s.default)
            named = re.fullmatch(r"\s*\$\{([A-Za-z_]\w*)\}\s*", value) if isinstance(value, str) and s.name in block else None
            value = env.get(named[1]) or None if named else value
        out[s.name] = _typed(plugin, s, value)
        if s.required and out[s.name] in (None, ""):
            raise SettingsError(f"{plugin} needs {s.name!r}: set it in the manifest or as {variable(plugin, s.name)}")
    return out


def _typed(plugin: str, s: Setting, value: Any) -> Any:
    if value is None or s.kind is bool and isinstance(value, bool):
        return value
    if s.kind is bool:
        word = str(value).strip().lower()
        if word in TRUE + FALSE:
            return word in TRUE
    else:
        try:
            return s.kind(value)
        except (TypeError, ValueError):
            pass
    raise SettingsError(f"{plugin}.{s.name}: {value!r} is no {s.kind.__name__}")


def redact(values: Mapping[str, Any], settings: Iterable[Setting]) -> dict[str, Any]:
    """The values with secrets masked, fit to be recorded."""
    secret = {s.name for s in settings if s.secret}
    return {k: HIDDEN if k in secret and v else v for k, v in values.items()}
