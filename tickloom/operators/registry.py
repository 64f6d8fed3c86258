"""Names of indicators and their configuration."""

from __future__ import annotations

import inspect
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Spec:
    """One configured output column."""

    name: str
    cls: str
    params: dict[str, Any] = field(default_factory=dict)
    category: str = ""


class Registry:
    """Maps class names to builders `(graph, **params) -> Node`.

    A builder may instead be marked `ordered`; it then runs as an ordered pass
    over the finished columns, see `operators.sequential`.
    """

    def __init__(self) -> None:
        self._builders: dict[str, Callable] = {}

    def register(self, name: str, builder: Callable | None = None):
        if builder is None:
            return lambda made: self.register(name, made)
        if name in self._builders:
            log.warning("replacing indicator %s", name)
        self._builders[name] = builder
        return builder

    def get(self, name: str) -> Callable | None:
        return self._builders.get(name)

    def names(self) -> list[str]:
        return list(self._builders)

    def check(self, specs: list[Spec]) -> tuple[list[Spec], list[str]]:
        """Split specs into usable ones and the names to skip.

        Skipped are unknown classes and parameters the builder does not take.
        """
        good, skipped = [], []
        for spec in specs:
            builder = self.get(spec.cls)
            try:
                if builder is None:
                    raise TypeError(f"no indicator class {spec.cls}")
                inspect.signature(builder).bind(None, **spec.params)
            except TypeError as problem:
                log.error("skipping %s: %s", spec.name, problem)
                skipped.append(spec.name)
            else:
                good.append(spec)
        return good, skipped


registry = Registry()
indicator = registry.register


def parse_config(config: dict[str, list[dict]]) -> list[Spec]:
    """category -> [{name, class, params}] as specs; a repeated name: the last one counts."""
    specs: dict[str, Spec] = {}
    for category, entries in config.items():
        for entry in entries:
            specs[entry["name"]] = Spec(entry["name"], entry["class"], dict(entry.get("params") or {}), category)
    return list(specs.values())


def load_config(path: str) -> list[Spec]:
    """Read an indicator configuration in YAML."""
    import yaml

    with open(path) as handle:
        return parse_config(yaml.safe_load(handle))
