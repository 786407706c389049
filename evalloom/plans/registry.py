"""Tasks, models and composable steps: plain driver-side tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Registry:
    """Names with aliases; ``pick`` takes one name, a comma list or ``all``."""

    kind: str
    entries: dict[str, object] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, entry: object, *aliases: str) -> None:
        self.entries[name] = entry
        self.aliases.update(dict.fromkeys(aliases, name))

    def resolve(self, name: str) -> str:
        full = self.aliases.get(name, name)
        if full not in self.entries:
            raise KeyError(f"unknown {self.kind}: {name}; known: {', '.join(sorted(self.entries))}")
        return full

    def pick(self, names: str) -> list[str]:
        if names == "all":
            return sorted(self.entries)
        return [self.resolve(n.strip()) for n in names.split(",") if n.strip()]


@dataclass(frozen=True)
class Step:
    """A function of a DataFrame; ``a >> b`` applies a, then b."""

    apply: Callable[[DataFrame], DataFrame]

    def __rshift__(self, other: Step | Callable[[DataFrame], DataFrame]) -> Step:
        after = other.apply if isinstance(other, Step) else other
        return Step(lambda df: df.transform(self.apply).transform(after))

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.transform(self.apply)


def by_suffix(routes: Mapping[Sequence[str], Callable], path: str) -> object:
    """Call the first route that has the path's suffix."""
    suffix = path.rsplit(".", 1)[-1].lower()
    for suffixes, f in routes.items():
        if suffix in suffixes:
            return f(path)
    raise ValueError(f"no route for {path}")


def close_schema(schema: Mapping) -> dict:
    """A JSON schema whose objects allow no other fields and require all of theirs."""
    out = {k: close_schema(v) if isinstance(v, Mapping) else [close_schema(x) if isinstance(x, Mapping) else x for x in v] if isinstance(v, list) else v for k, v in schema.items()}
    if out.get("type") == "object":
        out["additionalProperties"] = False
        out["required"] = sorted(out.get("properties", {}))
    return out
