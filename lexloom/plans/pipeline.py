"""Pipelines: named steps over named tables, with gates between them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..session import cut

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Step:
    """A step makes tables of those made before it. `write` has them written once; `gate` must hold for them, or the run stops."""

    name: str
    make: Callable[[Tables], Tables]
    write: bool = False
    gate: Callable[[Tables], bool] | None = None


def run(steps: list[Step], tables: Tables) -> Tables:
    """All tables, the given ones and those of the steps in order. A step may not replace a table; a failed gate names its step."""
    done = dict(tables)
    for step in steps:
        made = step.make(dict(done))
        again = sorted(set(made) & set(done))
        if again:
            raise ValueError(f"{step.name} makes {again} again")
        done |= {k: cut(df, k) for k, df in made.items()} if step.write else made
        if step.gate and not step.gate(dict(done)):
            raise RuntimeError(f"the gate after {step.name} doesn't hold")
    return done
