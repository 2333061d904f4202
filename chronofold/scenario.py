"""Scripted appends with checks in between, for tests of projections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .sources.store import Action, Event, EventStore


@dataclass
class Scenario:
    """Steps that run in order; a failing check names its step."""

    store: EventStore
    steps: list[tuple[str, Callable[[], None]]] = field(default_factory=list)

    def append(self, stream_id: str, *events: Event, start: bool = False) -> Scenario:
        self.steps.append((f"append {len(events)} to {stream_id}", lambda: self.store.append(Action(stream_id, list(events), start=start)) and None))
        return self

    def check(self, name: str, projection: Callable[[DataFrame], DataFrame], test: Callable[[list], bool]) -> Scenario:
        def run() -> None:
            rows = projection(self.store.events()).collect()
            if not test(rows):
                raise AssertionError(f"{name}: {rows[:5]}")

        self.steps.append((name, run))
        return self

    def play(self) -> None:
        for number, (name, step) in enumerate(self.steps, 1):
            try:
                step()
            except AssertionError as e:
                raise AssertionError(f"step {number}, {name}: {e}") from e
