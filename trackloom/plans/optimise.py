"""Search over cut values: every configuration is run once, its figures are kept, the best set is returned."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator


def grid(space: dict[str, list]) -> Iterator[dict]:
    """All combinations, in the order of the space."""
    for values in itertools.product(*space.values()):
        yield dict(zip(space, values, strict=True))


def sampled(space: dict[str, list], n: int, seed: int = 0) -> Iterator[dict]:
    """``n`` random combinations."""
    rng = random.Random(seed)
    for _ in range(n):
        yield {k: rng.choice(v) for k, v in space.items()}


def search(configs: Iterator[dict], run: Callable[[dict], dict[str, float]], known: dict[tuple, dict[str, float]] | None = None) -> dict[tuple, dict[str, float]]:
    """Figures per configuration (as sorted items); one that is ``known`` isn't run again."""
    found = dict(known or {})
    for config in configs:
        key = tuple(sorted(config.items()))
        if key not in found:
            found[key] = run(config)
    return found


def best_set(results: dict[tuple, dict[str, float]], lower: list[str], higher: list[str]) -> list[tuple]:
    """Configurations that no other one equals or beats in every figure."""

    def beats(a: dict, b: dict) -> bool:
        return all(a[k] <= b[k] for k in lower) and all(a[k] >= b[k] for k in higher)

    return [k for k, v in results.items() if not any(beats(w, v) for j, w in results.items() if j != k)]
