"""Minimising a smooth function whose value and gradient are one Spark job."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Sufficient decrease, shrinkage of a step, and steps tried along one direction.
_DECREASE, _SHRINK, _TRIES = 1e-4, 0.5, 30


@dataclass
class Point:
    x: np.ndarray
    value: float
    gradient: np.ndarray
    #: Whatever else the job has summed up at this point.
    extra: dict


Evaluate = Callable[[np.ndarray], Point]


def descend(evaluate: Evaluate, start: np.ndarray, done: Callable[[Point], bool], steps: int, memory: int = 10):
    """Points visited by limited-memory quasi-Newton steps, the first being ``start``.

    A step is shortened until the value decreases enough.  The walk ends when
    ``done`` says so, after ``steps`` steps, or when no step decreases the value any
    more; the caller sees from the last point which of them it was.
    """
    here = evaluate(np.asarray(start, dtype=np.float64))
    yield here
    pairs: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=memory)
    for _ in range(steps):
        if done(here):
            return
        there = _step(evaluate, here, _direction(here.gradient, pairs), first=not pairs)
        if there is None and pairs:  # a stale memory points nowhere: start again from the slope
            pairs.clear()
            there = _step(evaluate, here, -here.gradient, first=True)
        if there is None:
            return
        moved, turned = there.x - here.x, there.gradient - here.gradient
        if moved @ turned > 1e-12 * np.sqrt((moved @ moved) * (turned @ turned)):
            pairs.append((moved, turned))
        here = there
        yield here


def _step(evaluate: Evaluate, here: Point, direction: np.ndarray, first: bool) -> Point | None:
    slope = float(here.gradient @ direction)
    if not slope < 0:
        return None
    size = min(1.0, 1.0 / np.abs(here.gradient).sum()) if first else 1.0
    for _ in range(_TRIES):
        there = evaluate(here.x + size * direction)
        if np.isfinite(there.value) and there.value <= here.value + _DECREASE * size * slope:
            return there
        size *= _SHRINK
    return None


def _direction(gradient: np.ndarray, pairs) -> np.ndarray:
    """Minus the gradient times the inverse curvature that the last steps have shown."""
    q, weights = gradient.copy(), []
    for moved, turned in reversed(pairs):
        a = (moved @ q) / (moved @ turned)
        weights.append(a)
        q -= a * turned
    if pairs:
        moved, turned = pairs[-1]
        q *= (moved @ turned) / (turned @ turned)
    for (moved, turned), a in zip(pairs, reversed(weights)):
        q += moved * (a - (turned @ q) / (moved @ turned))
    return -q
