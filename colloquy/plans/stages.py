"""Declared stages and their order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def order(stages: Mapping[str, Sequence[str]], target: str | None = None) -> list[str]:
    """Stages in an order in which each follows what it needs; only the ancestors of ``target`` if given.

    Raises ValueError on a cycle or an unknown stage.
    """
    out: list[str] = []
    state: dict[str, int] = {}
    for first in [target] if target is not None else list(stages):
        stack = [(first, iter(stages[first]) if first in stages else None)]
        if stack[0][1] is None:
            raise ValueError(f"unknown stage {first}")
        if state.get(first) == 2:
            continue
        state[first] = 1
        while stack:
            name, rest = stack[-1]
            need = next(rest, None)
            if need is None:
                state[name] = 2
                out.append(name)
                stack.pop()
            elif need not in stages:
                raise ValueError(f"unknown stage {need}")
            elif state.get(need) == 1:
                raise ValueError(f"cycle at {need}")
            elif need not in state:
                state[need] = 1
                stack.append((need, iter(stages[need])))
    return out
