"""The order of jobs: what reads a path comes after what writes it."""

from __future__ import annotations

from collections import defaultdict, deque
from fnmatch import fnmatchcase

from ..types import SchemaError


def feeds(output: str, wanted: str) -> bool:
    """Whether what is written at output may be read as wanted: the same place, one inside the other, or one that a pattern meets."""
    a, b = output.rstrip("/").split("/"), wanted.replace("#LATEST", "*").rstrip("/").split("/")
    n = min(len(a), len(b))
    return all(x == y or fnmatchcase(x, y.replace("{", "[{]")) or ("{" in y and any(fnmatchcase(x, z) for z in _choices(y))) for x, y in zip(a[:n], b[:n], strict=True))


def _choices(part: str) -> list[str]:
    """Of a pattern's part with {x,y}, the patterns that it stands for."""
    head, _, rest = part.partition("{")
    inside, close, tail = rest.partition("}")
    return [h for x in inside.split(",") for h in _choices(f"{head}{x}{tail}")] if close else [part]


def levels(jobs: dict[str, tuple[set[str], set[str]]]) -> list[list[str]]:
    """Names in groups that can run side by side, from (inputs, outputs) of each job. A cycle is an error."""
    writer: dict[str, str] = {}
    for name, (_, outputs) in jobs.items():
        for path in outputs:
            if path in writer:
                raise SchemaError(f"{writer[path]} and {name} both write {path}")
            writer[path] = name
    for name, (inputs, outputs) in jobs.items():
        if inputs & outputs:
            raise SchemaError(f"{name} reads what it writes")
    after: dict[str, set[str]] = {name: {w for path, w in writer.items() if w != name and any(feeds(path, p) for p in inputs)} for name, (inputs, _) in jobs.items()}
    waiting = {name: len(before) for name, before in after.items()}
    then = defaultdict(list)
    for name, before in after.items():
        for b in before:
            then[b].append(name)
    ready, out, done = deque(n for n in jobs if not waiting[n]), [], 0
    while ready:
        level = list(ready)
        ready.clear()
        out.append(level)
        done += len(level)
        for n in level:
            for m in then[n]:
                waiting[m] -= 1
                if not waiting[m]:
                    ready.append(m)
    if done < len(jobs):
        raise SchemaError("jobs depend on each other in a cycle: " + ", ".join(n for n in jobs if waiting[n]))
    return out
