"""Graph of a flow's operators, as text and as DOT."""

from __future__ import annotations

import re


def clean(name: str) -> str:
    return re.sub(r"[^\w ,.:<>=-]", "", name)


def nodes(flow, seen: dict | None = None) -> dict[int, object]:
    seen = {} if seen is None else seen
    if id(flow) not in seen:
        seen[id(flow)] = flow
        for u in flow.upstreams:
            nodes(u, seen)
    return seen


def edges(flow) -> list[tuple[int, int]]:
    found = nodes(flow)
    number = {k: n for n, k in enumerate(found)}
    return [(number[id(u)], number[k]) for k, f in found.items() for u in f.upstreams]


def dot(flow) -> str:
    labels = "\n".join(f'  n{n} [label="{clean(f.name)}"];' for n, f in enumerate(nodes(flow).values()))
    return "digraph flow {\n" + labels + "\n" + "\n".join(f"  n{a} -> n{b};" for a, b in edges(flow)) + "\n}"


def readable(flow) -> str:
    names = [clean(f.name) for f in nodes(flow).values()]
    return "\n".join(f"{names[a]} -> {names[b]}" for a, b in edges(flow))
