"""What a view's program looks like and what its steps took."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Metrics:
    """Steps of one view or rule: how many, milliseconds, rows that came out."""

    steps: int = 0
    total_ms: float = 0.0
    rows: int = 0
    each_ms: list[float] = field(default_factory=list)

    def add(self, ms: float, rows: int = 0) -> None:
        self.steps += 1
        self.total_ms += ms
        self.rows += rows
        self.each_ms.append(ms)

    @property
    def average_ms(self) -> float:
        return self.total_ms / self.steps if self.steps else 0.0


def dot(views: dict[str, list[tuple[int, str, str]]]) -> str:
    """A drawing, in DOT, of the programs of all views; a table or view that several read is one node."""
    nodes: dict[str, str] = {}
    edges: list[tuple[str, str]] = []
    number = 0

    def name_of(view: str, rule: str, what: str) -> str:
        nonlocal number
        if rule == "Input":
            key = f"in_{what}"
        else:
            key, number = f"n{number}", number + 1
        nodes[key] = f"{rule}\\n{what}" if rule == "Input" or rule != what else rule
        return key

    for view, lines in views.items():
        out = f"in_{view}"
        nodes[out] = f"View\\n{view}"
        above: list[str] = []
        for depth, rule, what in lines:
            key = name_of(view, rule, what)
            edges.append((key, above[depth - 1] if depth else out))
            above = [*above[:depth], key]
    body = [f'  "{k}" [label="{v}"];' for k, v in nodes.items()] + [f'  "{a}" -> "{b}";' for a, b in dict.fromkeys(edges)]
    return "\n".join(["digraph Circuit {", "  rankdir=LR;", *body, "}"])
