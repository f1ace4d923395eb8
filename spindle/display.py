"""Results as text."""

from __future__ import annotations

from .functions.values import display


def cells(rows: list) -> list[list[str]]:
    return [[display(v) for v in row] for row in rows]


def table_text(headers: list[str], rows: list[list[str]]) -> str:
    """A ruled table, left-aligned."""
    widths = [max([len(h), *(len(r[k]) for r in rows)]) for k, h in enumerate(headers)]
    rule = "+" + "".join("-" * (w + 2) + "+" for w in widths)
    line = lambda row: "|" + "".join(f" {x:<{w}} |" for x, w in zip(row, widths, strict=True))
    return "\n".join([rule, line(headers), rule, *map(line, rows), rule])


def result_text(result, seconds: float) -> str:
    took = f"({seconds:.3f} sec)"
    if not result.success:
        return f"Error: {result.error} {took}"
    if result.headers is None:
        return f"OK ({result.affected} row(s) affected) {took}" if result.affected else f"OK {took}"
    rows = result.text_rows()
    return f"{table_text(result.headers, rows)}\n{len(rows)} row(s) in set {took}"
