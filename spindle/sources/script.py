"""SQL scripts as statements."""

from __future__ import annotations

import re

#: What a script is made of as far as semicolons go: strings and comments hide theirs.
_PIECE = re.compile(r"'(?:[^']|'')*'?|--[^\n]*|;|[^';-]+|-")


def complete(text: str) -> bool:
    """Whether a semicolon outside strings and comments ends ``text``'s statement."""
    return ";" in _PIECE.findall(text)


def split_statements(text: str) -> list[str]:
    """The statements of a script; the last one may lack its semicolon."""
    out, held = [], []
    for piece in _PIECE.findall(text):
        if piece == ";":
            out.append("".join(held))
            held = []
        else:
            held.append(piece)
    out.append("".join(held))
    return [s.strip() for s in out if re.sub(r"--[^\n]*", "", s).strip()]
