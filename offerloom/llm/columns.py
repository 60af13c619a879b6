"""Names of columns that an operator adds for a while."""

from __future__ import annotations


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column has one of them, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
