"""Postfix Boolean queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compile_postfix(query: str) -> tuple[list[str], Column]:
    """The terms of a postfix query and its condition over the columns has_0, has_1, ... (one per term).

    `AND` and `OR` in capitals are operators, every other token a term. An operator without two operands or a query
    without terms raises ValueError. The result is the operand on top at the end.
    """
    terms: dict[str, int] = {}
    stack: list[Column] = []
    for token in (query or "").split():
        if token in ("AND", "OR"):
            if len(stack) < 2:
                raise ValueError(f"{token} lacks operands in {query!r}")
            right, left = stack.pop(), stack.pop()
            stack.append(left & right if token == "AND" else left | right)
        else:
            stack.append(F.col(f"has_{terms.setdefault(token, len(terms))}"))
    if not stack:
        raise ValueError(f"no terms in {query!r}")
    return list(terms), stack[-1]
