"""Residual code of one value against a centre, as SQL expressions on BIGINT.

With d = |v - c|: the signal is how many steps of 126 are needed (1 where v = c), the code is the
zig-zagged remainder: 1 for v = c, even above the centre, odd from 3 below it.
"""

from __future__ import annotations

from tallow.schema import RADIX


def distance(v: str, c: str) -> str:
    return f"abs({v} - {c})"


def signal(v: str, c: str) -> str:
    return f"greatest(1L, ({distance(v, c)} + {RADIX - 1}) div {RADIX})"


def code(v: str, c: str) -> str:
    rest = f"({distance(v, c)} - {RADIX} * ({signal(v, c)} - 1))"
    return f"(CASE WHEN {v} = {c} THEN 1L WHEN {v} > {c} THEN 2 * {rest} ELSE 2 * {rest} + 1 END)"


def value(code: str, length: str, c: str) -> str:
    """The inverse of signal() and code()."""
    steps = f"{RADIX} * ({length} - 1)"
    return f"(CASE WHEN {code} % 2 = 1 THEN {c} - (({code} - 1) div 2 + {steps}) ELSE {c} + {code} div 2 + {steps} END)"
