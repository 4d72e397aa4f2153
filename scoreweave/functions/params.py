"""One declarative check for the small parameter objects of the library.

A rule is (kind, lowest, highest, open): ``number`` is a finite float, ``whole`` an integer, ``flag`` a
boolean; ``open`` excludes the lowest value. None means unbounded.
"""

from __future__ import annotations

import math

NON_NEGATIVE = ("number", 0.0, None, False)
POSITIVE = ("number", 0.0, None, True)
ANY_NUMBER = ("number", None, None, False)
SHARE = ("number", 0.0, 1.0, False)
AT_LEAST_ONE = ("whole", 1, None, False)
FLAG = ("flag", None, None, False)

_KINDS = {"number": (int, float), "whole": int, "flag": bool}


def checked(value, rule: tuple, name: str = "value"):
    """``value`` if it keeps ``rule``; whole numbers become floats where a number is asked for."""
    kind, low, high, is_open = rule
    fits = isinstance(value, _KINDS[kind]) and (kind == "flag") == isinstance(value, bool)
    if not fits or (kind == "number" and not math.isfinite(value)):
        raise ValueError(f"{name}: {value!r} is not a {kind}")
    if (low is not None and (value < low or (is_open and value == low))) or (high is not None and value > high):
        raise ValueError(f"{name}: {value!r} is outside {'(' if is_open else '['}{low}, {high}]")
    return float(value) if kind == "number" else value


def check_fields(holder, rules: dict[str, tuple]) -> None:
    """Check and normalise the named fields of a frozen dataclass."""
    for name, rule in rules.items():
        object.__setattr__(holder, name, checked(getattr(holder, name), rule, name))
