"""Small helpers to compose SQL expressions as text.

The URL and HTML rules are deep expressions. Composed as text they reach the JVM in one call
each; built from Column objects the same plan takes hundreds of calls and seconds to set up.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

_names = count()


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it by name in ``body``."""
    name = f"v{next(_names)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def lam(body: Callable[..., str], arity: int = 1) -> str:
    """A lambda with fresh variable names."""
    names = [f"v{next(_names)}" for _ in range(arity)]
    head = names[0] if arity == 1 else f"({', '.join(names)})"
    return f"{head} -> {body(*names)}"


def raw(pattern: str) -> str:
    """A pattern as a raw literal; write quotes in it as \\x22 and \\x27."""
    assert "'" not in pattern
    return f"r'{pattern}'"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
