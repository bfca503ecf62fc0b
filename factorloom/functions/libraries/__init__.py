"""Libraries of named factors.

Each builder takes the names of the panel's columns by canonical name, and a list
of factors in the order wanted (all by default).
"""

from __future__ import annotations

from ..expr import Expr
from . import alpha101, alpha158, alpha191


def _build(title: str, library: dict[str, Expr], input_alias: dict[str, str] | None, alphas: list[str] | None) -> list[Expr]:
    left = dict(library)
    chosen = []
    for name in list(library) if alphas is None else alphas:
        if name not in left:
            raise ValueError(f"factor `{name}` is not known")
        chosen.append((name, left.pop(name)))
    names = dict(input_alias or {})
    fields = sorted(set().union(*(e.collect_inputs() for _, e in chosen))) if chosen else []
    print(f"{title} input_fields: { {f: names.get(f, f) for f in fields} }")
    return [e.replace_inputs(names).alias(n) for n, e in chosen]


def worldquant_alpha101(input_alias: dict[str, str] | None = None, alphas: list[str] | None = None) -> list[Expr]:
    return _build("worldquant_alpha101", alpha101.library(), input_alias, alphas)


def qlib_alpha158(input_alias: dict[str, str] | None = None, alphas: list[str] | None = None) -> list[Expr]:
    return _build("qlib_alpha158", alpha158.library(), input_alias, alphas)


def gtja_alpha191(input_alias: dict[str, str] | None = None, alphas: list[str] | None = None) -> list[Expr]:
    return _build("gtja_alpha191", alpha191.library(), input_alias, alphas)
