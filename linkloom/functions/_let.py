"""Chains of small dependent expressions.

URL work is a chain of small steps.  A chain is declared once, as an ordered
list of ``(name, fn(env) -> Column)``, and evaluated in one of two ways:

* :func:`chain_columns` adds one column per step to a DataFrame.  Catalyst keeps
  the projections apart when a step is used more than once, so every regex runs
  once per row and the steps stay in generated code.  Use it for tables.
* :func:`chain_array` runs the steps over every element of an array, one
  ``transform`` per step, so a row's items are worked on without leaving it.
* :func:`inline_expr` substitutes the steps into one expression.  Right for short
  chains, whose steps Spark evaluates once per row by itself.
* :func:`chain_expr` is the array form for a single value, giving one Column for use
  where no columns can be added.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Env = dict[str, Column]
Step = tuple[str, Callable[[Env], Column]]


def prefixed(steps: Sequence[Step], prefix: str) -> list[Step]:
    """The same steps under other names, reading and writing ``<prefix><name>``."""

    def view(env: Env) -> Env:
        return {name[len(prefix) :]: c for name, c in env.items() if name.startswith(prefix)}

    return [(prefix + name, lambda env, fn=fn: fn(view(env))) for name, fn in steps]


def _extend(known: list[str], name: str, fn: Callable[[Env], Column]) -> Callable[[Column], Column]:
    def extended(s: Column) -> Column:
        return F.struct(*[s[k].alias(k) for k in known], fn({k: s[k] for k in known}).alias(name))

    return extended


def chain_array(
    items: Column, fields: Sequence[str], steps: Sequence[Step], result: Callable[[Env], Column]
) -> Column:
    """``result`` of the steps for every struct in ``items`` (which has ``fields``).

    The transforms follow one another rather than nest: a step sees the values
    of the steps before it as struct fields, and each is computed once.
    """
    names = list(fields)
    for name, fn in steps:
        items = F.transform(items, _extend(list(names), name, fn))
        names.append(name)
    return F.transform(items, lambda s: result({k: s[k] for k in names}))


def inline_expr(
    steps: Sequence[Step], env: Mapping[str, Column], result: Callable[[Env], Column]
) -> Column:
    bound = dict(env)
    for name, fn in steps:
        bound[name] = fn(bound)
    return result(bound)


def chain_expr(
    steps: Sequence[Step], env: Mapping[str, Column], result: Callable[[Env], Column]
) -> Column:
    one = F.array(F.struct(*[c.alias(name) for name, c in env.items()]))
    return F.get(chain_array(one, list(env), steps, result), F.lit(0))


class _Watched(dict):
    """An env that remembers which names were read."""

    def __init__(self, env: Mapping[str, Column]):
        super().__init__(env)
        self.read: set[str] = set()

    def __getitem__(self, name: str) -> Column:
        self.read.add(name)
        return super().__getitem__(name)


def chain_columns(
    df: DataFrame, steps: Sequence[Step], env: Mapping[str, Column], prefix: str
) -> tuple[DataFrame, Env]:
    """Add ``<prefix><name>`` for every step; return the frame and its env.

    Steps that do not read one another share a projection.
    """
    bound = dict(env)
    waiting: dict[str, Column] = {}
    for name, fn in steps:
        watched = _Watched(bound)
        value = fn(watched)
        if watched.read & waiting.keys():
            df = df.withColumns({prefix + k: c for k, c in waiting.items()})
            waiting = {}
        waiting[name] = value
        bound[name] = F.col(prefix + name)
    return df.withColumns({prefix + k: c for k, c in waiting.items()}), bound


def settled(value: Column) -> Column:
    """``value``, computed below every filter put on it.

    Catalyst moves a filter below a projection by copying the projected
    expression into it, which for a chain of steps means computing the whole
    chain twice.  A generator of exactly one row is where that stops.  (One per
    ``select``.)
    """
    return F.explode_outer(F.array(value))
