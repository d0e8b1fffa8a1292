"""The axis-stage planner: a set of expression nodes becomes alternating stages of windows.

All trailing windows of a stage share one shuffle by entity and one sort; all ranks of a
stage share one shuffle by date. Windows over windows of the same axis need no shuffle in between.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelith.functions.expr import ROW, TS, XS, Node

ENTITY, DATE, ORDER, UNIVERSE = "ticker", "date", "t", "universe"
#: Product of two standard deviations up to which no correlation is told.
SPREAD = 1e-12


def history() -> WindowSpec:
    return Window.partitionBy(ENTITY).orderBy(ORDER)


@dataclass
class Stage:
    axis: str
    nodes: list[Node]


def windowed(roots: Iterable[Node]) -> list[Node]:
    """All nodes below that need a window, operands first."""
    seen: dict[int, Node] = {}

    def visit(node: Node) -> None:
        if node.number in seen:
            return
        for a in node.args:
            visit(a)
        seen[node.number] = node

    for root in roots:
        visit(root)
    return [n for n in seen.values() if n.axis != ROW]


def plan(roots: Iterable[Node]) -> list[Stage]:
    """Stages in order: every node as early as the alternation of axes allows."""
    nodes = windowed(roots)
    below: dict[int, set[int]] = {}

    def needs(node: Node) -> set[int]:
        if node.number not in below:
            out: set[int] = set()
            for a in node.args:
                out |= {a.number} if a.axis != ROW else needs(a)
            below[node.number] = out
        return below[node.number]

    done: set[int] = set()
    stages: list[Stage] = []
    axis = TS
    while len(done) < len(nodes):
        ready = [n for n in nodes if n.number not in done and n.axis == axis and needs(n) <= done]
        if ready:
            stages.append(Stage(axis, ready))
            done |= {n.number for n in ready}
        else:
            axis = XS if axis == TS else TS
    return stages


def scalar(node: Node) -> Column:
    """A row's expression over panel columns and windows computed so far."""
    if node.axis != ROW:
        return F.col(node.column)
    if node.op == "const":
        return F.lit(node.params[0])
    if node.op == "field":
        return F.col(node.params[0])
    a = [scalar(x) for x in node.args]
    match node.op:
        case "add":
            return a[0] + a[1]
        case "sub":
            return a[0] - a[1]
        case "mul":
            return a[0] * a[1]
        case "div":
            return F.try_divide(a[0], a[1])
        case "neg":
            return -a[0]
        case "ln":
            return F.ln(a[0])
        case "sqrt":
            return F.when(a[0] >= 0, F.sqrt(a[0]))
        case "abs":
            return F.abs(a[0])
        case "sign":
            return F.signum(a[0])
        case "pow":
            return F.pow(a[0], F.lit(float(node.params[0])))
        case "at_least":
            return F.when(a[0].isNotNull(), F.greatest(a[0], F.lit(node.params[0])))
        case "at_most":
            return F.when(a[0].isNotNull(), F.least(a[0], F.lit(node.params[0])))
        case "not_zero":
            return F.nullif(a[0], F.lit(0.0))
        case "flag":
            return (a[0] > 0).cast("double")
        case "where_both":
            return F.when(a[1].isNotNull(), a[0])
        case "above":
            return F.when(a[0] > node.params[0], a[1])
        case "known_mean":
            known = F.array_compact(F.array(*a))
            return F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known))
        case "digits":
            return F.round(a[0], node.params[0])
    raise ValueError(node.op)


def average_rank(x: Column, *by: str) -> Column:
    """Rank among known values with ties averaged, from one sort: the mean of those below plus one and those not above."""
    w = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    upto = F.count(x).over(w.rangeBetween(Window.unboundedPreceding, 0))
    return F.when(x.isNotNull(), (F.rank().over(w) + upto) / 2)


def share_rank(x: Column, *by: str) -> Column:
    return average_rank(x, *by) / F.count(x).over(Window.partitionBy(*by))


def trailing(node: Node) -> Column:
    """One trailing window over the dense history."""
    x = scalar(node.args[0])
    if node.op == "lag":
        k = node.params[0]
        return F.lag(x, k).over(history()) if k > 0 else F.lead(x, -k).over(history())
    w = history().rowsBetween(1 - node.params[0], 0)
    if node.op in ("age_max", "age_min"):
        least = node.op == "age_min"
        filled = F.coalesce(x, F.lit(float("inf" if least else "-inf")))
        # The oldest of equal extremes: the latest under the reversed order of places.
        held = F.min(F.struct(filled.alias("x"), F.col(ORDER).alias("t"))).over(w) if least else F.max(F.struct(filled.alias("x"), (-F.col(ORDER)).alias("t"))).over(w)
        age = F.col(ORDER) - (held["t"] if least else -held["t"])
        whole = F.count(F.lit(1)).over(w) == node.params[0]
        return F.when(whole & x.isNotNull(), age.cast("double"))
    n = F.count(x).over(w)
    match node.op:
        case "mean":
            out = F.avg(x).over(w)
        case "sum":
            out = F.sum(x).over(w)
        case "std":
            out = F.stddev_samp(x).over(w)
        case "max":
            out = F.max(x).over(w)
        case "min":
            out = F.min(x).over(w)
        case "rank":
            held = F.collect_list(x).over(w)
            below = F.size(F.filter(held, lambda v: v < x))
            equal = F.size(F.filter(held, lambda v: v == x))
            return F.when((n >= node.params[1]) & x.isNotNull(), (below + (equal + 1) / 2) / n)
        case "cov":
            out = F.covar_pop(x, scalar(node.args[1])).over(w)
        case "corr":
            y = scalar(node.args[1])
            spread = F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)
            out = F.when(spread > SPREAD, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.covar_pop(x, y).over(w) / spread)))
        case "skew":
            flat = F.max(x).over(w) == F.min(x).over(w)
            out = F.when(flat, 0.0).otherwise(F.skewness(x).over(w) * F.sqrt(n * (n - 1)) / (n - 2))
        case "kurt":
            flat = F.max(x).over(w) == F.min(x).over(w)
            out = F.when(flat, -3.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(w) + 6))
        case _:
            raise ValueError(node.op)
    return F.when(n >= node.params[1], out)


def with_streaks(df: DataFrame, nodes: list[Node]) -> DataFrame:
    """Runs of equal signs as islands: a run starts where the sign changes, and its length is the distance from its start."""
    signs = {n: F.signum(scalar(n.args[0])) for n in nodes}
    turns = df.withColumns({f"{n.column}_turn": F.when(~s.eqNullSafe(F.lag(s).over(history())), F.col(ORDER)) for n, s in signs.items()})
    upto = history().rowsBetween(Window.unboundedPreceding, 0)
    out = turns.withColumns({n.column: s * (F.col(ORDER) - F.last(f"{n.column}_turn", ignorenulls=True).over(upto) + 1) for n, s in signs.items()})
    return out.drop(*[f"{n.column}_turn" for n in nodes])


def with_ewms(df: DataFrame, nodes: list[Node]) -> DataFrame:
    """Exponentially weighted means, an entity's whole history at a time: the recursion has no bounded frame.

    An entity's history is as long as the calendar, which bounds the group.
    """
    ready = df.withColumns({f"{n.column}_x": scalar(n.args[0]) for n in nodes})
    schema = T.StructType([*df.schema.fields, *[T.StructField(n.column, T.DoubleType()) for n in nodes]])
    specs = [(n.column, *n.params) for n in nodes]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDER)
        for name, alpha, least in specs:
            pdf[name] = pdf.pop(f"{name}_x").astype("float64").ewm(alpha=alpha, min_periods=least).mean()
        return pdf

    return ready.groupBy(ENTITY).applyInPandas(run, schema)


def evaluate(panel: DataFrame, outputs: dict[str, Node], keep: Iterable[str] = (DATE, ORDER, ENTITY)) -> DataFrame:
    """The panel's ``keep`` columns and one column an output.

    ``panel`` is dense: a row for each entity and date, ``t`` the date's place in the calendar, NULL where unknown.
    """
    df = panel
    for stage in plan(outputs.values()):
        if stage.axis == XS:
            member = lambda n: F.when(F.col(UNIVERSE), scalar(n.args[0]))
            df = df.withColumns({n.column: share_rank(member(n), DATE) for n in stage.nodes})
            continue
        plain = [n for n in stage.nodes if n.op not in ("ewm", "streak")]
        if plain:
            df = df.withColumns({n.column: trailing(n) for n in plain})
        if runs := [n for n in stage.nodes if n.op == "streak"]:
            df = with_streaks(df, runs)
        if means := [n for n in stage.nodes if n.op == "ewm"]:
            df = with_ewms(df, means)
    return df.select(*keep, *[scalar(n).alias(name) for name, n in outputs.items()])
