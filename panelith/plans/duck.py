"""The same expression nodes as SQL text for the DuckDB oracle, operator by operator in its own terms."""

from __future__ import annotations

from panelith.functions.expr import ROW, XS, Node
from panelith.plans.stages import SPREAD, plan


def scalar(node: Node) -> str:
    if node.axis != ROW:
        return node.column
    if node.op == "const":
        return f"({node.params[0]!r}::DOUBLE)"
    if node.op == "field":
        return node.params[0]
    a = [scalar(x) for x in node.args]
    p = node.params
    match node.op:
        case "add" | "sub" | "mul":
            return f"({a[0]} {'+-*'[['add', 'sub', 'mul'].index(node.op)]} {a[1]})"
        case "div":
            return f"({a[0]} / nullif({a[1]}, 0))"
        case "neg":
            return f"(-{a[0]})"
        case "ln":
            return f"(CASE WHEN {a[0]} > 0 THEN ln({a[0]}) END)"
        case "sqrt":
            return f"(CASE WHEN {a[0]} >= 0 THEN sqrt({a[0]}) END)"
        case "abs" | "sign":
            return f"{node.op}({a[0]})"
        case "pow":
            return f"pow({a[0]}, {p[0]})"
        case "at_least":
            return f"(CASE WHEN {a[0]} < {p[0]!r} THEN {p[0]!r} ELSE {a[0]} END)"
        case "at_most":
            return f"(CASE WHEN {a[0]} > {p[0]!r} THEN {p[0]!r} ELSE {a[0]} END)"
        case "not_zero":
            return f"nullif({a[0]}, 0)"
        case "flag":
            return f"(({a[0]} > 0)::INT::DOUBLE)"
        case "where_both":
            return f"(CASE WHEN {a[1]} IS NOT NULL THEN {a[0]} END)"
        case "above":
            return f"(CASE WHEN {a[0]} > {p[0]!r} THEN {a[1]} END)"
        case "known_mean":
            return f"list_avg([{', '.join(a)}])"
        case "digits":
            return f"round({a[0]}, {p[0]})"
    raise ValueError(node.op)


H = "PARTITION BY ticker ORDER BY t"


def trailing(node: Node) -> str:
    x, p = scalar(node.args[0]), node.params
    if node.op == "lag":
        return f"lag({x}, {p[0]}) OVER ({H})" if p[0] > 0 else f"lead({x}, {-p[0]}) OVER ({H})"
    w = f"OVER ({H} ROWS BETWEEN {p[0] - 1} PRECEDING AND CURRENT ROW)"
    n = f"count({x}) {w}"
    if node.op in ("age_max", "age_min"):
        fill, most = ("'-inf'", "list_max") if node.op == "age_max" else ("'inf'", "list_min")
        held = f"list(coalesce({x}, {fill}::DOUBLE)) {w}"
        return f"CASE WHEN count(*) {w} = {p[0]} AND {x} IS NOT NULL THEN ({p[0]} - list_position({held}, {most}({held})))::DOUBLE END"
    if node.op == "rank":
        earlier = [f"lag({x}, {k}) OVER ({H})" for k in range(1, p[0])]
        below = " + ".join(f"coalesce(({y} < {x})::INT, 0)" for y in earlier)
        equal = " + ".join(f"coalesce(({y} = {x})::INT, 0)" for y in earlier)
        return f"CASE WHEN {n} >= {p[1]} AND {x} IS NOT NULL THEN (({below}) + (({equal}) + 2) / 2.0) / ({n}) END"
    if node.op in ("cov", "corr"):
        y = scalar(node.args[1])
        if node.op == "cov":
            return f"CASE WHEN {n} >= {p[1]} THEN covar_pop({x}, {y}) {w} END"
        spread = f"(stddev_pop({x}) {w} * stddev_pop({y}) {w})"
        return f"CASE WHEN {n} >= {p[1]} AND {spread} > {SPREAD} THEN greatest(-1, least(1, covar_pop({x}, {y}) {w} / {spread})) END"
    make = {"mean": "avg", "sum": "sum", "std": "stddev_samp", "max": "max", "min": "min", "skew": "skewness", "kurt": "kurtosis"}[node.op]
    out = f"{make}({x}) {w}"
    if node.op in ("skew", "kurt"):
        out = f"CASE WHEN max({x}) {w} = min({x}) {w} THEN {0.0 if node.op == 'skew' else -3.0} ELSE {out} END"
    return f"CASE WHEN {n} >= {p[1]} THEN {out} END"


def program(base: str, outputs: dict[str, Node], keep: tuple[str, ...] = ("date", "t", "ticker")) -> tuple[list[str], str]:
    """CTEs over the table ``base`` and the final select's text."""
    ctes, last = [], base
    for i, stage in enumerate(plan(outputs.values())):
        name = f"{base}_{i}"
        if stage.axis == XS:
            ranked = []
            for n in stage.nodes:
                x = f"(CASE WHEN universe THEN {scalar(n.args[0])} END)"
                ranked.append(f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END AS {n.column}")
            ctes.append(f"{name} AS (SELECT *, {', '.join(ranked)} FROM {last})")
            last = name
            continue
        plain = [n for n in stage.nodes if n.op not in ("ewm", "streak")]
        if plain:
            ctes.append(f"{name} AS (SELECT *, {', '.join(f'{trailing(n)} AS {n.column}' for n in plain)} FROM {last})")
            last = name
        for n in stage.nodes:
            x, c = scalar(n.args[0]), n.column
            if n.op == "streak":
                ctes.append(f"{c}_s AS (SELECT *, sign({x}) AS {c}_g FROM {last})")
                ctes.append(f"{c}_t AS (SELECT *, sum(CASE WHEN {c}_g IS DISTINCT FROM {c}_p THEN 1 ELSE 0 END) OVER ({H}) AS {c}_i FROM (SELECT *, lag({c}_g) OVER ({H}) AS {c}_p FROM {c}_s))")
                ctes.append(f"{c}_u AS (SELECT *, {c}_g * row_number() OVER (PARTITION BY ticker, {c}_i ORDER BY t) AS {c} FROM {c}_t)")
                last = f"{c}_u"
            elif n.op == "ewm":
                alpha, least = n.params
                ctes.append(f"{c}_x AS (SELECT *, {x} AS {c}_v FROM {last})")
                ctes.append(f"{c}_w AS (SELECT a.ticker AS {c}_k, a.t AS {c}_o, CASE WHEN count(b.{c}_v) >= {least} THEN sum(b.{c}_v * pow({1 - alpha!r}, a.t - b.t)) / sum(pow({1 - alpha!r}, a.t - b.t)) END AS {c} FROM {c}_x a JOIN {c}_x b ON a.ticker = b.ticker AND b.t <= a.t AND b.{c}_v IS NOT NULL GROUP BY 1, 2)")
                ctes.append(f"{c}_j AS (SELECT {c}_x.*, {c}_w.{c} FROM {c}_x LEFT JOIN {c}_w ON ticker = {c}_k AND t = {c}_o)")
                last = f"{c}_j"
    columns = ", ".join([*keep, *[f"{scalar(n)} AS {name}" for name, n in outputs.items()]])
    return ctes, f"SELECT {columns} FROM {last}"
