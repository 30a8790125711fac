"""A perceptron as SQL: parameters drawn by position, one list product per layer."""

from __future__ import annotations

from ..operators.networks import Layout
from .views import unit_sql


def parameters_sql(layout: Layout, seed: str, tag: str = "") -> list[str]:
    """CTEs w<i> (o, w) and b<i> (o, b) of the used layers."""
    ctes, at, depth = [], 0, 0
    for o, i, used in layout.shapes():
        if used:
            depth += 1
            draw = f"(2 * {unit_sql(f"'{seed}:' || (p + {{}})")} - 1) * {1.0 / i**0.5!r}"
            ctes.append(
                f"w{tag}{depth} AS (SELECT p // {i} AS o, list({draw.format(at)} ORDER BY p) AS w "
                f"FROM range({o * i}) t(p) GROUP BY 1)"
            )
            ctes.append(f"b{tag}{depth} AS (SELECT p AS o, {draw.format(at + o * i)} AS b FROM range({o}) t(p))")
        at += o * i + o
    return ctes


def network_sql(layout: Layout, seed: str, source: str, key: str, out: str, tag: str = "") -> str:
    """CTEs ending in ``out`` (key, scores) for ``source`` (key, x DOUBLE[])."""
    ctes = parameters_sql(layout, seed, tag)
    depth = len(layout.sizes) - 1
    previous = source
    for d in range(1, depth + 1):
        z = "list_dot_product(w, x) + b"
        cell = f"greatest({z}, 0)" if d < depth else z
        name = f"h{tag}{d}"
        ctes.append(
            f"{name} AS (SELECT {key}, list({cell} ORDER BY w.o) AS x FROM {previous}, w{tag}{d} w JOIN b{tag}{d} b USING (o) GROUP BY {key})"
        )
        previous = name
    head = {
        "logits": "x",
        "sigmoid": "list_transform(x, lambda v: 1 / (1 + exp(-v)))",
        "softmax": "list_transform(x, lambda v: exp(v) / list_sum(list_transform(x, lambda u: exp(u))))",
    }[layout.head]
    ctes.append(f"{out} AS (SELECT {key}, {head} AS scores FROM {previous})")
    return ",\n".join(ctes)
