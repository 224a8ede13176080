"""Linear regressions in DuckDB SQL, for oracles: Gauss-Jordan steps on matrices held as lists of lists."""

from __future__ import annotations

from collections.abc import Sequence


def products(columns: Sequence[str]) -> str:
    """Sums of products of the distances from the means, the target last."""
    return "[" + ", ".join("[" + ", ".join(f"covar_pop({a}, {b}) * count(*)" for b in columns) + "]" for a in columns) + "]"


def steps(name: str, source: str, keys: str, p: int) -> str:
    """Recursive CTE (keys, k, m, o): in step k + 1 the first k of p variables are eliminated from the matrix o of `source`.

    Cells (i, p + 1) of step p + 1 are the coefficients, cell (p + 1, p + 1) of any step is the squared error so far. A
    variable that the ones before it determine is passed over.
    """
    cell = "CASE WHEN NOT m[k][k] > 1e-10 * o[k][k] THEN m[i][j] WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END"
    size = f"range(1, {p + 2})"
    return f"""{name}({keys}, k, m, o) AS (SELECT {keys}, 1, m, m FROM {source} UNION ALL
  SELECT {keys}, k + 1, list_transform({size}, lambda i: list_transform({size}, lambda j: {cell})), o FROM {name} WHERE k <= {p})"""
