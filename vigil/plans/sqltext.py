"""Helpers for writing the DuckDB oracle text."""


def sround(expr: str, n: int) -> str:
    """Half-up rounding of the shortest decimal form of a double — the
    rule of Spark's ``round`` — written for DuckDB."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,24)), {n}) AS DOUBLE)"


def bigint_counts(sql: str) -> str:
    """Write every ``count_if(cond)`` as ``count(*) FILTER (WHERE cond)``:
    same value, but BIGINT like Spark's counts (DuckDB's count_if is
    HUGEINT)."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        k, depth = j + len(key), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j])
        out.append(f"count(*) FILTER (WHERE {bigint_counts(sql[j + len(key):k - 1])})")
        i = k
