"""Output shaping shared by the queries: rounded doubles, epoch micros, long counts."""
from pyspark.sql import Column
from pyspark.sql import functions as F


#: moves exact decimal ties off the rounding edge, where summation order would decide them
NUDGE = 1.2345e-9


def r(x, name: str | None = None, digits: int = 6) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c.cast("double") + NUDGE, digits).alias(name or (x if isinstance(x, str) else "value"))


def us(x, name: str | None = None) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.unix_micros(c).alias(name or x)


def n(x, name: str | None = None) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return c.cast("long").alias(name or x)


def s(x, name: str | None = None) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return c.cast("string").alias(name or x)


def nudge_rounds(sql: str) -> str:
    """Apply the same nudge to every ``round(expr, n)`` of an oracle query."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            return "".join(out) + sql[i:]
        depth, k, comma = 1, j + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if sql[k] == "," and depth == 1:
                comma = k
            k += 1
        inner = nudge_rounds(sql[j + 6:comma])
        out.append(f"{sql[i:j]}round(CAST({inner} AS DOUBLE) + {NUDGE}{sql[comma:k]}")
        i = k
