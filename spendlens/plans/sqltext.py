"""SQL text builders for the oracle queries (DuckDB dialect).

The oracle restates each operator in plain SQL over the same parquet
tables; these helpers only spell out repeated fragments (band CASE chains,
rounding, the split hash) so every oracle uses the same constants as the
Spark operator it checks.
"""

from __future__ import annotations

from collections.abc import Sequence

from spendlens.functions import bands
from spendlens.operators.split import DIGITS
from spendlens.sources.demo import CUSTOMERS_SQL, GAPS_SQL


def r6(x: str) -> str:
    return f"(ROUND(CAST({x} AS DOUBLE), 6) + 0.0)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cut(x: str, edges: Sequence[float], labels: Sequence[str], open_ends: bool = False) -> str:
    parts = []
    k = len(edges) - 1
    for i in range(k):
        lo, hi = edges[i], edges[i + 1]
        if open_ends and i == 0:
            cond = f"{x} <= {hi}"
        elif open_ends and i == k - 1:
            cond = f"{x} > {lo}"
        else:
            cond = f"{x} > {lo} AND {x} <= {hi}"
        parts.append(f"WHEN {cond} THEN {q(labels[i])}")
    return "(CASE " + " ".join(parts) + " END)"


def threshold(x: str, cuts: Sequence[float], labels: Sequence[str]) -> str:
    parts = [f"WHEN {x} IS NULL THEN NULL"] + [f"WHEN {x} < {t} THEN {q(labels[i])}" for i, t in enumerate(cuts)]
    return "(CASE " + " ".join(parts) + f" ELSE {q(labels[len(cuts)])} END)"


def age_group(x: str = "age") -> str:
    return cut(x, bands.AGE_EDGES, bands.AGE_LABELS)


def income_group(x: str = "annual_income_k") -> str:
    return cut(x, bands.INCOME_EDGES, bands.INCOME_LABELS)


def labels_table(name: str, labels: Sequence[str]) -> str:
    rows = ", ".join(f"({i}, {q(v)})" for i, v in enumerate(labels))
    return f"(SELECT CAST(position AS BIGINT) AS position, {name} FROM (VALUES {rows}) t(position, {name}))"


def key_hash(key: str, seed: int = 42, salt: str = "split") -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{salt}', '{seed}', coalesce(CAST({key} AS VARCHAR), ''))), 1, {DIGITS}) AS BIGINT)"


def _hash_at(rank: str, seed: int, keys: str, table: str) -> str:
    """The hash at a rank (from 1) of all keys of a table."""
    return f"(SELECT list_sort(list({key_hash(keys, seed)}))[CAST({rank} AS BIGINT)] FROM {table})"


def split(key: str, test_fraction: float = 0.2, seed: int = 42, keys: str = "c_custkey", table: str = "customer") -> str:
    end = _hash_at(f"CEIL({test_fraction!r}::DOUBLE * COUNT(*))", seed, keys, table)
    return f"(CASE WHEN {key_hash(key, seed)} <= {end} THEN 'test' ELSE 'train' END)"


def fold(key: str, k: int, test_fraction: float = 0.2, seed: int = 42, keys: str = "c_custkey", table: str = "customer") -> str:
    test = f"CEIL({test_fraction!r}::DOUBLE * COUNT(*))"
    h = key_hash(key, seed)

    def end(i: int) -> str:
        left = f"(COUNT(*) - {test})"
        return _hash_at(f"{test} + {i + 1} * FLOOR({left} / {k}) + LEAST({i + 1}, {left} % {k})", seed, keys, table)
    passed = " + ".join(f"CAST({h} > {end(i)} AS INTEGER)" for i in range(k - 1))
    return f"(CASE WHEN {h} > {_hash_at(test, seed, keys, table)} THEN {passed} END)"


def with_customers(*ctes: str) -> str:
    return "WITH " + ",\n".join((CUSTOMERS_SQL,) + ctes)


def with_gaps(*ctes: str) -> str:
    return "WITH " + ",\n".join((GAPS_SQL,) + ctes)


FEATURES_CTE = f"""
feat AS (
  SELECT c.*,
    {age_group('c.age')} AS age_group,
    {income_group('c.annual_income_k')} AS income_group,
    CAST(c.annual_income_k AS DOUBLE) / (c.age + 1) AS income_age_ratio,
    c.age * c.age AS age_squared,
    c.annual_income_k * c.annual_income_k AS income_squared,
    c.age * c.annual_income_k AS age_income_interaction,
    CASE WHEN mm.mx = mm.mn THEN 0.0 ELSE CAST(c.annual_income_k - mm.mn AS DOUBLE) / (mm.mx - mm.mn) END
      AS spending_capacity,
    CAST(COALESCE(c.age < 35 AND c.annual_income_k > 70, false) AS INTEGER) AS young_high_income,
    CAST(COALESCE(c.age > 50 AND c.annual_income_k < 50, false) AS INTEGER) AS senior_low_income
  FROM customers c CROSS JOIN (SELECT MIN(annual_income_k) AS mn, MAX(annual_income_k) AS mx FROM customers) mm
)"""
