"""Registered queries with the SQL that gives the same rows, where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def indel_sql(a: str, b: str) -> str:
    """The ratio 2 * LCS / (len a + len b) in DuckDB: rows of the LCS table by nested list folds."""
    row = f"list_transform(range(0, len({b}) + 1), lambda z: 0::bigint)"
    steps = f"list_transform(range(1, len({a}) + 1), lambda i: [i::bigint])"
    cells = f"list_transform(range(1, len({b}) + 1), lambda j: [j::bigint])"
    cell = f"case when substr({a}, cur[1], 1) = substr({b}, jj[1], 1) then prev[jj[1]] + 1 else greatest(prev[jj[1] + 1], acc[-1]) end"
    fold = f"list_reduce(list_concat([[0::bigint]], {cells}), lambda acc, jj: list_append(acc, {cell}))"
    lcs = f"list_reduce(list_concat([{row}], {steps}), lambda prev, cur: {fold})[-1]"
    return f"(case when len({a}) + len({b}) = 0 then 1.0::double when len({a}) = 0 or len({b}) = 0 then 0.0::double else 2.0::double * {lcs} / (len({a}) + len({b})) end)"


def letters_sql(name: str, source: str, column: str) -> str:
    """A common table expression ``name(column, places)``: for each distinct string the bits of the places of each of its letters."""
    return f"""{name} as (
    select {column}, map_from_entries(list((c, bits))) as places from (
        select {column}, c, sum(1::bigint << (i - 1))::bigint as bits
        from (select {column}, unnest(string_split({column}, '')) as c, unnest(range(1, len({column}) + 1)) as i from (select distinct {column} from {source})) group by all) group by all)"""


def indel_bits_sql(a: str, places: str, b: str) -> str:
    """The ratio 2 * LCS / (len a + len b) with one machine word as a row of the table, for ``a`` of 1 to 60 characters and its ``letters_sql``."""
    full = f"((1::bigint << len({a})) - 1)"
    hits = f"list_transform(string_split({b}, ''), lambda c: coalesce({places}[c], 0::bigint))"
    row = f"list_reduce(list_concat([{full}], {hits}), lambda r, h: (((r + (r & h)) | (r - (r & h))) & {full}))"
    return f"(2.0::double * (len({a}) - bit_count({row})) / (len({a}) + len({b})))"


def blocks_sql(name: str, source: str, a: str, b: str) -> str:
    """Recursive common table expressions that end in ``name(a, b, ratio)``: the share of characters in matching blocks of each distinct pair."""
    place = f"list_max(flatten(list_transform(range(1, len(x) + 1), lambda i: list_transform(range(1, len(x) - i + 2), lambda n: case when contains(y, substr(x, i, n)) then [n, -i] else [0, 0] end))))"
    return f"""{name}_parts as (
    select {a}, {b}, {a} as x, {b} as y, {place} as best from (select distinct {a}, {b}, {a} as x, {b} as y from {source})
    union all
    select {a}, {b}, x, y, {place} as best from (
        select {a}, {b}, unnest([substr(x, 1, -best[2] - 1), substr(x, -best[2] + best[1])]) as x,
               unnest([substr(y, 1, instr(y, substr(x, -best[2], best[1])) - 1), substr(y, instr(y, substr(x, -best[2], best[1])) + best[1])]) as y
        from {name}_parts where best[1] > 0) where x <> '' and y <> ''
), {name} as (
    select {a}, {b}, case when len({a}) + len({b}) = 0 then 1.0::double else 2.0::double * coalesce(sum(best[1]), 0) / (len({a}) + len({b})) end as ratio from {name}_parts group by {a}, {b})"""
