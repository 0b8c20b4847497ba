"""Reads and writes of tables (SRC)."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_CHARS = 100_000


def identifier(name: str) -> str:
    """SRC-12: one or two parts of letters, digits and _."""
    parts = name.split(".")
    if not 1 <= len(parts) <= 2 or not all(re.fullmatch(r"[A-Za-z0-9_]+", p) for p in parts):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def allowed(name: str, tables: set[str]) -> str:
    """SRC-12: a table of the list."""
    if identifier(name) not in tables:
        raise PermissionError(f"{name} is not one of {sorted(tables)}")
    return name


def validated(requests: DataFrame) -> DataFrame:
    """SRC-02: requests with their fault (422 blank, 413 too long) and language; ``locale`` may be null."""
    fault = F.when(F.coalesce(F.regexp_replace("text", r"(?U)\s+", ""), F.lit("")) == "", 422).when(F.length("text") > MOST_CHARS, 413)
    lang = F.lower(F.substring_index(F.coalesce(F.nullif("locale", F.lit("")), F.lit("en")), "-", 1))
    return requests.withColumn("fault", fault).withColumn("lang", lang)


def select_rows(table: DataFrame, columns: list[str] | None = None, where: dict[str, object] | None = None, order_by: list[str] | None = None, descending: bool = False, limit: int | None = None) -> DataFrame:
    """SRC-04: projection, equality filters, order and limit; names are checked."""
    out = table
    for name, value in (where or {}).items():
        out = out.where(F.col(identifier(name)).isNull() if value is None else F.col(name) == F.lit(value))
    if order_by:
        out = out.orderBy(*[F.col(identifier(c)).desc() if descending else F.col(c).asc() for c in order_by])
    if limit is not None:
        out = out.limit(limit)
    return out.select(*map(identifier, columns)) if columns else out


def criteria(parts: list[tuple[str, str, object]]) -> Column:
    """SRC-05: (column, AND or OR, value) from left to right; each joiner ties its item to the next one, the last has no effect."""
    tests = [F.col(identifier(name)) == F.lit(value) for name, _, value in parts]
    joiners = [j.upper() for _, j, _ in parts[:-1]]
    if any(j not in ("AND", "OR") for j in joiners):
        raise ValueError("a joiner is AND or OR")
    return reduce(lambda left, nxt: (left & nxt[1]) if nxt[0] == "AND" else (left | nxt[1]), zip(joiners, tests[1:]), tests[0])


def query(spark: SparkSession, statement: str, **named: DataFrame) -> DataFrame:
    """SRC-06: SQL over named DataFrames."""
    return spark.sql(statement, **named)


def updated(table: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """SRC-07: rows with the changed columns of ``changes`` (by ``key``), and updated_at where there is one."""
    names = [c for c in changes.columns if c != key]
    c = changes.select(F.col(key).alias("_k"), F.struct(*names).alias("_c"))
    j = table.join(c, table[key] == c["_k"], "left")
    hit = F.col("_k").isNotNull()
    out = [F.when(hit, F.col(f"_c.{n}")).otherwise(F.col(n)).alias(n) if n in names else F.when(hit, F.current_timestamp()).otherwise(F.col(n)).alias(n) if n == "updated_at" else F.col(n) for n in table.columns]
    return j.select(*out)


# ---- sinks ---------------------------------------------------------------------

SINKS: dict[str, Callable[[DataFrame, str], None]] = {}


def sink(name: str) -> Callable:
    """SRC-09: registers a sink under a name."""

    def put(f: Callable[[DataFrame, str], None]) -> Callable[[DataFrame, str], None]:
        if name in SINKS:
            raise ValueError(f"there is a sink {name} already")
        SINKS[name] = f
        return f

    return put


@sink("parquet")
def _parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


@sink("json")
def _json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def make_sink(name: str) -> Callable[[DataFrame, str], None]:
    if name not in SINKS:
        raise ValueError(f"no sink {name!r}; there are {', '.join(sorted(SINKS))}")
    return SINKS[name]


def log_rows(events: DataFrame) -> DataFrame:
    """SRC-08: payloads (level, event, result, info) as log rows."""
    from lexloom.operators.limits import cap_text, log_level

    name, code = log_level(F.col("level"))
    info = F.coalesce(F.nullif("result", F.lit("")), F.nullif("info", F.lit("")), F.col("event"))
    return events.select("id", code.cast("int").alias("level_code"), name.alias("level_name"), F.coalesce("event", F.lit("")).alias("event"), cap_text(info).alias("info"))


def append(rows: DataFrame, to: str, name: str = "parquet") -> None:
    """SRC-07, SRC-08."""
    make_sink(name)(rows, to)


def pressure_text(spark: SparkSession, rows: int, seed: int = 7) -> DataFrame:
    """SRC-11: lines of three to nine words with the initials of the first five in parentheses."""
    bank = ["alpha", "bridge", "council", "delta", "energy", "forum", "global", "harbour", "index", "joint", "kernel", "ledger", "market", "network", "office", "policy"]
    n = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(7)).cast("int") + 3
    words = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(F.array(*map(F.lit, bank)), (F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(len(bank))) + 1).cast("int")))
    initials = F.upper(F.array_join(F.transform(F.slice("w", 1, 5), lambda x: F.substring(x, 1, 1)), ""))
    head = F.array_join(F.transform(F.slice("w", 1, 5), lambda x: F.initcap(x)), " ")
    return spark.range(rows).withColumn("w", words).select(F.col("id").alias("doc_id"), F.concat(head, F.lit(" ("), initials, F.lit(") "), F.array_join(F.slice("w", F.lit(6), F.greatest(F.size("w") - 5, F.lit(0))), " ")).alias("text"))


# Fixed values (SRC-10): a first glossary: acronym, domain, definition, variants.
SEED = [
    ("MPS", "general", "Metropolitan Police Service.", ["Met Police", "Metropolitan Police"]),
    ("NHS", "general", "UK National Health Service.", ["National Health Service"]),
    ("GPU", "general", "Graphics Processing Unit.", ["Graphics Card"]),
    ("CPU", "general", "Central Processing Unit.", ["Processor"]),
    ("PDF", "general", "Portable Document Format.", ["Portable Document Format"]),
    ("GDPR", "general", "General Data Protection Regulation.", ["General Data Protection Regulation"]),
    ("ECHR", "general", "European Convention on Human Rights.", ["European Convention on Human Rights"]),
    ("FOI", "general", "Freedom of Information.", ["Freedom of Information"]),
    ("SAR", "general", "Subject Access Request.", ["Subject Access Request"]),
    ("SLA", "general", "Service Level Agreement.", ["Service-Level Agreement", "Service Level Agreements"]),
    ("KPI", "general", "Key Performance Indicator.", ["Key Performance Indicators"]),
]


def seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED, "acronym string, domain string, definition string, variants array<string>")
