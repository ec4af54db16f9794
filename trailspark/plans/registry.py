"""Registered queries: each operator over the projected tables, with SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspark import session
from trailspark.plans.views import VIEWS
from trailspark.sources.projection import Projection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# The same before the projection and its views are put in, for queries made of others.
BUILDERS: dict[str, Callable[[Projection], DataFrame]] = {}
BODIES: dict[str, str] = {}

_WORD = re.compile(r"[a-z_][a-z0-9_]*")


def _with_views(body: str) -> str:
    """Prefix the views the SQL names, and those they name, in definition order."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        for word in set(_WORD.findall(pending.pop())) & VIEWS.keys() - needed:
            needed.add(word)
            pending.append(VIEWS[word])
    if not needed:
        return body
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed)
    return f"WITH {views}\n{body.strip()}"


def plain(frame: DataFrame) -> DataFrame:
    """Comparable columns: lists as sorted text, times as text, integers as BIGINT."""
    out = []
    for field in frame.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), ",")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("bigint")
        out.append(column.alias(field.name))
    return frame.select(*out)


def shared(build: Callable):
    """Build a helper's frame once per projection, however many parts of a query use it."""
    key = f"{build.__module__}.{build.__name__}"

    def once(p: Projection):
        if key not in p.__dict__:
            p.__dict__[key] = build(p)
        return p.__dict__[key]

    once.key = key
    return once


def cut(p: Projection, *parts: str | Callable) -> None:
    """Write tables that a query reads more than once, so that they are computed once.

    ``parts``: names of the projection's tables, or helpers made by ``shared``. Tables that
    come from gathered lines without an exchange are cheaper read again than written.
    """
    for part in parts:
        name = part if isinstance(part, str) else part.key
        frame = getattr(p, part) if isinstance(part, str) else part(p)
        if hasattr(frame, "_cut") or (p.gathered and name.split(".")[-1] in _BY_CONTRACT):
            continue
        p.__dict__[name] = p.stored(frame) if p.gathered and "contract_id" in frame.columns else session.durable(frame)


_BY_CONTRACT = ("order_control", "order_module", "obligation", "obligation_derive", "attestation", "evidence", "resource_control", "_row_hashes", "_document")


def query(name: str, sql: str | None = None, gather: bool = False):
    """Register a builder ``Projection -> DataFrame`` under ``name``.

    ``gather``: it groups and joins line items by contract many times, so they are stored by contract first.
    """

    def register(build: Callable[[Projection], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            p = Projection(session.tune(spark), folder)
            if gather:
                p.gather()
                p.store_lines()
            return plain(build(p))

        run.__doc__ = build.__doc__
        QUERIES[name], BUILDERS[name] = run, build
        if sql is not None:
            ORACLES[name], BODIES[name] = _with_views(sql), sql
        return build

    return register
