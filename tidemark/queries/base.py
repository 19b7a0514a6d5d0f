"""What the query modules share: a registry of (Spark function, SQL) pairs, and panel shorthands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F  # noqa: F401

from ..plans import panels as p
from ..plans.panels import table, with_panels  # noqa: F401
from ..shared import written as once  # noqa: F401  a panel that a query needs several times is aggregated once
from ..shipping import ship


class Registry(dict):
    """name -> (query, SQL or None)."""

    def add(self, name: str, sql: str | None = None, needs: str = "") -> Callable:
        """Decorates a query; needs: panels that the SQL reads, "" for plain tables."""

        def put(f):
            def run(spark, sf_dir):
                ship(spark)
                return f(spark, sf_dir)

            self[name] = (run, with_panels(needs, sql) if sql and needs else sql)
            return f

        return put


def q_receipts(s, d):
    return p.receipts(s, d)


def q_monthly(s, d):
    return p.receipts(s, d, "monthly")
