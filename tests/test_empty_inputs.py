"""Every order-line operator runs on an empty input (same schema, no rows)."""

import inspect

import pytest
from pyspark.sql import functions as F

from tillroll.operators import aggregate, customer, measures, rank, text, time

MODULES = [aggregate, customer, measures, rank, text, time]


def _line_operators():
    out = []
    for mod in MODULES:
        for name, fn in inspect.getmembers(mod, inspect.isfunction):
            if fn.__module__ != mod.__name__ or name.startswith("_"):
                continue
            params = list(inspect.signature(fn).parameters.values())
            required = [p for p in params if p.default is inspect.Parameter.empty]
            if len(required) == 1 and required[0].name == "sl":
                out.append((f"{mod.__name__.rsplit('.', 1)[1]}.{name}", fn))
    return out


@pytest.fixture(scope="module")
def empty_lines(spark, sf_small):
    from tillroll.sources.binding import sales_line
    return sales_line(spark, sf_small).where(F.lit(False))


@pytest.mark.parametrize("name,fn", _line_operators(), ids=[n for n, _ in _line_operators()])
def test_operator_on_empty_input(empty_lines, name, fn):
    rows = fn(empty_lines).collect()
    # global aggregates / per-label reports return rows of NULL or 0 next to their
    # labels; nothing numeric is made up from no data
    for r in rows:
        assert all(v in (None, 0, 0.0) or isinstance(v, str) for v in r), (name, r)


@pytest.fixture(scope="module")
def lines_with_nulls(spark, sf_small):
    from tillroll.sources.binding import sales_line
    base = sales_line(spark, sf_small).orderBy("row_id").limit(400)
    nulls = base.limit(6).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema.fields])
    return base.unionByName(nulls)


@pytest.mark.parametrize("name,fn", _line_operators(), ids=[n for n, _ in _line_operators()])
def test_operator_with_null_rows(lines_with_nulls, name, fn):
    fn(lines_with_nulls).collect()
