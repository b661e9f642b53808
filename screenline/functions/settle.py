"""Columns that are computed once, whatever is filtered on top of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns so that no filter is pushed below them.

    Pushing a filter through a projection copies the projected expression into
    the filter, once per mention. For chains of costly text expressions that
    runs patterns several times over and makes plans explode. The optimizer does
    not move conditions on generated columns, so the columns are generated, as
    the one row of an array of one. Filters on other columns still pass.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
