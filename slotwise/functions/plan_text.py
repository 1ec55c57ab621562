"""Parsing of query-plan sub-step strings.

Sub-steps of a READ step come in three forms:

* ``$1:col_a,$2:col_b``  - parameter keys mapped to column names
* ``FROM project.dataset.table`` - the table read
* ``WHERE pred($1, ...)`` - the filter, referring to parameter keys
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (reference parsing rules) ---------------------------------
TABLE_PATTERN = r" (.+?)$"  # table name: everything after the first space
PREDICATE_KEY_PATTERN = r"\$[0-9]+"  # parameter keys inside a WHERE sub-step
COLUMN_LIST_SEPARATOR = ","  # between "$k:col" pairs (not trimmed)
KEY_COLUMN_SEPARATOR = ":"  # between key and column
READ_KIND = "READ"
INPUT_STAGE_SUFFIX = "Input"  # stage_name like '%Input'
FROM_PREFIX = "FROM "  # substep like 'FROM %'
COLUMNS_PREFIX = "$"  # substep like '$%'
WHERE_PREFIX = "WHERE"  # substep like 'WHERE%'
# ------------------------------------------------------------------------------


def table_name(substep: Column) -> Column:
    """Everything after the first space; NULL when nothing follows it."""
    return F.nullif(F.regexp_extract(substep, TABLE_PATTERN, 1), F.lit(""))


def column_params(substep: Column, trim: bool = False) -> Column:
    """The ``$k:col`` pairs of a column-list sub-step (split on ',', untrimmed)."""
    parts = F.split(substep, COLUMN_LIST_SEPARATOR, -1)
    if trim:
        parts = F.transform(parts, lambda p: F.trim(p))
    return parts


def param_key(param: Column, strict: bool = True) -> Column:
    parts = F.split(param, KEY_COLUMN_SEPARATOR, -1)
    return parts[0] if strict else F.get(parts, 0)


def param_column(param: Column, strict: bool = True) -> Column:
    """Column name of a ``$k:col`` pair.

    ``strict=True`` raises on a pair without ':' (the reference's ``offset``);
    ``strict=False`` gives NULL (``safe_offset``).
    """
    parts = F.split(param, KEY_COLUMN_SEPARATOR, -1)
    return parts[1] if strict else F.get(parts, 1)


def predicate_keys(substep: Column) -> Column:
    """Every ``$<digits>`` occurrence of a WHERE sub-step, in order, repeats kept."""
    return F.regexp_extract_all(substep, F.lit(PREDICATE_KEY_PATTERN), 0)
