"""Table programs: one pass over rows, no cells shuffled by row, first rows cut in each task."""

import contextlib
import io
import re

from tabsleuth.operators import cells as C
from tabsleuth.operators import programs as PG

_SCHEMA = "program_id string, table_id string, filter_col string, filter_value string, filter_op string, agg string, target_col string, by_col string, n long"
_PROGRAMS = [("count", "t", "k", "a", "=", "count", "x", None, 1), ("sum", "t", "k", "a", "=", "sum", "x", None, 1),
             ("kinds", "t", None, None, "=", "nunique", "k", None, 1), ("mode", "t", None, None, "=", "mode", "k", None, 1),
             ("top", "t", "x", "4", "<", "top", "name", "x", 2), ("last", "t", None, None, "=", "argmin", "name", "x", 1),
             ("null", "t", "k", None, "=", "count", "x", None, 1), ("nowhere", "u", "k", "a", "=", "count", "x", None, 1),
             ("not", "t", "k", "a", "!=", "count", "name", None, 1)]
_WANT = {"count": ("2", 3), "sum": ("6", 3), "kinds": ("2", 6), "mode": ("a", 6), "top": ("r3 | r1", 4), "last": ("r4", 6), "null": ("0", 0), "nowhere": ("0", 0),
         "not": ("2", 2)}


def _table(spark):
    rows = [(0, "r0", "a", 5.0), (1, "r1", "a", 1.0), (2, "r2", "a", None), (3, "r3", "b", 3.0), (4, "r4", "b", -1.0), (5, "r5", None, 1.0)]
    return spark.createDataFrame(rows, "row_id long, name string, k string, x double")


def test_programs_over_rows_and_over_cells(spark):
    programs, tables = spark.createDataFrame(_PROGRAMS, _SCHEMA), {"t": _table(spark)}
    for form in (C.rows_of(tables), C.cells_of(tables)):
        got = {r.program_id: (r.answer, r.n_rows) for r in PG.evaluate(programs, form).collect()}
        assert got == _WANT


def test_rows_stay_in_place(spark):
    programs, seen = spark.createDataFrame(_PROGRAMS, _SCHEMA), []
    write = PG.materialize
    try:
        PG.materialize = lambda df, name: seen.append((name, df)) or write(df, name)
        PG.evaluate(programs, C.rows_of({"t": _table(spark)})).collect()
    finally:
        PG.materialize = write
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        dict(seen)["program-answers"].explain()
    plan = text.getvalue()
    assert "WindowGroupLimit" in plan and not re.search(r"hashpartitioning\([^)]*(row_id|_value)", plan)
