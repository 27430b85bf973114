"""Cells that no program names do not move when actions are evaluated."""

from tabsleuth.operators import actions as A
from tabsleuth.operators import cells as C
from tabsleuth.session import ship_package

WANT = {"many": "2", "all": "3", "own": "['a', None]", "joined": "2", "free": "success!", "worse": "KeyError: 'z'"}
ACTIONS = [("many", "df1[df1['k'] > 1].shape[0]"), ("all", "len(df1)"), ("own", "df1.sort_values('k', ascending=False)['v'].tolist()[1:]"),
           ("joined", "df2.merge(df1, left_on='f', right_on='k')['v'].count()"), ("free", "x = df2['f'].max()"), ("worse", "df1['z'].sum()")]


def test_only_named_cells_are_written(spark, monkeypatch):
    ship_package(spark)
    wide = spark.createDataFrame([(0, 1, None, "u1"), (1, 2, "a", "u2"), (2, 3, "b", None)], "row_id long, k long, v string, unread string")
    other = spark.createDataFrame([(0, 2, "n"), (1, 3, "m"), (2, 9, "o")], "row_id long, f long, unread2 string")
    cells = C.cells_of({"one": wide, "two": other})
    written = {}

    def keep(df, name, _real=A.materialize):
        written[name] = _real(df, name)
        return written[name]
    monkeypatch.setattr(A, "materialize", keep)
    programs = spark.createDataFrame(ACTIONS, "program_id string, action string")
    aliases = programs.selectExpr("program_id", "inline(array(struct('df1' as alias, 'one' as table_id), struct('df2' as alias, 'two' as table_id)))")
    got = {r.program_id: r.answer for r in A.run_actions(programs, A.frames_of(aliases, cells), cells).collect()}
    assert got == WANT
    assert {r.col for r in written["action-cells"].select("col").distinct().collect()} == {"k", "v", "f"}


def test_rows_count_without_a_named_column(spark):
    ship_package(spark)
    cells = C.cells_of({"one": spark.createDataFrame([(0, 1), (1, 2)], "row_id long, k long")})
    programs = spark.createDataFrame([("n", "len(df1)"), ("none", None)], "program_id string, action string")
    aliases = programs.selectExpr("program_id", "'df1' as alias", "'one' as table_id")
    got = {r.program_id: r.answer for r in A.run_actions(programs, A.frames_of(aliases, cells), cells).collect()}
    assert got == {"n": "2", "none": "Error: no action found."}
