"""Programs that ask the same share its evaluation and keep their own answers and errors."""

from tabsleuth.operators import actions as A
from tabsleuth.operators import cells as C
from tabsleuth.session import ship_package

_MERGE = "m = df2.merge(df1, left_on='f', right_on='k')\n"
_ACTIONS = [("x", _MERGE + "m[m['v'] == 'a']['k'].nunique()", "1"), ("y", _MERGE + "m[m['v'] == 'b']['k'].nunique()", "1"), ("z", _MERGE + "len(m)", "2"),
            ("again", _MERGE + "len(m)", "2"), ("twice", "x = df1['k'].max()\nx * x - df1['k'].min()", "8"), ("first", "df1['v'].min()", "a"),
            ("none", "df1[df1['k'] > 9]['k'].max()", "nan"), ("both", "df1[(df1['k'] > 1) & (df1['v'] == 'b')]['k'].sum()", "3"),
            ("error", "df1[df1['k'] > 9]['v'].iloc[0]", "IndexError: index out of bounds")]


def test_equal_nodes_are_evaluated_once(spark, monkeypatch):
    ship_package(spark)
    tables = {"one": spark.createDataFrame([(0, 1, "a"), (1, 2, "a"), (2, 3, "b")], "row_id long, k long, v string"),
              "two": spark.createDataFrame([(0, 2), (1, 3), (2, 9)], "row_id long, f long")}
    cells, written = C.cells_of(tables), {}

    def keep(df, name, _real=A.materialize):
        written[name] = _real(df, name)
        return written[name]
    monkeypatch.setattr(A, "materialize", keep)
    programs = spark.createDataFrame([(p, a) for p, a, _ in _ACTIONS], "program_id string, action string")
    aliases = programs.selectExpr("program_id", "inline(array(struct('df1' as alias, 'one' as table_id), struct('df2' as alias, 'two' as table_id)))")
    for rows in (None, C.rows_of(tables)):
        got = {r.program_id: r.answer for r in A.run_actions(programs, A.frames_of(aliases, cells), cells, rows=rows).collect()}
        assert got == {p: want for p, _, want in _ACTIONS}
        nodes = written["action-nodes"].where("kind = 'rows'")
        # x and y filter the joined rows, z and again are one
        assert nodes.where("right is not null").count() == 3 and nodes.where("source is null and tests is null and table_id = 'one'").count() == 1
