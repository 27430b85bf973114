"""Documents of whole columns and tables in chunks."""

import pytest

from tabsleuth.operators import cells as C
from tabsleuth.operators import corpus as K
from tabsleuth.operators import evidence as EV


@pytest.mark.parametrize("longest", [1, 400])
def test_large_documents_stay_in_ordered_parts(spark, monkeypatch, longest):
    """A table over the bound comes in parts of bounded size that give the whole; a small one stays one text."""
    for name, n in (("WHOLE_BYTES", 2000), ("CHUNK_BYTES", 500), ("CHUNK_ROWS", 64)):
        monkeypatch.setattr(C, name, n, raising=False)
    value = {("big", i, c): None if i % 7 == 0 else f"{i * 3 + c}é" * (longest if i == 100 else 1) for i in range(5, 605) for c in range(2)}
    value |= {("small", i, c): f"{i}" for i in range(100) for c in range(2)}
    cells = spark.createDataFrame([(t, i, c, f"n{c}", "object", v) for (t, i, c), v in value.items()],
                                  "table_id string, row_id long, col_id int, column_name string, dtype string, value string")

    docs = K.column_docs(cells).orderBy("doc_ord", "part").collect()
    for t, parts in (("big", 5), ("small", 1)):
        rows = sorted(i for x, i, c in value if x == t and c == 0)
        for c in range(2):
            got = [r for r in docs if (r.table_id, r.doc_ord) == (t, c)]
            assert "|".join(r.page_content for r in got) == "|".join(value[t, i, c] or "None" for i in rows)
            assert len(got) >= parts and (t == "big" or [r.part for r in got] == [0])
            assert all(len(r.page_content.encode()) <= 500 or "|" not in r.page_content for r in got)
        text = "\n".join(["| n0 | n1 |", "|---|---|", *("| " + " | ".join(value[t, i, c] or "None" for c in range(2)) + " |" for i in rows)])
        got = EV.markdown(cells.where(f"table_id = '{t}'"), ["table_id"])
        got = [r.markdown for r in got.orderBy("part").collect()]
        assert "\n".join(got) == text and len(got) >= parts


def test_one_part_below_the_bound(spark):
    cells = spark.createDataFrame([("t", i, 0, "n", "object", str(i)) for i in range(9)],
                                  "table_id string, row_id long, col_id int, column_name string, dtype string, value string")
    assert K.column_docs(cells).collect() == [("t", 0, "0|1|2|3|4|5|6|7|8", 0, 0)]
