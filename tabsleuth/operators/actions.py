"""Dataframe actions evaluated for all programs at once (L4).

``compile_actions`` turns each action text into program nodes (`functions.actions`);
``run_actions`` evaluates the nodes of all programs together over the long cell
form.  One round evaluates one level: its tests are joined with the cells of the
columns that they name (equalities on the value, so that only matching cells move),
nodes that programs have in common are evaluated once for all of them,
rows that pass all tests of a conjunction are kept by a grouped count, joins are
equi-joins of key cells, and values are one grouped aggregation.  The number of
rounds is the depth of the deepest program, not the number of programs.  Orders
are found by range sorts (`group_ordinals`), so no table is sorted in one task.

Answers are printed as Python prints them.  A list or a mapping whose text
would pass ``max_chars`` is not gathered: its answer is ``TOO_LONG``.

Defined cases: an action outside the grammar, an unknown table or column and
an index beyond the rows answer with an error text; null actions with 'Error: no action
found.'; statements without a value with 'success!'.  Comparisons with missing
values are false, != is true; missing values come last in any order; grouped
values come in the order of their keys, equal values in the order of keys or rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.actions import SHARED_SCHEMA, calculate, compile_action, shared_nodes
from ..functions.parse import observation_text, parse_action
from ..functions.text import token_count
from ..sources.store import materialize
from .cells import group_ordinals

# Observations of the reference's loop.
TOO_LONG = "Observation is too long, we cannot query the API."
NO_OUTPUT = "success!"
MAX_CHARS = 1_000_000

_PN = ["program_id", "node"]
#: Aggregates that pick one of the values.
_PICKS = ("min", "max", "first", "last")


def compile_actions(actions: DataFrame, frames: DataFrame) -> DataFrame:
    """actions(program_id, action), frames(program_id, alias, table_id, columns array<struct<name, dtype>>)
    -> program_id, answer_node, error, nodes; equal nodes of all programs have one id."""
    of = frames.groupBy("program_id").agg(F.map_from_entries(F.collect_list(F.struct("alias", F.struct("table_id", "columns")))).alias("frames"))

    @F.pandas_udf(f"answer_node long, error string, nodes array<struct<{SHARED_SCHEMA}>>")
    def compiled(text: pd.Series, tables: pd.Series) -> pd.DataFrame:
        rows = []
        for t, f in zip(text, tables):
            nodes, answer, error = compile_action(t, dict(f) if f is not None else {})
            nodes, answer = shared_nodes(nodes, answer)
            rows.append((answer, error, nodes))
        out = pd.DataFrame(rows, columns=["answer_node", "error", "nodes"], dtype=object)
        out["answer_node"] = out["answer_node"].astype("Int64")
        return out

    # only a few aliases stand in one program: the map is as small as the prompt that names them
    return actions.join(of, "program_id", "left").select("program_id", compiled("action", "frames").alias("c")).select("program_id", "c.*")


def frames_of(aliases: DataFrame, cells: DataFrame) -> DataFrame:
    """aliases(program_id, alias, table_id) with the columns of each table, in order."""
    columns = (cells.groupBy("table_id", "col_id").agg(F.first("column_name").alias("name"), F.first("dtype").alias("dtype"))
               .groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col_id", "name", "dtype"))).alias("c"))
               .select("table_id", F.transform("c", lambda c: F.struct(c["name"].alias("name"), c["dtype"].alias("dtype"))).alias("columns")))
    return aliases.join(columns, "table_id")


def _comparable(cells: DataFrame) -> DataFrame:
    """Cells with ``x``: the number or the time of a value, missing where it is not a number."""
    time = F.unix_micros(F.try_to_timestamp(F.col("value"))) / 1e6
    x = F.when(F.col("dtype").startswith("datetime"), time).otherwise(F.col("num"))
    kind = (F.when(F.col("dtype").startswith("int"), "i").when(F.col("dtype").startswith("float"), "f")
            .when(F.col("dtype").startswith("bool"), "b").otherwise("s"))
    return cells.select("table_id", "row_id", F.col("column_name").alias("col"), "value", F.when(~F.isnan(x), x).alias("x"), kind.alias("k"))


def _test_holds():
    """Whether a cell (value, x) passes its test; a missing value passes none but !=."""
    bound = F.when(F.col("kind") == "t", F.unix_micros(F.try_to_timestamp("text")) / 1e6).otherwise(F.col("bound"))
    number = F.col("kind").isin("n", "t")
    a, b = F.col("x"), bound
    op = F.col("op")

    def compare(f):
        return F.when(number, f(a, b)).otherwise(f(F.col("value"), F.col("text")) & (F.col("k") != "i") & (F.col("k") != "f"))
    tests = {"=": compare(lambda p, q: p == q), "!=": ~F.coalesce(compare(lambda p, q: p == q), F.lit(False)),
             "<": compare(lambda p, q: p < q), "<=": compare(lambda p, q: p <= q), ">": compare(lambda p, q: p > q), ">=": compare(lambda p, q: p >= q),
             "missing": F.col("value").isNull() | (F.col("k").isin("i", "f") & F.col("x").isNull()),
             "in": F.when(F.col("k").isin("i", "f"), F.array_contains("nums", a)).otherwise(F.array_contains("texts", F.col("value"))),
             "startswith": F.startswith("value", "text"), "endswith": F.endswith("value", "text"), "has": F.contains("value", "text"),
             "has_low": F.contains(F.lower("value"), F.col("text")), "matches": F.regexp_like("value", F.col("text"))}
    out = F.lit(None).cast("boolean")
    for name, t in tests.items():
        out = F.when(op == name, t).otherwise(out)
    return F.coalesce(out, F.lit(False)) != F.col("neg")


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _named(nodes: DataFrame) -> DataFrame:
    """table_id, col of the cells that the programs may read: a few rows for each table."""
    def texts(*arrays):
        return F.explode(F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])))

    def of(name):
        return F.transform(name, lambda s: s["col"]), F.transform(name, lambda s: s["table_id"])
    (test_col, test_table), (sort_col, sort_table) = of("tests"), of("sort")
    tables = nodes.select("program_id", texts(F.array("table_id", "right_table"), test_table, sort_table).alias("table_id"))
    cols = nodes.select("program_id", texts(F.array("left_on", "right_on", "distinct_col", "col", "key_col"), test_col, sort_col).alias("col"))
    named = tables.distinct().join(cols.distinct(), "program_id").select("table_id", "col").where("table_id is not null and col is not null")
    return materialize(named.distinct(), "action-columns")


class _Run:
    """The state of one evaluation.  ``has``: what occurs at the present level, so that steps nobody asks for are left out."""

    def __init__(self, cells: DataFrame, named: DataFrame, rows: DataFrame | None = None):
        # a row's identity needs one cell of it, any other cell is one that some program names: written once
        self.every = cells.select("table_id", "row_id").distinct() if rows is None else rows.select("table_id", "row_id")
        self.c = materialize(_comparable(cells).join(named, ["table_id", "col"], "left_semi"), "action-cells")
        self.has: dict[str, bool] = {}
        self.aggs: set[str] = set()
        self.rows: list[DataFrame] = []          # program_id, node, p1, p2 (place), row1, row2
        self.values: list[DataFrame] = []        # program_id, node, pos, kk, key, key_x, k, value, x

    def all_rows(self):
        return _union(self.rows)

    def all_values(self):
        return _union(self.values)

    # -- rows ------------------------------------------------------------------

    def tested(self, nodes: DataFrame, base: DataFrame | None) -> DataFrame:
        """program_id, node, row1, row2 of the rows that pass: of the table (``base`` None), else of ``base``."""
        one = (F.size("tests") == 1).alias("_one")
        t = nodes.select(*_PN, one, F.explode("tests").alias("t")).select(*_PN, "_one", "t.*").withColumn("bound", F.col("num"))
        if self.values:
            computed = self.all_values().where("pos = 0").select("program_id", F.col("node").alias("ref"), F.col("value").alias("_v"), F.col("x").alias("_x"))
            t = t.join(computed, ["program_id", "ref"], "left")
            scalar = F.col("ref").isNotNull() & ~F.col("op").isin("in_values", "in_keys")
            t = t.withColumn("text", F.when(scalar, F.col("_v")).otherwise(F.col("text"))).withColumn("bound", F.when(scalar, F.col("_x")).otherwise(F.col("bound"))).drop("_v", "_x")
        keep = [*_PN, "_one", "conj", "test", "n_tests"]
        member = F.col("op").isin("in_values", "in_keys")
        if base is None:
            rows = [F.col("row_id").alias("row1"), F.lit(None).cast("long").alias("row2")]
            cells = self.c
            on = ["table_id", "col"]
        else:
            b = base.select(*_PN, "row1", "row2")
            t = t.join(b, _PN).withColumn("row_id", F.when(F.col("side") == 0, F.col("row1")).otherwise(F.col("row2")))
            rows = [F.col("row1"), F.col("row2")]
            cells = self.c
            on = ["table_id", "col", "row_id"]
        same_text = (F.col("op") == "=") & (F.col("kind") == "s") & ~F.col("neg") & F.col("text").isNotNull()
        equal = t.where(same_text).withColumn("value", F.col("text")).join(cells.where(~F.col("k").isin("i", "f")), [*on, "value"])
        other = t.where(~F.coalesce(same_text, F.lit(False)) & ~member).join(cells, on).where(_test_holds())
        parts = [x.select(*keep, *rows) for x in (equal, other)]
        if self.has["member"]:
            every = t.where(member).join(cells, on).withColumn("_m", F.when(F.col("k").isin("i", "f"), F.col("x").cast("string")).otherwise(F.col("value")))
            v = self.all_values()
            sets = _union([v.select("program_id", F.col("node").alias("ref"), F.lit("in_values").alias("op"),
                                    F.when(F.col("k").isin("i", "f"), F.col("x").cast("string")).otherwise(F.col("value")).alias("_m")),
                           v.select("program_id", F.col("node").alias("ref"), F.lit("in_keys").alias("op"),
                                    F.when(F.col("kk").isin("i", "f"), F.col("key_x").cast("string")).otherwise(F.col("key")).alias("_m"))]).distinct()
            on_set = ["program_id", "ref", "op", "_m"]
            parts += [every.where(~F.col("neg")).join(sets, on_set, "left_semi").select(*keep, *rows),
                      every.where(F.col("neg")).join(sets, on_set, "left_anti").select(*keep, *rows)]
        # a row that passes the only test of a node is found once: there is nothing to count
        single, several = _union(parts).where("_one").select(*_PN, "row1", "row2"), _union(parts).where("not _one")
        several = (several.groupBy(*_PN, "conj", "n_tests", "row1", "row2").agg(F.count_distinct("test").alias("_n"))
                   .where(F.col("_n") == F.col("n_tests")).select(*_PN, "row1", "row2").distinct())
        return _union([several, single]) if self.has["conjunction"] else single

    def sourced(self, nodes: DataFrame) -> DataFrame:
        left = nodes.select(*_PN, "source", "right", "table_id", "right_table", "left_on", "right_on")
        rows = self.all_rows()
        src = rows.select("program_id", F.col("node").alias("source"), "p1", "p2", "row1", "row2")
        plain = left.where("right is null").join(src, ["program_id", "source"]).select(*_PN, "p1", "p2", "row1", "row2")
        key = F.when(F.col("k").isin("i", "f"), F.col("x").cast("string")).otherwise(F.col("value"))
        joined = left.where("right is not null")

        def keys(side, table, on, row, place):
            return (joined.select(*_PN, F.col(side).alias("_src"), F.col(table).alias("table_id"), F.col(on).alias("col"))
                    .join(rows.select("program_id", F.col("node").alias("_src"), F.col("row1").alias("row_id"), "p1"), ["program_id", "_src"])
                    .join(self.c, ["table_id", "col", "row_id"]).select(*_PN, key.alias("_key"), F.col("row_id").alias(row), F.col("p1").alias(place))
                    .where("_key is not null"))
        pairs = keys("source", "table_id", "left_on", "row1", "p1").join(keys("right", "right_table", "right_on", "row2", "p2"), [*_PN, "_key"])
        return _union([plain, pairs.select(*_PN, "p1", "p2", "row1", "row2")])

    def placed(self, found: DataFrame, nodes: DataFrame) -> DataFrame:
        """Sort, drop duplicates and cut."""
        steps = nodes.select(*_PN, "sort", "distinct_side", "distinct_col", "take", "from_end", "table_id", "right_table")
        if not (self.has["sort"] or self.has["distinct"] or self.has["take"]):
            return found
        moving = steps.where("sort is not null or distinct_col is not null or take is not null")
        still = found.join(moving.select(*_PN), _PN, "left_anti")
        rows = found.join(moving.select(*_PN), _PN, "left_semi")

        def row_of(side):
            return F.when(F.col(side) == 0, F.col("row1")).otherwise(F.col("row2"))
        ordered = self.sort_orders(rows, moving, row_of) if self.has["sort"] else rows.withColumn("_order", F.lit(None).cast("array<bigint>"))
        ordered = ordered.withColumn("_order", F.coalesce("_order", F.array().cast("array<bigint>"))).withColumn("p2", F.coalesce("p2", F.lit(0).cast("long")))
        # range sorts read their rows twice: these are written first
        numbered = group_ordinals(materialize(ordered, "action-ordered"), _PN, ["_order", "p1", "p2"], col="_place")
        numbered = numbered.drop("_order", "p1", "p2").withColumnRenamed("_place", "p1").withColumn("p2", F.lit(0).cast("long"))
        numbered = numbered.join(moving.drop("sort"), _PN)
        if not self.has["distinct"]:
            return _union([still, self.cut(numbered, "p1").select(*_PN, "p1", "p2", "row1", "row2")])
        once = numbered.where("distinct_col is not null").withColumn("row_id", row_of("distinct_side")).withColumn(
            "table_id", F.when(F.col("distinct_side") == 0, F.col("table_id")).otherwise(F.col("right_table"))).withColumn("col", F.col("distinct_col"))
        first = (once.join(self.c.select("table_id", "col", "row_id", "value"), ["table_id", "col", "row_id"])
                 .groupBy(*_PN, "value", "take", "from_end").agg(F.min_by(F.struct("row1", "row2"), "p1").alias("r"), F.min("p1").alias("p1")))
        first = materialize(first.select(*_PN, "take", "from_end", "r.row1", "r.row2", "p1"), "action-firsts")
        firsts = group_ordinals(first, _PN, ["p1"], col="_place").drop("p1").withColumnRenamed("_place", "p1").withColumn("p2", F.lit(0).cast("long"))
        rest = _union([numbered.where("distinct_col is null").select(*_PN, "take", "from_end", "row1", "row2", "p1", "p2"), firsts])
        rest = self.cut(rest, "p1")
        return _union([still, rest.select(*_PN, "p1", "p2", "row1", "row2")])

    def sort_orders(self, rows: DataFrame, moving: DataFrame, row_of) -> DataFrame:
        """Rows with ``_order``: the ranks of their sort keys, to be compared as a list."""
        keyed = (rows.join(moving.where("sort is not null").select(*_PN, F.explode("sort").alias("s")).select(*_PN, "s.*"), _PN)
                 .withColumn("row_id", row_of("side")).join(self.c, ["table_id", "col", "row_id"])
                 .select(*_PN, "row1", "row2", "i", "ascending", "x", "value", (F.col("value").isNull() | (F.col("k").isin("i", "f") & F.col("x").isNull())).alias("last")))
        keyed = materialize(keyed, "sort-keys")
        distinct = keyed.where("not last").select(*_PN, "i", "x", "value").distinct()
        number = materialize(group_ordinals(distinct, [*_PN, "i"], ["x", "value"], col="_rank"), "sort-ranks")
        same = [keyed[c].eqNullSafe(number[c]) for c in ("x", "value")]
        k = keyed.join(number, (keyed["program_id"] == number["program_id"]) & (keyed["node"] == number["node"]) & (keyed["i"] == number["i"])
                       & same[0] & same[1], "left").select(*[keyed[c] for c in (*_PN, "row1", "row2", "i", "ascending", "last")], "_rank")
        big = F.lit(2 ** 62)
        rank = F.when(F.col("last"), big).when(F.col("ascending"), F.col("_rank")).otherwise(-F.col("_rank"))
        orders = k.groupBy(*_PN, "row1", "row2").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", rank.alias("r")))), lambda s: s["r"]).alias("_order"))
        second = F.coalesce("row2", F.lit(-1))
        return rows.withColumn("_r2", second).join(orders.withColumn("_r2", second).drop("row2"), [*_PN, "row1", "_r2"], "left").drop("_r2")

    def cut(self, rows: DataFrame, place: str) -> DataFrame:
        """The first or last ``take`` rows of each node by their place."""
        if not self.has["take"]:
            return rows
        n = rows.where("from_end").groupBy(*_PN).agg(F.count(F.lit(1)).alias("_n"))
        rows = rows.join(n, _PN, "left")
        return rows.where(F.col("take").isNull() | F.when(F.col("from_end"), F.col(place) >= F.col("_n") - F.col("take")).otherwise(F.col(place) < F.col("take"))).drop("_n")

    def step_rows(self, nodes: DataFrame) -> None:
        table = nodes.where("source is null")
        wanted = table.where("tests is null").select(*_PN, "table_id")
        whole = wanted.join(self.every.join(wanted.select("table_id").distinct(), "table_id", "left_semi"), "table_id").select(
            *_PN, F.col("row_id").alias("row1"), F.lit(None).cast("long").alias("row2"))
        found = [_union([whole, self.tested(table.where("tests is not null"), None)]).select(
            *_PN, F.col("row1").alias("p1"), F.lit(None).cast("long").alias("p2"), "row1", "row2")]
        if self.rows:
            base = materialize(self.sourced(nodes.where("source is not null")), "action-sources")
            filtering = nodes.where("source is not null and tests is not null")
            free = base.join(filtering.select(*_PN), _PN, "left_anti")
            hits = self.tested(filtering, base).withColumn("_r2", F.coalesce("row2", F.lit(-1))).drop("row2")
            kept = base.withColumn("_r2", F.coalesce("row2", F.lit(-1))).join(hits, [*_PN, "row1", "_r2"], "left_semi").drop("_r2")
            found += [free, kept]
        found = materialize(_union(found), "action-found")
        placed = self.placed(found, nodes)
        self.rows.append(found if placed is found else materialize(placed, "action-rows"))

    # -- values ----------------------------------------------------------------

    def step_values(self, nodes: DataFrame) -> None:
        wide = nodes.select(*_PN, "source", "side", "col", "is_int", "key_side", "key_col", "agg", "order_by", "ascending", "unique", "drop_null",
                            "take", "from_end", "fold")
        tables = self.nodes.where("kind = 'rows'").select("program_id", F.col("node").alias("source"), F.col("table_id").alias("_t1"), F.col("right_table").alias("_t2"))
        rows = wide.join(tables, ["program_id", "source"]).join(
            self.all_rows().select("program_id", F.col("node").alias("source"), "p1", "p2", "row1", "row2"), ["program_id", "source"])
        # of joined rows the second table's name comes with the node that joins; later nodes keep it
        at = [F.when(F.col("side") == 0, F.col("_t1")).otherwise(F.col("_t2")).alias("table_id"), F.when(F.col("side") == 0, F.col("row1")).otherwise(F.col("row2")).alias("row_id")]
        own = rows.select("*", *at).join(self.c, ["table_id", "col", "row_id"]).drop("table_id", "row_id", "_c")
        key_at = [F.when(F.col("key_side") == 0, F.col("_t1")).otherwise(F.col("_t2")).alias("table_id"),
                  F.when(F.col("key_side") == 0, F.col("row1")).otherwise(F.col("row2")).alias("row_id")]
        keyed = own.where("key_col is not null").select("*", *key_at).join(
            self.c.select("table_id", F.col("col").alias("key_col"), "row_id", F.col("value").alias("key"), F.col("x").alias("key_x"), F.col("k").alias("kk")),
            ["table_id", "key_col", "row_id"]).where("key is not null").drop("table_id", "row_id")
        flat = own.where("key_col is null").withColumn("key", F.lit(None).cast("string")).withColumn("key_x", F.lit(None).cast("double")).withColumn("kk", F.lit(None).cast("string"))
        vals = _union([flat, keyed])
        missing = F.col("value").isNull() | (F.col("k").isin("i", "f") & F.col("x").isNull())
        vals = vals.withColumn("_missing", missing).where(~(F.col("drop_null") & F.col("_missing")))
        meta = ["is_int", "order_by", "ascending", "take", "from_end", "fold"]

        # lists: values in the order of the rows
        lists = vals.where("agg is null")
        plain = lists.where("not unique").select(*_PN, *meta, "p1", "p2", "k", "value", "x", "_missing")
        single = (lists.where("unique").groupBy(*_PN, *meta, "k", "value", "x", "_missing")
                  .agg(F.min(F.struct("p1", "p2")).alias("_p")).select(*_PN, *meta, F.col("_p.p1").alias("p1"), F.col("_p.p2").alias("p2"), "k", "value", "x", "_missing"))
        listed = _union([plain, single])

        # aggregates, by key or whole; each kind only where some node asks for it
        group = [*_PN, *meta, "agg", "key", "key_x", "kk", "k"]
        a, k = F.col("agg"), F.col("k")
        text_kind = ~k.isin("i", "f")
        present = F.when(~F.col("_missing"), F.col("value"))
        px = F.when(~F.col("_missing"), F.col("x"))
        first_place = F.min("p1").alias("p1")

        def part(rows, kind, v, x):
            return rows.select(*_PN, *meta, "agg", "key", "key_x", "kk", kind.alias("k"), v.alias("value"), x.alias("x"), "p1")
        parts, none = [], F.lit(None)
        if self.aggs - {"median", "nunique", *_PICKS}:
            dec = F.sum(F.when(~F.col("_missing"), F.coalesce(F.col("x"), (F.col("value") == "True").cast("int").cast("double"))).cast("decimal(38,10)")).cast("double")
            truth = F.when(k.isin("i", "f"), F.col("x") != 0).otherwise(F.col("value").isNotNull() & ~F.col("value").isin("", "False"))
            r = vals.where("agg is not null").where(~a.isin("median", "nunique", *_PICKS)).groupBy(*group).agg(
                F.count(F.lit(1)).alias("size"), F.count(present).alias("count"), dec.alias("sum"), F.stddev_samp(px).alias("std"),
                F.bool_or(truth).alias("any"), F.bool_and(truth).alias("all"), first_place)
            x = (F.when(a == "size", F.col("size").cast("double")).when(a == "count", F.col("count").cast("double"))
                 .when(a == "sum", F.coalesce("sum", F.lit(0.0))).when(a == "mean", F.col("sum") / F.col("count")).when(a == "std", F.col("std")))
            v = F.initcap(F.when(a == "any", F.col("any").cast("string")).when(a == "all", F.col("all").cast("string")))
            kind = (F.when(a.isin("size", "count"), "i").when(a.isin("mean", "std"), "f").when(a == "sum", F.when((k == "i") | text_kind, "i").otherwise("f"))
                    .when(a.isin("any", "all"), "b").otherwise(k))
            parts.append(part(r, kind, v, x))
        if "nunique" in self.aggs:
            r = vals.where("agg = 'nunique'").groupBy(*group).agg(F.count_distinct(present).alias("n"), first_place)
            parts.append(part(r, F.lit("i"), none.cast("string"), F.col("n").cast("double")))
        if self.aggs & set(_PICKS):
            # texts and structs among the aggregates would sort all rows; beside a set, groups are hashed while they are few
            r = vals.where(a.isin(*_PICKS)).groupBy(*group).agg(
                F.min(px).alias("min_x"), F.max(px).alias("max_x"), F.min(present).alias("min_v"), F.max(present).alias("max_v"), first_place,
                F.min_by(F.struct("x", "value"), F.struct("_missing", "p1", "p2")).alias("first"), F.max_by(F.struct("x", "value"), F.struct(~F.col("_missing"), "p1", "p2")).alias("last"),
                F.collect_set(F.when(F.col("_missing") & F.lit(False), True)).alias("_hashed")).where(F.size("_hashed") == 0)
            x = F.when(a == "min", F.col("min_x")).when(a == "max", F.col("max_x")).when(a == "first", F.col("first.x")).when(a == "last", F.col("last.x"))
            v = F.when(a == "min", F.col("min_v")).when(a == "max", F.col("max_v")).when(a == "first", F.col("first.value")).when(a == "last", F.col("last.value"))
            parts.append(part(r, k, v, x))
        # whole-column aggregates of no rows
        none = wide.where("agg <> 'median' and key_col is null")
        grouped = [materialize(_union(parts), "action-groups")] if parts else []
        none = none.join(grouped[0].select(*_PN), _PN, "left_anti") if parts else none
        zero = F.when(F.col("agg").isin("size", "count", "nunique", "sum"), F.lit(0.0))
        grouped = _union([*grouped, none.select(*_PN, *meta, "agg", F.when(F.col("agg") == "sum", F.when(F.col("is_int"), "i").otherwise("f"))
                                               .when(F.col("agg").isin("size", "count", "nunique"), "i").when(F.col("agg").isin("any", "all"), "b").otherwise("f").alias("k"),
                                               F.when(F.col("agg") == "any", "False").when(F.col("agg") == "all", "True").alias("value"), zero.alias("x"),
                                                *[F.lit(None).cast(t).alias(c) for c, t in (("key", "string"), ("key_x", "double"), ("kk", "string"), ("p1", "long"))])])
        if self.has["median"]:
            grouped = _union([grouped, self.medians(vals.where("agg = 'median' and not _missing"), wide.where("agg = 'median'"), meta)])
        series = grouped.withColumn("_missing", F.col("value").isNull() & F.col("x").isNull())
        if self.has["fold"]:
            series = _union([series.where("fold is null"), self.folded(series.where("fold is not null"), wide.where("fold is not null"), meta)])
        if not self.has["several"]:
            self.values.append(materialize(series.withColumn("pos", F.lit(0).cast("long")).select(*_PN, "pos", "kk", "key", "key_x", "k", "value", "x"), "action-values"))
            return

        every = materialize(_union([series, listed]), "action-listed")
        by_value = F.col("order_by").isin("value", "frequency")
        by_key = F.col("order_by") == "key"
        sign = F.when(F.col("ascending"), F.lit(1.0)).otherwise(F.lit(-1.0))
        # texts in descending order: by their rank among the node's values
        texts = every.where(by_value & F.col("k").isin("s", "b") & ~F.col("_missing")).select(*_PN, "value").distinct()
        ranks = group_ordinals(texts, _PN, ["value"], col="_rank")
        key_texts = every.where(by_key & ~F.col("kk").isin("i", "f")).select(*_PN, "key").distinct()
        key_ranks = group_ordinals(key_texts, _PN, ["key"], col="_key_rank")
        every = every.join(ranks, [*_PN, "value"], "left").join(key_ranks, [*_PN, "key"], "left")
        rank = F.coalesce(F.when(F.col("k").isin("i", "f"), F.col("x")), F.col("_rank").cast("double"))
        key_rank = F.coalesce(F.when(F.col("kk").isin("i", "f"), F.col("key_x")), F.col("_key_rank").cast("double"))
        every = (every.withColumn("_o1", F.when(by_value & F.col("_missing"), 1).otherwise(0))
                 .withColumn("_o2", F.when(by_value, sign * rank).when(by_key, sign * key_rank))
                 .withColumn("_o3", F.when(F.col("order_by") == "frequency", F.col("p1")).otherwise(F.lit(0)))
                 .withColumn("_o7", F.coalesce("key_x", F.lit(0.0))).withColumn("_o4", F.coalesce("key", F.lit("")))
                 .withColumn("_o5", F.coalesce("p1", F.lit(0).cast("long"))).withColumn("_o6", F.coalesce("p2", F.lit(0).cast("long"))))
        every = group_ordinals(every, _PN, ["_o1", "_o2", "_o3", "_o7", "_o4", "_o5", "_o6"], col="pos")
        every = self.cut(every, "pos")
        # places of the last values start at 0 again
        starts = every.where("from_end").groupBy(*_PN).agg(F.min("pos").alias("_from"))
        every = every.join(starts, _PN, "left").withColumn("pos", F.col("pos") - F.coalesce("_from", F.lit(0)))
        self.values.append(materialize(every.select(*_PN, "pos", "kk", "key", "key_x", "k", "value", "x"), "action-values"))

    def medians(self, vals, wide, meta):
        vals = materialize(vals.select(*_PN, "x"), "action-medians")
        n = vals.groupBy(*_PN).agg(F.count(F.lit(1)).alias("_n"))
        placed = group_ordinals(vals, _PN, ["x"], col="_i").join(n, _PN)
        middle = placed.where((F.col("_i") >= F.floor((F.col("_n") - 1) / 2)) & (F.col("_i") <= F.floor(F.col("_n") / 2))).groupBy(*_PN).agg(F.avg("x").alias("x"))
        return wide.join(middle, _PN, "left").select(*_PN, *meta, "agg", F.lit("f").alias("k"), F.lit(None).cast("string").alias("value"), "x")

    def folded(self, series, wide, meta):
        """One value of all groups."""
        f = F.col("fold")
        out = series.groupBy(*_PN).agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("x").cast("decimal(38,10)")).cast("double").alias("sum"),
                                       F.min("x").alias("min"), F.max("x").alias("max"), F.max("k").alias("k"))
        out = wide.join(out, _PN, "left")
        x = (F.when(f == "count", F.coalesce("count", F.lit(0)).cast("double")).when(f == "sum", F.coalesce("sum", F.lit(0.0)))
             .when(f == "mean", F.col("sum") / F.col("count")).when(f == "min", F.col("min")).when(f == "max", F.col("max")))
        kind = F.when(f == "count", "i").when(f == "mean", "f").otherwise(F.coalesce("k", F.lit("f")))
        return out.select(*_PN, *meta, "agg", kind.alias("k"), F.lit(None).cast("string").alias("value"), x.alias("x"), F.lit(False).alias("_missing"))

    # -- expressions -------------------------------------------------------------

    def step_exprs(self, nodes: DataFrame, max_chars: int) -> DataFrame:
        """program_id, node, k, value, x, text, error of the expressions."""
        refs = nodes.select(*_PN, "code", F.explode_outer(F.arrays_zip("refs", "names")).alias("r")).select(
            *_PN, "code", F.col("r.refs").alias("ref"), F.col("r.names").alias("name"))
        if self.values:
            v = self.all_values().select("program_id", F.col("node").alias("ref"), "pos", "kk", "key", "key_x", "k", F.col("value").alias("v"), "x")
            sizes = v.groupBy("program_id", "ref").agg((F.sum(F.coalesce(F.octet_length("v"), F.lit(8)) + F.coalesce(F.octet_length("key"), F.lit(0)) + 4)).alias("chars"))
            heavy = refs.join(sizes, ["program_id", "ref"]).groupBy(*_PN).agg(F.sum("chars").alias("chars")).where(F.col("chars") > max_chars).select(*_PN)
            light = refs.join(heavy, _PN, "left_anti")
            got = light.join(v, ["program_id", "ref"], "left")
        else:
            heavy = refs.select(*_PN).limit(0)
            got = refs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (
                ("pos", "long"), ("kk", "string"), ("key", "string"), ("key_x", "double"), ("k", "string"), ("v", "string"), ("x", "double"))])
        one = F.struct("name", "pos", "k", "kk", "key", "key_x", "v", "x")
        # bounded by max_chars
        rows = got.groupBy(*_PN, "code").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), one))).alias("rows"))

        @F.pandas_udf("k string, value string, x double, text string, error string")
        def compute(code: pd.Series, rows: pd.Series) -> pd.DataFrame:
            out = []
            for c, rs in zip(code, rows):
                values: dict = {}
                for r in rs:
                    at = [None if y is not None and y != y else y for y in (r["k"], r["kk"], r["key"], r["key_x"], r["v"], r["x"])]
                    values.setdefault(r["name"], []).append(tuple(at))
                try:
                    got = calculate(c, values)
                except Exception as e:  # noqa: BLE001 - the error is the program's answer
                    out.append((None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                number = isinstance(got, (int, float)) and not isinstance(got, bool)
                kind = "b" if isinstance(got, bool) else "i" if isinstance(got, int) else "f" if isinstance(got, float) else "s"
                out.append((kind, None if number else str(got), float(got) if number else None, str(got), None))
            return pd.DataFrame(out, columns=["k", "value", "x", "text", "error"], dtype=object).astype({"x": "float64"})

        done = rows.select(*_PN, compute("code", "rows").alias("e")).select(*_PN, "e.*")
        none = F.lit(None).cast("string")
        return materialize(_union([done, heavy.select(*_PN, none.alias("k"), none.alias("value"), F.lit(None).cast("double").alias("x"), none.alias("text"),
                                                      F.lit(TOO_LONG).alias("error"))]), "action-exprs")

    def run(self, nodes: DataFrame, max_chars: int) -> DataFrame | None:
        # a node that reads joined rows needs the second table's name of the node that joins
        self.nodes = nodes
        test = F.coalesce(F.transform("tests", lambda t: t["op"]), F.array().cast("array<string>"))
        some = {"conjunction": F.coalesce(F.size("tests") > 1, F.lit(False)), "member": F.arrays_overlap(test, F.array(F.lit("in_values"), F.lit("in_keys"))), "sort": F.col("sort").isNotNull(),
                "distinct": F.col("distinct_col").isNotNull(), "take": F.col("take").isNotNull(), "median": F.col("agg") == "median",
                "fold": F.col("fold").isNotNull(), "several": (F.col("kind") == "values") & (F.col("agg").isNull() | (F.col("key_col").isNotNull() & F.col("fold").isNull()))}
        levels = nodes.groupBy("level").agg(F.collect_set("kind").alias("kinds"), F.collect_set("agg").alias("aggs"), *[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in some.items()])
        out = []
        for r in sorted(levels.collect(), key=lambda r: r["level"]):           # a row for each level
            self.has, self.aggs = {n: r[n] for n in some}, set(r["aggs"])
            here, kinds = nodes.where(F.col("level") == r["level"]), r["kinds"]
            if "rows" in kinds:
                self.step_rows(here.where("kind = 'rows'"))
            if "values" in kinds:
                self.step_values(here.where("kind = 'values'"))
            if "expr" in kinds:
                e = self.step_exprs(here.where("kind = 'expr'"), max_chars)
                out.append(e)
                self.values.append(e.select(*_PN, F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("kk"), F.lit(None).cast("string").alias("key"),
                                            F.lit(None).cast("double").alias("key_x"), "k", "value", "x"))
        return _union(out) if out else None


def run_actions(actions: DataFrame, frames: DataFrame, cells: DataFrame, max_chars: int = MAX_CHARS, rows: DataFrame | None = None) -> DataFrame:
    """actions(program_id, action) -> program_id, answer, is_error.  ``rows``: table_id, row_id of every row, once; else found in ``cells``."""
    compiled = materialize(compile_actions(actions, frames), "actions")
    own = compiled.select("program_id", F.posexplode("nodes").alias("_at", "n")).select("program_id", "_at", "n.*")
    # what several programs ask is asked once, by no program in particular
    nodes = materialize(own.drop("program_id", "_at").dropDuplicates(["sig"]).withColumn("program_id", F.lit("")), "action-nodes")
    n, ids = nodes.agg(F.count(F.lit(1)), F.count_distinct("node")).first()
    if n != ids:
        raise ValueError("two nodes share a 60-bit hash of what they do")
    exprs = _Run(cells, _named(own), rows).run(nodes, max_chars)
    plain = compiled.select("program_id", "answer_node", F.col("error").alias("broken"))
    if exprs is None:
        got = plain.withColumn("text", F.lit(None).cast("string")).withColumn("failed", F.lit(None).cast("string"))
    else:
        # the error of an inner expression is the program's error
        failed = own.where("kind = 'expr'").select("program_id", "_at", "node").join(exprs.where("error is not null").select("node", "error"), "node")
        inner = failed.groupBy("program_id").agg(F.min_by("error", "_at").alias("failed"))
        last = exprs.select(F.col("node").alias("answer_node"), "text")
        got = plain.join(last, "answer_node", "left").join(inner, "program_id", "left")
    error = F.coalesce("broken", "failed")
    return got.select("program_id", F.coalesce(error, F.when(F.col("answer_node").isNull(), NO_OUTPUT), F.when(F.col("text") == "", NO_OUTPUT), "text").alias("answer"),
                      error.isNotNull().alias("is_error"))


def observe(replies: DataFrame, frames: DataFrame, cells: DataFrame, limit: int, count=token_count, rows: DataFrame | None = None) -> DataFrame:
    """replies(program_id, reply) -> program_id, observation: what a reasoning loop shows next (F10, SC18).

    The code after the last 'Action:' is evaluated; an observation of more than ``limit`` tokens is replaced by ``TOO_LONG``.  ``count`` gives the
    tokens of a text column."""
    actions = replies.select("program_id", parse_action(F.col("reply")).alias("action"))
    ran = run_actions(actions, frames, cells, rows=rows).join(actions, "program_id")
    shown = F.when(count(F.col("answer")) > limit, F.lit(TOO_LONG)).otherwise(F.col("answer"))
    return ran.select("program_id", observation_text(F.col("action"), shown).alias("observation"))
