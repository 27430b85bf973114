"""Dataframe actions: against pandas itself, odd values, errors and the guard."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsleuth.functions.actions import compile_action
from tabsleuth.operators import actions as A
from tabsleuth.operators import cells as C
from tabsleuth.session import ship_package

PEOPLE = pd.DataFrame({"id": [1, 2, 3, 4, 5, 6], "Name": ["Ann", "bob", None, "Cid", "Ann", "Éva"], "Age": [30.0, 41.5, 25.0, None, 30.0, 18.0],
                       "City": ["Rome", "Oslo", "Rome", "Bern", "Oslo", "Rome"]})
CITIES = pd.DataFrame({"City": ["Rome", "Oslo", "Paris", "Rome"], "id": [7, 8, 9, 10], "Size": [3, 1, 2, 4]})

ACTIONS = """
df1[df1['Age'] > 29]['Name'].nunique()
df1[~(df1['Age'] > 29)]['id'].tolist()
df1[(df1['Age'] != 30) & (df1['City'] == 'Rome') | (df1['id'] == 5)]['id'].tolist()
df1[~((df1['Age'] > 20) & (df1['City'] == 'Rome'))]['id'].tolist()
df1['Age'].sum() / df1['Age'].count()
df1['Age'].mean()
df1['Age'].median()
df1['Age'].isna().sum()
df1[df1['Name'].isna()]['id'].tolist()
df1['Name'].dropna().tolist()
df1.sort_values('Age', kind='stable')['id'].tolist()
df1.sort_values('Age', ascending=False, kind='stable').head(2)['id'].tolist()
df1.sort_values(['City', 'id'], ascending=[False, True])['id'].tolist()
df1.sort_values('Name')['id'].tail(2).tolist()
df1.head(4).sort_values('id', ascending=False).head(2)['Name'].tolist()
df1.head(4)[df1['City'] == 'Rome']['id'].tolist()
df1.groupby('City')['Age'].max()
df1.groupby('City')['id'].sum().sort_values(ascending=False).index[0]
df1.groupby('City')['id'].count()['Oslo']
df1['City'].value_counts()
df1['City'].value_counts().index[0]
df1['City'].mode()[0]
df1.merge(df2, on='City')['Size'].tolist()
df1.merge(df2, on='City')['id_y'].sum()
df2.merge(df1, on='City').sort_values('id_x', ascending=False, kind='stable').head(3)['id_y'].tolist()
m = df1.merge(df2, on='City')\\nm[(m['Size'] > 1) & (m['Age'] < 31)].shape[0]
df1[df1['City'].isin(df2['City'])]['id'].tolist()
df1[~df1['City'].isin(df2[df2['Size'] > 1]['City'].tolist())]['id'].tolist()
df1[df1['id'].isin([1, 3, 99])]['City'].unique()
df1[df1['Age'] == df1['Age'].max()]['Name'].iloc[0]
df1[df1['Age'] > df1['Age'].mean() + 1]['id'].tolist()
df1[df1['Name'].str.contains('n', na=False)]['id'].count()
df1[df1['Name'].str.startswith('A', na=False)]['id'].tolist()
df1['id'].nlargest(2).tolist()
df1.nsmallest(2, 'Age')['id'].tolist()
df1['Name'].iloc[-1]
df1.iloc[1]['City']
df1.loc[df1['id'] > 4, 'City'].tolist()
df1['City'].nunique() == len(df2)
-df1['id'].min()
round(df1['Age'].mean(), 1)
df1.drop_duplicates('City')['id'].tolist()
df1['Age'].unique().tolist()[:2]
(df1['id'] > 0).all()
'Oslo' in df1['City'].values
df1[df1['id'] > 100]['id'].sum()
df1[df1['id'] > 100]['id'].tolist()
df1[df1['id'] > 100]['Age'].max()
df1.query("id >= 2 and City == 'Oslo'")['id'].tolist()
df1[df1['id'].between(2, 4)].shape
df1['Age'].max() - df2['Size'].min() * 2
""".strip().split("\n")


@pytest.fixture(scope="module")
def tables(spark):
    ship_package(spark)
    frames = {"people": (PEOPLE, "id long, Name string, Age double, City string"), "cities": (CITIES, "City string, id long, Size long")}
    cells = []
    for name, (pdf, schema) in frames.items():
        rows = [tuple(None if v is None or v != v else v for v in r) for r in pdf.itertuples(index=False)]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, " + schema)
        cells.append(C.to_cells(df, name))
    return cells[0].unionByName(cells[1]).cache()


def _run(spark, tables, actions, **options):
    programs = spark.createDataFrame(list(enumerate(actions)), "program_id int, action string")
    both = [F.struct(F.lit(a).alias("alias"), F.lit(t).alias("table_id")) for a, t in (("df1", "people"), ("df2", "cities"))]
    frames = A.frames_of(programs.select("program_id", F.explode(F.array(*both)).alias("a")).select("program_id", "a.*"), tables)
    return {actions[r.program_id]: (r.answer, r.is_error) for r in A.run_actions(programs, frames, tables, **options).collect()}


def _pandas(action):
    scope = {"df1": PEOPLE, "df2": CITIES}
    *before, last = action.replace("\\n", "\n").split("\n")
    exec("\n".join(before), {}, scope)          # noqa: S102 - the texts above
    out = eval(last, {}, scope)                 # noqa: S307
    if isinstance(out, pd.Series):
        out = {k: v.item() if hasattr(v, "item") else v for k, v in out.to_dict().items()}
    if isinstance(out, list):
        out = [None if v != v and any(isinstance(x, str) for x in out) else v for v in out]        # a missing text
    return str(out.tolist() if hasattr(out, "tolist") else out)


def test_answers_are_those_of_pandas(spark, tables):
    got = _run(spark, tables, [a.replace("\\n", "\n") for a in ACTIONS])
    want = {a.replace("\\n", "\n"): (_pandas(a), False) for a in ACTIONS}
    assert got == want


def test_errors_and_the_guard(spark, tables):
    got = _run(spark, tables, ["df1['Nme'].max()", "df7.shape", "df1[df1['id'] > 100]['id'].iloc[0]", "__import__('os')", "df1.to_csv('x')", "1 +", None, "",
                               "x = 3", "df1['Name'].mean()", "open('x').read()", "df1[df1['Name'] > 3]", "[x for x in df1]", "(lambda: 1)()"])
    assert all(v[1] for k, v in got.items() if k != "x = 3")
    assert got["x = 3"] == ("success!", False) and got[None][0] == "Error: no action found." and got["df1['Nme'].max()"][0] == "KeyError: 'Nme'"
    assert _run(spark, tables, ["df1['City'].tolist()"], max_chars=10) == {"df1['City'].tolist()": (A.TOO_LONG, True)}
    assert _run(spark, tables, ["df1['City'].max()"], max_chars=10) == {"df1['City'].max()": ("Rome", False)}


def test_conditions_are_bounded():
    frames = {"df1": {"table_id": "t", "columns": [{"name": "a", "dtype": "int64"}]}}
    many = " & ".join("((df1['a'] > 1) | (df1['a'] < 0))" for _ in range(20))
    assert compile_action(f"df1[{many}].shape[0]", frames)[2].startswith("NotImplementedError")
    assert compile_action("df1[" * 2000, frames)[2].startswith("SyntaxError")


def test_no_programs(spark, tables):
    assert _run(spark, tables, []) == {}
