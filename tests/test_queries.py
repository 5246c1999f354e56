"""Every query of the catalogue against DuckDB on the smallest tables."""

import duckdb
import pytest

from sheafwork.plans import catalogue, fixtures

EVERY = catalogue.queries() | fixtures.queries()
SQL = catalogue.oracle_sql() | fixtures.oracle_sql()

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(EVERY))
def test_query(spark, duck, name):
    df = EVERY[name](spark, DATA)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    done = duck.execute(SQL[name])
    columns = [c[0] for c in done.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in rows)
    theirs = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in done.fetchall())
    assert ours == theirs


def test_excel_formats_equals_its_sql_on_odd_prices(spark, duck, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    inf, nan = float("inf"), float("nan")
    odd = [496250.0, 250.0, 750.0, 0.125, 0.375, 1234567.125, 0.005, 0.015, 2.675, 0.0, 0.001, 999.995, 999950.0, 1e15, 1.23e20, 1e307, inf]
    prices = [*odd, *(-x for x in odd), None, nan]
    pq.write_table(pa.table({"o_orderkey": pa.array(range(len(prices)), pa.int64()), "o_totalprice": pa.array(prices, pa.float64())}), f"{tmp_path}/orders.parquet")
    sql = SQL["excel_formats"].replace("from orders", f"from '{tmp_path}/orders.parquet'")
    # of 1e307 DuckDB prints digits that the number doesn't have: only the percentage, which is infinite there, is compared
    near = lambda rows: sorted((k, *((p,) if k % len(odd) == 15 else (g, p, s))) for k, g, p, s in rows)
    ours = near(map(tuple, EVERY["excel_formats"](spark, str(tmp_path)).collect()))
    assert len(ours) == len(prices) and ours == near(duck.execute(sql).fetchall())


def test_spreadsheets_round_halves_up_and_printf_to_even():
    from sheafwork.functions.formats import shown

    assert [shown(496250.0, '0.0,"K"'), shown(-0.125, "0.00"), shown(-0.0, "0"), shown(float("nan"), "0"), shown(float("inf"), "0")] == ["496.3K", "-0.13", "0", None, None]
    assert [shown(496250.0, '0.0,"K"', True), shown(-0.125, "0.00", True), shown(-0.0, "0", True), shown(float("nan"), "0", True), shown(float("-inf"), "00000", True)] == ["496.2K", "-0.12", "-0", "nan", "-inf"]


def test_same_and_removed_words_rebuild_the_page():
    from sheafwork.operators.diff import edits

    found = edits("a b c d".split(), "a x c e d".split())
    assert " ".join(t for k, t in found if k != "added") == "a b c d"
    assert " ".join(t for k, t in found if k != "removed") == "a x c e d"


def test_edits_equal_a_plain_table():
    import random

    from sheafwork.operators.diff import edits

    def plain_edits(a, b):
        common = {}
        for i in reversed(range(len(a) + 1)):
            for j in reversed(range(len(b) + 1)):
                inside = i < len(a) and j < len(b)
                common[i, j] = common[i + 1, j + 1] + 1 if inside and a[i] == b[j] else max(common.get((i + 1, j), 0), common.get((i, j + 1), 0))
        out, i, j = [], 0, 0
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and a[i] == b[j]:
                out, i, j = [*out, ("same", a[i])], i + 1, j + 1
            elif i < len(a) and (j == len(b) or common[i + 1, j] >= common[i, j + 1]):
                out, i = [*out, ("removed", a[i])], i + 1
            else:
                out, j = [*out, ("added", b[j])], j + 1
        return out

    r = random.Random(1)
    for _ in range(400):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 20))] for _ in range(2))
        assert [(k, w) for k, t in edits(a, b) for w in t.split()] == plain_edits(a, b)


def test_delimited_is_lenient():
    from sheafwork.operators.delimited import parse, sniff

    assert list(parse('a,"b ""c"", d"\ne,f"g\n"h\ni",', ",")) == [["a", 'b "c", d'], ["e", 'f"g'], ["h\ni", ""]]
    assert sniff("a;b;c\n1;2;3\n") == ";"


def test_unknown_operations_are_errors(spark):
    from sheafwork.plans import dispatch

    with pytest.raises(ValueError):
        dispatch.run("compress", spark.range(1))
