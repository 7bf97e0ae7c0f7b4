"""The function library against values from the public documentation."""

import datetime
import decimal

import pytest
from function_cases import CASES

from quillstore.functions import REGISTRY, UnsupportedFunction, call, install, render
from quillstore.plans.rewrite import SqlError, rewrite, rewrite_expression


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, bytearray):
        return bytes(value)
    return str(value) if isinstance(value, (datetime.date, datetime.datetime)) else value


def test_values(spark):
    install(spark)
    wrong = []
    for at in range(0, len(CASES), 40):
        part = CASES[at : at + 40]
        row = spark.sql("SELECT " + ", ".join(f"{rewrite_expression(e)} AS c{i}" for i, (e, _) in enumerate(part))).first()
        for (text, want), got in zip(part, map(plain, row)):
            close = isinstance(want, float) and isinstance(got, (int, float)) and abs(got - want) <= 1e-9 * max(1, abs(want))
            if got != want and not close:
                wrong.append((text, got, want))
    assert wrong == []


def test_registry_is_whole():
    assert len(REGISTRY) >= 272
    with pytest.raises(UnsupportedFunction):
        render("load_file", "'x'")
    with pytest.raises(UnsupportedFunction):
        render("no_such_function")
    with pytest.raises(ValueError):
        render("ascii")


def test_call_as_column(spark):
    assert spark.range(3).select(call("lpad", "CAST(id AS STRING)", 3, "'0'").alias("x")).collect()[2].x == "002"


def test_sequences_and_variables(spark):
    from quillstore.functions import info

    with info.using(info.Scope()):
        info.create_sequence("s", 10, 5)
        assert [rewrite_expression(f"nextval({n!r})") for n in ("s", "s")] == ["(10)", "(15)"]
        assert rewrite_expression("lastval('s')") == "(15)"
        assert rewrite_expression("setvar('v', 3)") == "(3)" and rewrite_expression("getvar('v')") == "(3)"
    assert rewrite_expression("@v") == "(NULL)"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("select a, b from t limit 5, 10", "LIMIT 10 OFFSET 5"),
        ("select t.a as x from t join u on t.a = u.a where not t.b = 1", "JOIN u ON (t.a = u.a)"),
        ("select left(a, 2) from t left join u using (a)", "LEFT JOIN u USING (a)"),
        ("select count(distinct a) from t group by b having count(*) > 1 order by 2 desc", "ORDER BY 2 DESC"),
        ("select group_concat(a order by a separator ';') from t", "listagg(CAST(a AS STRING), ';') WITHIN GROUP (ORDER BY a)"),
        ("select row_number() over (partition by a order by b) from t", "OVER (PARTITION BY a ORDER BY b)"),
        ("select 1 union all select 2", "UNION ALL"),
    ],
)
def test_statements(text, want):
    assert want in rewrite(text)


def test_errors():
    with pytest.raises(SqlError):
        rewrite_expression("1 + ")
    with pytest.raises(SqlError):
        rewrite_expression("\\")


def test_week_modes_against_the_calendar(spark):
    """Every day of several years, in all modes, against counting from the definition."""
    from quillstore.functions.times import week

    start, n = datetime.date(1998, 12, 20), 800
    columns = [f"{week('d', m)[0]} AS w{m}" for m in range(8)]
    rows = spark.sql(f"SELECT d, {', '.join(columns)} FROM (SELECT date_add(DATE'{start}', CAST(id AS INT)) AS d FROM range({n}))").collect()

    def first(year, mode):
        day = datetime.date(year, 1, 1)
        since = day.weekday() if mode & 1 else (day.weekday() + 1) % 7  # days of its week before the year
        if mode in (1, 3, 4, 6):
            return day - datetime.timedelta(since) if since <= 3 else day + datetime.timedelta(7 - since)
        return day if since == 0 else day + datetime.timedelta(7 - since)

    for row in rows:
        for mode in range(8):
            year = row.d.year
            if mode in (2, 3, 6, 7):
                year += row.d >= first(year + 1, mode)
                year -= row.d < first(year, mode)
            assert row[f"w{mode}"] == (row.d - first(year, mode)).days // 7 + 1, (row.d, mode)
