"""Every registered query of the core library against its SQL, and assertions on small rows."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import panels, queries, research, spine, stories, studies
from tidemark.functions import expr as E
from tidemark.operators import market, tables

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.QUERIES | research.QUERIES | panels.QUERIES | spine.QUERIES | studies.QUERIES | stories.QUERIES, queries.ORACLES | research.ORACLES | panels.ORACLES | spine.ORACLES | studies.ORACLES | stories.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SMALL)
    if name not in ORACLES:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    split = lambda rows: sorted((tuple(str(x) for x in r if not isinstance(x, float)), tuple(x for x in r if isinstance(x, float))) for r in rows)
    ours, theirs = split(got.select(*columns).collect()), split(want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert len(ours) == len(theirs)
    for (a, x), (b, y) in zip(ours, theirs, strict=True):
        assert a == b and x == pytest.approx(y, abs=2e-4 if name == "composite_scores" else 2e-6)


def test_strict_numbers_and_keys(spark):
    df = spark.createDataFrame([("1.5",), ("",), ("nan",), ("inf",), ("1d",), (None,), (" 2 ",)], "x string")
    assert [r[0] for r in df.select(E.strict_double(F.col("x"))).collect()] == [1.5, None, None, None, None, None, 2.0]
    row = spark.createDataFrame([("0000320193", "000032019323000106")], "c string, a string").select(E.cik10(F.col("c")), E.accession_dashed(F.col("a"))).first()
    assert tuple(row) == ("0000320193", "0000320193-23-000106")


def test_entry_on_or_after_the_date_and_weights_sum_to_nothing(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    prices = spark.createDataFrame([("a", "s", day(k), 10.0 + k) for k in (1, 3, 5)], "security string, sector string, date date, price double")
    asof = spark.createDataFrame([("a", day(k)) for k in (0, 1, 4, 6)], "security string, asof_date date")
    assert {r.asof_date: r.entry_date for r in market.entry_dates(asof, prices).collect()} == {day(0): day(1), day(1): day(1), day(4): day(5), day(6): None}
    df = spark.createDataFrame([("p", k, float(k)) for k in range(20)], "period string, name int, score double")
    held = market.holdings(df, period="period", name="name", score="score").collect()
    assert len(held) == 4 and abs(sum(r.weight for r in held)) < 1e-12 and sum(abs(r.weight) for r in held) == 2.0


def test_html_text(spark):
    df = spark.createDataFrame([("<head>x</head><p> A\n\tB&nbsp; C </p><script>z</script><table><tr>q</table>",)], "h string")
    assert df.select(tables.clean_html(F.col("h"))).first()[0] == "A B C"


def test_fold_models_fit_and_evaluate_every_month(spark):
    import numpy as np
    import pandas as pd

    got = {(r.fold_id, r.role): r for r in studies.fold_models(spark, SMALL).filter("model_name = 'ridge' and status = 'success'").collect()}
    t = pd.read_parquet(f"{SMALL}/lineitem.parquet")
    t["day"] = pd.to_datetime(t.l_shipdate).dt.normalize()
    t.loc[t.l_returnflag == "A", "l_tax"] = np.nan
    raw, y, day = t[["l_quantity", "l_discount", "l_tax"]].to_numpy(float), t.l_extendedprice.to_numpy(float), pd.Timedelta(days=1)
    first, last, want = t.day.min(), t.day.max(), {}
    for start in pd.date_range(first.replace(day=1) + pd.DateOffset(months=36), last, freq="MS"):
        valid_end = start - 64 * day
        valid_start = valid_end - pd.DateOffset(months=12) + day
        train_end = valid_start - 64 * day
        if train_end < first + pd.DateOffset(months=24) - day:
            continue
        name = f"WF{len(want) + 1:04d}_{start:%Y%m}"
        train = ((t.day >= first) & (t.day <= train_end)).to_numpy()
        x = np.where(np.isnan(raw), np.nanmedian(raw[train], axis=0), raw)
        mean, sd = x[train].mean(0), x[train].std(0)
        z = (x - mean) / sd
        w = np.linalg.solve(z[train].T @ z[train] + np.eye(3), z[train].T @ (y[train] - y[train].mean()))
        want[name] = {}
        for role, a, b in (("validation", valid_start, valid_end), ("test", start, start + pd.DateOffset(months=1) - day)):
            seen = ((t.day >= a) & (t.day <= b)).to_numpy()
            if seen.any():
                want[name][role] = (seen.sum(), np.sqrt(np.mean((y[seen] - z[seen] @ w - y[train].mean()) ** 2)))
    assert len(want) > 12 and set(got) == {(f, role) for f, roles in want.items() for role in roles}
    for (f, role), r in got.items():
        n, rmse = want[f][role]
        assert r.n_rows == n and r.rmse == pytest.approx(rmse, rel=1e-6)
