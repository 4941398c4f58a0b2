"""Compares a query with its SQL, rows in any order."""


def same(df, con, sql: str) -> None:
    got, want = df.toPandas(), con.sql(sql).df()
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    text = lambda x: x[names].astype(object).astype(str).sort_values(names).reset_index(drop=True)
    assert text(got).equals(text(want))
