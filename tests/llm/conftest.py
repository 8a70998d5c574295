import pytest


@pytest.fixture(scope="session")
def against_sql():
    """Compares a query of the subpackage with its SQL over a folder's tables."""
    import duckdb

    from mobtrace.llm.queries import ORACLES, QUERIES

    def run(spark, name, folder):
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        want = con.execute(ORACLES[name])
        columns = sorted(x[0] for x in want.description)
        at = [[x[0] for x in want.description].index(c) for c in columns]
        rows = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
        df = QUERIES[name](spark, folder)
        assert sorted(df.columns) == columns
        assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == rows
        return rows

    return run
