"""Every engine query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from quern import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows(df):
    plain = lambda v: round(v, 9) if isinstance(v, float) else int(v) if "int" in type(v).__name__ else v
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got) == sorted(want)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_twice_alike(spark, sf, name):
    a, b = (rows(catalog.QUERIES[name](spark, sf).toPandas()) for _ in range(2))
    assert a and len(a) == len(b)
    assert all(abs(x - y) < 1e-6 if isinstance(x, float) else x == y for p, q in zip(a, b) for x, y in zip(p, q))


def test_entry_survives_without_the_training_data_part(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__ as entry

    real = builtins.__import__

    def missing(name, *a, **k):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", missing)
    importlib.reload(entry)
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLES)
