"""Every query with SQL gives what the SQL gives."""

import math

import pytest

from tabfidelity.plans.queries import ORACLE_SQL, QUERIES

from .conftest import SMALL


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    answer = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.columns, df.collect()) == table(names, answer.fetchall())


#: Rows-only queries that fit models run in test_operators.py on smaller data.
SLOW = {"det5_ensemble_of_detectors", "det1_linear", "det2_boosted", "det3_mlp", "det4_gmm", "dwn1_train_on_synthetic", "prv2_k_anonymity_clustered", "gen2_gaussian_copula", "mv2_alpha_precision"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - SLOW))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).limit(1).collect()


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
