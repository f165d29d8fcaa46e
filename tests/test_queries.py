"""Every registered query of the library against its SQL twin; those without one must run and give rows."""

import pytest

from saleslens.plans import queries as plans

from .compare import difference, duck


def test_all_features_match_sql(spark, sf_dir, tmp_path):
    """All columns of every row, joined by date and series: too many to compare one by one."""
    df = plans.all_features(spark, sf_dir)
    df.write.parquet(f"{tmp_path}/features")
    con = duck(sf_dir)
    con.execute(f"CREATE TABLE a AS SELECT * FROM read_parquet('{tmp_path}/features/*.parquet')")
    con.execute(f"CREATE TABLE b AS {plans.ORACLE_SQL['all_features']}")
    kinds, others = (dict(con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {t})").fetchall()) for t in "ab")
    assert kinds == others and len(kinds) == 143
    a, b, both = (con.execute(x).fetchone()[0] for x in ("SELECT count(*) FROM a", "SELECT count(*) FROM b", "SELECT count(*) FROM a JOIN b USING (date, store_nbr, family)"))
    assert a == b == both > 0
    values = [c for c in kinds if c not in plans.KEY]
    differs = {c: f"a.{c} IS DISTINCT FROM b.{c}" + (f" AND NOT coalesce(abs(a.{c} - b.{c}) <= 1e-9 * abs(b.{c}) + 2e-6, false)" if kinds[c] == "DOUBLE" else "") for c in values}
    counts = con.execute(f"SELECT {', '.join(f'count_if({x})' for x in differs.values())} FROM a JOIN b USING (date, store_nbr, family)").fetchone()
    assert {c: n for c, n in zip(values, counts, strict=True) if n} == {}


@pytest.mark.parametrize("name", sorted(set(plans.ORACLE_SQL) - {"all_features"}))
def test_matches_sql(spark, sf_dir, name):
    assert difference(plans.QUERIES[name](spark, sf_dir), plans.ORACLE_SQL[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
