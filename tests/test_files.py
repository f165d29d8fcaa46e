"""Readers, writers, synthetic data, runs over files, texts and streaming on small inputs."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from saleslens.functions import text
from saleslens.operators import eda, temporal
from saleslens.plans import runs
from saleslens.sources import readers, synthetic, writers
from saleslens.streaming import panels

DAY = date(2017, 6, 1)


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    base = f"file://{tmp_path_factory.mktemp('project')}"
    made = synthetic.generate_synthetic_data(spark, n_days=40, n_stores=3, n_families=4, save_to=f"{base}/data/raw")
    return readers.Project(base), made


def test_synthetic_data_is_seeded_and_in_range(spark, project):
    _, made = project
    again = synthetic.generate_synthetic_data(spark, n_days=40, n_stores=3, n_families=4)
    assert all(sorted(map(str, made[n].collect())) == sorted(map(str, again[n].collect())) for n in made)
    r = made["train"].agg(F.count("*").alias("n"), F.min("sales").alias("low"), F.avg((F.col("sales") == 0).cast("int")).alias("zero"), F.avg("onpromotion").alias("promo")).first()
    assert r.n == 40 * 3 * 4 and r.low == 0 and 0.05 < r.zero < 0.16 and 0.1 < r.promo < 0.2
    o = made["oil"].agg(F.min("dcoilwtico"), F.max("dcoilwtico"), F.count("*")).first()
    assert 30 <= o[0] <= o[1] <= 150 and o[2] == 40
    assert made["holidays_events"].count() == 2 and made["stores"].count() == 3


def test_readers_give_what_was_written(spark, project):
    where, made = project
    raw = where.data_dir()
    found = readers.check_data_files(spark, raw)
    assert {n for n, there in found.items() if there} == {"train.csv", "stores.csv", "oil.csv", "holidays_events.csv"}
    for load, name in ((readers.load_train_data, "train"), (readers.load_stores_data, "stores"), (readers.load_oil_data, "oil"), (readers.load_holidays_data, "holidays_events")):
        got = load(spark, raw)
        assert got.columns == made[name].columns and got.exceptAll(made[name]).isEmpty() and got.count() == made[name].count()
    assert readers.load_transactions_data(spark, raw) is None
    spark.createDataFrame([(DAY, 1, 7)], "date date, store_nbr int, transactions int").transform(lambda d: writers.write_csv(d, f"{raw}/transactions.csv") or d)
    assert [tuple(r) for r in readers.load_transactions_data(spark, raw).collect()] == [(DAY, 1, 7)]
    with pytest.raises(FileNotFoundError):
        readers.load_master_dataframe(spark, where.data_dir("nothing"))
    assert readers.load_evaluation_results(spark, where.data_dir("nothing")) is None and readers.load_historical_data(spark, where.data_dir("nothing")) is None


def test_gaps_of_the_oil_price(spark, tmp_path):
    rows = [(DAY + timedelta(days=i), p) for i, p in enumerate([None, 50.0, None, 52.0])]
    writers.write_csv(spark.createDataFrame(rows, "date date, dcoilwtico double"), f"file://{tmp_path}/oil.csv")
    assert [r.dcoilwtico for r in readers.load_oil_data(spark, f"file://{tmp_path}").orderBy("date").collect()] == [50, 50, 50, 52]


def test_master_features_and_their_table(spark, project):
    """CSV files to features; the bucketed table gives the same rows, and windows over its series need no exchange."""
    where, made = project
    processed = where.data_dir("processed")
    master = runs.create_master_dataframe(spark, where.data_dir(), processed)
    assert master.count() == made["train"].count() and len(master.columns) == 27
    assert readers.load_historical_data(spark, processed, "2013-02-01").agg(F.min("date")).first()[0] == date(2013, 2, 1)
    features = runs.create_features(spark, processed, "2013-02-05", "2013-02-09", table="series_features")
    train, val = (spark.read.parquet(f"{processed}/train_features_{x}.parquet") for x in ("train", "val"))
    assert train.agg(F.max("date")).first()[0] < date(2013, 2, 5) and val.count() == 5 * 12
    lines = [r.value for r in spark.read.text(f"{processed}/features_list").collect()]
    assert lines[0] == "ENGINEERED FEATURES" and any(x.startswith("TOTAL FEATURES: ") for x in lines) and "  - sales_lag_7" in lines
    table = spark.table("series_features")
    assert table.count() == features.count() and table.select(*features.columns).exceptAll(features).isEmpty()
    plan = temporal.add_rolling(table.select("store_nbr", "family", "date", "sales"), "sales", (7, 28))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan
    spark.sql("DROP TABLE series_features")


def test_exploration_of_a_whole_panel_and_its_report(spark, project):
    where, _ = project
    master = readers.load_master_dataframe(spark, where.data_dir("processed"))
    results = runs.run_full_eda(master)
    report = runs.generate_eda_report(results)
    assert "| Stores | 3 |" in report and "| Rows | 480 |" in report and report.startswith("# Sales panel report")
    assert all(results[n].count() >= 0 for n in ("histogram", "month", "top_families", "store_patterns"))


def test_narrow_types_and_sizes(spark):
    df = spark.createDataFrame([(1, 300, 70_000, 1 << 40, 1.5, "ab"), (-128, -5, 0, 0, None, None)], "a int, b int, c int, d long, e double, s string")
    got = writers.narrow_types(df)
    assert dict(got.dtypes) == {"a": "tinyint", "b": "smallint", "c": "int", "d": "bigint", "e": "float", "s": "string"}
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in df.collect()]
    assert writers.estimated_bytes(df) == 2 * (4 * 3 + 8 * 2) + 2


def test_rows_are_sorted_inside_files(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.rand(1).alias("x")).repartition(3)
    writers.write_parquet(rows, f"file://{tmp_path}/t", sort_by=("k",), floats=True)
    got = spark.read.parquet(f"file://{tmp_path}/t")
    assert dict(got.dtypes)["x"] == "float" and got.count() == 1000
    for part in got.select("k", F.input_file_name().alias("f")).groupBy("f").agg(F.collect_list("k").alias("ks")).collect():
        assert part.ks == sorted(part.ks)


def test_texts(spark):
    df = spark.createDataFrame([("12_BREAD_x", 1234567.0, "pred_MinTrace_ols"), ("3_A", None, "pred_base")], "uid string, n double, p string")
    got = df.select(text.store_of(F.col("uid")), text.family_of(F.col("uid")), text.short_number(F.col("n")), text.method_label(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("12", "BREAD_x", "1,234,567", "Mintrace Ols"), ("3", "A", "N/A", "Base")]
    assert text.label_codes([10, 1, 2, 1]) == {"1": 0, "10": 1, "2": 2}


def test_last_rows(spark):
    df = spark.createDataFrame([(i, i * 7 % 10) for i in range(10)] + [(10, None)], "i int, k int")
    assert [r.k for r in eda.last_rows(df, 3, "k").collect()] == [7, 8, 9]
    assert eda.last_rows(df, 50, "k").count() == 11


def test_streams(spark, tmp_path):
    """Daily totals and zero streaks of files that arrive one after another equal those of all rows at once."""
    rows = [(s, DAY + timedelta(days=i), 0.0 if (i * s) % 3 else float(i)) for i in range(12) for s in (1, 2)]
    schema = "series_id int, date date, sales double"
    for k in range(3):
        spark.createDataFrame([r for r in rows if (r[1] - DAY).days // 4 == k], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = panels.read_sales_stream(spark, f"{tmp_path}/in", schema, 1)
    panels.zero_streak_stream(stream).writeStream.format("memory").queryName("streaks").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.series_id, r.date): r.zero_streak for r in spark.table("streaks").collect()}
    for s in (1, 2):
        streak = 0
        for _, d, v in sorted(r for r in rows if r[0] == s):
            streak = streak + 1 if v == 0 else 0
            assert got[s, d] == streak
    totals = panels.daily_totals_stream(stream, "date", "sales", delay="0 days")
    totals.writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.date, r.total, r.n) for r in spark.table("totals").collect()} == {(DAY + timedelta(days=i), sum(v for _, d, v in rows if d == DAY + timedelta(days=i)), 2) for i in range(12)}
