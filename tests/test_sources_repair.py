"""Sources, sinks, fingerprints, ranking helper and repairs."""

import random

import pytest
from pyspark.sql import functions as F

from tabsieve.operators import repair
from tabsieve.plans.ranking import cumulative_before, exact_quantiles
from tabsieve.sources import tables
from tabsieve.sources.derived import dirty_accounts


def test_csv_read_na_tokens_and_types(spark, tmp_path):
    p = tmp_path / "data.csv"
    p.write_text("id,segment,value,flag\n1,NA,10,True\n2,na,,False\n3,None,2.5,True\n")
    df = tables.read_table(spark, str(p))
    types = dict(df.dtypes)
    assert types["id"] == "bigint" and types["value"] == "double" and types["flag"] == "boolean"
    rows = df.orderBy("id").collect()
    assert [r["segment"] for r in rows] == [None, "na", None]


def test_unsupported_and_missing(spark, tmp_path):
    with pytest.raises(tables.UnsupportedFileTypeError):
        tables.read_table(spark, str(tmp_path / "x.xlsx"))
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "missing.csv"))


def test_atomic_write_keeps_old_on_failure(spark, tmp_path):
    target = str(tmp_path / "out.parquet")
    tables.write_table_atomic(spark.range(3), target)
    bad = spark.range(3).select((F.col("id") / F.lit(0)).cast("int").alias("id"))
    spark.conf.set("spark.sql.ansi.enabled", "true")
    with pytest.raises(Exception):
        tables.write_table_atomic(bad, target)
    assert spark.read.parquet(target).count() == 3
    tables.write_table_atomic(spark.range(5), target)
    assert spark.read.parquet(target).count() == 5


def test_csv_sink_round_trip_keeps_whitespace(spark, tmp_path):
    df = spark.createDataFrame([(1, "  a ", 1.5), (2, "", None), (3, None, -2.0), (4, " N/A ", 0.0)],
                               "k long, s string, x double")
    target = str(tmp_path / "out.csv")
    tables.write_table_atomic(df, target, fmt="csv")
    back = {r["k"]: (r["s"], r["x"]) for r in tables.read_table(spark, target).collect()}
    # empty text is an NA token of the reader; spaced markers stay text
    assert back == {1: ("  a ", 1.5), 2: (None, None), 3: (None, -2.0), 4: (" N/A ", 0.0)}


def test_fingerprint_changes_and_is_order_free(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    a = tables.fingerprint_value(c)
    assert a == tables.fingerprint_value(c.repartition(7).orderBy(F.rand(3)))
    assert a != tables.fingerprint_value(c.where("c_custkey <> 1"))
    swapped = spark.createDataFrame([(None, 1)], "a int, b int")
    other = spark.createDataFrame([(1, None)], "a int, b int")
    assert tables.fingerprint_value(swapped) != tables.fingerprint_value(other)


def test_verified_scan(spark, sf_dir):
    path = f"{sf_dir}/region.parquet"
    fp = tables.fingerprint_value(spark.read.parquet(path))
    assert tables.read_verified(spark, path, fp).count() == 5
    with pytest.raises(tables.StaleDatasetError):
        tables.read_verified(spark, path, "0" * 64)


def test_dataset_equality(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (1, "x"), (1, "x")], "k long, v string")
    assert tables.datasets_equal(a, b)
    assert not tables.datasets_equal(a, b.limit(2))


def test_cumulative_matches_brute_force(spark):
    rng = random.Random(11)
    rows = [(rng.choice("ab"), i, rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, w int")
    got = {(r["g"], r["o"]): (r["cum_before"], r["group_total"])
           for r in cumulative_before(df, [F.col("o")], ["g"], "w", num_slices=6).collect()}
    for g in "ab":
        run = 0
        total = sum(w for gg, _, w in rows if gg == g)
        for gg, o, w in sorted(x for x in rows if x[0] == g):
            assert got[(gg, o)] == (run, total)
            run += w


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    rng = random.Random(5)
    vals = [rng.choice([1.0, 2.0, 2.0, 3.5, rng.random() * 100]) for _ in range(333)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.9]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(float(np.quantile(vals, p)))


def test_repairs_and_invariants(spark, sf_dir):
    src = dirty_accounts(spark, sf_dir)
    res = repair.repair_accounts(src)
    repair.validate_repair(src, res.table)
    assert "account_closed_date" not in res.table.columns
    assert res.table.where(F.col("total_charge") > 20000).count() == 0
    broken = res.table.withColumn("tenure_months", F.col("tenure_months") + 1)
    with pytest.raises(repair.RepairError):
        repair.validate_repair(src, broken)


def test_quantiles_over_many_slices_match_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.integers(0, 50, 300), np.full(400, 17)])  # one hot value
    b = rng.normal(size=700).round(2)
    rows = [(int(x), float(y) if i % 9 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a long, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    for slices in (1, 5, 23):
        got = {(r["column"], r["p"]): r["value"] for r in exact_quantiles(df, ["a", "b"], probs, slices).collect()}
        for col, values in (("a", a), ("b", np.array([r[1] for r in rows if r[1] is not None]))):
            for p in probs:
                assert abs(got[(col, p)] - float(np.quantile(values.astype(float), p))) < 1e-9, (col, p, slices)


def test_dataset_difference_matches_multiset_count(spark):
    from collections import Counter
    left = [(1, "a"), (1, "a"), (2, None), (3, "c")] + [(9, "hot")] * 50
    right = [(1, "a"), (2, None), (2, None), (4, "d")] + [(9, "hot")] * 47
    lc, rc = Counter(left), Counter(right)
    row = tables.dataset_difference(spark.createDataFrame(left, "k int, s string"),
                                    spark.createDataFrame(right, "k long, s string")).first()
    assert row["left_only"] == sum((lc - rc).values()) == 5
    assert row["right_only"] == sum((rc - lc).values()) == 2
    assert row["equal"] is False


def test_invariants_with_repeated_and_null_keys(spark):
    schema = ("customer_id int, account_number string, age string, monthly_charge double, tenure_months int, "
              "total_charge double, signup_date string, churned int")
    rows = [(1, "a", "30", 1.0, 2, 2.0, "2024-01-01", 0), (1, "b", "31", 1.0, 3, 2.0, "2024-01-01", 1),
            (None, "c", "32", 1.0, 4, 2.0, "2024-01-01", 0)]
    same = spark.createDataFrame(rows, schema)

    def failed(result):
        found = repair.repair_invariants(same, result).where("violations > 0").collect()
        return {r["invariant"]: r["violations"] for r in found}

    assert failed(spark.createDataFrame(rows[::-1], schema)) == {}
    changed = [rows[0], rows[1][:1] + ("x",) + rows[1][2:], rows[2]]
    assert failed(spark.createDataFrame(changed, schema)) == {"protected_column_changed:account_number": 1}
    lost = failed(spark.createDataFrame(rows[:2], schema))
    assert lost["row_count_changed"] == 1 and lost["row_pairing"] == 1
