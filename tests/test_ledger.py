import pytest

from sluice.operators import ledger


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", ""])
def test_guard_refuses(sql):
    with pytest.raises(ValueError, match="single SELECT"):
        ledger.guarded(sql)


def test_claims(spark):
    spark.range(3).createOrReplaceTempView("claim_rows")
    rows = ledger.run_claims(spark, [{"claim_id": "a", "sql": "SELECT count(*) FROM claim_rows", "expected": 3}, {"claim_id": "b", "sql": "SELECT 'drop; it'", "expected": "x"}]).collect()
    assert [(r["claim_id"], r["found"], r["passes"]) for r in rows] == [("a", "3", True), ("b", "drop; it", False)]


def test_conflicts_collapse(spark):
    df = spark.createDataFrame([("k", 1, "Funded"), ("k", 1, "Funded"), ("m", 1, "a"), ("m", 2, "b")], "k string, rank int, outcome string")
    got = {r["k"]: tuple(r)[1:] for r in ledger.conflict_collapse(df, ["k"], ["rank", "outcome"]).collect()}
    assert got == {"k": (1, False, "Funded", False), "m": (None, True, "a|b", True)}
