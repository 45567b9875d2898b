"""Shares of suppliers: rows are counted once, and sums do not depend on their order."""

import random

from spanweave import views as v
from spanweave.queries import stats


def test_rows_are_not_dealt_by_supplier_again(spark):
    plan = stats.a13_dependency_profile(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_shares_in_any_order(spark, monkeypatch):
    draw = random.Random(3)
    strengths = [0.98] + [0.93, 0.97, 0.95, 0.95] * 5 + [0.5]
    assert round(sum(strengths), 6) == 20.48
    rows = []
    for part in range(300):
        some = draw.sample(strengths, len(strengths))
        rows += [(f"supplier:{k}", f"part:{part}", x) for k, x in enumerate(some)]
    rows += [(None, "part:nobody", 0.5), ("supplier:1", "part:one", 0.5), ("supplier:1", "part:none", None)]
    monkeypatch.setattr(v, "supplies", lambda s, d: spark.createDataFrame(rows, "src string, dst string, strength double"))
    got = {r.entity: (r.upstream, r.concentration, r.single_point) for r in stats.a13_dependency_profile(spark, "").collect()}
    assert got.pop("part:nobody") == (0, 1.0, False) and got.pop("part:one") == (1, 1.0, True) and got.pop("part:none") == (1, None, True)
    assert set(got.values()) == {(22, 0.047851563, False)} and len(got) == 300
