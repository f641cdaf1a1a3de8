"""Queries on pairs compare every row with all others of their table."""

import oracle

from tessaline.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_overlaps_pair_all_customers(spark):
    orders = oracle.connection(FOLDER).sql("SELECT o_custkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) FROM orders").fetchall()
    days = {}
    for customer, day in orders:
        days.setdefault(customer, []).append(day)
    ranges = {c: (min(d), min(d) + 3 * len(d)) for c, d in days.items()}
    want = sorted((a, b) for a, (a0, a1) in ranges.items() for b, (b0, b1) in ranges.items() if a0 <= b1 and b0 <= a1)
    found = QUERIES["p6_overlap"](spark, FOLDER)
    assert found.columns == ["o_custkey", "other"]
    assert sorted(map(tuple, found.collect())) == want and any(a != b for a, b in want)
