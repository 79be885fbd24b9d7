"""Queries that must take every row of their tables."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import identity
from tessera.plans.registry import QUERIES
from tessera.sources.tables import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def ids(frame, column):
    return {r[0] for r in frame.select(column).collect()}


def test_fits_of_entry(spark):
    asked = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (5000, 2, "a"), (6000, 3, "a")], "id long, entry long, platform string")
    cands = spark.createDataFrame([(7, 1, "a", 3), (7, 1, "a", 3), (8, 1, "b", 2), (9, 1, "b", 4), (10, 2, "b", 1)], "cand long, entry long, platform string, gen long")
    got = {tuple(r) for r in identity.fits_of_entry(asked, cands).collect()}
    assert got == {(1, 1, 7, 2), (2, 2, 8, 2), (3, 0, None, 2), (5000, 0, None, 1)}


def test_per_entry_resolve_judges_every_order(spark):
    entries = {r[0] for r in table(spark, SF, "supplier").select(F.col("s_nationkey") % 9).collect()}
    orders = {r[0] for r in table(spark, SF, "orders").select("o_orderkey", F.col("o_custkey") % 9).collect() if r[1] in entries}
    assert ids(QUERIES["per_entry_resolve"](spark, SF), "id") == orders


def test_learn_identities_learns_from_every_order(spark):
    got = QUERIES["learn_identities"](spark, SF)
    assert got.count() == 2 * table(spark, SF, "orders").count()
    assert ids(got, "find") == ids(table(spark, SF, "orders"), "o_orderkey")


def test_bundle_members_expands_every_order(spark):
    assert ids(QUERIES["bundle_members"](spark, SF), "o_orderkey") == ids(table(spark, SF, "orders").join(table(spark, SF, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")), "o_orderkey")


def test_materialize_members_gives_every_order_a_role(spark):
    lines = table(spark, SF, "lineitem").join(table(spark, SF, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey", "o_orderstatus").collect()
    assert {r.o_orderstatus for r in lines} == set("FOP")
    owned, wished = ({r.l_partkey for r in lines if r.o_orderstatus == s} for s in "OP")
    want = {(r.l_orderkey, r.l_partkey): "standalone" if r.l_partkey in owned else "satisfied" if r.l_partkey in wished else "created" for r in lines if r.o_orderstatus == "F"}
    assert {(r.coll, r.part): r.status for r in QUERIES["materialize_members"](spark, SF).collect()} == want
