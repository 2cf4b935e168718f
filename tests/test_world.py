"""Invariants of the simulated world."""

import pytest
from pyspark.sql import functions as F

from ringlight.functions import normalize
from ringlight.operators import crossbank, features
from ringlight.operators.snapshot import snapshot
from ringlight.session import checkpointed
from ringlight.sources import bank_view, world as sim
from ringlight.sources.tables import BANK_TABLES, read_bank, write_tables


@pytest.fixture(scope="module")
def tables(spark):
    return {k: v.cache() for k, v in sim.world(spark, sim.World(households=300, rings=12)).items()}


def test_people(tables):
    i, r = tables["identities"], tables["records"]
    assert i.count() == i.select("identity_id").distinct().count() and r.count() == r.select("person_id").distinct().count()
    assert r.groupBy("identity_id").agg(F.count("*").alias("n"), F.count_distinct("bank").alias("b")).where("n > 2 or n <> b").count() == 0
    rings = {x.ring_id: x["size"] for x in tables["rings"].collect()}
    assert {x.ring_id: x["count"] for x in i.where("ring_id >= 0").groupBy("ring_id").count().collect()} == rings and all(3 <= n <= 30 for n in rings.values())
    assert i.where("stolen_nid").select("nid").join(i.where("kind = 'legit'"), "nid", "left_anti").count() == 0
    assert i.where("kind = 'legit'").groupBy("nid").count().where("count > 1").count() == 0
    assert i.where("is_dorm").groupBy("address").count().where("count < 15 or count > 45").count() == 0 and i.where("is_dorm").count() > 0
    assert r.groupBy("bank").count().count() == 3 and i.where("is_mule").count() > 10 and i.where("is_tradeline_seller").count() > 5
    assert i.where("variant and sophistication = 3").count() == 0 and i.where("variant").count() > 0 and i.where("is_colocation").count() > 0


def test_links(tables):
    i, r = tables["identities"], tables["records"]
    own = r.join(i.select("identity_id", "kind", "is_mule", "is_tradeline_seller", "household_id"), "identity_id")
    users = tables["authorized_users"].join(own.select(F.col("person_id").alias("host_person_id"), "is_tradeline_seller", F.col("household_id").alias("h")), "host_person_id").join(own, "person_id")
    assert users.count() == tables["authorized_users"].count() and users.where("kind = 'synthetic' and h is null").count() == 0
    cashed = tables["transfers"].where("amount > 1000").join(own.select(F.col("person_id").alias("dst"), "is_mule"), "dst")
    assert cashed.count() > 0 and cashed.where("not is_mule").count() == 0
    assert tables["catalog"].groupBy("attr_type", "value").count().where("count > 1").count() == 0
    a = tables["record_attr"].select("attr_type", "value").where("attr_type <> 'nid'").distinct()
    assert a.join(tables["catalog"], ["attr_type", "value"], "left_anti").count() == 0
    assert tables["paid_at"].join(tables["merchants"], "merchant_id", "left_anti").count() == 0


def test_bank_view(spark, tables, tmp_path):
    write_tables(bank_view.bank_view(tables, "k", 1, ["A", "B", "C"]), str(tmp_path))
    bank, truth = read_bank(spark, str(tmp_path)), bank_view.labels(tables).cache()
    assert set(bank) == set(BANK_TABLES) and bank["persons"].count() == tables["records"].count() == truth.count()
    # No truth and nothing in the clear in what banks see; tokens of one value differ between banks.
    assert not {c for df in bank.values() for c in df.columns} & {"ring_id", "kind", "is_synthetic", "value", "domain", "fictitious", "household_id"}
    assert bank["person_attr"].where("token is null or not token rlike '^[0-9a-f]{20}$'").count() == 0
    assert bank["person_attr"].join(tables["records"].select("person_id", "bank"), "person_id").groupBy("token").agg(F.count_distinct("bank").alias("n")).where("n > 1").count() == 0
    assert bank["attr_meta"].groupBy("token").count().where("count > 1").count() == 0
    assert bank["similar"].where("a >= b or score < 85").count() == 0
    s = snapshot(bank, 720)
    f = features.graph_counts(s, checkpointed(features.snapshot_projection(s)))
    both = f.join(truth, "person_id").groupBy("is_synthetic").agg(F.avg("g_share_device").alias("d")).collect()
    assert {x.is_synthetic: x.d for x in both}[1] > {x.is_synthetic: x.d for x in both}[0]
    pii, records = map(checkpointed, bank_view.pii_view(tables))
    xb = crossbank.xb_features(crossbank.bank_keys(pii), records, crossbank.other_totals(crossbank.live_counts(crossbank.bank_keys(pii), records, 720).withColumnRenamed("key", "token")).withColumnRenamed("token", "key"), 720)
    assert xb.count() == records.where("onboard_day <= 720").count() and xb.where("xb_identity_other_banks > 0").count() > 0 and xb.where("xb_nid_mismatch < 0").count() == 0


def test_spellings_come_back(tables):
    a = tables["record_attr"]
    assert a.where("attr_type = 'email'").where(normalize.norm_plain(F.col("raw")) != F.col("value")).count() == 0
    assert a.where("attr_type = 'address'").where(normalize.norm_address(F.col("raw")) != F.col("value")).count() == 0
    assert a.where("attr_type = 'phone'").where(normalize.norm_phone(F.col("raw")) != F.col("value")).count() == 0
    assert a.where("attr_type = 'phone' and raw <> value").count() > 0


def test_months_and_transfers(tables):
    m = tables["monthly"]
    assert m.where("utilization < 0 or utilization > 1 or pay_ratio < 0 or pay_ratio > 1 or credit_limit > 30000 or n_txn < 0 or month < 0 or month >= 36").count() == 0
    both = m.join(tables["records"], "person_id")
    burst = both.where("month * 30 >= bust_out_day and month * 30 < bust_out_day + 3")
    assert burst.where("utilization < 0.97 or late = 0").count() == 0
    t = tables["transfers"]
    assert t.count() > 0 and t.where("src = dst or substring(src, 1, 1) <> substring(dst, 1, 1)").count() == 0
    assert tables["paid_at"].where("merchant_id > 400 or merchant_id = 0").count() == 0
    assert m.where("n_mcc > greatest(n_txn, 1) or n_mcc < 0").count() == 0


def test_partitioning_changes_nothing(spark, tables):
    w = sim.World(households=300, rings=12)
    again = sim.accounts(sim.honest(spark, w).repartition(7).unionByName(sim.false_ones(spark, w).repartition(3), allowMissingColumns=True), w)
    key = F.sum(F.xxhash64("person_id", "onboard_day", "close_day", F.round("util_mu", 9)).cast("decimal(38,0)"))
    assert again.agg(key).first() == tables["records"].agg(key).first()
