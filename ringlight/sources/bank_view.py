"""What each bank sees: attributes as keyed tokens, without the truth; and the truth's labels, apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, normalize, similarity
from ..session import checkpointed

NEVER = 1_000_000
#: What banks know of an attribute's value; whether an employer is fictitious is not among it.
VISIBLE = ("subtype", "domain", "disposable", "os", "emulator")
LABELS = ("kind", "ring_id", "operator_id", "sophistication", "scenario", "household_id", "is_dorm", "is_colocation", "is_elderly_assisted", "is_newcomer", "is_tradeline_seller", "is_mule", "stolen_nid", "variant", "file_start_day")


def similar_pairs(persons: DataFrame, block: list[str], name: str, least: float, day: str = "onboard_day") -> DataFrame:
    """a, b, first_day (the later of both days), score of pairs within a block whose names are alike by the Indel ratio.

    Each two different names of a block are compared once, however many persons and blocks have them; lengths that can't reach
    the ratio are left out before the fold. The pairs of persons come by an equi-join on block and name."""
    p = persons.select(*block, "person_id", F.col(name).alias("n"), F.col(day).alias("d"))
    names = p.where(F.col("n").isNotNull()).select(*block, "n").distinct()
    a, b = names.withColumnRenamed("n", "na"), names.withColumnRenamed("n", "nb")
    met = a.join(b, block).where("na <= nb").where(similarity.could_reach(F.col("na"), F.col("nb"), least)).select("na", "nb").distinct()
    parts = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # long work on few bytes
    met = met.repartition(parts, "na", "nb")
    alike = checkpointed(met.withColumn("score", similarity.indel_ratio(F.col("na"), F.col("nb"))).where(F.col("score") >= least))
    both = alike.unionByName(alike.where("na <> nb").select(F.col("nb").alias("na"), F.col("na").alias("nb"), "score"))
    a, b = p.withColumnsRenamed({"person_id": "a", "n": "na", "d": "da"}), p.withColumnsRenamed({"person_id": "b", "n": "nb", "d": "db"})
    pairs = a.join(names.withColumnRenamed("n", "na").join(both, "na"), [*block, "na"]).join(b, [*block, "nb"]).where("a < b")
    return pairs.select("a", "b", F.greatest("da", "db").alias("first_day"), "score")


def bank_view(sim: dict[str, DataFrame], secret: str, seed: int, banks: list[str], least: float = 85.0) -> dict[str, DataFrame]:
    """The ten tables that features may read, from the simulated world's: persons, person_attr, attr_meta, paid_at,
    merchant_meta, transfers, authorized_users, similar, monthly, fraud_confirmations."""
    keys = {b: hashing.bank_key(secret, seed, b) for b in banks}
    token = lambda message: hashing.bank_token(F.col("bank"), message, keys)
    records, identities = sim["records"], sim["identities"]
    where = records.select("person_id", "bank")
    held = sim["record_attr"].join(where, "person_id").withColumn("token", token(F.concat(F.col("attr_type"), F.lit(":"), normalize.normalized(F.col("attr_type"), F.col("raw")))))
    visible = sim["catalog"].select("attr_type", "value", *VISIBLE)
    values = held.groupBy("attr_type", "token").agg(F.min("value").alias("value"))
    meta = values.join(visible, ["attr_type", "value"], "left").withColumn("email_popular_domain", F.coalesce(F.col("domain").isin(*normalize.POPULAR_DOMAINS), F.lit(False)))

    def of(kind: str, key: str, **columns: str) -> DataFrame:
        return sim["catalog"].where(F.col("attr_type") == kind).select(F.col("value").alias(key), *[F.col(c).alias(n) for n, c in columns.items()])

    who = identities.select("identity_id", "first_name", "last_name", "dob", "birth_year", "income", "file_start_day", "email", "phone", "address")
    p = records.join(who, "identity_id")
    for kind, key, columns in (("email", "email", {"email_created_day": "created_day", "email_disposable": "disposable"}), ("phone", "phone", {"__phone": "subtype", "phone_first_seen": "first_seen"}), ("address", "address", {"address_type": "subtype"}), ("ip", "app_ip", {"app_ip_type": "subtype"}), ("device", "app_device", {"app_device_emulator": "emulator"})):
        p = p.join(of(kind, key, **columns), key, "left")
    employed = sim["record_attr"].where("attr_type = 'employer'").select("person_id", F.lit(True).alias("has_employer")).distinct()
    false = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    persons = p.join(employed, "person_id", "left").select(
        "person_id", "bank", "onboard_day", "close_day", "birth_year", F.bround("income", -2).alias("income"), "file_start_day", token(F.concat(F.lit("id:"), normalize.identity_key(F.col("first_name"), F.col("last_name"), F.col("dob")))).alias("id_token"),
        F.col("email_created_day").cast("double").alias("email_created_day"), false("email_disposable"), F.coalesce(F.col("__phone") == "voip", F.lit(False)).alias("phone_voip"), F.col("phone_first_seen").cast("double").alias("phone_first_seen"), "address_type", "app_ip_type", false("app_device_emulator"),
        normalize.popular_domain(F.col("email")).alias("email_popular_domain"), false("has_employer"),
    )
    named = p.select("bank", "dob", "person_id", "onboard_day", F.concat_ws(" ", normalize.norm_name(F.col("first_name")), normalize.norm_name(F.col("last_name"))).alias("name"))
    visits = sim["paid_at"].join(where, "person_id").withColumn("merchant_token", F.concat(F.col("bank"), F.lit(":m"), F.col("merchant_id").cast("string")))
    return {
        "persons": persons, "person_attr": held.select("person_id", "attr_type", "token", "first_day", "last_day"), "attr_meta": meta.drop("domain", "value"), "paid_at": visits.select("person_id", "merchant_token", "first_day", "last_day"),
        "merchant_meta": visits.select("merchant_token", "merchant_id").distinct().join(sim["merchants"], "merchant_id", "left").select("merchant_token", "mcc", "high_risk_mcc"), "transfers": sim["transfers"], "authorized_users": sim["authorized_users"],
        "similar": similar_pairs(named, ["bank", "dob"], "name", least), "monthly": sim["monthly"], "fraud_confirmations": records.where((F.col("bust_out_day") < NEVER) & F.col("label_observed")).select("person_id", F.col("label_day").alias("confirmed_day")),
    }


def labels(sim: dict[str, DataFrame]) -> DataFrame:
    """The truth of each account, never a feature; exposure is its greatest limit."""
    records = sim["records"].select("person_id", "bank", "identity_id", "onboard_day", "close_day", "bust_out_day", "bust_out_end", "label_day", "label_observed", "is_distressed")
    most = sim["monthly"].groupBy("person_id").agg(F.max("credit_limit").alias("exposure"))
    out = records.join(sim["identities"].select("identity_id", *LABELS), "identity_id").join(most, "person_id", "left").na.fill(0.0, ["exposure"])
    false = F.col("kind") == "synthetic"
    return out.withColumn("is_synthetic", false.cast("int")).withColumn("group", F.when(false, F.concat(F.lit("r"), "ring_id")).otherwise(F.concat(F.lit("h"), "household_id")))


def pii_view(sim: dict[str, DataFrame], kinds: tuple[str, ...] = ("nid", "phone", "email", "device")) -> tuple[DataFrame, DataFrame]:
    """What the banks hold in the clear within their own walls: (person_id, bank, attr_type, value, idkey, first_day,
    onboard_day), and records (person_id, bank, idkey, onboard_day)."""
    key = sim["identities"].select("identity_id", normalize.identity_key(F.col("first_name"), F.col("last_name"), F.col("dob")).alias("idkey"))
    records = sim["records"].select("person_id", "bank", "identity_id", "onboard_day").join(key, "identity_id").drop("identity_id")
    held = sim["record_attr"].where(F.col("attr_type").isin(*kinds)).select("person_id", "attr_type", normalize.normalized(F.col("attr_type"), F.col("raw")).alias("value"), "first_day")
    return held.join(records, "person_id"), records
