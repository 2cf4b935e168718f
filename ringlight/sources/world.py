"""A simulated world of households, student halls, fraud operators and their rings at several banks, as DataFrames.

Every value is a function of the seed and the row's own keys, so tables are the same however they are partitioned
and a lost task makes the same rows again; what one person has from another (a helper's device, a ring's phone, a
victim's national id) is computed from the other's keys, without a join. Distributions and invariants are what matters;
counts of transactions are rounded normals in place of Poisson draws, beta draws are powers of uniforms, and Zipf ranks come from
the continuous inverse distribution. Names are made of syllables. The shares, levels, ranges and factors are fixed
values: those of the simulation that this one stands in for."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import norm_name
from ..session import checkpointed

NEVER, MONTH, LIMIT = 1_000_000, 30, 30_000.0
#: Identities are household * STRIDE + member; halls and rings have ranges of their own.
STRIDE, HALL_BASE, RING_BASE = 64, 1 << 36, 1 << 40
#: Scenarios of the third level, merchant categories, mail domains and their shares, networks.
SUBTLE = ["shared_employer", "tradeline", "circular_transfers", "complicit_merchant"]
REGULAR_MCC = ["grocery", "restaurant", "fuel", "pharmacy", "clothing", "transport", "utilities", "telecom", "entertainment", "travel", "home", "health", "online_retail", "sports", "books", "beauty"]
HIGH_RISK_MCC = ["electronics", "jewelry", "gift_cards", "money_transfer"]
POPULAR_DOMAINS = {"gmail.com": 0.38, "orange.fr": 0.16, "hotmail.fr": 0.12, "free.fr": 0.10, "yahoo.fr": 0.08, "outlook.fr": 0.07, "laposte.net": 0.05, "sfr.fr": 0.04}
DISPOSABLE_DOMAINS = ["yopmail.com", "mailinator.com", "trashmail.fr", "tempmail.dev", "guerrillamail.com"]
IP_PREFIX = {"residential": 90, "cgnat": 37, "public_wifi": 212, "office": 193, "datacenter": 51, "vpn": 185}
SYLLABLES = "ba be bi bo du fa gi la le li lo ma me mi mo na ni no pa ra re ri ro sa se si ta te ti va".split()


@dataclass(frozen=True)
class World:
    seed: int = 42
    households: int = 1000
    halls: int = 2
    hall_size: tuple[int, int] = (15, 45)
    rings: int = 30
    months: int = 36
    banks: dict[str, float] = field(default_factory=lambda: {"A": 0.5, "B": 0.3, "C": 0.2})
    sizes: tuple[float, ...] = (0.32, 0.30, 0.18, 0.13, 0.07)
    levels: tuple[float, ...] = (0.3, 0.4, 0.3)
    ring_size: tuple[float, float, int, int] = (6, 0.45, 3, 30)
    rings_per_operator: int = 3
    ring_start: tuple[int, int] = (-300, 700)
    spread: int = 60
    cultivation: tuple[int, int] = (180, 600)
    burst: tuple[int, int] = (3, 21)
    label_delay: tuple[int, int] = (60, 180)
    label_noise: float = 0.2
    cross_bank: float = 0.5
    spray: float = 0.35
    stolen_nid: tuple[float, float, float] = (0.10, 0.20, 0.30)
    reused_nid: tuple[float, float, float] = (0.5, 0.15, 0.0)
    variants: tuple[float, float, float] = (0.5, 0.2, 0.0)
    second_bank: float = 0.25
    employers: int = 150
    employer_zipf: float = 1.3
    merchants: int = 400
    cgnat: int = 30
    wifi: int = 10
    wifi_share: float = 0.25
    office_share: float = 0.4
    tablet: float = 0.3
    assisted: float = 0.15
    distressed: float = 0.03
    newcomer: float = 0.08
    voip: float = 0.03
    new_email: float = 0.15
    new_phone: float = 0.15
    disposable: float = 0.005
    transactor: float = 0.45
    sellers_per_bank: int = 4
    mules_per_bank: int = 12

    @property
    def horizon(self) -> int:
        return self.months * MONTH

    def u(self, what: str, *keys: Column) -> Column:
        """Uniform in [0, 1)."""
        return F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.lit(what), *keys), 11) / float(1 << 53)

    def chance(self, share, what: str, *keys: Column) -> Column:
        return self.u(what, *keys) < share

    def whole(self, low, high, what: str, *keys: Column) -> Column:
        """Whole number from low to high, both included."""
        low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
        return (low + F.floor(self.u(what, *keys) * (high - low + 1))).cast("int")

    def real(self, low: float, high: float, what: str, *keys: Column) -> Column:
        return low + (high - low) * self.u(what, *keys)

    def normal(self, what: str, *keys: Column) -> Column:
        return F.sqrt(-2 * F.log(1 - self.u(what, *keys))) * F.cos(2 * math.pi * self.u(what + "'", *keys))

    def zipf(self, n: int, a: float, what: str, *keys: Column) -> Column:
        return F.least(F.lit(n), F.floor(F.pow(1 - self.u(what, *keys) * (1 - float(n) ** (1 - a)), F.lit(1 / (1 - a))))).cast("long")

    def name(self, what: str, *keys: Column) -> Column:
        part = lambda k: F.element_at(F.array(*map(F.lit, SYLLABLES)), self.whole(1, len(SYLLABLES), f"{what}{k}", *keys))
        return F.initcap(F.concat(part(1), part(2), F.when(self.chance(0.6, what + "3?", *keys), part(3)).otherwise("")))


def pick(u: Column, weights, values) -> Column:
    """The value whose share of the weights ``u`` falls in."""
    total, at, out = sum(weights), 0.0, F
    for w, v in zip(list(weights)[:-1], list(values)[:-1], strict=True):
        at += w / total
        out = out.when(u < at, v)
    return out.otherwise(list(values)[-1]) if out is not F else F.lit(list(values)[-1])


def by_level(values) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.greatest(F.col("sophistication"), F.lit(1)))


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def mutated(name: Column, w: World, *keys: Column) -> Column:
    """One letter of a name, never the first, left out, doubled, swapped with the next or replaced."""
    n = F.length(name)
    at = F.least(w.whole(2, F.greatest(F.lit(2), n), "letter", *keys), n)
    head, ch, tail = F.substring(name, F.lit(1), at - 1), F.substring(name, at, F.lit(1)), F.substring(name, at + 1, n)
    way = w.whole(0, 3, "way", *keys)
    other = F.element_at(F.split(F.lit("a e i o u l m n r s t"), " "), w.whole(1, 11, "instead", *keys))
    out = F.when((way == 0) & (n > 4), F.concat(head, tail)).when(way == 1, F.concat(head, ch, ch, tail))
    out = out.when((way == 2) & (at < n), F.concat(head, F.substring(tail, F.lit(1), F.lit(1)), ch, F.substring(tail, F.lit(2), n))).otherwise(F.concat(head, other, tail))
    return F.initcap(out)


# Values that belong to a key: whoever knows the key makes the same value.
def national_id(w: World, i: Column) -> Column:
    return F.lpad(i.cast("string"), 15, "0")


def device(*key) -> Column:
    return F.concat(F.lit("fp_"), F.lpad(F.lower(F.hex(F.xxhash64(*[F.lit(k) if isinstance(k, str) else k for k in key]))), 16, "0"))


def address_ip(kind: str, *key: Column) -> Column:
    h = F.xxhash64(F.lit(kind), *key)
    return F.concat_ws(".", F.lit(str(IP_PREFIX[kind])), F.pmod(h, F.lit(256)), F.pmod(F.shiftright(h, 8), F.lit(256)), F.pmod(F.shiftright(h, 16), F.lit(254)) + 1)


def phone(voip: Column, *key: Column) -> Column:
    return F.concat(F.lit("+33"), F.when(voip, "9").otherwise("6"), F.lpad(F.pmod(F.xxhash64(F.lit("phone"), *key), F.lit(10**8)).cast("string"), 8, "0"))


def street(w: World, *key: Column) -> Column:
    h = F.xxhash64(F.lit("street"), *key)
    return F.lower(F.concat_ws(" ", (F.pmod(h, F.lit(199)) + 1).cast("string"), F.lit("rue"), w.name("street", *key), F.lpad(F.pmod(F.shiftright(h, 8), F.lit(95000)).cast("string"), 5, "0"), w.name("city", *key)))


def employer(w: World, rank: Column) -> Column:
    return F.lower(F.concat_ws(" ", w.name("company", rank), F.element_at(F.array(*map(F.lit, ("conseil", "services", "logistique", "batiment", "digital"))), w.whole(1, 5, "trade", rank)), F.lit("sas"), rank.cast("string")))


def rings(spark: SparkSession, w: World) -> DataFrame:
    k = F.col("ring_id")
    middle, sigma, least, most = w.ring_size
    level = pick(w.u("level", k), w.levels, (1, 2, 3))
    scenario = F.when(F.col("sophistication") == 1, "overt").when(F.col("sophistication") == 2, "partial").otherwise(pick(w.u("scenario", k), (1, 1, 1, 1), SUBTLE))
    out = spark.range(w.rings).select(F.col("id").alias("ring_id")).withColumn("sophistication", level).withColumn("scenario", scenario)
    size = F.greatest(F.lit(least), F.least(F.lit(most), F.round(middle * F.exp(sigma * w.normal("size", k))).cast("int")))
    operators = math.ceil(w.rings / w.rings_per_operator)
    out = out.withColumns({"operator_id": F.floor(w.u("operator", k) * operators), "size": size, "start_day": w.whole(*w.ring_start, "start", k), "cross_bank": w.chance(w.cross_bank, "cross", k)})
    return out.withColumn("bust_out_day", F.col("start_day") + w.spread + w.whole(*w.cultivation, "cultivation", k))


def _head_age(w: World, household: Column) -> Column:
    return w.real(19, 88, "head", household)


def _works(w: World, age: Column, i: Column) -> Column:
    return F.when(age.between(22, 64), w.u("works", i) < 0.82).when(age < 22, w.u("works", i) < 0.3).otherwise(False)


def _income(w: World, age: Column, works: Column, i: Column) -> Column:
    return 28000 * F.exp(0.45 * w.normal("income", i)) * F.when(age < 23, 0.3).when(age > 65, 0.8).when(works, 1.0).otherwise(0.5)


def honest(spark: SparkSession, w: World) -> DataFrame:
    """Members of households (families and flat shares) and of student halls, where each is a household of one."""
    h, m = F.col("household_id"), F.col("member")
    houses = spark.range(w.households).select(F.col("id").alias("household_id")).withColumn("member", F.explode(F.sequence(F.lit(1), pick(w.u("household", F.col("household_id")), w.sizes, range(1, len(w.sizes) + 1)))))
    houses = houses.withColumns({"hall": F.lit(-1).cast("long"), "identity_id": h * STRIDE + m, "size": pick(w.u("household", h), w.sizes, range(1, len(w.sizes) + 1)), "head": _head_age(w, h)})
    shared = (F.col("size") >= 2) & (F.col("head") < 32) & w.chance(0.5, "flat share", h)
    i = F.col("identity_id")
    age = F.when(m == 1, F.col("head")).when(F.col("is_colocation"), F.least(F.lit(35.0), F.greatest(F.lit(18.0), F.col("head") + 3 * w.normal("age", i)))).when(m == 2, F.least(F.lit(95.0), F.greatest(F.lit(18.0), F.col("head") + 4 * w.normal("age", i)))).when(F.col("head") > 42, 18 + w.u("age", i) * (F.greatest(F.lit(19.0), F.col("head") - 20) - 18)).otherwise(w.real(18, 30, "age", i))
    houses = houses.withColumn("is_colocation", shared).withColumn("age", age)
    halls = spark.range(w.halls).select(F.col("id").alias("hall")).withColumn("member", F.explode(F.sequence(F.lit(1), w.whole(*w.hall_size, "hall", F.col("hall")))))
    halls = halls.withColumn("identity_id", HALL_BASE + F.col("hall") * STRIDE + m).withColumns({"household_id": i, "size": F.lit(1), "head": F.lit(0.0), "is_colocation": F.lit(False), "age": w.real(18, 25, "age", i)})
    people = houses.unionByName(halls).withColumns({"is_dorm": F.col("hall") >= 0, "works": _works(w, F.col("age"), F.col("identity_id"))})
    place = F.when(F.col("is_dorm"), -1 - F.col("hall")).otherwise(h)
    # A helper: the first of four drawn households whose head is 30 to 60 years old and lives elsewhere.
    drawn = [F.floor(w.u(f"helper{k}", i) * w.households) for k in range(4)]
    helper = F.coalesce(*[F.when(_head_age(w, x).between(30, 60) & (x != h), x * STRIDE + 1) for x in drawn])
    assisted = (F.col("age") >= 75) & w.chance(w.assisted, "assisted", i) & helper.isNotNull()
    rank = w.zipf(w.employers, w.employer_zipf, "employer", i)
    tablet = (F.col("size") >= 2) & w.chance(w.tablet, "tablet", h) & (m <= 2)
    net = [(address_ip("residential", place), F.lit(True)), (address_ip("cgnat", w.whole(0, w.cgnat - 1, "cgnat", i)), w.chance(0.75, "mobile", i)), (address_ip("cgnat", w.whole(0, w.cgnat - 1, "cgnat2", i)), w.chance(0.3, "mobile2", i)), (address_ip("public_wifi", w.whole(0, w.wifi - 1, "wifi", i)), w.chance(w.wifi_share, "wifi?", i)), (address_ip("office", rank), F.col("works") & (rank <= w.employers // 5) & w.chance(w.office_share, "office", i))]
    columns = {
        "kind": F.lit("legit"), "ring_id": F.lit(-1).cast("long"), "operator_id": F.lit(-1).cast("long"), "sophistication": F.lit(0), "scenario": F.lit(""), "variant": F.lit(False), "stolen_nid": F.lit(False), "cross_bank": F.lit(False), "start_day": F.lit(None).cast("int"), "bust_out_day": F.lit(NEVER),
        "sex": w.whole(1, 2, "sex", i), "first_name": w.name("first", i), "last_name": F.when(F.col("is_colocation") | F.col("is_dorm"), w.name("last", i)).otherwise(w.name("last", h)), "birth_day": F.floor(-F.col("age") * 365.25 - w.whole(0, 364, "birthday", i)).cast("int"),
        "nid": national_id(w, i), "phone": phone(w.chance(w.voip, "voip", i), i), "phone_type": F.when(w.chance(w.voip, "voip", i), "voip").otherwise("mobile"), "address": street(w, place), "address_type": F.lit("residential"), "employer": F.when(F.col("works"), employer(w, rank)), "fictitious": F.lit(False),
        "income": _income(w, F.col("age"), F.col("works"), i), "is_elderly_assisted": assisted, "is_newcomer": w.chance(w.newcomer, "newcomer", i), "mail_age": F.lit(None).cast("int"), "phone_age": F.lit(None).cast("int"), "file_age": F.lit(None).cast("int"), "is_disposable": w.chance(w.disposable, "disposable", i),
        "devices": F.array_distinct(F.array_compact(F.array(device(i), F.when(tablet, device("tablet", h)), F.when(assisted, device(helper))))), "ips": F.array_distinct(F.array_compact(F.array(*[F.when(c, x) for x, c in net]))),
    }
    return people.withColumns(columns)


def false_ones(spark: SparkSession, w: World) -> DataFrame:
    """Members of rings. What a ring shares comes from its own pool or from its operator's, so that waves are linked."""
    r, o, m, i, level = F.col("ring_id"), F.col("operator_id"), F.col("member"), F.col("identity_id"), F.col("sophistication")
    people = rings(spark, w).withColumn("member", F.explode(F.sequence(F.lit(1), F.col("size")))).withColumn("identity_id", RING_BASE + r * STRIDE + m)
    people = people.withColumn("variant", (m > 1) & (w.u("variant", i) < by_level(w.variants)))
    base_age, own_age = w.real(22, 50, "base age", r), F.when(level == 3, w.real(20, 65, "age", i)).otherwise(w.real(22, 50, "age", i))
    age = F.when(F.col("variant"), base_age).otherwise(own_age)
    people = people.withColumn("age", age).withColumn("works", _works(w, F.col("age"), i))
    first = F.when(~F.col("variant"), w.name("first", i)).when(w.chance(0.3, "same first", i), w.name("base first", r)).otherwise(mutated(w.name("base first", r), w, i))
    last = F.when(~F.col("variant"), w.name("last", i)).otherwise(mutated(w.name("base last", r), w, i, F.lit("last")))
    reused, stolen = (m > 1) & (w.u("reused", i) < by_level(w.reused_nid)), w.u("stolen", i) < by_level(w.stolen_nid)
    victim = F.floor(w.u("victim", i) * w.households) * STRIDE + 1  # every household has a first member
    nid = F.when(reused, national_id(w, RING_BASE + r * STRIDE + 1)).when(stolen, national_id(w, victim)).otherwise(national_id(w, i))
    half, third = F.greatest(F.lit(1), F.floor(F.col("size") / 2)), F.greatest(F.lit(1), F.floor(F.col("size") / 3))
    from_op = lambda what, least, most, n=1: F.floor(w.u(what, r, F.floor(w.u(what + "'", i) * n)) * w.whole(least, most, what + " pool", o))  # noqa: E731  # one of n of the ring's picks from the pool
    of_two = F.floor(w.u("slot", i) * (half + 1))
    op_voip = F.struct(phone(F.lit(True), o, from_op("op phone", 4, 12, 2)).alias("v"), F.lit("voip").alias("t"))
    ring_voip = w.u("ring voip", r, of_two) < 0.5
    own_voip = w.chance(w.voip, "voip", i)
    number = F.when((level == 1) | ((level == 2) & (of_two == half)), op_voip).when(level == 2, F.struct(phone(ring_voip, r, of_two).alias("v"), F.when(ring_voip, "voip").otherwise("mobile").alias("t"))).otherwise(F.struct(phone(own_voip, i).alias("v"), F.when(own_voip, "voip").otherwise("mobile").alias("t")))
    drop = from_op("drop", 2, 6, 2)
    drop_at = F.struct(street(w, F.lit("drop"), o, drop).alias("v"), F.when(w.chance(0.5, "drop kind", o, drop), "mail_drop").otherwise("commercial").alias("t"))
    at_third = F.floor(w.u("flat", i) * (third + 1))
    home = F.when((level == 1) | ((level == 2) & (at_third == third)), drop_at).when(level == 2, F.struct(street(w, F.lit("ring"), r, at_third).alias("v"), F.lit("residential").alias("t"))).otherwise(F.struct(street(w, i).alias("v"), F.lit("residential").alias("t")))
    shell = F.concat(F.lit("shell "), employer(w, o * 4 + from_op("shell", 1, 3)))
    false_job = (level == 1) | ((level == 2) & w.chance(0.5, "ring shell", r)) | (F.col("scenario") == "shared_employer")
    job = F.when(false_job, shell).when((level == 2) | F.col("works"), employer(w, w.zipf(w.employers, w.employer_zipf, "employer", i)))
    op_device, op_ip = device("op", o, from_op("op device", 4, 10)), F.when(w.chance(0.5, "op net", o), address_ip("datacenter", o, from_op("op ip", 4, 8, 2))).otherwise(address_ip("vpn", o, from_op("op ip", 4, 8, 2)))
    ring_device = device("ring", r, F.floor(w.u("ring device", i) * half))
    devices = F.when(level == 1, F.array(op_device)).when(level == 2, F.array_compact(F.array(ring_device, F.when(w.chance(0.3, "op device?", i), op_device)))).otherwise(F.array(device(i)))
    proxy = lambda *k: address_ip("residential", F.floor(w.u("proxy", *k) * w.households))  # noqa: E731  # a household's own address
    mobile = address_ip("cgnat", w.whole(0, w.cgnat - 1, "cgnat", i))
    ips = F.when(level == 1, F.array_compact(F.array(op_ip, F.when(w.chance(0.3, "mobile", i), mobile)))).when(level == 2, F.array_compact(F.array(proxy(r, of_two), F.when(w.chance(0.5, "op ip?", i), op_ip), F.when(w.chance(0.5, "mobile", i), mobile))))
    ips = ips.otherwise(F.array_compact(F.array(proxy(i), F.when(w.chance(0.75, "mobile", i), mobile), F.when(w.chance(w.wifi_share, "wifi?", i), address_ip("public_wifi", w.whole(0, w.wifi - 1, "wifi", i))))))
    ages = lambda one, two, three, what: F.when(level == 1, w.whole(*one, what, i)).when(level == 2, w.whole(*two, what, i)).otherwise(three)
    new = lambda share, what: F.when(w.chance(share, what + "?", i), w.whole(0, 90, what, i)).otherwise(w.whole(365, 6000, what, i))
    columns = {
        "kind": F.lit("synthetic"), "household_id": F.lit(-1).cast("long"), "hall": F.lit(-1).cast("long"), "head": F.lit(0.0), "is_colocation": F.lit(False), "is_dorm": F.lit(False), "is_elderly_assisted": F.lit(False), "is_newcomer": F.lit(False), "stolen_nid": stolen & ~reused,
        "sex": F.when(F.col("variant"), w.whole(1, 2, "base sex", r)).otherwise(w.whole(1, 2, "sex", i)), "first_name": first, "last_name": last, "birth_day": F.floor(-F.col("age") * 365.25).cast("int"), "nid": nid, "phone": number["v"], "phone_type": number["t"], "address": home["v"], "address_type": home["t"],
        "employer": job, "fictitious": false_job, "income": F.when(level == 3, _income(w, F.col("age"), F.col("works") | false_job, i)).otherwise(34000 * F.exp(0.35 * w.normal("income", i))), "devices": F.array_distinct(devices), "ips": F.array_distinct(ips),
        "mail_age": ages((1, 45), (60, 900), new(w.new_email, "mail"), "mail"), "phone_age": ages((0, 30), (10, 300), new(w.new_phone, "phone age"), "phone age"), "file_age": ages((30, 300), (200, 900), F.lit(None), "file"), "is_disposable": w.u("disposable", i) < F.when(level == 1, 0.5).when(level == 2, 0.1).otherwise(w.disposable),
    }
    return people.withColumns(columns)


def accounts(people: DataFrame, w: World) -> DataFrame:
    """One row for each bank that an identity is at (a second bank is never the first), with the identity's columns,
    its dates and the account's behaviour."""
    i, false, level = F.col("identity_id"), F.col("kind") == "synthetic", F.col("sophistication")
    names, share = list(w.banks), list(w.banks.values())
    first = pick(w.u("bank", F.when(false & ~F.col("cross_bank"), -1 - F.col("ring_id")).otherwise(i)), share, range(len(names)))
    more = F.when(false, F.col("cross_bank") & w.chance(w.spray, "second", i)).otherwise(w.chance(w.second_bank, "second", i))
    other = [pick(w.u("other", i), [x for k, x in enumerate(share) if k != b] or [1], [k for k in range(len(names)) if k != b] or [0]) for b in range(len(names))]
    adult = F.floor(F.col("birth_day") + 18 * 365.25).cast("int")
    low = F.greatest(F.lit(-3650), adult)
    opened = lambda k: F.when(false, F.col("start_day") + w.whole(0, w.spread, "spread", i) + (w.whole(0, 45, "later", i) if k else 0)).otherwise(w.whole(low, F.greatest(low, F.lit(w.horizon - 120)), f"onboard{k}", i))
    r = people.withColumns({"__first": first, "__more": more & F.lit(len(names) > 1), "__on0": opened(0), "__on1": opened(1), "__adult": adult}).withColumn("__other", F.element_at(F.array(*other), F.col("__first") + 1))
    early = F.when(F.col("__more"), F.least("__on0", "__on1")).otherwise(F.col("__on0"))
    young = lambda share, what: F.when(F.col("is_newcomer") | w.chance(share, what + "?", i), w.whole(0, 90, what, i))
    r = r.withColumn("__early", early).withColumns({
        "file_start_day": F.when(F.col("file_age").isNotNull(), F.col("__on0") - F.col("file_age")).when(F.col("is_newcomer"), F.col("__early") - w.whole(0, 400, "file", i)).otherwise(F.least(F.col("__early") - 30, F.col("__adult") + w.whole(0, 8 * 365, "file", i))),
        "email_created_day": F.greatest(F.col("__early") - F.coalesce("mail_age", young(w.new_email, "mail").otherwise(w.whole(365, 6000, "mail", i))), F.col("birth_day") + 12 * 365),
        "phone_first_seen": F.col("__early") - F.coalesce("phone_age", young(w.new_phone, "phone age").otherwise(w.whole(200, 5000, "phone age", i))),
        "dob": F.date_add(F.lit("2023-01-01").cast("date"), F.col("birth_day")).cast("string"),
    })
    domain = F.when(F.col("is_disposable"), F.element_at(F.array(*map(F.lit, DISPOSABLE_DOMAINS)), w.whole(1, len(DISPOSABLE_DOMAINS), "domain", i))).otherwise(pick(w.u("domain", i), POPULAR_DOMAINS.values(), POPULAR_DOMAINS))
    r = r.withColumn("email", F.concat(F.regexp_replace(norm_name(F.col("first_name")), " ", ""), F.lit("."), F.regexp_replace(norm_name(F.col("last_name")), " ", ""), i.cast("string"), F.lit("@"), domain)).withColumn("birth_year", F.substring("dob", 1, 4).cast("int"))
    both = F.when(F.col("__more"), F.array(F.struct(F.col("__first").alias("b"), F.col("__on0").alias("d")), F.struct(F.col("__other").alias("b"), F.col("__on1").alias("d")))).otherwise(F.array(F.struct(F.col("__first").alias("b"), F.col("__on0").alias("d"))))
    r = r.withColumn("__b", F.explode(both)).withColumns({"bank": F.element_at(F.array(*map(F.lit, names)), F.col("__b.b") + 1), "onboard_day": F.col("__b.d")})
    b = F.col("bank")
    bust = F.when(false, F.col("bust_out_day") + w.whole(0, 7, "bust", i)).otherwise(NEVER)
    end = bust + w.whole(*w.burst, "burst", F.col("ring_id"))
    slump = F.greatest(F.col("onboard_day"), F.lit(0)) + w.whole(90, 400, "default", i, b)
    bad = ~false & w.chance(w.distressed, "distressed", i, b) & (slump < w.horizon - 60)
    full = F.when(level == 1, True).when(level == 2, True).otherwise(w.chance(w.transactor, "transactor", i, b))
    fresh = F.col("onboard_day") - F.col("file_start_day") < 730
    three = lambda one, two, rest: F.when(level == 1, one).when(level == 2, two).otherwise(rest)
    k = (i, b)
    seen = false & (w.u("noise", *k) >= w.label_noise)
    columns = {
        "person_id": F.concat(b, F.lit("-"), F.lpad(i.cast("string"), 14, "0")), "is_distressed": bad, "default_day": F.when(bad, slump).otherwise(NEVER), "bust_out_day": bust, "bust_out_end": F.when(false, end).otherwise(NEVER),
        "close_day": F.when(false, end).when(bad, slump + w.whole(90, 150, "closing", *k)).otherwise(NEVER), "label_observed": seen, "label_day": F.when(false, end + w.whole(*w.label_delay, "label", *k)).otherwise(NEVER),
        "limit0": F.when(false & (level < 3), F.bround(w.real(300, 1500, "limit", *k), -2)).otherwise(F.greatest(F.lit(300.0), F.least(F.lit(12000.0), F.bround(F.col("income") * w.real(0.04, 0.12, "limit", *k), -2)))),
        "lir_p": three(w.real(0.2, 0.3, "ask", *k), w.real(0.06, 0.15, "ask", *k), F.when(false | fresh, w.real(0.02, 0.07, "ask", *k)).otherwise(w.real(0.005, 0.03, "ask", *k))), "grant_p": three(F.lit(0.75), F.lit(0.75), F.lit(0.5)), "lir_mult": three(F.lit(1.3), F.lit(1.3), F.lit(1.25)),
        "util_mu": three(w.real(0.1, 0.3, "util", *k), w.real(0.1, 0.35, "util", *k), 1 - F.pow(1 - F.pow(w.u("util", *k), F.lit(0.6)), F.lit(0.28))), "util_sd": three(F.lit(0.02), w.real(0.03, 0.08, "util sd", *k), w.real(0.02, 0.12, "util sd", *k)),
        "pay_mu": F.when(full, 1.0).otherwise(w.real(0.05, 0.6, "pay", *k)), "pay_sd": F.when(level == 1, 0.005).when(full, 0.01).otherwise(w.real(0.05, 0.2, "pay sd", *k)), "late_p": F.when(level == 1, 0.0).when(full, 1 - F.pow(1 - w.u("late", *k), F.lit(1 / 80))).otherwise(1 - F.pow(1 - F.pow(w.u("late", *k), F.lit(0.75)), F.lit(1 / 25))),
        "txn_lam": three(w.real(6, 14, "txn", *k), w.real(6, 30, "txn", *k), w.real(4, 50, "txn", *k)), "n_mcc_base": three(w.real(2, 4, "mcc", *k), w.real(3, 9, "mcc", *k), w.real(3, 12, "mcc", *k)), "cash_p": F.when((level == 1) | (level == 2), 0.0).when(w.chance(0.1, "draws?", *k), w.real(0.05, 0.2, "draws", *k)).otherwise(0.0),
        # Opened from the mobile network rather than at home by some, though never by rings of the first two levels.
        "ips": F.when((F.size("ips") > 1) & w.chance(0.4, "on the way", *k) & ~level.isin(1, 2), F.concat(F.array(F.element_at("ips", 2), F.element_at("ips", 1)), F.slice("ips", 3, 99))).otherwise(F.col("ips")),
    }
    out = r.withColumns(columns).withColumns({"app_device": F.element_at("devices", 1), "app_ip": F.element_at("ips", 1)})
    return out.drop("__first", "__more", "__on0", "__on1", "__adult", "__other", "__early", "__b")


def roles(held: DataFrame, w: World) -> DataFrame:
    """bank, role (seller or mule), rank from 1, person_id, identity_id: accounts of honest people, chosen by hash."""
    calm = held.where("kind = 'legit' and not is_distressed")
    out = None
    for role, some, n in (("seller", (F.col("age").between(40, 70)) & (F.col("onboard_day") <= 0), w.sellers_per_bank), ("mule", F.col("age") <= 30, w.mules_per_bank)):
        order = Window.partitionBy("bank").orderBy(w.u(role, F.col("person_id")), "person_id")
        mine = calm.where(some).select("bank", "person_id", "identity_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).withColumn("role", F.lit(role))
        out = mine if out is None else out.unionByName(mine)
    return out


def with_roles(held: DataFrame, chosen: DataFrame, w: World) -> DataFrame:
    """Accounts with is_tradeline_seller and is_mule of their identity; a seller's limit is high from the start."""
    marks = chosen.groupBy("identity_id").agg(F.max(F.col("role") == "seller").alias("is_tradeline_seller"), F.max(F.col("role") == "mule").alias("is_mule"))
    sells = chosen.where("role = 'seller'").select("person_id", F.lit(True).alias("__sells"))
    out = held.join(F.broadcast(marks), "identity_id", "left").join(F.broadcast(sells), "person_id", "left")  # some tens of rows a bank
    out = out.withColumn("limit0", F.when(F.col("__sells"), w.real(15000, 25000, "seller limit", F.col("person_id"))).otherwise(F.col("limit0"))).drop("__sells")
    return out.na.fill(False, ["is_tradeline_seller", "is_mule"])


def record_attr(held: DataFrame, w: World) -> DataFrame:
    """person_id, attr_type, raw (in one of several spellings), value, first_day, last_day. The first device and network are
    those of the application; others come later."""
    p, number = F.col("person_id"), F.col("phone")
    local = F.concat(F.lit("0"), F.substring(number, 4, 20))
    raw = {
        "phone": F.element_at(F.array(number, local, F.rtrim(F.regexp_replace(local, "(..)", "$1 "))), w.whole(1, 3, "spell phone", p)),
        "email": F.when(w.chance(0.2, "title", p), F.initcap(F.regexp_replace("email", "([.@])", "$1 "))).otherwise(F.col("email")),
        "address": F.element_at(F.array(F.col("address"), F.upper("address"), F.concat(F.substring_index("address", " ", 1), F.lit(", "), F.initcap(F.expr("substring(address, instr(address, ' ') + 1)")))), w.whole(1, 3, "spell address", p)),
    }
    raw["email"] = F.regexp_replace(raw["email"], " ", "")
    end = F.least("close_day", F.lit(w.horizon))
    one = lambda kind, text, value, k: F.struct(F.lit(kind).alias("attr_type"), text.alias("raw"), value.alias("value"), k.cast("int").alias("k"))
    plain = F.array(*[one(k, raw.get(k, F.col(k)), F.col(k), F.lit(0)) for k in ("nid", "phone", "email", "address", "employer")])
    session = [F.transform("devices", lambda v, k: one("device", v, v, k)), F.transform("ips", lambda v, k: one("ip", v, v, k))]
    rows = held.select("person_id", "onboard_day", end.alias("last_day"), (F.col("kind") == "synthetic").alias("f"), F.explode(F.concat(plain, *session)).alias("x")).select("*", "x.*").where("value is not null and onboard_day <= last_day")
    later = w.whole(0, F.when(F.col("f"), 120).otherwise(400), "delay", p, F.col("value"))
    return rows.select("person_id", "attr_type", "raw", "value", F.when(F.col("k") == 0, F.col("onboard_day")).otherwise(F.least("last_day", F.col("onboard_day") + later)).alias("first_day"), "last_day")


def catalog(held: DataFrame, w: World) -> DataFrame:
    """attr_type, value, subtype, first_seen, domain, disposable, created_day, os, emulator, fictitious: one row a value."""
    kind = reduce(lambda out, k: F.when(F.col("ip").startswith(f"{IP_PREFIX[k]}."), k).otherwise(out), IP_PREFIX, F.lit(None).cast("string"))
    empty = {"subtype": "string", "first_seen": "int", "domain": "string", "disposable": "boolean", "created_day": "int", "os": "string", "emulator": "boolean", "fictitious": "boolean"}
    own = held.withColumn("device", F.explode("devices"))
    operators = F.col("sophistication") == 1
    emulator = F.when(operators, w.u("emulator", F.col("device")) < 0.4).otherwise(w.u("emulator", F.col("device")) < F.when(F.col("sophistication") == 2, 0.2).otherwise(0.002))
    parts = [
        held.groupBy(F.col("phone").alias("value")).agg(F.min("phone_type").alias("subtype"), F.min("phone_first_seen").alias("first_seen")).withColumn("attr_type", F.lit("phone")),
        held.groupBy(F.col("email").alias("value")).agg(F.min(F.substring_index("email", "@", -1)).alias("domain"), F.max("is_disposable").alias("disposable"), F.min("email_created_day").alias("created_day")).withColumn("attr_type", F.lit("email")),
        held.groupBy(F.col("address").alias("value")).agg(F.min("address_type").alias("subtype")).withColumn("attr_type", F.lit("address")),
        own.groupBy(F.col("device").alias("value")).agg(F.max(emulator).alias("emulator"), F.min(F.when(w.chance(0.5, "os", F.col("device")), "ios").otherwise("android")).alias("os")).withColumn("attr_type", F.lit("device")),
        held.select(F.explode("ips").alias("ip")).distinct().select(F.col("ip").alias("value"), kind.alias("subtype"), F.lit("ip").alias("attr_type")),
        held.where("employer is not null").groupBy(F.col("employer").alias("value")).agg(F.max("fictitious").alias("fictitious")).withColumn("attr_type", F.lit("employer")),
    ]
    whole = [p.select("attr_type", "value", *[F.col(c) if c in p.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()]) for p in parts]
    return reduce(DataFrame.unionByName, whole)


def monthly(held: DataFrame, w: World) -> DataFrame:
    """The panel of account months; a limit is what was granted in the months before, at most LIMIT."""
    first = F.greatest(F.lit(0), F.floor(F.col("onboard_day") / MONTH).cast("int"))
    last = F.least(F.lit(w.months), F.ceil(F.col("close_day") / MONTH).cast("int")) - 1
    m = held.withColumn("__a", first).withColumn("__b", last).where("__a <= __b").withColumn("month", F.explode(F.sequence("__a", "__b")))
    p, t = F.col("person_id"), F.col("month")
    slump = F.greatest(F.lit(0.0), (t * MONTH + MONTH - F.col("default_day")) / MONTH)
    m = m.withColumns({"__k": slump, "__burst": (t * MONTH < F.col("bust_out_end")) & (t * MONTH + MONTH > F.col("bust_out_day"))})
    calm = (F.col("__k") == 0) & ~F.col("__burst")
    m = m.withColumns({"__late": w.u("late", p, t) < F.col("late_p"), "__ask": w.u("ask", p, t) < F.col("lir_p")})
    m = m.withColumn("__granted", F.col("__ask") & ~F.col("__late") & (w.u("grant", p, t) < F.col("grant_p")))
    before = Window.partitionBy("person_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    grown = F.exp(F.coalesce(F.sum(F.when(F.col("__granted"), F.log("lir_mult")).otherwise(0.0)).over(before), F.lit(0.0)))
    m = m.withColumn("credit_limit", F.least(F.col("limit0") * grown, F.lit(LIMIT)))
    m = m.withColumn("utilization", F.when(F.col("__burst"), w.real(0.97, 1.0, "full", p, t)).otherwise(unit(unit(F.col("util_mu") + F.col("util_sd") * w.normal("util", p, t)) + 0.15 * F.col("__k"))))
    pay = F.when(F.col("__burst"), w.real(0.8, 1.0, "bounce", p, t)).otherwise(unit(unit(F.col("pay_mu") + F.col("pay_sd") * w.normal("pay", p, t)) - 0.25 * F.col("__k")))
    cash = F.when(F.col("__burst"), w.real(0.3, 0.7, "cash", p, t)).when(w.u("draws", p, t) < F.col("cash_p"), w.real(0.05, 0.2, "cash", p, t)).otherwise(0.0)
    calm_n = F.greatest(F.lit(0.0), F.round(F.col("txn_lam") + F.sqrt("txn_lam") * w.normal("txn", p, t)))
    n = calm_n * F.when(F.col("__burst"), 2.5).otherwise(1.0)
    mcc = F.least(F.greatest(n, F.lit(1.0)), F.least(calm_n, F.greatest(F.lit(1.0), F.round(F.col("n_mcc_base") + w.normal("mcc", p, t)))))
    late = F.col("__late") | F.col("__burst") | ((F.col("__k") > 0) & (w.u("slip", p, t) < 0.3 * F.col("__k")))
    spend = F.col("utilization") * F.col("credit_limit")
    return m.select(
        "person_id", "month", "credit_limit", "utilization", spend.alias("spend"), n.alias("n_txn"), mcc.alias("n_mcc"), pay.alias("pay_ratio"), late.cast("int").alias("late"), (spend * cash).alias("cash_advance"),
        (F.col("__ask") & calm).cast("int").alias("limit_increase_request"), (F.col("__granted") & calm).cast("int").alias("limit_increase_granted"), F.when(F.col("__burst"), w.whole(1, 3, "returned", p, t)).otherwise(0).cast("double").alias("returned_payment"),
    )


def _each_month(pairs: DataFrame, first: Column, last: Column, w: World, share: float, n: tuple[int, int], amount: tuple[float, float], what: str) -> DataFrame:
    """src, dst, month, n, amount: some of the months from first to last of each pair."""
    some = pairs.withColumns({"__a": F.greatest(F.lit(0), first), "__b": F.least(F.lit(w.months - 1), last)}).where("__a <= __b").withColumn("month", F.explode(F.sequence("__a", "__b")))
    k = (F.lit(what), F.col("src"), F.col("dst"), F.col("month"))
    return some.where(w.u("moves", *k) < share).select("src", "dst", "month", w.whole(*n, "n", *k).alias("n"), F.round(w.real(*amount, "amount", *k), 2).alias("amount"))


def transfers(held: DataFrame, chosen: DataFrame, w: World) -> DataFrame:
    """Within households, between acquaintances at one bank, within some rings, and from rings to their operator's mules in
    the month of the bust-out. src, dst, month, n, amount."""
    month = lambda c: F.floor(c / MONTH).cast("int")
    cols = ["bank", "person_id", "onboard_day", "close_day", "bust_out_day", "household_id", "ring_id", "size"]
    legit, false = held.where("kind = 'legit'").select(*cols), held.where("kind = 'synthetic'").select(*cols, "operator_id", "sophistication", "scenario")
    other = lambda df, *keys: df.select(*keys, F.col("person_id").alias("dst"), F.col("onboard_day").alias("on2"), F.col("close_day").alias("off2"), F.col("bust_out_day").alias("bust2"))
    start, stop = month(F.greatest("onboard_day", "on2", F.lit(0))) + 1, month(F.least("close_day", "off2", F.lit(w.horizon))) - 1
    one = legit.withColumnRenamed("person_id", "src")
    home = one.join(other(legit, "bank", "household_id"), ["bank", "household_id"]).where("src <> dst").where(w.u("pays", F.col("src"), F.col("dst")) < 0.5)
    out = [_each_month(home, start, stop, w, 0.6, (1, 2), (50, 800), "home")]
    # Acquaintances: a bank's accounts lie in slots by hash, the least of a slot can be drawn; payers draw one or two.
    slots = max(1, w.households)
    meet = legit.withColumn("slot", F.pmod(F.xxhash64(F.lit("slot"), "person_id"), F.lit(slots)))
    known = other(meet.join(meet.groupBy("bank", "slot").agg(F.min("person_id").alias("person_id")), ["bank", "slot", "person_id"], "left_semi"), "bank", "slot")
    draws = F.sequence(F.lit(1), w.whole(1, 2, "friends", F.col("src")))
    friends = one.where(w.u("sociable", F.col("src")) < 0.3).withColumn("d", F.explode(draws)).withColumn("slot", F.floor(w.u("friend", F.col("src"), F.col("d")) * slots))
    friends = friends.join(known, ["bank", "slot"]).where("src <> dst").dropDuplicates(["src", "dst"])
    out.append(_each_month(friends, start, stop, w, 0.15, (1, 2), (10, 300), "friend"))
    uses = ((F.col("sophistication") == 1) & w.chance(0.6, "circle", F.col("ring_id"))) | ((F.col("sophistication") == 2) & w.chance(0.4, "circle", F.col("ring_id"))) | (F.col("scenario") == "circular_transfers")
    circle = false.where(uses).withColumnRenamed("person_id", "src").join(other(false, "bank", "ring_id"), ["bank", "ring_id"]).where("src <> dst").where(w.u("circle", F.col("src"), F.col("dst")) < F.least(F.lit(1.0), 1.5 / F.col("size")))
    out.append(_each_month(circle, month(F.greatest("onboard_day", "on2")) + 1, month(F.least("bust_out_day", "bust2")) - 1, w, 0.5, (1, 3), (20, 300), "circle"))
    o = (F.col("operator_id"), F.col("bank"))
    mine = F.slice(F.array_distinct(F.array(*[w.whole(1, w.mules_per_bank, f"mule{k}", *o) for k in range(2)])), 1, w.whole(1, 2, "mules", F.col("person_id")))
    mules = chosen.where("role = 'mule'").select("bank", "rank", F.col("person_id").alias("dst"))
    cashed = false.select("bank", F.col("person_id").alias("src"), F.explode(mine).alias("rank"), month(F.col("bust_out_day")).alias("m")).join(F.broadcast(mules), ["bank", "rank"])
    out.append(_each_month(cashed, F.when(F.col("m") >= 0, F.col("m")).otherwise(NEVER), F.col("m"), w, 1.0, (2, 5), (2000, 9000), "cash"))
    return reduce(DataFrame.unionByName, out)


def authorized_users(held: DataFrame, chosen: DataFrame, w: World) -> DataFrame:
    """person_id, host_person_id, first_day: second members on the first's account, and ring members on sellers' accounts."""
    p = F.col("person_id")
    legit = held.where("kind = 'legit' and not is_dorm").select("bank", "household_id", "member", "person_id", "onboard_day")
    host = legit.where("member = 1").select("bank", "household_id", F.col("person_id").alias("host_person_id"), F.col("onboard_day").alias("on2"))
    home = legit.where("member = 2").join(host, ["bank", "household_id"]).where(w.u("guest", p) < 0.15).select("person_id", "host_person_id", (F.greatest("onboard_day", "on2") + w.whole(0, 200, "since", p)).alias("first_day"))
    level = F.col("sophistication")
    buys = ((level == 1) & w.chance(0.2, "buys", p)) | ((level == 2) & w.chance(0.4, "buys", p)) | (F.col("scenario") == "tradeline")
    o = (F.col("operator_id"), F.col("bank"))
    ranks = F.slice(F.array_distinct(F.array(*[w.whole(1, w.sellers_per_bank, f"seller{k}", *o) for k in range(2)])), 1, w.whole(1, 2, "sellers", *o))
    sellers = chosen.where("role = 'seller'").select("bank", "rank", F.col("person_id").alias("host_person_id"))
    bought = held.where("kind = 'synthetic'").where(buys).select("bank", "person_id", "onboard_day", F.explode(ranks).alias("rank")).join(F.broadcast(sellers), ["bank", "rank"])
    return home.unionByName(bought.select("person_id", "host_person_id", (F.col("onboard_day") + w.whole(20, 120, "since", p, F.col("host_person_id"))).alias("first_day")))


def _complicit(w: World) -> int:
    return math.ceil(w.rings / w.rings_per_operator)


def merchants(spark: SparkSession, w: World) -> DataFrame:
    """merchant_id, mcc, high_risk_mcc, complicit. Regular ones count from 1, in order of popularity; each operator has one or
    two complicit ones, below 0."""
    m = F.col("merchant_id")
    named = lambda values, what: F.element_at(F.array(*map(F.lit, values)), w.whole(1, len(values), what, m))
    regular = spark.range(1, w.merchants + 1).select(F.col("id").alias("merchant_id"), F.lit(False).alias("complicit"))
    bad = spark.range(_complicit(w)).select(F.explode(F.sequence(F.lit(0), w.whole(0, 1, "shops", F.col("id")))).alias("k"), "id").select((-1 - F.col("id") * 2 - F.col("k")).alias("merchant_id"), F.lit(True).alias("complicit"))
    risky = F.col("complicit") | w.chance(0.08, "risky", m)
    return regular.unionByName(bad).select("merchant_id", F.when(risky, named(HIGH_RISK_MCC, "risk")).otherwise(named(REGULAR_MCC, "mcc")).alias("mcc"), risky.alias("high_risk_mcc"), "complicit")


def paid_at(held: DataFrame, w: World) -> DataFrame:
    """person_id, merchant_id, first_day, last_day: merchants of each account by Zipf, the operator's own ones for a scenario,
    and some honest customers of these."""
    p, level, end = F.col("person_id"), F.col("sophistication"), F.least("close_day", F.lit(w.horizon))
    many = F.when(level == 1, w.whole(3, 6, "shops", p)).when(level == 2, w.whole(4, 8, "shops", p)).when(level == 3, w.whole(8, 20, "shops", p)).otherwise(w.whole(8, 25, "shops", p))
    visit = held.select("person_id", "onboard_day", "close_day", end.alias("last_day"), F.explode(F.sequence(F.lit(1), many)).alias("v")).withColumn("merchant_id", w.zipf(w.merchants, 1.05, "shop", p, F.col("v")))
    usual = visit.groupBy("person_id", "merchant_id").agg(F.min(F.least(F.col("onboard_day") + w.whole(0, 300, "visit", p, F.col("v")), F.col("close_day") - 1)).alias("first_day"), F.max("last_day").alias("last_day"))
    shop = -1 - F.col("operator_id") * 2 - F.col("k")
    own = held.where("scenario = 'complicit_merchant'").withColumn("k", F.explode(F.sequence(F.lit(0), w.whole(0, 1, "shops", F.col("operator_id"))))).select("person_id", shop.alias("merchant_id"), (F.col("onboard_day") + w.whole(10, 90, "visit", p, F.col("k"))).alias("first_day"), F.col("close_day").alias("last_day"))
    # About two honest customers for each complicit merchant: an account is drawn with that chance, and draws its merchant.
    shops, all_ = 2 * _complicit(w), max(1, w.households * 3)
    decoys = held.where("kind = 'legit'").where(w.u("decoy", p) < 2 * shops / all_).select("person_id", (-1 - F.floor(w.u("which", p) * shops)).alias("merchant_id"), F.least(F.col("onboard_day") + w.whole(0, 600, "visit", p, F.lit("d")), F.col("close_day") - 1).alias("first_day"), end.alias("last_day"))
    real = merchants(held.sparkSession, w).where("complicit").select("merchant_id")
    return usual.unionByName(own).unionByName(decoys.join(F.broadcast(real), "merchant_id", "left_semi").select("person_id", "merchant_id", "first_day", "last_day"))


IDENTITY_COLUMNS = (
    "identity_id", "kind", "sex", "first_name", "last_name", "dob", "birth_day", "birth_year", "household_id", "ring_id", "operator_id", "sophistication", "scenario", "is_dorm", "is_colocation", "is_elderly_assisted", "is_newcomer",
    "is_tradeline_seller", "is_mule", "stolen_nid", "variant", "nid", "phone", "email", "address", "employer", "income", "file_start_day",
)
RECORD_COLUMNS = (
    "person_id", "bank", "identity_id", "onboard_day", "close_day", "bust_out_day", "bust_out_end", "label_day", "label_observed", "is_distressed", "default_day", "app_device", "app_ip",
    "limit0", "lir_p", "grant_p", "lir_mult", "util_mu", "util_sd", "pay_mu", "pay_sd", "late_p", "txn_lam", "n_mcc_base", "cash_p",
)


def world(spark: SparkSession, w: World | None = None) -> dict[str, DataFrame]:
    """All tables by name: identities, records, catalog, record_attr, paid_at, merchants, transfers, authorized_users, monthly,
    rings. Accounts are checkpointed once; write the tables by ``tables.write_tables`` before reading them more than once."""
    w = w or World()
    people = honest(spark, w).unionByName(false_ones(spark, w), allowMissingColumns=True)
    held = checkpointed(accounts(people, w))
    chosen = checkpointed(roles(held, w))
    held = checkpointed(with_roles(held, chosen, w))
    return {
        "identities": held.select(*IDENTITY_COLUMNS).dropDuplicates(["identity_id"]), "records": held.select(*RECORD_COLUMNS), "catalog": catalog(held, w), "record_attr": record_attr(held, w), "paid_at": paid_at(held, w),
        "merchants": merchants(spark, w), "transfers": transfers(held, chosen, w), "authorized_users": authorized_users(held, chosen, w), "monthly": monthly(held, w), "rings": rings(spark, w),
    }
