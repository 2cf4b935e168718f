import hashlib
import hmac
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringlight.functions import hashing, normalize, similarity
from ringlight.operators import alerts, blinding, crossbank, evaluation, features
from ringlight.operators.components import connected_components
from ringlight.operators.graph import pagerank
from ringlight.operators.running import running_totals
from ringlight.operators.snapshot import snapshot
from ringlight.plans import queries


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_normalizers(spark):
    for phone in ("06 12 34 56 78", "+33612345678", "0612345678"):
        assert one(spark, phone, normalize.norm_phone) == "+33612345678"
    assert one(spark, "  Jean.Dupont@Gmail.com ", normalize.norm_plain) == "jean.dupont@gmail.com"
    assert one(spark, "12, Rue de l'Église 75001 PARIS", normalize.norm_address) == "12 rue de l eglise 75001 paris"
    assert one(spark, "Jean-Luc l'Église", normalize.norm_name) == "jean luc leglise"


def test_tokens(spark):
    key = hashing.bank_key("k", 1, "B")
    assert one(spark, "nid:123", lambda c: hashing.hmac_token(c, key)) == hmac.new(key, b"nid:123", hashlib.sha256).hexdigest()[:20]
    want = int.from_bytes(hashlib.sha256(b"7|x").digest()[:8], "big") / 2**64
    assert abs(one(spark, "x", lambda c: hashing.uniform(7, c)) - want) < 1e-15


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_indel_ratio(spark):
    pairs = [("jean dupont", "jean dupond"), ("", ""), ("", "a"), ("abc", "cba"), ("kitten", "sitting")]
    got = spark.createDataFrame(pairs, "a string, b string").select(similarity.indel_ratio(F.col("a"), F.col("b"))).collect()
    for (a, b), (r,) in zip(pairs, got):
        assert abs(r - (200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)) < 1e-9


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()))
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pagerank_keeps_mass(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 2.0), (3, 2, 2.0)], "src long, dst long, w double")
    got = dict(map(tuple, pagerank(edges, spark.range(1, 6).withColumnRenamed("id", "person_id"), rounds=20).collect()))
    assert abs(sum(got.values()) - 5) < 1e-9 and got[2] > got[3] > got[1] > got[4] == got[5]


def test_pagerank_by_numpy(spark):
    rng = np.random.default_rng(5)
    w = np.triu(rng.random((12, 12)) * (rng.random((12, 12)) < 0.3), 1)
    w = w + w.T
    w[3], w[:, 3] = 0, 0
    edges = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*w.nonzero())], "src long, dst long, w double")
    out = w.sum(1)
    share = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    r = np.full(12, 1 / 12)
    for _ in range(7):
        r = 0.15 / 12 + 0.85 * (share.T @ r + r[out == 0].sum() / 12)
    got = dict(map(tuple, pagerank(edges, spark.range(12).withColumnRenamed("id", "person_id"), rounds=7).collect()))
    assert max(abs(got[i] - r[i] * 12) for i in range(12)) < 1e-9


def test_metrics(spark):
    rows = spark.createDataFrame([(i, "a", int(i < 10), float(100 - i)) for i in range(100)], "pos long, g string, y int, score double")
    weighted = evaluation.prevalence_weights(rows, "y", 0.01, "g")
    p, n = weighted.agg(F.sum(F.col("w") * F.col("y")), F.sum("w")).first()
    assert abs(p / n - 0.01) < 1e-12
    rows = spark.createDataFrame([(i, "a", int(i < 2), float(-i)) for i in range(200)], "pos long, g string, y int, score double").withColumn("w", F.lit(1.0))
    assert evaluation.average_precision(rows, "y", "score", "g").first()["ap"] == 1.0
    chosen = evaluation.select_budget(rows, "score", "pos", 0.02, "g")
    m = evaluation.budget_metrics(chosen, "y", "g").first()
    assert (m["alerts"], m["precision"], m["recall"]) == (4, 0.5, 1.0)


def test_greedy_takes_what_fits(spark):
    r = random.Random(4)
    for n, budget in ((0, 5.0), (30, 0.5), (30, 20.0), (60, 33.0), (20, 1000.0)):
        made = [(f"c{i:02d}", float(r.choice([0.25, 0.5, 1.0, 2.5, 7.0])), round(r.random(), 1)) for i in range(n)]
        want, left = [], budget
        for c, w, _ in sorted(made, key=lambda x: (-x[2], x[0])):
            if w <= left:
                want.append(c)
                left -= w
        scored = spark.createDataFrame(made, "c string, weight double, top3 double")
        assert sorted(x.c for x in alerts.greedy_communities(scored, "c", budget).collect()) == sorted(want)


def test_running_totals(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), i, r.randrange(5)) for i in range(300)]
    got = running_totals(spark.createDataFrame(rows, "g string, i long, v long"), ["g"], [F.col("i").desc()], {"t": F.col("v"), "n": F.lit(1)})
    for g, i, _, t, n in got.select("g", "i", "v", "t", "n").collect():
        mine = [v for h, j, v in rows if h == g and j >= i]
        assert (t, n) == (sum(mine), len(mine))


def test_accents_are_those_of_unicode(spark):
    r = random.Random(8)
    texts = ["Čapek Šimon Őry ﬁn", "½ ㎏ 𝐀b ŒøßÉ", None, ""] + ["".join(r.choice("aZ 9é") if r.random() < 0.3 else chr(r.choice([r.randrange(0x80, 0x3000), r.randrange(0x1D400, 0x1D7FF), r.randrange(0xFB00, 0xFB07)])) for _ in range(20)) for _ in range(200)]
    got = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "v string").select(normalize.strip_accents(F.col("v"))).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]


def test_folds(spark):
    rows = [(f"{k}{i % 25}", int(k == "r"), "x" if (i % 25) % 7 == 0 else "y", 100 * (i % 25) + i) for k in "rh" for i in range(100)]
    got = {tuple(r) for r in evaluation.assign_folds(spark.createDataFrame(rows, "group string, is_synthetic int, scenario string, bust_out_day int"), 7, ["x"], 1500, 0.5, 0.25).select("group", "fold").collect()}
    assert len(got) == 50  # one fold a group
    for group, fold in got:
        u = int.from_bytes(hashlib.sha256(f"7|{group}".encode()).digest()[:8], "big") / 2**64
        k = int(group[1:])
        if group[0] == "r":
            want = "test" if k % 7 == 0 or 101 * k > 1500 else "val" if u < 0.25 else "train"
        else:
            want = "test" if u < 0.5 else "val" if (u - 0.5) / 0.5 < 0.25 else "train"
        assert fold == want


def test_hubs_change_nothing(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(50, 51), (51, 52), (40, 39)], "src long, dst long")
    plain, split = (dict(map(tuple, connected_components(edges, hub_edges=h).collect())) for h in (1000, 3))
    assert plain == split and plain[40] == 0 and plain[52] == 50


def test_no_feature_uses_the_future(spark, smallest):
    t = queries.Tables(spark, smallest)
    tables = {"persons": t.persons(), "person_attr": t.person_attr("nid", "phone"), "paid_at": t.paid_at(), "transfers": t.transfers(), "authorized_users": t.authorized_users(), "similar": t.similar(), "monthly": t.monthly(), "fraud_confirmations": t.confirmations()}
    day = 800
    past = dict(tables)
    for name, when in (("person_attr", "first_day"), ("paid_at", "first_day"), ("authorized_users", "first_day"), ("similar", "first_day"), ("persons", "onboard_day"), ("fraud_confirmations", "confirmed_day")):
        past[name] = tables[name].where(F.col(when) <= day)
    for name in ("transfers", "monthly"):
        past[name] = tables[name].where((F.col("month") + 1) * 30 <= day)
    made = []
    for x in (tables, past):
        s = snapshot(x, day)
        f = features.application(s["persons"], day).join(features.behaviour(s["monthly"], day), "person_id", "left").join(features.graph_counts(s, features.snapshot_projection(s)), "person_id")
        made.append(f.orderBy("person_id").toPandas())
    assert len(made[0]) > 50
    assert ((made[0] - made[1]).abs().fillna(0) < 1e-9).all().all() and (made[0].isna() == made[1].isna()).all().all()


def test_encrypted_equals_clear(spark):
    rows = [(b, f"t{t}", 100 * b + p) for b in range(3) for t in range(25) for p in range(1 + (t * b) % 4) if (t + b) % 5]
    h = spark.createDataFrame(rows, "bank int, token string, person_id long")
    assert sorted(map(tuple, crossbank.reuse(h).collect())) == sorted(map(tuple, crossbank.encrypted_reuse(h, 256).collect()))


def test_round_hides_and_counts(spark):
    per = spark.createDataFrame([(b, f"t{t}", 1 + (t * b) % 5) for b in range(3) for t in range(40) if (t + b) % 3 or t % 4 == 0], "bank int, token string, n long").cache()
    requests = crossbank.round_requests(per, 0.5).cache()
    totals = crossbank.encrypted_totals(requests, 256)
    assert requests.groupBy("asker", "bank", "slot").count().where("count > 1").count() == 0
    # A decoy's slot is nobody else's, a real token's slot is the same at all banks.
    assert requests.where("not real").groupBy("asker", "slot").count().where("count > 1").count() == 0
    assert requests.where("real").groupBy("asker", "token").agg(F.count_distinct("slot").alias("n")).where("n > 1").count() == 0
    st = crossbank.round_statistics(requests, totals, per, 256).first()
    assert st.max_abs_error == 0 and st.decoy_slots > 0 and st.slots_per_ciphertext == 15 and st.security_bits is None
    with pytest.raises(Exception, match="does not fit"):
        crossbank.encrypted_totals(requests.withColumn("n", F.lit(1 << 16)), 256).collect()


def test_paillier():
    key = crossbank.Paillier(1024, 5)
    assert key.n.bit_length() in (1023, 1024) and key.decrypt(key.encrypt(5, 99) * key.encrypt(7, 101) % key.square) == 12
    assert not crossbank.Paillier.passes(561 * 1105, random.Random(1))


def test_leakage(spark):
    values = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "v string")
    r = blinding.leakage_report(values, "v", 12345, 999).first()
    assert (r.hub_strings_not_tokens, r.raw_values_at_hub, r.unblinded_points_at_service, r.naive_recovered, r.blinded_recovered) == (0, 0, 0, 1.0, 0.0)
    assert blinding.leakage_report(values, "v", 12345, 12345).first().blinded_recovered == 1.0
    with pytest.raises(PermissionError):
        blinding.blinded_tokens(values, "v", 12345, most=2)


def test_snapshot_ignores_the_future(spark):
    t = {
        "persons": spark.createDataFrame([("a", 1, None), ("b", 5, 8), ("c", 99, None)], "person_id string, onboard_day int, close_day int"),
        "fraud_confirmations": spark.createDataFrame([("a", 50), ("b", 9)], "person_id string, confirmed_day int"),
        "person_attr": spark.createDataFrame([("a", "x", 2), ("a", "y", 70), ("c", "x", 2)], "person_id string, token string, first_day int"),
    }
    s = snapshot(t, 10)
    assert sorted((r.person_id, r.known_fraud, r.closed, r.scored) for r in s["persons"].collect()) == [("a", False, False, True), ("b", True, True, False)]
    assert [(r.person_id, r.token) for r in s["person_attr"].collect()] == [("a", "x")]


def test_sealed_and_packed():
    """Sealing needs no secret, differs by seed and adds up; decryption by the two primes is the textbook's."""
    key = crossbank.Paillier(512, 3)
    a, b = key.seal(20, "a"), key.seal(key.n - 7, "b")
    assert key.decrypt(a * b % key.square) == 13 and a == key.seal(20, "a") != key.seal(20, "c")
    (p, _, _), (q, _, _) = key.primes
    secret = (p - 1) * (q - 1)
    assert all(key.decrypt(c) == (pow(c, secret, key.square) - 1) // key.n * pow(secret, -1, key.n) % key.n for c in (a, b, key.encrypt(5, 99)))


def test_score_packs_rows_and_keeps_wide_ones(spark):
    """Rows share ciphertexts (4 in 512 bits here), and a feature too wide for that is still scored whole."""
    values = [0.0, -1e6, 2.5e12, -3e15, 1e9, None, -0.25, 7.0, 1e-6]
    rows = spark.createDataFrame([(i, v, -v if v else 1.0) for i, v in enumerate(values)], "id long, a double, b double").coalesce(1)
    got = {r.id: r.logit for r in blinding.encrypted_score(rows, "id", {"a": 0.5, "b": -0.75}, 2.0, 512).collect()}
    assert got == {i: pytest.approx(2.0 + 0.5 * (v or 0.0) - 0.75 * (-v if v else 1.0), rel=1e-9, abs=1e-9) for i, v in enumerate(values)}


def test_training_makes_no_graph(spark, smallest):
    """The models on a person's own columns store neither visits nor the projection."""
    from ringlight.plans import queries
    from ringlight.plans.binding import Tables

    spark.sparkContext._ringlight_stored = {}
    train, rows = queries._training(Tables(spark, smallest))
    made = {k[1].split(":")[0] for k in spark.sparkContext._ringlight_stored}
    assert "own" in made and not made & {"projection", "columns", "paid_at", "attr"} and 0 < train.count() < rows.count()


def test_round_draws_the_least_hashes(spark):
    """Decoys are the tokens of least hash that the asker lacks, all slots are dense, and nulls and lone tokens break nothing."""
    rows = [(b, f"t{t}", 1 + (t * b) % 5) for b in range(4) for t in range(300) if (t * 7 + b * 3) % 5 < 2] + [(1, None, 3)]
    per = spark.createDataFrame(rows, "bank int, token string, n long")
    got = crossbank.round_requests(per, 0.5).withColumn("h", F.xxhash64(F.lit(1), "asker", "bank", "token")).collect()
    held = {(b, t): n for b, t, n in rows}
    real = {(r.asker, r.bank, r.token) for r in got if r.real}
    assert real == {(a, b, t) for b, t in held for a in range(4) if a != b and t is not None and (a, t) in held}
    assert all(held[r.bank, r.token] == r.n for r in got)
    hashed = {(r.asker, r.bank, r.token): r.h for r in spark.createDataFrame([(a, b, t) for b, t in held for a in range(4)], "asker int, bank int, token string").withColumn("h", F.xxhash64(F.lit(1), "asker", "bank", "token")).collect()}
    for a in range(4):
        assert sorted({r.slot for r in got if r.asker == a}) == list(range(max(r.slot for r in got if r.asker == a) + 1))
        for b in set(range(4)) - {a}:
            n = sum(r.asker == a and r.bank == b and r.real for r in got) // 2
            pool = sorted((hashed[a, b, t], t or "") for x, t in held if x == b and (a, t) not in held)
            assert sorted((r.h, r.token or "") for r in got if (r.asker, r.bank, r.real) == (a, b, False)) == pool[:n]


def test_components_of_holders(spark):
    """Persons and attributes in one graph, against the rounds over all nodes: chains, tokens of one, a name that sorts before persons'."""
    from ringlight.operators import graph
    from ringlight.operators.components import component_sizes, holder_component_sizes

    rows = [(p, k, f"{(p * 7 + j * 5) // 3 % 40}") for p in range(60) for j, k in enumerate(("a", "z")) if p % 9] + [(100, "a", "only"), (101, "A", "first"), (101, "a", "x"), (None, "a", "x")]
    attrs = spark.createDataFrame(rows, "person_id long, attr_type string, token string")
    for least in (1, 3):
        assert sorted(map(tuple, holder_component_sizes(attrs, least).collect())) == sorted(map(tuple, component_sizes(graph.bipartite(attrs.where("person_id is not null")), least).collect()))


def test_components_of_lines(spark, monkeypatch):
    """Tokens made of lines on the way, against a table of attributes: small and large batches, tasks that pass on early, hubs, repeated lines, and
    nulls that make two different lines' tokens one."""
    from ringlight.operators import components

    r = random.Random(3)
    some = lambda n, p=0.0: None if r.random() < p else r.randrange(n)
    rows = [(some(90, 0.03), some(50, 0.1) if i % 3 else 7, some(4, 0.1), some(3, 0.1)) for i in range(130)] * 2 + [(200, 60, 1, 1), (201, 60, 1, 2), (202, None, 60, 2)]
    lines = spark.createDataFrame(rows, "person_id long, part long, supp int, day int")
    schemes = {"nid": ("part", "supp"), "year": ("day", "part"), "lot": ("part", "supp", "day")}
    parts = [lines.select("person_id", F.lit(k).alias("attr_type"), F.concat_ws(":", F.lit(k), *c).alias("token")) for k, c in schemes.items()]
    attrs = parts[0].unionByName(parts[1]).unionByName(parts[2])
    for batch, held, joined in ((10_000, 4_000_000, 3_000_000), (3, 20, 10)):
        monkeypatch.setattr(components, "HELD", held)
        monkeypatch.setattr(components, "JOINED", joined)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            for least in (1, 4):
                got = components.line_component_sizes(lines.repartition(3, "part"), schemes, "part", least).collect()
                assert sorted(map(tuple, got)) == sorted(map(tuple, components.holder_component_sizes(attrs, least).collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(ValueError):
        components.line_component_sizes(lines, {"Nid": ("part",)}, "part")


def test_identity_wcc_reads_all_strong_kinds_and_days(spark, tmp_path):
    """A national id and an address link persons too, also by orders after the day of the snapshot."""
    from ringlight.plans import queries

    day = "timestamp'2001-06-01 00:00:00'"
    spark.range(1).selectExpr("1L as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3).selectExpr("id as o_orderkey", "id + 1 as o_custkey", f"{day} + make_dt_interval(cast(id * 400 as int)) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(3).selectExpr("id as l_orderkey", "5L as l_partkey", "6L as l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in queries.QUERIES["identity_wcc"](spark, str(tmp_path)).collect()] == [("Person:1", 3 + 1 + 4 * 3)]


def test_rule_counts_are_the_graph_counts(spark, smallest):
    from ringlight.plans import queries
    from ringlight.plans.binding import Tables

    t = Tables(spark, smallest)
    mine = features.rule_counts(t.snapshot(kinds=("nid", "phone", "device")))
    whole = queries._features(t).select(*mine.columns)
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, whole.collect()))
    spark.sparkContext._ringlight_stored = {}
    queries.QUERIES["rules_score"](spark, smallest).count()
    made = {k[1].split(":")[0] for k in spark.sparkContext._ringlight_stored}
    assert "own" in made and not made & {"projection", "columns", "paid_at"}


def test_blocks_are_the_projection(spark, monkeypatch):
    """Counts, components, communities and ranks from lists in blocks, in several passes, against the table of edges."""
    from ringlight.operators import blocks, communities, graph

    monkeypatch.setattr(blocks, "BLOCK_PAIRS", 150)
    monkeypatch.setattr(blocks, "PASS_PAIRS", 500)
    monkeypatch.setattr(blocks, "HELD_PAIRS", 200)
    r = random.Random(5)
    attr = {(r.randrange(70), k, f"{k}{r.randrange(5 if k == 'employer' else 60)}") for k in features.ATTR_TYPES for _ in range(60)}
    visits = {(r.randrange(70), f"m{r.randrange(30)}") for _ in range(60)}
    pairs = {(a, b) for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(25)) if a != b} | {(1, 2), (2, 1), (90, 91)}
    frame = spark.createDataFrame
    s = {
        "persons": frame([(7 * p + 3, p % 6 == 0, f"id{p % 20}") for p in range(100)], "person_id long, known_fraud boolean, id_token string"),
        "person_attr": frame([(7 * p + 3, k, v) for p, k, v in attr], "person_id long, attr_type string, token string"), "paid_at": frame([(7 * p + 3, v) for p, v in visits], "person_id long, merchant_token string"),
        "transfers": frame([(7 * a + 3, 7 * b + 3) for a, b in pairs], "src long, dst long"), "authorized_users": frame([(7 * p + 3, 3) for p in range(1, 9)], "person_id long, host_person_id long"),
        "similar": frame([(7 * p + 3, 7 * p + 73) for p in range(12)], "a long, b long"),
    }
    edges = graph.projection([(s["person_attr"], "token", 6), (s["paid_at"], "merchant_token", 4)], [(s["transfers"], "src", "dst"), (s["authorized_users"], "person_id", "host_person_id"), (s["similar"], "a", "b")]).cache()
    nodes, n, lists = features.graph_lists(s, 6, 4)
    size, passes = blocks.block_size(lists, n)
    assert passes > 1 and size < 40 and n == 100
    folder = blocks.shared_folder(spark, "graph")
    one = features.listed_graph_counts(s, nodes, n, lists, (folder, size)).toPandas().set_index("person_id").sort_index()
    other = features.graph_counts(s, edges, 4).toPandas().set_index("person_id").sort_index()[one.columns]
    assert len(one) == 100 and (one - other).abs().max().max() < 1e-9 and (one.max() > 0).all()
    got = features.graph_groups(nodes, blocks.Graph(spark, folder, size, n)).toPandas().set_index("person_id").sort_index()
    labels = dict(map(tuple, communities.communities(edges).collect()))
    ranks = dict(map(tuple, graph.pagerank(edges, s["persons"]).collect()))
    parts = dict(map(tuple, connected_components(edges).collect()))
    sizes = {c: list(parts.values()).count(c) for c in set(parts.values())}
    assert {p: c for p, c in got.community.items() if c == c} == labels and len(set(labels.values())) > 2
    assert all(abs(got.g_pagerank[p] - x) < 1e-9 for p, x in ranks.items()) and len(ranks) == len(got) == 100
    assert all(got.g_wcc_size[p] == sizes.get(parts.get(p), 1) for p in got.index)


def test_graph_columns_store_no_projection(spark, smallest):
    """Neither edges nor attributes by type are stored for the columns of the graph."""
    for name in ("graph_features", "scaled_features", "shortcut_audit"):
        spark.sparkContext._ringlight_stored = {}
        assert queries.QUERIES[name](spark, smallest).count()
        made = {k[1].split(":")[0] for k in spark.sparkContext._ringlight_stored}
        assert made & {"graph", "audited"} and not made & {"projection", "columns", "paid_at", "attr"}


def test_volumes_are_made_once_a_round(spark):
    """Sums of degrees by label over several ranges of labels; blocks that move read them and never the labels of all persons."""
    import inspect

    from ringlight.operators import blocks

    g = blocks.Graph(spark, blocks.shared_folder(spark, "volumes"), 40, 100)
    labels, degree = g.state("u4"), g.state("f8")
    at, k = np.arange(100, dtype="u4") * 7 % 30, np.arange(100) / 4
    blocks._put(labels, 0, at)
    blocks._put(degree, 0, k)
    for span in (17, 1 << 22):
        assert np.array_equal(blocks._get(blocks.volumes(g, labels, degree, span), "f8"), np.bincount(at, k, 100))
    assert "volume" in inspect.signature(blocks._move_task).parameters


def test_fits_of_one_table_are_the_fits_alone(spark):
    """Trees on each feature set, fitted side by side, against each fitted alone."""
    from ringlight.operators import models

    named = {c: F.when(F.col("person_id") % 5 == 0, 1).otherwise(0) for c in ("g_share_phone", "g_share_device", "g_nid_identity_mismatch", "beh_lir_count")}
    app = {c: F.rand(i) for i, c in enumerate(("app_address_mail_drop", "app_address_commercial", "app_email_age_at_onboard", "app_phone_voip", "app_ip_datacenter", "app_ip_vpn", "app_email_disposable", "app_device_emulator"))}
    rows = spark.range(240).select(F.col("id").alias("person_id"), F.lit(1).alias("T"), (F.col("id") % 10 == 0).cast("int").alias("y"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split")).withColumns(named | app).localCheckpoint()
    out, info = models.model_scores(rows, trees=3)
    assert list(info) == ["tab", "graph"] and out.count() == 60
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    for name, columns in models.feature_sets(rows.columns).items():
        alone = models.boosted_trees(train, test, columns, "y", trees=3).select("person_id", "score")
        assert out.join(alone, "person_id").where(F.abs(F.col(f"trees_{name}") - F.col("score")) > 1e-9).count() == 0
