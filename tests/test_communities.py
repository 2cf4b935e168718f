"""Communities, blinded tokens and the encrypted score on small planted inputs."""

import pytest
from pyspark.sql import functions as F

from ringlight.operators import blinding, communities


def test_communities(spark):
    one = [(a, b) for g in range(6) for a in range(8 * g, 8 * g + 8) for b in range(a + 1, 8 * g + 8)] + [(8 * g, 8 * ((g + 1) % 6) + 3) for g in range(6)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in one] + [(b, a, 1.0) for a, b in one], "src long, dst long, w double")
    got = communities.communities(edges)
    labels = {r.node: r.community for r in got.collect()}
    assert len(labels) == 48 and all(len({labels[8 * g + k] for k in range(8)}) == 1 for g in range(6)) and len(set(labels.values())) >= 3
    assert communities.modularity(edges, got).first()[0] > 0.6
    known = spark.createDataFrame([(0,), (1,)], "person_id long")
    share = {r.node: (r.size, r.known_share) for r in communities.community_known(got, known).collect()}
    assert share[0][1] == pytest.approx(1 / (share[0][0] - 1)) and share[2][1] == pytest.approx(2 / (share[2][0] - 1))


def test_blinded_tokens(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "v string")
    got = {r.v: r.token for r in blinding.blinded_tokens(df, "v", 123456789).collect()}
    assert got == {v: blinding.token_of(blinding.times(123456789, blinding.to_curve(v))) for v in "ab"}


def test_encrypted_score(spark):
    rows = spark.range(20).select("id", (F.col("id") / 7 - 1).alias("a"), F.when(F.col("id") > 3, -F.col("id") * 0.5).alias("b"))
    got = blinding.encrypted_score(rows, "id", {"a": 1.25, "b": -0.3}, 0.5, 512).collect()
    assert all(r.logit == pytest.approx(0.5 + 1.25 * (r.id / 7 - 1) + (0.15 * r.id if r.id > 3 else 0), abs=1e-9) for r in got) and len(got) == 20


def test_multiples_of_points():
    """The short way against sums of points, from 0 to beyond the order, and a point's own opposite."""
    import random

    g, r = blinding.to_curve("g"), random.Random(1)

    def plainly(k, point):
        out = None
        while k:
            out, point, k = blinding.add(out, point) if k & 1 else out, blinding.add(point, point), k >> 1
        return out

    n = blinding.ORDER
    for k in [*range(40), n - 1, n, n + 5, 2 * n - 3, *(r.randrange(n) for _ in range(30))]:
        assert blinding.times(k, g) == plainly(k, g)
    assert blinding.times(5, None) is None and max(abs(x).bit_length() for x in blinding._halves(n - 12345)) <= 129


def test_like_names_compared_once(spark):
    """Few names of many persons: the fold sees each two names once; pairs are those of a comparison of all rows."""
    from ringlight.functions import similarity
    from ringlight.sources import bank_view

    names = ["anna berg", "anna bergs", "ana berg", "otto", None, ""]
    rows = [(i, i % 3 if i % 10 else None, names[i % 6 if i % 4 else i % 2], i % 7) for i in range(120)]
    p = spark.createDataFrame(rows, "person_id long, block int, name string, onboard_day int")
    got = bank_view.similar_pairs(p, ["block"], "name", 85.0)
    pairs = [(a, b, max(da, db), na, nb) for a, ba, na, da in rows for b, bb, nb, db in rows if a < b and ba == bb is not None and None not in (na, nb)]
    asked = spark.createDataFrame(pairs, "a long, b long, first_day int, na string, nb string").withColumn("score", similarity.indel_ratio(F.col("na"), F.col("nb"))).where("score >= 85").select("a", "b", "first_day", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, asked.collect())) and asked.count() > 500
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "lambdafunction" not in plan.lower()  # the fold's results stand in a checkpoint: it doesn't run on pairs of rows
