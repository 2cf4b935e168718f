"""Case files, contributions and the property graph on a few rows."""

import json

from ringlight.operators import casefiles
from ringlight.sources import property_graph
from pyspark.sql import functions as F


def test_contributions(spark):
    row = spark.createDataFrame([(3.0, 1.0, None)], "a double, b double, c double").select(casefiles.top_contributions({"a": 1.0, "b": 4.0, "c": 9.0}, {"a": 1.0, "b": 0.0, "c": 5.0}).alias("x")).first()
    assert [tuple(x.values()) for x in json.loads(row.x)] == [("b", 4.0), ("a", 2.0)]


def test_files_and_graph(spark, tmp_path):
    members = spark.createDataFrame([(7, 1, 0.9), (7, 2, 0.5), (8, 3, None)], "community long, person_id long, score double")
    attrs = spark.createDataFrame([(1, "phone", "t1", 0), (2, "phone", "t1", 3), (3, "phone", "t2", 1)], "person_id long, attr_type string, token string, first_day int")
    moved = spark.createDataFrame([(1, 2, 4, 1, 10.0), (1, 2, 6, 2, 5.5), (1, 3, 4, 1, 99.0)], "src long, dst long, month int, n long, amount double")
    hosts = spark.createDataFrame([(2, 1, 5)], "person_id long, host_person_id long, first_day int")
    files = {r.community: r.text for r in casefiles.case_files(members, attrs, moved, hosts).collect()}
    assert files[7] == "# Community 7\n\n## Members (2)\n* 1 0.900\n* 2 0.500\n\n## Shared attributes (1)\n* phone t1 held by 2\n\n## Transfers within (1)\n* 1 to 2 15.50\n\n## Hosts (1)\n* 1 hosts 1"
    assert files[8] == "# Community 8\n\n## Members (1)\n* 3"
    persons = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, None)], "person_id long, income double")
    visits = spark.createDataFrame([(1, "m", 2)], "person_id long, merchant_token string, first_day int")
    every, links = property_graph.property_graph(persons, attrs, visits, moved, hosts)
    property_graph.write_graph(every, links, str(tmp_path))
    every, links = spark.read.parquet(f"{tmp_path}/nodes"), spark.read.parquet(f"{tmp_path}/edges")
    assert property_graph.repeated_keys(every).count() == 0 and every.count() == 3 + 3 + 2 + 1 and links.count() == 3 + 3 + 1 + 2 + 1
    assert json.loads(links.where("type = 'TRANSFERRED_TO' and dst = '2'").first().properties) == {"n": 3, "amount": 15.5, "first_day": 120, "last_day": 180}
    assert every.where("label = 'Person' and id = '2'").first().properties == "{}"
    scored = property_graph.with_scores(persons, members, members.where("community = 7"))
    assert {r.person_id: (r.risk_score, r.community_alert) for r in scored.collect()} == {1: (0.9, True), 2: (0.5, True), 3: (None, False)}


def test_members_and_summaries(spark):
    members = spark.createDataFrame([(7, "A-1", 0.9, '[{"feature":"g_share_phone","contribution":1.0},{"feature":"zzz","contribution":0.5}]'), (7, "B-2", 0.5, None), (8, "A-3", None, "[]")], "community long, person_id string, score double, explanation string")
    persons = spark.createDataFrame([("A-1", 10), ("B-2", 20)], "person_id string, onboard_day int")
    got = {r.person_id: (r.tenure, r.reasons) for r in casefiles.case_members(members, persons, 100).collect()}
    assert got == {"A-1": (90, "téléphone partagé, zzz"), "B-2": (80, ""), "A-3": (None, "")}
    attrs = spark.createDataFrame([("A-1", "phone", "t1"), ("B-2", "phone", "t1")], "person_id string, attr_type string, token string")
    moved = spark.createDataFrame([("A-1", "B-2", 4, 10.0), ("A-1", "B-2", 5, 1.5), ("A-3", "B-2", 5, 9.0)], "src string, dst string, month int, amount double")
    hosts = spark.createDataFrame([("B-2", "A-1")], "person_id string, host_person_id string")
    rows = {r.community: tuple(r)[1:] for r in casefiles.case_summaries(members, attrs, moved, hosts).collect()}
    assert rows == {7: (2, "A, B", 0.9, 1, 2, 11.5, 1), 8: (1, "A", None, 0, 0, 0.0, 0)}
    scored = members.withColumn("community_score", F.col("community").cast("double"))
    assert {r.community: r.case_number for r in casefiles.ranked(scored, 1).collect()} == {8: 1}


def test_tables_by_day(spark, tmp_path):
    from ringlight.sources import config, tables

    edges = spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, w double")
    for day in (180, 300):
        tables.write_projection(edges, day, str(tmp_path))
    assert [tuple(r) for r in tables.read_projection(spark, str(tmp_path), [300]).select("T", "src", "w").collect()] == [(300, 1, 0.5)]
    tables.write_tables({"a": edges, "b": edges}, str(tmp_path / "t"))
    assert set(tables.read_tables(spark, str(tmp_path / "t"))) == {"a", "b"} and tables.read_tables(spark, str(tmp_path / "t"), ("a",), {"a": "src long"})["a"].columns == ["src"]
    path = tmp_path / "c.yaml"
    path.write_text("seed: 7\nevaluation: {test_snapshots: [900]}\n")
    c = config.load_config(path)
    assert c["seed"] == 7 and config.snapshot_days(c) == [180, 300, 420, 540, 900] and config.DEFAULTS["seed"] == 42
