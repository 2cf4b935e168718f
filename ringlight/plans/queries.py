"""Queries: each operator applied to the bound tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, normalize, numeric
from ..operators import alerts, blinding, blocks, casefiles, communities, crossbank, evaluation, features, graph, models, relations, report
from ..operators.components import component_sizes, line_component_sizes
from ..operators.snapshot import snapshot
from ..session import checkpointed, ship_package, written
from ..sources import bank_view, property_graph, tables, world
from .binding import DAY, FIRST_YEAR, SCHEMES, Tables

TOKEN_CAP, MERCHANT_CAP, HUB_CAP, TARGET, BUDGET = 30, 15, 20, 0.01, 0.02
#: Key sizes of the registered demonstrations; the operators' own default is 3072.
SCORE_BITS, COUNTER_BITS = 512, 512
SECRET, SEED = "ring-demo-key", 42
HOLDOUT, CUTOFF, TEST_SHARE, VAL_SHARE, MAX_TENURE = ["complicit_merchant"], 1500, 0.5, 0.25, 1200
TRAIN_DAYS, TEST_DAYS = [1100, 1281], [DAY]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CONFOUNDERS = {"long": "n_chars >= 3000", "short": "n_chars < 500", "english": "lang = 'en'", "poor": "quality = 0", "first_source": "source = 'src0'"}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: (ship_package(spark), f(Tables(spark, sf_dir)))[1]
    return f


def six(c, name):
    return F.round(c, 6).alias(name)


def _known(t: Tables) -> DataFrame:
    return t.confirmations().where(F.col("confirmed_day") <= DAY).select("person_id")


def _attrs(t: Tables, *kinds: str) -> DataFrame:
    return t.person_attr(*kinds).where(F.col("first_day") <= DAY)


def _months(t: Tables) -> DataFrame:
    return t.monthly().where((F.col("month") + 1) * 30 <= DAY)


def _lot_edges(t: Tables) -> DataFrame:
    return graph.co_occurrence(_attrs(t, "lot"), "token", TOKEN_CAP)


@query
def projection_adamic_adar(t):
    months = t.transfers().where((F.col("month") + 1) * 30 <= DAY)
    e = graph.projection([(_attrs(t, "half"), "token", TOKEN_CAP), (t.paid_at().where(F.col("first_day") <= DAY), "merchant_token", MERCHANT_CAP)], [(months, "src", "dst"), (t.authorized_users().where(F.col("first_day") <= DAY), "person_id", "host_person_id")])
    return e.select("src", "dst", six(F.col("w"), "w"))


@query
def projection_degrees(t):
    d = graph.degrees(_lot_edges(t))
    return d.select("src", "degree", six(F.col("weighted_degree"), "weighted_degree"))


@query
def snapshot_persons(t):
    s = snapshot({"persons": t.persons(), "fraud_confirmations": t.confirmations()}, DAY)["persons"]
    return s.select("person_id", "bank", "onboard_day", "known_fraud", "closed", "scored")


@query
def tokens_hmac(t):
    p = t.persons()
    token = F.lit(None).cast("string")
    for bank in range(5):
        token = F.when(F.col("bank") == bank, hashing.hmac_token(F.concat(F.lit("name:"), normalize.norm_plain(F.col("name"))), hashing.bank_key(SECRET, SEED, str(bank)))).otherwise(token)
    return p.select("person_id", "bank", token.alias("token"))


@query
def hash_uniform_folds(t):
    p = t.persons()
    return p.select("person_id", F.round(hashing.uniform(SEED, F.col("nation")), 9).alias("u"))


def _folded(t: Tables) -> DataFrame:
    return evaluation.assign_folds(t.labels(), SEED, HOLDOUT, CUTOFF, TEST_SHARE, VAL_SHARE)


@query
def group_folds(t):
    return _folded(t).select("person_id", "group", "fold")


@query
def row_builder(t):
    """Rows of three snapshots with their split and target."""
    days = [*TRAIN_DAYS, *TEST_DAYS]
    stacked = None
    for day in days:
        s = t.snapshot(day, only=())["persons"]
        one = s.select("person_id", F.lit(day).alias("T"), "scored", (F.lit(day) - F.col("onboard_day")).alias("app_tenure_days"))
        stacked = one if stacked is None else stacked.unionByName(one)
    rows = evaluation.build_rows(stacked, _folded(t), TRAIN_DAYS, TEST_DAYS, CUTOFF, MAX_TENURE)
    return rows.select("person_id", "T", "fold", "eligible", "split", F.col("y").cast("int").alias("y"))


@query
def normalize_all(t):
    name = F.col("c_name")
    c = t.read("customer")
    phone = F.concat(F.lit("0"), F.col("c_custkey").cast("string"), F.lit(" 12-34"))
    return c.select("c_custkey", normalize.norm_name(F.concat(name, F.lit(" l'Église-Ñu Čapek Šimon"))).alias("name"), normalize.norm_address(F.concat(name, F.lit(", Rue de l'Église, Őry"))).alias("address"), normalize.digits(name).alias("nid"), normalize.norm_phone(phone).alias("phone"), normalize.norm_plain(F.concat(F.lit("  "), name, F.lit("@Mail.com "))).alias("email"), normalize.email_domain(F.concat(name, F.lit("@Mail.com"))).alias("domain"))


@query
def numeric_functions(t):
    """Signed logarithm, clip, age, domains and bank prefixes."""
    c, x = t.read("customer"), F.col("c_acctbal")
    mail = F.concat(F.lower("c_name"), F.when(F.col("c_custkey") % 2 == 0, "@gmail.com").otherwise("@mail.test"))
    return c.select("c_custkey", six(numeric.signed_log(x), "signed_log"), six(numeric.clipped(x / 1000, -1.0, 6.0), "clipped"), six(numeric.age_at(DAY, (F.col("c_custkey") % 60 + 1940).cast("int"), FIRST_YEAR), "age"), F.bround(x, -2).alias("rounded"), normalize.popular_domain(mail).alias("popular"), normalize.bank_prefix(F.concat_ws("-", "c_mktsegment", "c_custkey")).alias("bank"), hashing.naive_token(F.col("c_name")).alias("naive"))


@query
def entity_resolution(t):
    p = t.read("part").select(F.col("p_partkey").alias("person_id"), normalize.norm_plain(F.col("p_name")).alias("name"), "p_brand", "p_type", F.col("p_size").alias("onboard_day"))
    return bank_view.similar_pairs(p, ["p_brand", "p_type"], "name", 85.0).select("a", "b", "first_day", six(F.col("score"), "score"))


@query
def app_features(t):
    return features.application(t.persons().where(F.col("onboard_day") <= DAY), DAY, FIRST_YEAR).withColumn("app_age", F.round("app_age", 6))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("person_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in df.columns if c != "person_id"])


@query
def beh_features_life(t):
    return _rounded(features.behaviour_life(_months(t)))


@query
def beh_features_six(t):
    return _rounded(features.behaviour_recent(_months(t), DAY))


def _graph_counts(t: Tables) -> DataFrame:
    """Of the day's snapshot over all seven attribute types, by lists in blocks: the projection itself is never stored."""

    def build():
        s = t.graph_snapshot()
        return features.listed_graph_counts(s, *features.graph_lists(s, TOKEN_CAP, MERCHANT_CAP))

    return t.kept(f"graph:{DAY}", build)


@query
def graph_features(t):
    return _rounded(_graph_counts(t))


def _feature_table(t: Tables) -> DataFrame:
    return t.kept(f"features:{DAY}", lambda: features.feature_table(t.graph_snapshot(months=True), DAY, TOKEN_CAP, MERCHANT_CAP, FIRST_YEAR))


@query
def feature_table(t):
    """All columns, those of components, communities and PageRank too."""
    return _feature_table(t)


def _records(t: Tables) -> DataFrame:
    return t.persons().select("person_id", "bank", F.col("id_token").alias("idkey"), "onboard_day")


def _counts(t: Tables) -> DataFrame:
    return crossbank.live_counts(crossbank.bank_keys(t.pii()), _records(t), DAY)


@query
def live_key_counts(t):
    return _counts(t)


@query
def xb_features(t):
    """Columns of other banks, by one round of encrypted counters."""
    counts = _counts(t).withColumnRenamed("key", "token")
    totals = crossbank.encrypted_totals(crossbank.round_requests(counts), COUNTER_BITS)
    return crossbank.xb_features(crossbank.bank_keys(t.pii()), _records(t), totals.withColumnsRenamed({"asker": "bank", "token": "key"}), DAY)


@query
def round_statistics(t):
    counts = written(_counts(t).withColumnRenamed("key", "token"))
    requests = crossbank.round_requests(counts)
    return crossbank.round_statistics(requests, crossbank.encrypted_totals(requests, COUNTER_BITS), counts, COUNTER_BITS)


@query
def round_requests(t):
    """Real and decoy slots of each two banks."""
    r = crossbank.round_requests(_counts(t).withColumnRenamed("key", "token"))
    return r.groupBy("asker", "bank", "real").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"))


@query
def share_counts_pivot(t):
    f = graph.shared_counts(_attrs(t, "half", "year", "lot"), ["half", "year", "lot"])
    return f.select("person_id", *[F.col(k).cast("long").alias(f"shared_{k}") for k in ("half", "year", "lot")])


@query
def known_links(t):
    return graph.known_links(_attrs(t, "half"), _known(t))


@query
def fraud_hops(t):
    return graph.hop_counts(_lot_edges(t), _known(t))


@query
def wcc_sizes(t):
    return component_sizes(_lot_edges(t))


@query
def identity_wcc(t):
    """Components of more than 5 nodes of persons and their strong attributes (undirected, six labels), whatever the day."""
    return line_component_sizes(t.lines("l_partkey"), {k: SCHEMES[k] for k in features.STRONG_TYPES}, "l_partkey", 6)


@query
def pagerank(t):
    """The 50 rounds of the reference."""
    p = t.persons().where(F.col("onboard_day") <= DAY)
    r = graph.pagerank(checkpointed(_lot_edges(t)), p)
    return r.select("person_id", six(F.col("pagerank"), "pagerank"))


@query
def transfer_counterparties(t):
    m = t.transfers().where((F.col("month") + 1) * 30 <= DAY)
    out, back = m.groupBy(F.col("src").alias("person_id")).agg(F.count_distinct("dst").alias("n_out")), m.groupBy(F.col("dst").alias("person_id")).agg(F.count_distinct("src").alias("n_in"))
    return out.join(back, "person_id", "full").select("person_id", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


@query
def transfer_rollup(t):
    return t.transfers().groupBy("src", "dst").agg(F.sum("n").alias("n"), F.round(F.sum("amount"), 2).alias("amount"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


@query
def au_dependents(t):
    return t.authorized_users().groupBy("host_person_id").agg(F.count_distinct("person_id").alias("dependents")).where("dependents >= 3")


@query
def covisitors(t):
    return graph.covisitors(t.paid_at().where(F.col("first_day") <= DAY), "merchant_token", MERCHANT_CAP)


@query
def cy_pairs(t):
    return graph.strong_pairs(_attrs(t, "half", "lot"), HUB_CAP)


@query
def cy_contagion(t):
    held, known = _attrs(t, "half", "lot"), _known(t)
    small = held.groupBy("attr_type", "token").agg(F.count("*").alias("deg")).where(F.col("deg").between(2, HUB_CAP)).drop("deg")
    held = held.join(small, ["attr_type", "token"])
    bad = held.join(known, "person_id", "left_semi").select("attr_type", "token", F.col("person_id").alias("via"))
    return held.join(known, "person_id", "left_anti").join(bad, ["attr_type", "token"]).groupBy("person_id").agg(F.count_distinct("via").alias("n_confirmed"), F.array_join(F.array_sort(F.collect_set("attr_type")), ",").alias("via_types"))


@query
def nid_mismatch(t):
    return _attrs(t, "lot").join(t.persons().select("person_id", "bank"), "person_id").groupBy("token").agg(F.count_distinct("person_id").alias("n_persons"), F.count_distinct("bank").alias("n_banks")).where("n_persons >= 2")


def _own_columns(t: Tables) -> DataFrame:
    """The columns of one row a person from the person's own tables, ``app_*`` and ``beh_*``."""

    def build():
        s = t.snapshot(only=("monthly",))
        return features.application(s["persons"], DAY, FIRST_YEAR).join(features.behaviour(s["monthly"], DAY), "person_id", "left")

    return t.kept(f"own:{DAY}", build)


def _features(t: Tables) -> DataFrame:
    """The columns of one row a person that SQL can make too: all but components, communities and PageRank."""
    return t.kept(f"columns:{DAY}", lambda: _own_columns(t).join(_graph_counts(t), "person_id", "left"))


@query
def rules_score(t):
    """Of the graph, the rules read shares and mismatches of three kinds alone: no projection is made for them."""
    rows = _own_columns(t).join(t.kept(f"rules:{DAY}", lambda: features.rule_counts(t.snapshot(kinds=("nid", "phone", "device"), only=("person_attr",)))), "person_id", "left")
    return features.rules_score(rows).select("person_id", six(F.col("rules"), "score"))


AUDIT = ["app_tenure_days", "app_income", "beh_months", "beh_late_count", "g_share_phone", "g_proj_degree"]


def _audited(t: Tables) -> DataFrame:
    """The columns of ``AUDIT``, and what it is held against: of the graph, shared phones and degrees alone."""

    def build():
        own = _own_columns(t).select("person_id", "app_has_employer", *[c for c in AUDIT if not c.startswith("g_")])
        graph_ = features.list_counts(*features.graph_lists(t.graph_snapshot(), TOKEN_CAP, MERCHANT_CAP), hops=False)
        zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in AUDIT if c.startswith("g_")]
        return own.join(graph_, "person_id", "left").select(*own.columns, *zero)

    return t.kept(f"audited:{DAY}", build)


@query
def shortcut_audit(t):
    f = _audited(t).withColumn("y", F.col("app_has_employer"))
    return features.univariate_audit(f, "y", AUDIT).select("feature", six(F.col("auc"), "auc"), "suspect")


def _weighted(t: Tables) -> DataFrame:
    return evaluation.select_budget(evaluation.prevalence_weights(t.scored_rows(), "y", TARGET, "lang"), "score", "doc_id", BUDGET, "lang")


@query
def topk_budget(t):
    return _weighted(t).select("doc_id", "lang", six(F.col("w"), "w"), "selected")


@query
def budget_metrics(t):
    return evaluation.budget_metrics(_weighted(t), "y", "lang").select("lang", "alerts", six(F.col("precision"), "precision"), six(F.col("recall"), "recall"))


@query
def rank_ensemble(t):
    return evaluation.rank_ensemble(t.scored_rows(), ["score", "score2"], "lang").select("doc_id", six(F.col("ensemble"), "ensemble"))


@query
def average_precision(t):
    return evaluation.average_precision(_weighted(t), "y", "score", "lang").select("lang", six(F.col("ap"), "ap"))


@query
def roc_auc(t):
    return evaluation.roc_auc(t.scored_rows(), "y", "score", "lang").select("lang", six(F.col("auc"), "auc"))


@query
def recall_at_fpr(t):
    return evaluation.recall_at_fpr(t.scored_rows(), "y", "score", "lang", 0.01).select("lang", six(F.col("recall"), "recall"))


@query
def confounder_rates(t):
    return evaluation.predicate_rates(_weighted(t), "selected", CONFOUNDERS).select("name", "n", six(F.col("rate"), "rate"), six(F.col("ratio"), "ratio"))


def _flagged(t: Tables) -> DataFrame:
    """Rows of two test days with the truth's columns and a made-up flag."""
    days = F.explode(F.array(F.lit(DAY), F.lit(DAY + 90))).alias("T")
    return t.labels().select("*", days).where("bust_out_day > T").withColumn("flag", (F.col("person_id") * 7 + F.col("T")) % 10 < 4)


@query
def ring_metrics(t):
    m = evaluation.ring_metrics(_flagged(t), "flag")
    return m.select("rings", *[six(F.col(c), c) for c in m.columns if c != "rings"])


@query
def ring_recall_by_level(t):
    rows = _flagged(t)
    both = evaluation.ring_recall_by(rows, "flag", "sophistication").select(F.col("sophistication").cast("string").alias("level"), "rings", "recall").unionByName(evaluation.ring_recall_by(rows, "flag", "scenario").select(F.col("scenario").alias("level"), "rings", "recall"))
    return both.select("level", "rings", six(F.col("recall"), "recall"))


@query
def look_alike_rates(t):
    return evaluation.confounder_rates(_flagged(t).where(F.col("T") == DAY), t.labels(), "flag").select("name", "n", six(F.col("rate"), "rate"), six(F.col("ratio"), "ratio"))


@query
def look_alike_mean(t):
    return evaluation.confounder_mean(evaluation.confounder_rates(_flagged(t).where(F.col("T") == DAY), t.labels(), "flag")).select(six(F.col("mean"), "mean"))


@query
def recall_by_level(t):
    return evaluation.recall_by(_weighted(t), "y", "selected", "quality").select("quality", "positives", six(F.col("recall"), "recall"))


@query
def best_model(t):
    r = report.model_report(t.scored_rows(), "y", ["score", "score2"], "doc_id", "lang", TARGET, BUDGET)
    return evaluation.best_model(r, value="ap").select("model", six(F.col("ap"), "ap"))


@query
def nmi(t):
    return graph.mutual_information(t.read("documents"), "lang", "source").select(six(F.col("nmi"), "nmi"))


def _grouped(t: Tables) -> DataFrame:
    return _weighted(t).withColumn("community", F.concat_ws(":", "source", "lang", (F.col("doc_id") % 7).cast("string")))


def _communities(t: Tables) -> DataFrame:
    return alerts.community_alerts(_grouped(t), "community", "score", "doc_id", 0.2)


@query
def community_alerts(t):
    return _communities(t).select("community", "size", six(F.col("weight"), "weight"), six(F.col("top3"), "top3"))


def _holdings(t: Tables) -> DataFrame:
    return _attrs(t, "half").join(t.persons().select("person_id", "bank"), "person_id").select("bank", "token", "person_id")


@query
def cross_bank_reuse(t):
    return crossbank.reuse(_holdings(t))


@query
def encrypted_reuse(t):
    return crossbank.encrypted_reuse(_holdings(t), COUNTER_BITS)


MODEL_COLUMNS = ["app_tenure_days", "app_income", "beh_months", "beh_late_count", "beh_limit_growth", "beh_util_mean6", "beh_pay_mean6", "beh_txn_mean6", "beh_cash_share6"]


def _training(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Rows to train on (three of four folds by hash) and all rows; the target is confirmation by T. ``MODEL_COLUMNS`` has none of
    the graph, so none is made."""
    rows = _own_columns(t).join(_known(t).distinct().withColumn("y", F.lit(1)), "person_id", "left").withColumn("y", F.coalesce("y", F.lit(0)))
    rows = checkpointed(rows)
    return rows.where(hashing.uniform(SEED, F.col("person_id")) < 0.75), rows


@query
def logistic_scores(t):
    train, rows = _training(t)
    return models.logistic_head(train, rows, MODEL_COLUMNS, "y").select("person_id", "y", "score")


@query
def gbt_scores(t):
    train, rows = _training(t)
    return models.boosted_trees(train, rows, MODEL_COLUMNS, "y").select("person_id", "y", "score")


@query
def neighbour_scores(t):
    train, rows = _training(t)
    wide = checkpointed(models.neighbour_means(rows, _lot_edges(t), MODEL_COLUMNS))
    columns = MODEL_COLUMNS + [f"nb_{c}" for c in MODEL_COLUMNS]
    return models.logistic_head(wide.join(train.select("person_id"), "person_id", "left_semi"), wide, columns, "y").select("person_id", "y", "score")


@query
def gbt_contributions(t):
    train, rows = _training(t)
    return models.explained_trees(train, rows, MODEL_COLUMNS, "y").select("person_id", "score", "explanation")


@query
def propagated_scores(t):
    train, rows = _training(t)
    edges = checkpointed(_lot_edges(t))
    wide = checkpointed(models.propagated(models.filled(rows, MODEL_COLUMNS, models.medians(train, MODEL_COLUMNS)), edges, MODEL_COLUMNS))
    return models.logistic_head(wide.join(train.select("person_id"), "person_id", "left_semi"), wide, MODEL_COLUMNS, "y").select("person_id", "y", "score")


@query
def dataset_counts(t):
    named = {"persons": t.persons(), "person_attr": _attrs(t, "half", "lot"), "transfers": t.transfers(), "fraud_confirmations": t.confirmations()}
    return tables.dataset_statistics(named, {"persons": ["bank", "segment"], "person_attr": ["attr_type"]})


@query
def simulated_world(t):
    """Accounts, account months and transfers of the default world, by kind and sophistication."""
    w = world.World()
    tables_ = world.world(t.spark, w)
    held = checkpointed(tables_["records"].join(tables_["identities"].select("identity_id", "kind", "sophistication"), "identity_id"))
    size = lambda df, key, name: df.groupBy(F.col(key).alias("person_id")).agg(F.count("*").alias(name))
    out = held.join(size(tables_["monthly"], "person_id", "m"), "person_id", "left").join(size(tables_["transfers"], "src", "t"), "person_id", "left")
    return out.groupBy("kind", "sophistication").agg(F.count("*").alias("accounts"), F.coalesce(F.sum("m"), F.lit(0)).alias("months"), F.coalesce(F.sum("t"), F.lit(0)).alias("transfers"))


@query
def model_report(t):
    r = report.model_report(t.scored_rows(), "y", ["score", "score2"], "doc_id", "lang", TARGET, BUDGET)
    return r.select("model", *[six(F.col(c), c) for c in ("ap", "auc")])


@query
def alert_comparison(t):
    rows = _grouped(t)
    taken = _communities(t).select("community", F.lit(True).alias("in_community"))
    r = report.alert_comparison(rows.join(taken, "community", "left"), "y", "source", {"person": "selected", "community": "in_community"})
    return r.select("level", "alerted_rows", *[six(F.col(c), c) for c in ("alerted_weight", "precision", "recall", "ring_recall")])


SCORE_WEIGHTS, SCORE_INTERCEPT = {"app_tenure_days": -0.001, "app_income": 0.0002, "app_phone_voip": 0.75}, -0.5


@query
def encrypted_score(t):
    f = features.application(t.persons().where(F.col("onboard_day") <= DAY), DAY, FIRST_YEAR)
    return blinding.encrypted_score(f, "person_id", SCORE_WEIGHTS, SCORE_INTERCEPT, SCORE_BITS).select("person_id", six(F.col("logit"), "logit"))


@query
def blinded_tokens(t):
    return blinding.blinded_tokens(t.persons(), "name", int.from_bytes(hashing.bank_key(SECRET, SEED, "service")) % blinding.ORDER)


@query
def leakage_checks(t):
    """What hub and service get of a round, and dictionary attacks on it."""
    key = int.from_bytes(hashing.bank_key(SECRET, SEED, "service")) % blinding.ORDER
    return blinding.leakage_report(t.read("nation"), "n_name", key, key // 3 + 1)


@query
def score_contributions(t):
    """The contributions that push a score, largest first, from the JSON that they are written as."""
    f = features.application(t.persons().where(F.col("onboard_day") <= DAY), DAY, FIRST_YEAR)
    written = f.select("person_id", casefiles.top_contributions(SCORE_WEIGHTS, models.medians(f, list(SCORE_WEIGHTS))).alias("explanation"))
    return written.select("person_id", F.posexplode(casefiles.parsed(F.col("explanation"))).alias("place", "x")).select("person_id", "place", "x.feature", six(F.col("x.contribution"), "contribution"))


def _labels(t: Tables) -> DataFrame:
    return communities.communities(_lot_edges(t))


@query
def graph_communities(t):
    return communities.community_known(_labels(t), _known(t))


@query
def community_modularity(t):
    edges = checkpointed(_lot_edges(t))
    return communities.modularity(edges, communities.communities(edges)).select(six(F.col("modularity"), "modularity"))


def _graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    return property_graph.property_graph(t.persons(), _attrs(t, "half", "lot"), t.paid_at().where(F.col("first_day") <= DAY), t.transfers(), t.authorized_users())


@query
def property_graph_nodes(t):
    return _graph(t)[0].select("label", "id")


@query
def property_graph_edges(t):
    return _graph(t)[1].select("type", "src", "dst")


@query
def case_files(t):
    """Files of communities of 5 to 40 members, by score and by members' count of confirmed neighbours."""
    labels = checkpointed(_labels(t))
    some = labels.groupBy("community").agg(F.count("*").alias("n")).where("n between 5 and 40").select("community")
    score = graph.known_links(_attrs(t, "half"), _known(t)).select("person_id", F.col("known_links").cast("double").alias("score"))
    members = labels.join(some, "community").select("community", F.col("node").alias("person_id")).join(score, "person_id", "left")
    persons = t.persons()
    members = members.join(persons.select("person_id", "bank"), "person_id")
    return casefiles.case_files(members, _attrs(t, "half", "lot"), t.transfers(), t.authorized_users(), persons=persons, day=DAY, bank=F.col("bank"))


def _case_members(t: Tables) -> DataFrame:
    """Persons of one nation and segment as a community."""
    score = graph.known_links(_attrs(t, "half"), _known(t)).select("person_id", F.col("known_links").cast("double").alias("score"))
    return t.persons().select("person_id", "bank", F.concat_ws(":", "nation", "segment").alias("community")).join(score, "person_id", "left")


@query
def case_summaries(t):
    c = casefiles.case_summaries(_case_members(t), _attrs(t, "half", "lot"), t.transfers(), t.authorized_users(), F.col("bank"))
    return c.withColumn("amount", F.round("amount", 2))


@query
def case_members(t):
    f = features.application(t.persons(), DAY, FIRST_YEAR)
    why = f.select("person_id", casefiles.top_contributions(SCORE_WEIGHTS, models.medians(f, list(SCORE_WEIGHTS))).alias("explanation"))
    return casefiles.case_members(_case_members(t).join(why, "person_id"), t.persons(), DAY)


@query
def community_subgraph(t):
    """Edges of the property graph from the members of one community."""
    members = _case_members(t).where("community = '7:BUILDING'")
    return alerts.community_subgraph(members, _graph(t)[1])


@query
def trained_models(t):
    """Scores of the test rows by the rules and by trees on each feature set, stopped by validation."""
    f = _feature_table(t).join(t.kept("xb", lambda: QUERIES["xb_features"](t.spark, t.dir)), "person_id", "left")
    rows = evaluation.build_rows(f, _folded(t), [DAY], [], CUTOFF, 10**6)
    part = F.pmod(F.xxhash64("person_id"), F.lit(4))
    rows = checkpointed(rows.withColumn("split", F.when(part == 0, "val").when(part == 1, "test").otherwise("train")).withColumn("y", F.col("is_synthetic")))
    out, _ = models.model_scores(rows, trees=20)
    return out.select("person_id", "T", "y", *[c for c in out.columns if c.startswith("trees_") or c == "rules"])


@query
def relational_scores(t):
    """A network on the neighbourhoods of eight relations, two steps wide; edges are stored nowhere."""
    train, rows = _training(t)
    rows = rows.select("person_id", "y", *MODEL_COLUMNS)
    nodes, n = blocks.numbered(rows.select("person_id"))
    near = relations.Neighbourhoods(t.relation_lists(nodes, ("nid", "phone", "email", "device"), MERCHANT_CAP, TOKEN_CAP), nodes, n, 8)
    return models.relational_scores(train.select("person_id"), rows, near, MODEL_COLUMNS, "y", hidden=16).select("person_id", "y", "score")


@query
def scaled_features(t):
    f = _audited(t)
    x = models.scaled(f, models.fit_scaler(f, AUDIT))
    return x.select("person_id", "missing", *[six(F.col(c), c) for c in AUDIT])
