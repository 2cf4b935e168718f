"""Why a row scores as it does, and what an analyst reads of an alerted community."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import bank_prefix

#: What an analyst reads in place of a column's name.
REASONS = {
    "g_known_fraud_1hop": "voisin direct d'une fraude confirmée",
    "g_share_device": "appareil partagé avec d'autres clients",
    "g_share_phone": "téléphone partagé",
    "g_nid_identity_mismatch": "n° d'identité porté par plusieurs identités",
    "app_email_age_at_onboard": "email récent à l'ouverture",
    "app_phone_age_at_onboard": "téléphone récent à l'ouverture",
    "app_file_age": "dossier de crédit jeune",
    "beh_lir_rate": "demandes de hausse de plafond fréquentes",
    "beh_pay_full_share": "remboursements systématiquement intégraux",
    "xb_mismatch_total": "attributs réutilisés sous une autre identité dans une autre banque",
    "xb_nid_mismatch": "n° d'identité utilisé sous une autre identité dans une autre banque",
    "xb_phone_mismatch": "téléphone utilisé sous une autre identité dans une autre banque",
    "xb_device_mismatch": "appareil utilisé sous une autre identité dans une autre banque",
    "xb_email_mismatch": "email utilisé sous une autre identité dans une autre banque",
    "xb_identity_other_banks": "identité présente dans d'autres banques",
    "app_income": "revenu déclaré atypique",
    "app_has_employer": "employeur déclaré",
    "app_phone_voip": "téléphone VoIP",
    "app_tenure_days": "ancienneté du compte",
    "app_file_age_at_onboard": "dossier de crédit jeune à l'ouverture",
    "g_au_host_max_dependents": "utilisateur autorisé sur un compte hôte très sollicité (tradeline)",
    "g_comm_known_share": "communauté contenant des fraudes confirmées",
    "g_known_fraud_2hop_paths": "fraudes confirmées à 2 sauts",
    "g_share_employer": "employeur partagé avec d'autres clients suspects",
    "g_max_strong_share": "attribut fort très partagé",
    "g_share_address": "adresse partagée",
    "g_share_email": "email partagé",
    "g_share_nid": "n° d'identité partagé",
    "g_similar_count": "quasi-doublon nom / date de naissance",
    "g_transfer_out_cp": "virements vers d'autres clients",
    "g_small_merchant_covisitors": "petits marchands fréquentés par les mêmes clients",
    "beh_limit_growth": "croissance rapide du plafond",
    "beh_limit_last": "plafond actuel",
    "beh_pay_mean6": "taux de remboursement",
    "beh_pay_std6": "régularité des remboursements",
    "beh_txn_mean6": "nombre de transactions",
}


def top_contributions(weights: dict[str, float], middle: dict[str, float], k: int = 5) -> Column:
    """JSON list of [feature, contribution], the k largest above 0 of weight x (value - middle), largest first."""
    parts = [F.struct((-(F.coalesce(F.col(c).cast("double"), F.lit(float(middle[c]))) - middle[c]) * w).alias("o"), F.lit(c).alias("feature")) for c, w in weights.items()]
    best = F.slice(F.filter(F.array_sort(F.array(*parts)), lambda x: x["o"] < 0), 1, k)
    return F.to_json(F.transform(best, lambda x: F.struct(x["feature"].alias("feature"), (-x["o"]).alias("contribution"))))


def parsed(explanation: Column) -> Column:
    """Array of (feature, contribution) from the JSON that the contributions are written as; null without one."""
    return F.from_json(explanation, "array<struct<feature:string,contribution:double>>")


def reasons(explanation: Column, k: int = 3, labels: dict[str, str] = REASONS) -> Column:
    """The first k reasons of an explanation in an analyst's words, comma-joined; a column without words stands by its name."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    first = F.slice(F.coalesce(parsed(explanation), F.array().cast("array<struct<feature:string,contribution:double>>")), 1, k)
    return F.array_join(F.transform(first, lambda x: F.coalesce(F.try_element_at(table, x["feature"]), x["feature"])), ", ")


def case_members(members: DataFrame, persons: DataFrame, day: int) -> DataFrame:
    """community, person_id, score, tenure (days since the account was opened) and reasons, one row for each member."""
    m = members if "explanation" in members.columns else members.withColumn("explanation", F.lit(None).cast("string"))
    m = m.select("community", "person_id", "score", reasons(F.col("explanation")).alias("reasons")).dropDuplicates(["community", "person_id"])
    return m.join(persons.select("person_id", (F.lit(day) - F.col("onboard_day")).alias("tenure")), "person_id", "left").select("community", "person_id", "score", "tenure", "reasons")


def case_summaries(members: DataFrame, attrs: DataFrame, transfers: DataFrame, hosts: DataFrame, bank: Column | None = None) -> DataFrame:
    """One row for each community: n_members, banks (sorted, comma-joined), top_score, n_shared (tokens of two members or
    more), n_transfers and amount (months and sums between members), n_hosts (hosts of members)."""
    m = members.select("community", "person_id", "score", (bank if bank is not None else bank_prefix(F.col("person_id"))).cast("string").alias("bank")).dropDuplicates(["community", "person_id"])
    one = m.select("community", F.col("person_id").alias("src"))
    out = m.groupBy("community").agg(F.count("*").alias("n_members"), F.array_join(F.array_sort(F.collect_set("bank")), ", ").alias("banks"), F.max("score").alias("top_score"))
    held = m.join(attrs.select("person_id", "attr_type", "token").distinct(), "person_id").groupBy("community", "attr_type", "token").agg(F.count("*").alias("n")).where("n >= 2")
    inner = transfers.join(one, "src").join(one.withColumnRenamed("src", "dst"), ["community", "dst"])
    guests = m.join(hosts.select("person_id", "host_person_id").distinct(), "person_id")
    for part in (held.groupBy("community").agg(F.count("*").alias("n_shared")), inner.groupBy("community").agg(F.count("*").alias("n_transfers"), F.sum("amount").alias("amount")), guests.groupBy("community").agg(F.count_distinct("host_person_id").alias("n_hosts"))):
        out = out.join(part, "community", "left")
    return out.na.fill(0, ["n_shared", "n_transfers", "n_hosts"]).na.fill(0.0, ["amount"])


def ranked(members: DataFrame, n: int = 10) -> DataFrame:
    """Members of the ``n`` best communities by community_score, ties by name, with ``case_number``."""
    best = members.groupBy("community").agg(F.max("community_score").alias("s")).orderBy(F.col("s").desc_nulls_last(), "community").limit(n)
    best = best.withColumn("case_number", F.row_number().over(Window.orderBy(F.col("s").desc_nulls_last(), "community"))).drop("s")  # n rows
    return members.join(F.broadcast(best), "community")


def case_files(members: DataFrame, attrs: DataFrame, transfers: DataFrame, hosts: DataFrame, shown: int = 15, persons: DataFrame | None = None, day: int | None = None, bank: Column | None = None) -> DataFrame:
    """``community`` and ``text``, one Markdown file each, of alerted members (community, person_id, score, and explanation
    if there is one).

    A file counts all members, shared tokens, inner transfers and hosts, and shows the first ``shown`` of each; a report's
    table of contents, so to say, whose whole is in ``case_members`` and ``case_summaries``. With ``persons`` and ``day``
    members come with their tenure, and with an explanation with their reasons; with ``bank`` or account numbers with
    the banks."""

    def listed(rows: DataFrame, order: list[Column], line: Column, name: str) -> DataFrame:
        # Ranked before they are collected: a file stays short whatever the size of the community.
        at = F.row_number().over(Window.partitionBy("community").orderBy(*order))
        some = F.array_sort(F.collect_list(F.when(F.col("__at") <= shown, F.struct("__at", "__line"))))
        return rows.select("community", at.alias("__at"), line.alias("__line")).groupBy("community").agg(F.count("*").alias(f"n_{name}"), F.array_join(F.transform(some, lambda x: F.concat(F.lit("* "), x["__line"])), "\n").alias(name))

    m = members.dropDuplicates(["community", "person_id"])
    one = m.select("community", F.col("person_id").alias("src"))
    held = m.join(attrs.select("person_id", "attr_type", "token").distinct(), "person_id").groupBy("community", "attr_type", "token").agg(F.count("*").alias("n")).where("n >= 2")
    inner = transfers.groupBy("src", "dst").agg(F.sum("amount").alias("amount")).join(one, "src").join(one.withColumnRenamed("src", "dst"), ["community", "dst"])
    guests = m.join(hosts.select("person_id", "host_person_id").distinct(), "person_id").groupBy("community", "host_person_id").agg(F.count("*").alias("n"))
    text = lambda *c: F.concat_ws(" ", *[x if isinstance(x, Column) else F.lit(x) for x in c])
    line = [F.col("person_id").cast("string"), F.format_number("score", 3)]
    if persons is not None:
        m = m.join(persons.select("person_id", F.concat(F.lit(day) - F.col("onboard_day"), F.lit(" days")).alias("__tenure")), "person_id", "left")
        line.append(F.col("__tenure"))
    if "explanation" in members.columns:
        why = reasons(F.col("explanation"))
        line.append(F.when(why != "", F.concat(F.lit("("), why, F.lit(")"))))
    out = listed(m, [F.col("score").desc_nulls_last(), F.col("person_id")], text(*line), "members")
    if bank is not None:
        out = out.join(m.groupBy("community").agg(F.array_join(F.array_sort(F.collect_set(bank.cast("string"))), ", ").alias("banks")), "community")
    for rows, order, line, name in (
        (held, [F.col("n").desc(), F.col("attr_type"), F.col("token")], text(F.col("attr_type"), F.substring("token", 1, 10), "held by", F.col("n").cast("string")), "shared"),
        (inner, [F.col("amount").desc(), F.col("src"), F.col("dst")], text(F.col("src").cast("string"), "to", F.col("dst").cast("string"), F.format_number("amount", 2)), "transfers"),
        (guests, [F.col("n").desc(), F.col("host_person_id")], text(F.col("host_person_id").cast("string"), "hosts", F.col("n").cast("string")), "hosts"),
    ):
        out = out.join(listed(rows, order, line, name), "community", "left")
    parts = [F.concat(F.lit("# Community "), F.col("community").cast("string"))]
    if bank is not None:
        parts.append(F.concat(F.lit("Banks: "), F.col("banks")))
    for name, title in (("members", "Members"), ("shared", "Shared attributes"), ("transfers", "Transfers within"), ("hosts", "Hosts")):
        parts.append(F.when(F.col(f"n_{name}") > 0, F.concat(F.lit(f"## {title} ("), F.col(f"n_{name}").cast("string"), F.lit(")\n"), F.col(name))))
    return out.select("community", F.concat_ws("\n\n", *parts).alias("text"))
