"""The same queries as DuckDB SQL. Rules, tables and formulas are written out here again: of the engine only the parameters
of the registered queries are taken over, so that a fault of an operator isn't repeated."""

from __future__ import annotations

import hashlib

from .queries import BUDGET, CUTOFF, DAY, HUB_CAP, MAX_TENURE, MERCHANT_CAP, SECRET, SEED, TARGET, TEST_DAYS, TEST_SHARE, TOKEN_CAP, TRAIN_DAYS, VAL_SHARE

CONFOUNDERS = {"long": "n_chars >= 3000", "short": "n_chars < 500", "english": "lang = 'en'", "poor": "quality = 0", "first_source": "source = 'src0'"}
LOOK_ALIKES = {
    "foyer_3plus": "household_size >= 3", "colocation": "k % 7 = 0", "residence_etudiante": "k % 13 = 0", "personne_agee_aidee": "k % 17 = 0", "defaut_credit_legitime": "k % 19 = 0", "primo_arrivant": "k % 23 = 0",
    "vendeur_tradeline": "k % 29 = 0", "mule": "k % 31 = 0",
}
KINDS = ("nid", "phone", "email", "address", "device", "ip", "employer")

D = "CAST(date_diff('day', DATE '1995-01-01', CAST({} AS DATE)) AS INTEGER)"
#: Tables of the binding; each query takes those that it needs.
CTES = {
    "items": f"SELECT o_orderkey, o_custkey AS person_id, {D.format('o_orderdate')} AS day, year(o_orderdate) AS yr, CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS half, quarter(o_orderdate) AS quarter, CAST(floor({D.format('o_orderdate')} / 7) AS BIGINT) AS week, o_totalprice, lineitem.* FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "persons": f"SELECT c_custkey AS person_id, n_regionkey AS bank, c_nationkey AS nation, c_mktsegment AS segment, c_name AS name, c_acctbal AS income, onboard_day FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN (SELECT o_custkey, min({D.format('o_orderdate')}) AS onboard_day FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "attr": f"SELECT person_id, attr_type, token FROM (SELECT person_id, day, 'half' AS attr_type, concat_ws(':', l_partkey, yr, half) AS token FROM items UNION ALL SELECT person_id, day, 'year', concat_ws(':', l_partkey, yr) FROM items UNION ALL SELECT person_id, day, 'lot', concat_ws(':', l_partkey, l_suppkey) FROM items) GROUP BY ALL HAVING min(day) <= {DAY}",
    "pattr": "SELECT person_id, attr_type, token, min(day) AS first_day FROM (SELECT person_id, day, unnest([{'attr_type': 'nid', 'token': concat_ws(':', 'nid', l_partkey, l_suppkey)}, {'attr_type': 'phone', 'token': concat_ws(':', 'phone', l_partkey, yr, half)}, {'attr_type': 'email', 'token': concat_ws(':', 'email', l_partkey, l_suppkey, yr)}, {'attr_type': 'address', 'token': concat_ws(':', 'address', l_partkey, yr)}, {'attr_type': 'device', 'token': concat_ws(':', 'device', l_partkey, yr, quarter)}, {'attr_type': 'ip', 'token': concat_ws(':', 'ip', l_suppkey, week)}, {'attr_type': 'employer', 'token': concat_ws(':', 'employer', l_suppkey, yr, half)}], recursive := true) FROM items) GROUP BY ALL",
    "wattr": f"SELECT a.person_id, attr_type, token, CAST(b.person_id IS NOT NULL AS INTEGER) AS kn FROM pattr a LEFT JOIN known b USING (person_id) WHERE first_day <= {DAY}",
    "tok": "SELECT attr_type, token, count(*) - 1 AS others, sum(kn) AS total FROM wattr GROUP BY 1, 2",
    "live": f"SELECT *, person_id AS k, concat_ws(':', nation, segment, person_id % 3) AS id_token FROM persons WHERE onboard_day <= {DAY}",
    "full_edges": f"SELECT src, dst, sum(w) AS w FROM (SELECT a.person_id AS src, b.person_id AS dst, sum(1 / ln(others + 1)) AS w FROM wattr a JOIN wattr b USING (attr_type, token) JOIN tok USING (attr_type, token) WHERE others BETWEEN 1 AND {TOKEN_CAP - 1} AND a.person_id <> b.person_id GROUP BY 1, 2 UNION ALL SELECT a.person_id, b.person_id, sum(1 / ln(deg)) FROM visits a JOIN visits b USING (token) JOIN (SELECT token, count(*) AS deg FROM visits GROUP BY 1 HAVING count(*) BETWEEN 2 AND {MERCHANT_CAP}) USING (token) WHERE a.person_id <> b.person_id GROUP BY 1, 2 UNION ALL SELECT unnest([{{'src': src, 'dst': dst}}, {{'src': dst, 'dst': src}}], recursive := true), 1e0 FROM (SELECT src, dst FROM moved UNION ALL SELECT person_id, host_person_id FROM au WHERE first_day <= {DAY} AND host_person_id IN (SELECT person_id FROM live) UNION ALL SELECT a, b FROM alike)) GROUP BY 1, 2",
    "alike": f"SELECT a.person_id AS a, b.person_id AS b FROM persons a JOIN persons b ON a.nation = b.nation AND a.segment = b.segment AND a.person_id % 60 = b.person_id % 60 AND a.person_id < b.person_id WHERE greatest(a.onboard_day, b.onboard_day) <= {DAY}",
    "truth": "SELECT person_id, person_id AS k, income, bad, CASE WHEN bad THEN ring ELSE -1 END AS ring_id, CASE WHEN bad THEN -1 ELSE person_id // 3 END AS household_id, CASE WHEN bad THEN ring % 3 + 1 ELSE 0 END AS sophistication, CASE WHEN NOT bad THEN '' WHEN ring % 3 = 0 THEN 'overt' WHEN ring % 3 = 1 THEN 'partial' ELSE 'complicit_merchant' END AS scenario, CASE WHEN bad THEN 1300 + 200 * (ring % 5) ELSE 1000000 END AS bust_out_day, bad AND person_id % 5 <> 0 AS observed, CASE WHEN bad THEN 'r' || ring ELSE 'h' || person_id // 3 END AS grp FROM (SELECT person_id, income, person_id % 11 = 0 AS bad, person_id % 77 // 11 AS ring FROM persons)",
    "hashed": f"SELECT *, CAST(CAST('0x' || substr(sha256('{SEED}|' || grp), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616e0 AS u FROM truth",
    "folded": f"SELECT *, CASE WHEN bad AND (scenario = 'complicit_merchant' OR min(bust_out_day) OVER (PARTITION BY grp) > {CUTOFF}) THEN 'test' WHEN bad THEN CASE WHEN u < {VAL_SHARE} THEN 'val' ELSE 'train' END WHEN u < {TEST_SHARE} THEN 'test' WHEN (u - {TEST_SHARE}) / (1 - {TEST_SHARE}) < {VAL_SHARE} THEN 'val' ELSE 'train' END AS fold FROM hashed",
    "flagged": f"SELECT truth.*, T, (k * 7 + T) % 10 < 4 AS flag FROM truth, (SELECT unnest([{DAY}, {DAY + 90}]) AS T) WHERE bust_out_day > T",
    "ring_person": "SELECT person_id, min(ring_id) AS ring_id, min(bust_out_day) AS bust, min(abs(income)) AS exposure, min(sophistication) AS sophistication, min(scenario) AS scenario, min(T) FILTER (flag) AS first FROM flagged WHERE bad GROUP BY 1",
    "look": "SELECT person_id, k, household_size, flag FROM flagged JOIN (SELECT household_id, count(DISTINCT person_id) AS household_size FROM truth WHERE NOT bad GROUP BY 1) USING (household_id) WHERE NOT bad AND T = " + str(DAY),
    "look_rates": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, avg(CAST(flag AS INTEGER)) AS rate FROM look WHERE {p}" for n, p in LOOK_ALIKES.items()),
    "pii": f"SELECT person_id, bank, attr_type, attr_type || '|' || token AS ak, attr_type || '|' || token || '|' || id_token AS pk FROM pattr JOIN live USING (person_id) WHERE attr_type IN ('nid', 'phone', 'email', 'device') AND first_day <= {DAY}",
    "keyed": "SELECT bank, key, count(DISTINCT person_id) AS n FROM (SELECT bank, ak AS key, person_id FROM pii UNION ALL SELECT bank, pk, person_id FROM pii) GROUP BY 1, 2 UNION ALL SELECT bank, 'id|' || id_token, count(*) FROM live GROUP BY 1, 2",
    "elsewhere": "SELECT bank, key, sum(n) OVER (PARTITION BY key) - n AS other FROM keyed",
    "xb": "SELECT person_id, attr_type, max(coalesce(a.other, 0)) AS o, max(coalesce(a.other, 0) - coalesce(b.other, 0)) AS m FROM pii LEFT JOIN elsewhere a ON a.bank = pii.bank AND a.key = ak LEFT JOIN elsewhere b ON b.bank = pii.bank AND b.key = pk GROUP BY 1, 2",
    "visits": f"SELECT person_id, concat_ws(':', l_suppkey, CAST(floor(day / 30) AS BIGINT)) AS token FROM items GROUP BY ALL HAVING min(day) <= {DAY}",
    "transfers": f"SELECT a.o_custkey AS src, b.o_custkey AS dst, CAST(floor({D.format('a.o_orderdate')} / 30) AS INTEGER) AS month, count(*) AS n, sum(a.o_totalprice) AS amount FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey <> b.o_custkey GROUP BY ALL",
    "au": "SELECT person_id, host AS host_person_id, onboard_day AS first_day FROM persons JOIN (SELECT nation, segment, min(person_id) AS host FROM persons GROUP BY ALL) USING (nation, segment) WHERE person_id <> host",
    "known": f"SELECT person_id FROM items WHERE l_returnflag = 'R' AND l_quantity >= 50 GROUP BY 1 HAVING min({D.format('l_shipdate')}) <= {DAY}",
    "monthly": "SELECT *, spend / (spend + credit_limit) AS utilization FROM (SELECT person_id, CAST(floor(day / 30) AS INTEGER) AS month, sum(l_extendedprice) AS spend, count(*) AS n_txn, max(o_totalprice) AS credit_limit, 1 - avg(l_discount) AS pay_ratio, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS late, max(CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END) AS lir, max(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) AS granted, sum(CASE WHEN l_returnflag = 'R' AND l_quantity >= 30 THEN 1e0 ELSE 0e0 END) AS returned, count(DISTINCT l_suppkey % 20) AS n_mcc, sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END) AS cash_advance FROM items GROUP BY 1, 2)",
    "months": f"SELECT * FROM monthly WHERE (month + 1) * 30 <= {DAY}",
    "lot_deg": f"SELECT token, count(*) AS deg FROM attr WHERE attr_type = 'lot' GROUP BY 1 HAVING count(*) BETWEEN 2 AND {TOKEN_CAP}",
    "lot": "SELECT a.person_id AS src, b.person_id AS dst, sum(1 / ln(deg)) AS w FROM attr a JOIN attr b USING (token) JOIN lot_deg USING (token) WHERE a.attr_type = 'lot' AND b.attr_type = 'lot' AND a.person_id <> b.person_id GROUP BY 1, 2",
    "hub": f"SELECT attr_type, token FROM attr WHERE attr_type IN ('half', 'lot') GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND {HUB_CAP}",
    "small": "SELECT attr.* FROM attr JOIN hub USING (attr_type, token)",
    "life": "SELECT person_id, count(*) AS beh_months, sum(lir) AS beh_lir_count, sum(granted) AS beh_lir_granted, sum(late) AS beh_late_count, sum(returned) AS beh_returned_count, avg(CASE WHEN pay_ratio >= 0.99 THEN 1e0 ELSE 0e0 END) AS beh_pay_full_share, arg_max(credit_limit, month) AS beh_limit_last, sum(lir) / count(*) AS beh_lir_rate, arg_max(credit_limit, month) / arg_min(credit_limit, month) AS beh_limit_growth FROM months GROUP BY 1",
    "recent": f"SELECT person_id, avg(utilization) AS beh_util_mean6, stddev_samp(utilization) AS beh_util_std6, max(utilization) AS beh_util_max6, avg(pay_ratio) AS beh_pay_mean6, stddev_samp(pay_ratio) AS beh_pay_std6, avg(n_txn) AS beh_txn_mean6, avg(n_mcc) AS beh_mcc_mean6, sum(cash_advance) / sum(spend) AS beh_cash_share6 FROM months WHERE month >= {DAY // 30 - 6} GROUP BY 1",
    "app": f"SELECT person_id, 1995 + {DAY} / 365.25e0 - (1940 + k % 60) AS app_age, {DAY} - onboard_day AS app_tenure_days, 30 + k * 37 % 3000 AS app_file_age_at_onboard, {DAY} - (onboard_day - 30 - k * 37 % 3000) AS app_file_age, income AS app_income, CAST(k * 53 % 2000 AS DOUBLE) AS app_email_age_at_onboard, CAST(k % 40 = 0 AS INTEGER) AS app_email_disposable, CAST(k % 3 <> 0 AS INTEGER) AS app_email_popular_domain, CAST(k % 25 = 0 AS INTEGER) AS app_phone_voip, CAST(k * 71 % 2500 AS DOUBLE) AS app_phone_age_at_onboard, CAST(k % 10 > 1 AS INTEGER) AS app_address_residential, CAST(k % 10 = 0 AS INTEGER) AS app_address_mail_drop, CAST(k % 10 = 1 AS INTEGER) AS app_address_commercial, {', '.join(f'CAST(k % 6 = {i} AS INTEGER) AS app_ip_{n}' for i, n in enumerate(('residential', 'cgnat', 'public_wifi', 'office', 'datacenter', 'vpn')))}, CAST(k % 50 = 0 AS INTEGER) AS app_device_emulator, CAST(segment <> 'HOUSEHOLD' AS INTEGER) AS app_has_employer FROM live",
    "shares": "SELECT person_id, " + ", ".join(f"coalesce(sum(others) FILTER (attr_type = '{k}'), 0) AS g_share_{k}" for k in KINDS) + ", max(others) FILTER (attr_type IN ('nid', 'phone', 'email', 'address', 'device')) AS g_max_strong_share, count(*) FILTER (total > kn) AS g_attr_known_links FROM wattr JOIN tok USING (attr_type, token) GROUP BY 1",
    "mismatch": "SELECT person_id, max(m) AS g_nid_identity_mismatch FROM wattr JOIN (SELECT token, count(DISTINCT id_token) - 1 AS m FROM wattr JOIN live USING (person_id) WHERE attr_type = 'nid' GROUP BY 1) USING (token) WHERE attr_type = 'nid' GROUP BY 1",
    "g1": "SELECT src AS person_id, count(*) AS g_proj_degree, sum(w) AS g_proj_wdegree, count(known.person_id) AS g_known_fraud_1hop FROM full_edges LEFT JOIN known ON known.person_id = dst GROUP BY 1",
    "g2": "SELECT src AS person_id, sum(g_known_fraud_1hop) AS g_known_fraud_2hop_paths FROM full_edges JOIN g1 ON g1.person_id = dst GROUP BY 1",
    "moved": f"SELECT DISTINCT src, dst FROM transfers WHERE (month + 1) * 30 <= {DAY} AND src IN (SELECT person_id FROM live) AND dst IN (SELECT person_id FROM live)",
    "guests": f"SELECT person_id, host_person_id, count(*) OVER (PARTITION BY host_person_id) AS n FROM au WHERE first_day <= {DAY} AND host_person_id IN (SELECT person_id FROM live)",
    "met": f"SELECT a.person_id, count(DISTINCT b.person_id) AS g_small_merchant_covisitors FROM visits a JOIN visits b USING (token) WHERE a.person_id <> b.person_id AND token IN (SELECT token FROM visits GROUP BY 1 HAVING count(*) BETWEEN 2 AND {MERCHANT_CAP}) GROUP BY 1",
    "gf": "SELECT person_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in (*[f"g_share_{k}" for k in KINDS], "g_max_strong_share", "g_attr_known_links", "g_nid_identity_mismatch", "g_proj_degree", "g_proj_wdegree", "g_known_fraud_1hop", "g_known_fraud_2hop_paths", "g_transfer_out_cp", "g_transfer_in_cp", "g_au_hosts", "g_au_dependents", "g_au_host_max_dependents", "g_similar_count", "g_small_merchant_covisitors")) + " FROM live LEFT JOIN shares USING (person_id) LEFT JOIN mismatch USING (person_id) LEFT JOIN g1 USING (person_id) LEFT JOIN g2 USING (person_id) LEFT JOIN (SELECT src AS person_id, count(*) AS g_transfer_out_cp FROM moved GROUP BY 1) USING (person_id) LEFT JOIN (SELECT dst AS person_id, count(*) AS g_transfer_in_cp FROM moved GROUP BY 1) USING (person_id) LEFT JOIN (SELECT person_id, count(DISTINCT host_person_id) AS g_au_hosts, max(n) AS g_au_host_max_dependents FROM guests GROUP BY 1) USING (person_id) LEFT JOIN (SELECT host_person_id AS person_id, count(*) AS g_au_dependents FROM guests GROUP BY 1) USING (person_id) LEFT JOIN (SELECT person_id, count(*) AS g_similar_count FROM (SELECT a AS person_id FROM alike UNION ALL SELECT b FROM alike) GROUP BY 1) USING (person_id) LEFT JOIN met USING (person_id)",
    "f": "SELECT * FROM app LEFT JOIN life USING (person_id) LEFT JOIN recent USING (person_id) LEFT JOIN gf USING (person_id)",
    "told": f"SELECT person_id, unnest([{{'feature': 'app_tenure_days', 'w': -0.001e0, 'x': CAST(app_tenure_days AS DOUBLE), 'm': (SELECT median(app_tenure_days) FROM app)}}, {{'feature': 'app_income', 'w': 0.0002e0, 'x': app_income, 'm': (SELECT median(app_income) FROM app)}}, {{'feature': 'app_phone_voip', 'w': 0.75e0, 'x': CAST(app_phone_voip AS DOUBLE), 'm': (SELECT median(app_phone_voip) FROM app)}}], recursive := true) FROM app",
    "half_known": "SELECT token, count(known.person_id) AS total FROM attr LEFT JOIN known USING (person_id) WHERE attr_type = 'half' GROUP BY 1",
    "links": "SELECT attr.person_id, sum(CASE WHEN total - CASE WHEN known.person_id IS NULL THEN 0 ELSE 1 END > 0 THEN 1 ELSE 0 END) AS known_links FROM attr JOIN half_known USING (token) LEFT JOIN known ON known.person_id = attr.person_id WHERE attr_type = 'half' GROUP BY 1",
    "scored": "SELECT doc_id, lang, source, n_chars, quality, toxic AS y, CAST(n_chars % 500 AS DOUBLE) AS score, CAST(n_chars % 37 AS DOUBLE) AS score2 FROM documents JOIN labels USING (doc_id)",
    "weighted": f"SELECT *, CASE WHEN y = 1 OR p = 0 OR q = 0 THEN 1e0 ELSE p * {1 - TARGET}e0 / ({TARGET}e0 * q) END AS w FROM (SELECT *, sum(y) OVER (PARTITION BY lang) AS p, sum(1 - y) OVER (PARTITION BY lang) AS q FROM scored)",
    "picked": f"SELECT *, (sum(w) OVER (PARTITION BY lang ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) <= {BUDGET}e0 * sum(w) OVER (PARTITION BY lang) OR row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) = 1) AS selected FROM weighted",
    "curve": "SELECT lang, score, p, n, sum(p) OVER o AS tp, sum(n) OVER o AS fp, sum(p) OVER (PARTITION BY lang) AS pp, sum(n) OVER (PARTITION BY lang) AS nn FROM (SELECT lang, score, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS n FROM scored GROUP BY 1, 2) WINDOW o AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)",
    "wcurve": "SELECT lang, score, p, n, sum(p) OVER o AS tp, sum(n) OVER o AS fp, sum(p) OVER (PARTITION BY lang) AS pp FROM (SELECT lang, score, sum(y * w) AS p, sum((1 - y) * w) AS n FROM weighted GROUP BY 1, 2) WINDOW o AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)",
    "holdings": "SELECT DISTINCT bank, token, person_id FROM attr JOIN persons USING (person_id) WHERE attr_type = 'half'",
    "grouped": "SELECT *, concat_ws(':', source, lang, doc_id % 7) AS community FROM picked",
    "comm": "SELECT community, size, weight, top3, row_number() OVER (ORDER BY top3 DESC, community) AS rn FROM (SELECT community, count(*) AS size, sum(w) AS weight, list_avg(list_sort(list(score), 'DESC')[1:3]) AS top3 FROM grouped GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40)",
    "greedy": "SELECT CAST(0 AS BIGINT) AS rn, 0e0 AS used, false AS taken UNION ALL SELECT g.rn + 1, used + CASE WHEN used + weight <= (SELECT 0.2e0 * sum(w) FROM grouped) THEN weight ELSE 0 END, used + weight <= (SELECT 0.2e0 * sum(w) FROM grouped) FROM greedy g JOIN comm ON comm.rn = g.rn + 1",
    "cases": "SELECT person_id, bank, concat_ws(':', nation, segment) AS community, CAST(known_links AS DOUBLE) AS score FROM persons LEFT JOIN links USING (person_id)",
}
NEEDS = {
    "attr": ["items"], "pattr": ["items"], "wattr": ["pattr", "known"], "tok": ["wattr"], "live": ["persons"], "full_edges": ["wattr", "tok", "visits", "moved", "au", "live", "alike"], "alike": ["persons"], "truth": ["persons"], "hashed": ["truth"], "folded": ["hashed"],
    "flagged": ["truth"], "ring_person": ["flagged"], "look": ["flagged", "truth"], "look_rates": ["look"], "pii": ["pattr", "live"], "keyed": ["pii", "live"], "elsewhere": ["keyed"], "xb": ["pii", "elsewhere"],
    "visits": ["items"], "au": ["persons"], "known": ["items"], "monthly": ["items"], "months": ["monthly"], "lot_deg": ["attr"], "lot": ["attr", "lot_deg"], "hub": ["attr"], "small": ["attr", "hub"], "life": ["months"],
    "recent": ["months"], "app": ["live"], "shares": ["wattr", "tok"], "mismatch": ["wattr", "live"], "g1": ["full_edges", "known"], "g2": ["full_edges", "g1"], "moved": ["transfers", "live"], "guests": ["au", "live"], "met": ["visits"],
    "gf": ["live", "shares", "mismatch", "g1", "g2", "moved", "guests", "alike", "met"], "half_known": ["attr", "known"], "links": ["attr", "half_known", "known"], "f": ["app", "life", "recent", "gf"], "told": ["app"], "weighted": ["scored"], "picked": ["weighted"], "curve": ["scored"], "wcurve": ["weighted"],
    "holdings": ["attr", "persons"], "grouped": ["picked"], "comm": ["grouped"], "greedy": ["comm"], "cases": ["persons", "links"],
}


def with_tables(names: str, body: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(n):
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    joint = "," if body.startswith("+") else ""
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{joint}\n{body.lstrip('+')}"


def _co(table: str, kind: str, cap: int) -> str:
    where = f"WHERE attr_type = '{kind}'" if kind else ""
    return f"SELECT a.person_id AS src, b.person_id AS dst, sum(1 / ln(deg)) AS w FROM (SELECT * FROM {table} {where}) a JOIN (SELECT * FROM {table} {where}) b USING (token) JOIN (SELECT token, count(*) AS deg FROM {table} {where} GROUP BY 1 HAVING count(*) BETWEEN 2 AND {cap}) USING (token) WHERE a.person_id <> b.person_id GROUP BY 1, 2"


def _both(pairs: str) -> str:
    return f"SELECT src, dst, 1e0 AS w FROM ({pairs}) UNION ALL SELECT dst, src, 1e0 FROM ({pairs})"


_TRANSFER = f"SELECT DISTINCT src, dst FROM transfers WHERE (month + 1) * 30 <= {DAY}"
_AU = f"SELECT DISTINCT person_id AS src, host_person_id AS dst FROM au WHERE first_day <= {DAY}"


def _hmac() -> str:
    cases = []
    for b in range(5):
        key = hashlib.sha256(f"{SECRET}|{SEED}|{b}".encode()).digest() + bytes(32)
        outer, inner = (bytes(x ^ pad for x in key).hex() for pad in (0x5C, 0x36))
        cases.append(f"WHEN {b} THEN substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode('name:' || lower(trim(name)))))), 1, 20)")
    return f"CASE bank {' '.join(cases)} END"


def _pagerank() -> str:
    steps = ["+n AS (SELECT count(*) AS n FROM persons WHERE onboard_day <= %d)" % DAY, "s AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM lot)", f"d AS MATERIALIZED (SELECT person_id FROM persons WHERE onboard_day <= {DAY} AND person_id NOT IN (SELECT src FROM s))", f"r0 AS MATERIALIZED (SELECT person_id, 1e0 / n AS r FROM persons, n WHERE onboard_day <= {DAY})"]
    for k in range(1, 51):
        p = f"r{k - 1}"
        steps.append(f"r{k} AS MATERIALIZED (SELECT person_id, 0.15e0 / n + 0.85e0 * (coalesce(got, 0) + (SELECT coalesce(sum(r), 0) FROM {p} JOIN d USING (person_id)) / n) AS r FROM {p} LEFT JOIN (SELECT dst, sum(share * r) AS got FROM s JOIN {p} ON src = person_id GROUP BY 1) ON dst = person_id, n)")
    return ",\n".join(steps) + "\nSELECT person_id, round(r * n, 6) AS pagerank FROM r50, n"


_RULES = (
    "g_share_phone >= 2", "g_share_device >= 2", "app_address_mail_drop = 1 OR app_address_commercial = 1", "app_email_age_at_onboard < 60", "app_phone_voip = 1", "app_ip_datacenter = 1 OR app_ip_vpn = 1", "g_nid_identity_mismatch >= 1",
    "beh_lir_count >= 3", "app_email_disposable = 1", "app_device_emulator = 1",
)


def _rules() -> str:
    return " + ".join(f"CASE WHEN {r} THEN 1 ELSE 0 END" for r in _RULES)


def _rounded(columns: str) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns.split())


_LIFE = "beh_months beh_lir_count beh_lir_granted beh_late_count beh_returned_count beh_pay_full_share beh_limit_last beh_lir_rate beh_limit_growth"
_RECENT = "beh_util_mean6 beh_util_std6 beh_util_max6 beh_pay_mean6 beh_pay_std6 beh_txn_mean6 beh_mcc_mean6 beh_cash_share6"
_GRAPH = " ".join(f"g_share_{k}" for k in KINDS) + " g_max_strong_share g_attr_known_links g_nid_identity_mismatch g_proj_degree g_proj_wdegree g_known_fraud_1hop g_known_fraud_2hop_paths g_transfer_out_cp g_transfer_in_cp g_au_hosts g_au_dependents g_au_host_max_dependents g_similar_count g_small_merchant_covisitors"
_XB = ", ".join(f"CAST(coalesce(max({c}) FILTER (attr_type = '{t}'), 0) AS BIGINT) AS xb_{t}_{n}" for t in ("nid", "phone", "email", "device") for c, n in (("o", "other_banks"), ("m", "mismatch")))
# The Indel ratio by the textbook's table for the longest common subsequence: a row of it for each letter of a.
_LCS = "list_reduce(range(1, length(an) + 1), lambda up, i: list_reduce(range(1, length(bn) + 1), lambda acc, j: list_append(acc, CASE WHEN an[i] = bn[j] THEN up[j] + 1 ELSE greatest(acc[j], up[j + 1]) END), [CAST(0 AS BIGINT)]), list_transform(range(0, length(bn) + 1), lambda x: CAST(0 AS BIGINT)))[-1]"


_AUDIT = ["app_tenure_days", "app_income", "beh_months", "beh_late_count", "g_share_phone", "g_proj_degree"]

ORACLE_SQL = {
    "projection_adamic_adar": with_tables("attr visits transfers au", f"SELECT src, dst, round(sum(w), 6) AS w FROM ({_co('attr', 'half', TOKEN_CAP)} UNION ALL {_co('visits', '', MERCHANT_CAP)} UNION ALL {_both(_TRANSFER)} UNION ALL {_both(_AU)}) GROUP BY 1, 2"),
    "projection_degrees": with_tables("lot", "SELECT src, count(*) AS degree, round(sum(w), 6) AS weighted_degree FROM lot GROUP BY 1"),
    "snapshot_persons": with_tables("persons known", f"SELECT person_id, bank, onboard_day, k AS known_fraud, k AS closed, NOT k AS scored FROM (SELECT *, person_id IN (SELECT person_id FROM known) AS k FROM persons WHERE onboard_day <= {DAY})"),
    "tokens_hmac": with_tables("persons", f"SELECT person_id, bank, {_hmac()} AS token FROM persons"),
    "hash_uniform_folds": with_tables("persons", f"SELECT person_id, round(CAST(CAST('0x' || substr(sha256('{SEED}|' || nation), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616e0, 9) AS u FROM persons"),
    "group_folds": with_tables("folded", 'SELECT person_id, grp AS "group", fold FROM folded'),
    "row_builder": with_tables("folded persons known", f"+t AS (SELECT unnest({[*TRAIN_DAYS, *TEST_DAYS]}) AS T), c AS (SELECT person_id, min({D.format('l_shipdate')}) AS confirmed FROM items WHERE l_returnflag = 'R' AND l_quantity >= 50 GROUP BY 1), e AS (SELECT p.person_id, T, fold, coalesce(NOT coalesce(confirmed <= T, false) AND T - onboard_day <= {MAX_TENURE} AND bust_out_day > T, false) AS eligible, bad, observed, bust_out_day FROM persons p JOIN t ON onboard_day <= T JOIN folded USING (person_id) LEFT JOIN c ON c.person_id = p.person_id), z AS (SELECT *, CASE WHEN eligible AND T IN ({', '.join(map(str, TRAIN_DAYS))}) AND fold IN ('train', 'val') THEN fold WHEN eligible AND T IN ({', '.join(map(str, TEST_DAYS))}) AND fold = 'test' THEN 'test' ELSE 'none' END AS split FROM e)\nSELECT person_id, T, fold, eligible, split, CAST(CASE WHEN split = 'test' THEN bad ELSE bad AND observed AND bust_out_day + 100 <= {CUTOFF} END AS INTEGER) AS y FROM z"),
    "normalize_all": r"""SELECT c_custkey, trim(regexp_replace(lower(regexp_replace(c_name, '[^A-Za-z ]', '', 'g')), ' +', ' ', 'g')) || ' leglise nu capek simon' AS name,
        trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) || ' rue de l eglise ory' AS address,
        regexp_replace(c_name, '[^0-9]', '', 'g') AS nid, '+33' || c_custkey || '1234' AS phone, lower(c_name) || '@mail.com' AS email, 'Mail.com' AS domain FROM customer""",
    "numeric_functions": f"""SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS signed_log, round(CAST(least(greatest(c_acctbal / 1000, -1), 6) AS DOUBLE), 6) AS clipped, round(1995 + {DAY} / 365.25e0 - (1940 + c_custkey % 60), 6) AS age, round_even(c_acctbal / 100, 0) * 100 AS rounded, c_custkey % 2 = 0 AS popular, c_mktsegment AS bank, substr(sha256(c_name), 1, 32) AS naive FROM customer""",
    "entity_resolution": f"WITH p AS (SELECT p_partkey, lower(trim(p_name)) AS n, p_brand, p_type, p_size FROM part), j AS (SELECT a.p_partkey AS a, b.p_partkey AS b, greatest(a.p_size, b.p_size) AS first_day, a.n AS an, b.n AS bn FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey), s AS (SELECT a, b, first_day, 200e0 * {_LCS} / (length(an) + length(bn)) AS score FROM j)\nSELECT a, b, first_day, round(score, 6) AS score FROM s WHERE score >= 85",
    "app_features": with_tables("app", "SELECT * REPLACE (round(app_age, 6) AS app_age) FROM app"),
    "beh_features_life": with_tables("life", f"SELECT person_id, {_rounded(_LIFE)} FROM life"),
    "beh_features_six": with_tables("recent", f"SELECT person_id, {_rounded(_RECENT)} FROM recent"),
    "graph_features": with_tables("gf", f"SELECT person_id, {_rounded(_GRAPH)} FROM gf"),
    "live_key_counts": with_tables("keyed", "SELECT bank, key, CAST(n AS BIGINT) AS n FROM keyed"),
    "xb_features": with_tables("xb live elsewhere", f"+w AS (SELECT person_id, {_XB} FROM xb GROUP BY 1), v AS (SELECT live.person_id, w.* EXCLUDE (person_id), CAST(coalesce(other, 0) AS BIGINT) AS xb_identity_other_banks FROM live LEFT JOIN w ON w.person_id = live.person_id LEFT JOIN elsewhere e ON e.bank = live.bank AND e.key = 'id|' || id_token)\nSELECT person_id, " + ", ".join(f"coalesce(xb_{t}_{n}, 0) AS xb_{t}_{n}" for t in ("nid", "phone", "email", "device") for n in ("other_banks", "mismatch")) + ", xb_identity_other_banks, " + " + ".join(f"coalesce(xb_{t}_mismatch, 0)" for t in ("nid", "phone", "email", "device")) + " AS xb_mismatch_total FROM v"),
    "round_requests": with_tables("keyed", "+r AS (SELECT a.bank AS asker, b.bank AS bank, key FROM keyed a JOIN keyed b USING (key) WHERE a.bank <> b.bank), m AS (SELECT asker, bank, count(*) AS n FROM r GROUP BY 1, 2), p AS (SELECT x.bank AS asker, k.bank, count(*) AS free FROM (SELECT DISTINCT bank FROM keyed) x JOIN keyed k ON k.bank <> x.bank WHERE (x.bank, k.key) NOT IN (SELECT asker, key FROM r) GROUP BY 1, 2)\nSELECT asker, bank, true AS real, n, n AS slots FROM m UNION ALL SELECT asker, bank, false, least(floor(m.n * 0.5), free), least(floor(m.n * 0.5), free) FROM m JOIN p USING (asker, bank) WHERE least(floor(m.n * 0.5), free) > 0"),
    "share_counts_pivot": with_tables("attr", "SELECT person_id, " + ", ".join(f"CAST(coalesce(sum(others) FILTER (attr_type = '{k}'), 0) AS BIGINT) AS shared_{k}" for k in ("half", "year", "lot")) + " FROM (SELECT *, count(*) OVER (PARTITION BY attr_type, token) - 1 AS others FROM attr) GROUP BY 1"),
    "known_links": with_tables("links", "SELECT person_id, CAST(known_links AS BIGINT) AS known_links FROM links"),
    "fraud_hops": with_tables("lot known", "+h AS (SELECT src, count(*) AS hop1 FROM lot WHERE dst IN (SELECT person_id FROM known) GROUP BY 1), two AS (SELECT lot.src, sum(hop1) AS hop2 FROM lot JOIN h ON h.src = lot.dst GROUP BY 1)\nSELECT person_id, CAST(coalesce(hop1, 0) AS BIGINT) AS hop1, CAST(coalesce(hop2, 0) AS BIGINT) AS hop2 FROM (SELECT DISTINCT src AS person_id FROM lot) LEFT JOIN h ON h.src = person_id LEFT JOIN two ON two.src = person_id WHERE hop1 > 0 OR hop2 > 0"),
    "wcc_sizes": with_tables("lot", "+e AS MATERIALIZED (SELECT DISTINCT src, dst FROM lot), reach(node, goal) AS (SELECT src, src FROM e UNION SELECT reach.node, e.dst FROM reach JOIN e ON e.src = reach.goal)\nSELECT component, count(*) AS size FROM (SELECT node, min(goal) AS component FROM reach GROUP BY 1) GROUP BY 1", recursive=True),
    "identity_wcc": with_tables("pattr", f"+b AS MATERIALIZED (SELECT DISTINCT 'Person:' || person_id AS p, attr_type || ':' || token AS t FROM pattr WHERE attr_type IN ('nid', 'phone', 'email', 'address', 'device')), e AS MATERIALIZED (SELECT DISTINCT x.p AS src, y.p AS dst FROM b x JOIN b y USING (t)), reach(node, goal) AS (SELECT src, src FROM e UNION SELECT reach.node, e.dst FROM reach JOIN e ON e.src = reach.goal), m AS (SELECT node, min(goal) AS least FROM reach GROUP BY 1), z AS (SELECT least, count(*) AS n FROM m GROUP BY 1 UNION ALL SELECT least, count(DISTINCT t) FROM m JOIN b ON b.p = m.node GROUP BY 1)\nSELECT least AS component, CAST(sum(n) AS BIGINT) AS size FROM z GROUP BY 1 HAVING sum(n) >= 6", recursive=True),
    "pagerank": with_tables("lot persons", _pagerank()),
    "transfer_counterparties": with_tables("transfers", f"+m AS ({_TRANSFER})\nSELECT coalesce(a.src, b.dst) AS person_id, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM (SELECT src, count(DISTINCT dst) AS n_out FROM m GROUP BY 1) a FULL JOIN (SELECT dst, count(DISTINCT src) AS n_in FROM m GROUP BY 1) b ON a.src = b.dst"),
    "transfer_rollup": with_tables("transfers", "SELECT src, dst, CAST(sum(n) AS BIGINT) AS n, round(sum(amount), 2) AS amount, min(month) AS first_month, max(month) AS last_month FROM transfers GROUP BY 1, 2"),
    "au_dependents": with_tables("au", "SELECT host_person_id, count(DISTINCT person_id) AS dependents FROM au GROUP BY 1 HAVING count(DISTINCT person_id) >= 3"),
    "covisitors": with_tables("visits", f"+s AS (SELECT token FROM visits GROUP BY 1 HAVING count(*) BETWEEN 2 AND {MERCHANT_CAP})\nSELECT a.person_id, count(DISTINCT b.person_id) AS covisitors FROM visits a JOIN s USING (token) JOIN visits b USING (token) WHERE a.person_id <> b.person_id GROUP BY 1"),
    "cy_pairs": with_tables("small", "SELECT x.person_id AS a, y.person_id AS b, count(DISTINCT attr_type) AS n_kinds, count(*) AS n_shared FROM small x JOIN small y USING (attr_type, token) WHERE x.person_id < y.person_id GROUP BY 1, 2 HAVING count(DISTINCT attr_type) >= 2"),
    "cy_contagion": with_tables("small known", "SELECT x.person_id, count(DISTINCT y.person_id) AS n_confirmed, array_to_string(list_sort(list(DISTINCT attr_type)), ',') AS via_types FROM small x JOIN small y USING (attr_type, token) WHERE x.person_id NOT IN (SELECT person_id FROM known) AND y.person_id IN (SELECT person_id FROM known) GROUP BY 1"),
    "nid_mismatch": with_tables("attr persons", "SELECT token, count(DISTINCT person_id) AS n_persons, count(DISTINCT bank) AS n_banks FROM attr JOIN persons USING (person_id) WHERE attr_type = 'lot' GROUP BY 1 HAVING count(DISTINCT person_id) >= 2"),
    "rules_score": with_tables("f", f"SELECT person_id, round({_rules()} + 0.01e0 * ln(1 + g_share_phone + g_share_device), 6) AS score FROM f"),
    "shortcut_audit": with_tables("f", "+g AS (SELECT app_has_employer AS y, * FROM f), u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, y, CAST({c} AS DOUBLE) AS value FROM g" for c in _AUDIT) + "), m AS (SELECT feature, median(value) AS med FROM u GROUP BY 1 HAVING count(DISTINCT value) > 1), v AS (SELECT feature, y, coalesce(value, med) AS x FROM u JOIN m USING (feature)), k AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2e0 AS r FROM v), a AS (SELECT feature, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * sum(1 - y)) AS auc FROM k GROUP BY 1)\nSELECT feature, round(greatest(auc, 1 - auc), 6) AS auc, greatest(auc, 1 - auc) > 0.9 AS suspect FROM a"),
    "topk_budget": with_tables("picked", "SELECT doc_id, lang, round(w, 6) AS w, selected FROM picked"),
    "budget_metrics": with_tables("picked", "SELECT lang, count(*) FILTER (selected) AS alerts, round(sum(y * w) FILTER (selected) / sum(w) FILTER (selected), 6) AS precision, round(coalesce(sum(y * w) FILTER (selected), 0) / sum(y * w), 6) AS recall FROM picked GROUP BY 1"),
    "rank_ensemble": with_tables("scored", "SELECT doc_id, round(((rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2e0) + (rank() OVER (PARTITION BY lang ORDER BY score2) + (count(*) OVER (PARTITION BY lang, score2) - 1) / 2e0)) / count(*) OVER (PARTITION BY lang) / 2e0, 6) AS ensemble FROM scored"),
    "average_precision": with_tables("wcurve", "SELECT lang, round(sum(p / pp * tp / (tp + fp)), 6) AS ap FROM wcurve GROUP BY 1"),
    "roc_auc": with_tables("scored", "SELECT lang, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * sum(1 - y)), 6) AS auc FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2e0 AS r FROM scored) GROUP BY 1"),
    "recall_at_fpr": with_tables("curve", "+pts AS (SELECT lang, fp / nn AS x, min(tp / pp) AS lo, max(tp / pp) AS hi FROM curve GROUP BY 1, 2), seg AS (SELECT *, coalesce(lag(x) OVER o, 0) AS x0, coalesce(lag(hi) OVER o, 0) AS v0 FROM pts WINDOW o AS (PARTITION BY lang ORDER BY x))\nSELECT lang, round(max(CASE WHEN x <= 0.01e0 THEN hi WHEN x0 < 0.01e0 THEN v0 + (lo - v0) * (0.01e0 - x0) / (x - x0) END), 6) AS recall FROM seg GROUP BY 1"),
    "confounder_rates": with_tables("picked", "+b AS (SELECT avg(CAST(selected AS INTEGER)) AS base FROM picked), r AS (" + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n, avg(CAST(selected AS INTEGER)) AS rate FROM picked WHERE {p}" for k, p in CONFOUNDERS.items()) + ")\nSELECT name, n, round(rate, 6) AS rate, round(rate / base, 6) AS ratio FROM r, b"),
    "look_alike_rates": with_tables("look_rates look", "SELECT name, n, round(rate, 6) AS rate, round(rate / (SELECT avg(CAST(flag AS INTEGER)) FROM look), 6) AS ratio FROM look_rates"),
    "look_alike_mean": with_tables("look_rates", "SELECT round(sum(n * coalesce(rate, 0)) / sum(n), 6) AS mean FROM look_rates"),
    "recall_by_level": with_tables("picked", "SELECT quality, count(*) AS positives, round(avg(CAST(selected AS INTEGER)), 6) AS recall FROM picked WHERE y = 1 GROUP BY 1"),
    "ring_metrics": with_tables("ring_person", "+r AS (SELECT ring_id, max(first) IS NOT NULL AS hit, count(first) / count(*) AS coverage FROM ring_person GROUP BY 1)\nSELECT (SELECT count(*) FROM r) AS rings, (SELECT round(avg(CAST(hit AS INTEGER)), 6) FROM r) AS ring_recall, (SELECT round(coalesce(avg(coverage) FILTER (hit), 0), 6) FROM r) AS ring_coverage_when_detected, round(count(first) / count(*), 6) AS person_recall, round(CAST(median(bust - first) AS DOUBLE), 6) AS median_lead_days, round(count(*) FILTER (bust - first >= 30) / count(*), 6) AS share_detected_early, round(coalesce(sum(exposure) FILTER (first IS NOT NULL), 0) / greatest(1, sum(exposure)), 6) AS exposure_avoided_share FROM ring_person"),
    "ring_recall_by_level": with_tables("ring_person", "+r AS (SELECT ring_id, min(sophistication) AS s, min(scenario) AS c, max(first) IS NOT NULL AS hit FROM ring_person GROUP BY 1)\nSELECT CAST(s AS VARCHAR) AS level, count(*) AS rings, round(avg(CAST(hit AS INTEGER)), 6) AS recall FROM r GROUP BY 1 UNION ALL SELECT c, count(*), round(avg(CAST(hit AS INTEGER)), 6) FROM r GROUP BY 1"),
    "community_alerts": with_tables("greedy", "SELECT community, size, round(weight, 6) AS weight, round(top3, 6) AS top3 FROM comm JOIN greedy USING (rn) WHERE taken", recursive=True),
    "alert_comparison": with_tables("greedy", "+a AS (SELECT *, community IN (SELECT community FROM comm JOIN greedy USING (rn) WHERE taken) AS in_community FROM grouped), l AS (SELECT 'person' AS level, selected AS hit, * FROM a UNION ALL SELECT 'community', in_community, * FROM a)\nSELECT level, count(*) FILTER (hit) AS alerted_rows, round(coalesce(sum(w) FILTER (hit), 0), 6) AS alerted_weight, round(sum(w * y) FILTER (hit) / sum(w) FILTER (hit), 6) AS precision, round(count(*) FILTER (hit AND y = 1) / count(*) FILTER (y = 1), 6) AS recall, round(count(DISTINCT source) FILTER (hit AND y = 1) / count(DISTINCT source) FILTER (y = 1), 6) AS ring_recall FROM l GROUP BY 1", recursive=True),
    "score_contributions": with_tables("told", "+c AS (SELECT person_id, feature, w * (coalesce(x, m) - m) AS contribution FROM told)\nSELECT person_id, CAST(row_number() OVER (PARTITION BY person_id ORDER BY contribution DESC, feature) - 1 AS INTEGER) AS place, feature, round(contribution, 6) AS contribution FROM c WHERE contribution > 0"),
    "case_summaries": with_tables("cases attr transfers au", "+h AS (SELECT community, count(*) AS n FROM (SELECT community, attr_type, token FROM cases JOIN attr USING (person_id) WHERE attr_type IN ('half', 'lot') GROUP BY 1, 2, 3 HAVING count(*) >= 2) GROUP BY 1), i AS (SELECT a.community, count(*) AS n, sum(amount) AS amount FROM transfers JOIN cases a ON a.person_id = src JOIN cases b ON b.person_id = dst AND a.community = b.community GROUP BY 1), g AS (SELECT community, count(DISTINCT host_person_id) AS n FROM au JOIN cases USING (person_id) GROUP BY 1), c AS (SELECT community, count(*) AS n_members, array_to_string(list_sort(list(DISTINCT CAST(bank AS VARCHAR))), ', ') AS banks, max(score) AS top_score FROM cases GROUP BY 1)\nSELECT c.*, coalesce(h.n, 0) AS n_shared, coalesce(i.n, 0) AS n_transfers, round(coalesce(amount, 0), 2) AS amount, coalesce(g.n, 0) AS n_hosts FROM c LEFT JOIN h USING (community) LEFT JOIN i USING (community) LEFT JOIN g USING (community)"),
    "community_subgraph": with_tables("cases attr visits transfers au", "+m AS (SELECT person_id FROM cases WHERE community = '7:BUILDING')\nSELECT '7:BUILDING' AS community, 'OWNS' AS type, CAST(person_id AS VARCHAR) AS src, concat(person_id, ':acct') AS dst FROM m UNION ALL SELECT '7:BUILDING', concat('HAS_', upper(attr_type)), CAST(person_id AS VARCHAR), token FROM attr JOIN m USING (person_id) WHERE attr_type IN ('half', 'lot') UNION ALL SELECT '7:BUILDING', 'PAID_AT', CAST(person_id AS VARCHAR), token FROM visits JOIN m USING (person_id) UNION ALL SELECT DISTINCT '7:BUILDING', 'TRANSFERRED_TO', CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM transfers JOIN m ON m.person_id = src UNION ALL SELECT '7:BUILDING', 'AUTHORIZED_USER_ON', CAST(person_id AS VARCHAR), CAST(host_person_id AS VARCHAR) FROM au JOIN m USING (person_id)"),
    "scaled_features": with_tables("f", "+l AS (SELECT person_id, " + ", ".join(f"sign({c}) * ln(1 + abs({c})) AS {c}" for c in _AUDIT) + " FROM f), z AS (SELECT person_id, " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM l)) AS {c}" for c in _AUDIT) + ", CAST(" + " OR ".join(f"{c} IS NULL" for c in _AUDIT) + " AS DOUBLE) AS missing FROM l)\nSELECT person_id, missing, " + ", ".join(f"round(greatest(-6, least(6, ({c} - (SELECT avg({c}) FROM z)) / coalesce(nullif((SELECT stddev_samp({c}) FROM z), 0), 1))), 6) AS {c}" for c in _AUDIT) + " FROM z"),
    "nmi": "WITH j AS (SELECT lang, source, count(*) / (SELECT count(*) FROM documents) AS p FROM documents GROUP BY 1, 2), a AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT sum(p) AS p FROM j GROUP BY lang)), b AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT sum(p) AS p FROM j GROUP BY source)), ab AS (SELECT -sum(p * ln(p)) AS h FROM j) SELECT round((a.h + b.h - ab.h) / ((a.h + b.h) / 2), 6) AS nmi FROM a, b, ab",
    "encrypted_score": with_tables("app", "SELECT person_id, round(-0.5e0 - 0.001e0 * app_tenure_days + 0.0002e0 * CAST(app_income AS DOUBLE) + 0.75e0 * app_phone_voip, 6) AS logit FROM app"),
    "property_graph_nodes": with_tables("persons attr visits", "SELECT 'Person' AS label, CAST(person_id AS VARCHAR) AS id FROM persons UNION ALL SELECT 'Account', concat(person_id, ':acct') FROM persons UNION ALL SELECT DISTINCT attr_type, token FROM attr WHERE attr_type IN ('half', 'lot') UNION ALL SELECT DISTINCT 'Merchant', token FROM visits"),
    "property_graph_edges": with_tables("persons attr visits transfers au", "SELECT 'OWNS' AS type, CAST(person_id AS VARCHAR) AS src, concat(person_id, ':acct') AS dst FROM persons UNION ALL SELECT concat('HAS_', upper(attr_type)), CAST(person_id AS VARCHAR), token FROM attr WHERE attr_type IN ('half', 'lot') UNION ALL SELECT 'PAID_AT', CAST(person_id AS VARCHAR), token FROM visits UNION ALL SELECT DISTINCT 'TRANSFERRED_TO', CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM transfers UNION ALL SELECT 'AUTHORIZED_USER_ON', CAST(person_id AS VARCHAR), CAST(host_person_id AS VARCHAR) FROM au"),
    "cross_bank_reuse": with_tables("holdings", "SELECT bank, token, CAST(total - n AS BIGINT) AS other_banks FROM (SELECT *, sum(n) OVER (PARTITION BY token) AS total, count(*) OVER (PARTITION BY token) AS banks FROM (SELECT bank, token, count(*) AS n FROM holdings GROUP BY 1, 2)) WHERE banks > 1"),
    "dataset_counts": with_tables("persons attr transfers items", f"""+t AS (SELECT 'persons' AS "table", 'bank' AS "column", CAST(bank AS VARCHAR) AS value FROM persons UNION ALL SELECT 'persons', 'segment', segment FROM persons
UNION ALL SELECT 'person_attr', 'attr_type', attr_type FROM attr WHERE attr_type IN ('half', 'lot'))
SELECT "table", "column", value, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'persons', '', '', count(*) FROM persons UNION ALL SELECT 'person_attr', '', '', count(*) FROM attr WHERE attr_type IN ('half', 'lot')
UNION ALL SELECT 'transfers', '', '', count(*) FROM transfers UNION ALL SELECT 'fraud_confirmations', '', '', count(DISTINCT person_id) FROM items WHERE l_returnflag = 'R' AND l_quantity >= 50"""),
    "model_report": with_tables("scored", f"""+l AS (SELECT 'score' AS model, lang, y, score AS s FROM scored UNION ALL SELECT 'score2', lang, y, score2 FROM scored),
c AS (SELECT *, sum(y) OVER g AS p, sum(1 - y) OVER g AS q, rank() OVER (PARTITION BY model, lang ORDER BY s) + (count(*) OVER (PARTITION BY model, lang, s) - 1) / 2e0 AS r FROM l WINDOW g AS (PARTITION BY model, lang)),
w AS (SELECT *, CASE WHEN y = 1 OR p = 0 OR q = 0 THEN 1e0 ELSE p * {1 - TARGET}e0 / ({TARGET}e0 * q) END AS w FROM c),
k AS (SELECT model, lang, s, sum(y * w) AS tp, sum(w) AS n FROM w GROUP BY ALL),
v AS (SELECT *, sum(tp) OVER o AS above, sum(n) OVER o AS picked, sum(tp) OVER (PARTITION BY model, lang) AS whole FROM k WINDOW o AS (PARTITION BY model, lang ORDER BY s DESC)),
a AS (SELECT model, lang, sum(tp / nullif(whole, 0) * above / picked) AS ap FROM v GROUP BY ALL),
u AS (SELECT model, lang, (sum(r) FILTER (y = 1) - max(p) * (max(p) + 1) / 2e0) / nullif(max(p) * max(q), 0) AS auc FROM c GROUP BY ALL)
SELECT model, round(avg(ap), 6) AS ap, round(avg(auc), 6) AS auc FROM a JOIN u USING (model, lang) GROUP BY model"""),
}
ORACLE_SQL["encrypted_reuse"] = ORACLE_SQL["cross_bank_reuse"]
ORACLE_SQL["best_model"] = f"WITH m AS ({ORACLE_SQL['model_report']}) SELECT model, ap FROM m ORDER BY ap DESC, model LIMIT 1"
