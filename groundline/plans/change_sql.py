"""DuckDB oracles of change analysis, gates, metrics and snapshots."""

from __future__ import annotations

import re

from groundline.plans.overlay_sql import with_overlay
from groundline.plans.text_sql import TEXT
from groundline.plans.views_sql import VIEWS

EXTRA = (
    VIEWS
    | TEXT
    | {
        "sect": "SELECT c.agreement_id, c.section, string_agg(DISTINCT o.type, ',' ORDER BY o.type) AS types FROM clause_ref c JOIN obligation o ON o.id = c.obligation_id AND o.agreement_id = c.agreement_id WHERE c.grounded GROUP BY ALL",
        "gate": """
SELECT run_id, n - 1 AS category, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 END AS s1, CASE WHEN l_suppkey % 3 < 2 THEN l_suppkey % 3 END AS s2,
       CASE WHEN l_partkey % 5 < 4 THEN CASE WHEN l_partkey % 5 > 2 THEN 1 ELSE 0 END END AS s3, l_partkey % 13 = 0 AS failed, l_suppkey % 4 = 0 AS rule_hit
FROM (SELECT *, l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY id) AS n FROM line WHERE l_orderkey IN (SELECT agreement_id FROM agreement WHERE base_agreement_id IS NOT NULL)) WHERE n <= 6""",
        "counted": "SELECT *, coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0) AS yes, (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT AS usable FROM gate",
        "decided": """
SELECT run_id, category, CASE WHEN rule_hit THEN 'rules' WHEN NOT failed AND usable > 0 THEN 'classifier' ELSE 'none' END AS tier,
       CASE WHEN rule_hit THEN true WHEN usable > 0 THEN 2 * yes >= usable END AS answer, round(greatest(yes, usable - yes) / 3, 6) AS confidence,
       rule_hit OR failed OR NOT (usable = 3 AND yes = 0) AS run_check
FROM counted""",
        "iou": """
SELECT p.base_agreement_id AS doc, p.type, g.ref_id AS gold, c.ref_id AS pred, least(g.char_end, c.char_end) - greatest(g.char_start, c.char_start) AS inter,
       greatest(g.char_end, c.char_end) - least(g.char_start, c.char_start) AS "union"
FROM main_ref c JOIN obligation p ON p.id = c.obligation_id JOIN main_ref g ON g.agreement_id = p.base_agreement_id JOIN obligation o ON o.id = g.obligation_id AND o.type = p.type
WHERE least(g.char_end, c.char_end) > greatest(g.char_start, c.char_start)""",
        "lab": """
SELECT lang, count(*) FILTER (WHERE quality = 1 AND n_chars > 900) AS tp, count(*) FILTER (WHERE n_chars > 900) AS n_pred, count(*) FILTER (WHERE quality = 1) AS n_gold
FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)""",
        "prf": """
SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred WHEN n_gold = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN n_gold > 0 THEN tp / n_gold ELSE 1.0 END AS r FROM lab""",
        "prf1": """SELECT lang, tp, n_pred, n_gold, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM prf""",
        "ev": "SELECT l_orderkey AS agreement_id, l_returnflag AS flag, 'event' || CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS key, CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem",
        "extr": "SELECT l_partkey AS agreement_id, id AS run, 'v' || l_linenumber AS prompt FROM line",
        "digest": "SELECT doc_id AS id, sha256('v1' || chr(0) || lang || chr(0) || text) AS fingerprint FROM documents",
    }
)


def sql(query: str) -> str:
    return re.sub(r"\bat\b", '"at"', with_overlay(query, EXTRA))  # a reserved word


LEX = {
    "('other', 'invoice*')": "event = 1", "('term', 'expiration')": "event = 4", "('dates', 'Commencement Date')": "event = 0", "('dates', 'within')": "form IN (0, 1)",
    "('parties', 'Tenant')": "true", "('price', 'pay')": "true",
}

ORACLES = {
    "c11_targets": (
        "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 1 THEN 'Exhibit' ELSE 'Section' END AS kind, CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 9) || '.1' WHEN 1 THEN 'B' ELSE '3' END AS part, CAST(NULL AS VARCHAR) AS parent, "
        "CASE WHEN c_custkey % 4 < 2 THEN CAST(1 AS BIGINT) END AS doc, CASE c_custkey % 4 WHEN 0 THEN 'Section ' || (c_custkey % 9) || '.1 of the Original Lease' WHEN 1 THEN 'Exhibit “B” to the Lease' ELSE 'Section 3 of the OS Rider' END AS label "
        "FROM customer WHERE c_custkey % 4 < 3"
    ),
    "v10_mentioned": "SELECT c_custkey AS id, c_custkey % 2 = 1 OR c_custkey % 4 = 0 AS found FROM customer",
    "v13_declared_dates": "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 2 THEN DATE '2010-01-01' + CAST(c_custkey % 3000 AS INT) END AS date FROM customer",
    "v15_bound_roles": "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'landlord' WHEN 1 THEN 'tenant' WHEN 3 THEN 'guarantor' ELSE '' END AS roles FROM customer",
    "c01_chain": sql("SELECT run_id, agreement_id, position, role FROM chain"),
    "c02_current_extraction": sql("SELECT agreement_id, max(run) AS run, arg_max(prompt, run) AS prompt FROM extr GROUP BY agreement_id"),
    "c03_base_first": sql("SELECT agreement_id, CAST(CASE WHEN base_agreement_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS depth FROM agreement"),
    "c04_section_types": sql("SELECT * FROM sect"),
    "c12_first_of_key": sql("SELECT CASE WHEN n = 1 THEN 'kept' ELSE 'duplicate' END AS outcome, count(*) AS findings FROM (SELECT row_number() OVER (PARTITION BY run_id, kind, new_ref, old_ref ORDER BY finding_id) AS n FROM finding) GROUP BY 1"),
    "c14_supersession_edges": sql("SELECT * FROM edge"),
    "c16_costs": sql("SELECT l_orderkey AS run, CASE WHEN count(*) FILTER (WHERE l_suppkey % 40 = 39) = 0 THEN CAST(sum(CAST(l_quantity AS BIGINT) * (l_suppkey % 40 + 1)) AS BIGINT) END AS cost, count(*) AS attempts FROM line GROUP BY l_orderkey"),
    "ga01_lexicon_hits": sql(" UNION ALL ".join(f"SELECT id, {k[1:].split(',')[0]} AS category, {k[1:-1].split(', ')[1]} AS word FROM q WHERE {v}" for k, v in LEX.items())),
    "ga02_section_references": sql(
        "SELECT o.id, s.section, s.types FROM (SELECT id, base_agreement_id, unnest([id % 7, supplier % 7]) AS section FROM obligation WHERE base_agreement_id IS NOT NULL) o "
        "JOIN sect s ON s.agreement_id = o.base_agreement_id AND s.section = o.section"
    ),
    "ga03_signature_lines": sql("SELECT doc_id, at, at % 20 BETWEEN 6 AND 10 AS signature FROM seg"),
    "ga06_cascade": sql("SELECT * FROM decided"),
    "q19_gate_summary": sql("SELECT tier, count(*) AS decisions, count(*) FILTER (WHERE run_check) AS run, count(*) FILTER (WHERE NOT run_check) AS skipped FROM decided GROUP BY tier"),
    "m02_candidate_edges": sql('SELECT * FROM iou WHERE inter / "union" >= 0.3 OR 10 * inter = 3 * "union"'),
    "m05_label_scores": sql("SELECT * FROM prf1"),
    "m05_macro_scores": sql('SELECT round(avg("precision"), 4) AS "precision", round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1 FROM prf1 WHERE lang IS NOT NULL AND n_gold > 0'),
    "m06_field_accuracy": (
        "SELECT 'flag' AS field, count(*) AS pairs, round(count(*) FILTER (WHERE l_partkey % 3 <> 0 OR l_partkey % 6 = 0) / count(*), 6) AS coverage, "
        "round(count(*) FILTER (WHERE l_partkey % 3 <> 0) / count(*) FILTER (WHERE l_partkey % 3 <> 0 OR l_partkey % 6 = 0), 6) AS accuracy FROM lineitem "
        "UNION ALL SELECT 'line', count(*), round(count(*) FILTER (WHERE l_suppkey % 2 = 0 AND l_suppkey % 5 <> 0) / count(*) FILTER (WHERE l_suppkey % 2 = 0), 6), "
        "round(count(*) FILTER (WHERE l_suppkey % 2 = 0 AND l_suppkey % 5 <> 0 AND l_linenumber < 4) / count(*) FILTER (WHERE l_suppkey % 2 = 0 AND l_suppkey % 5 <> 0), 6) FROM lineitem"
    ),
    "m10_multiset_matches": (
        "SELECT CAST(sum(least(o, f)) AS BIGINT) AS matched, CAST(sum(o) AS BIGINT) AS n_gold, CAST(sum(f) AS BIGINT) AS n_pred FROM (SELECT count(*) FILTER (WHERE l_linestatus = 'O') AS o, count(*) FILTER (WHERE l_linestatus = 'F') AS f "
        "FROM lineitem GROUP BY l_suppkey, l_returnflag)"
    ),
    "m13_gate_metrics": sql(
        "SELECT count(*) AS decisions, count(*) FILTER (WHERE run_check AND p) AS caught, count(*) FILTER (WHERE NOT run_check AND p) AS missed, count(*) FILTER (WHERE NOT run_check AND NOT p) AS safe_skips, "
        "round(count(*) FILTER (WHERE run_check AND p) / count(*) FILTER (WHERE p), 6) AS recall FROM (SELECT *, (run_id + category) % 4 = 0 AS p FROM decided)"
    ),
    "m19_spread": "SELECT l_returnflag, round(avg(l_quantity), 4) AS mean, round(stddev_pop(l_quantity), 4) AS sd, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY l_returnflag",
    "b02_admitted": sql(
        "SELECT l_suppkey AS account, id AS at, CAST(l_quantity AS BIGINT) AS amount, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY id) <= 3000 AS admitted FROM line"
    ),
    "w05_party_dictionary": sql("SELECT count(DISTINCT name) AS names, count(DISTINCT name) AS ids FROM party"),
    "w01_replaced": sql(
        "SELECT version, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT id, CASE WHEN l_orderkey % 10 = 0 AND EXISTS (SELECT 1 FROM line m WHERE m.l_orderkey = l.l_orderkey AND m.id % 2 = 0) "
        "THEN CASE WHEN id % 2 = 0 THEN 'new' ELSE 'gone' END ELSE 'old' END AS version FROM line l) WHERE version <> 'gone' GROUP BY version"
    ),
    "w06_merged_events": sql(
        "SELECT agreement_id, key, CASE WHEN count(*) FILTER (WHERE flag = 'A') > 0 THEN CASE WHEN count(DISTINCT date) FILTER (WHERE flag = 'A') = 1 THEN min(date) FILTER (WHERE flag = 'A') END "
        "WHEN count(DISTINCT date) FILTER (WHERE flag = 'R') = 1 THEN min(date) FILTER (WHERE flag = 'R') END AS date FROM ev WHERE flag IN ('A', 'R') GROUP BY agreement_id, key"
    ),
    "w08_resolved_parties": sql(
        "SELECT o.id, coalesce((SELECT CASE WHEN count(DISTINCT party_id) = 1 THEN min(party_id) END FROM seen_party b WHERE b.agreement_id = o.agreement_id AND o.id % 2 = 0 AND b.role = CASE WHEN o.id % 4 = 0 THEN 'landlord' ELSE 'tenant' END), "
        "(SELECT CASE WHEN count(DISTINCT party_id) = 1 THEN min(party_id) END FROM seen_party b WHERE b.agreement_id = o.agreement_id AND b.name = p.name)) AS party_id FROM obligation o JOIN party p ON p.party_id = o.owed_to"
    ),
    "w09_resolved_anchors": sql(
        "SELECT o.id, coalesce((SELECT CASE WHEN count(*) = 1 THEN min(e.id) END FROM line e WHERE e.l_linenumber <= 3 AND e.l_orderkey = o.agreement_id AND e.l_suppkey % 3 = o.id % 3), "
        "(SELECT CASE WHEN count(*) = 1 THEN min(e.id) END FROM line e WHERE e.l_linenumber <= 3 AND e.l_orderkey = o.base_agreement_id AND e.l_suppkey % 3 = o.id % 3)) AS event_id FROM obligation o WHERE k IN (1, 2)"
    ),
    "s06_pins": "SELECT doc_id AS doc, CASE WHEN doc_id % 9 = 0 THEN 'no_pin' ELSE 'pin_mismatch' END AS fault FROM documents WHERE doc_id % 9 = 0 OR doc_id % 7 = 0",
    "s11_replay": sql("SELECT d.id, d.fingerprint, r.answer, r.answer IS NULL AS miss FROM digest d LEFT JOIN (SELECT fingerprint, max(id) AS answer FROM digest WHERE id % 6 <> 0 GROUP BY 1) r ON r.fingerprint = d.fingerprint"),
    "s15_validation_errors": sql(
        "SELECT id, error FROM (SELECT id, CASE WHEN l_suppkey % 50 <= l_partkey % 50 THEN 'empty_span' WHEN l_linenumber = 3 THEN 'bad_enum:status' WHEN l_partkey % 4 = 0 AND month(l_shipdate) < 10 THEN 'bad_date' "
        "WHEN l_suppkey % 3 = 0 AND l_suppkey % 6 <> 0 THEN 'anchor_iff_offset' END AS error FROM line) WHERE error IS NOT NULL"
    ),
    "s16_log_mismatches": sql(
        "SELECT r.agreement_id, r.run FROM (SELECT agreement_id, max(run) AS run FROM extr GROUP BY 1) r WHERE NOT EXISTS (SELECT 1 FROM (SELECT agreement_id, max(run) AS run FROM extr WHERE run % 5 <> 0 GROUP BY 1) l WHERE l.agreement_id = r.agreement_id AND l.run = r.run)"
    ),
}
