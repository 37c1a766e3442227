"""DuckDB oracles of the read API."""

from __future__ import annotations

from groundline.plans.views_sql import sql

LIVE = "(SELECT * FROM seen_obligation WHERE lifecycle <> 'superseded')"
PAYEE = "EXISTS (SELECT 1 FROM seen_party p WHERE p.agreement_id = o.agreement_id AND p.party_id = o.owed_to AND {})"
UNBOUND = (
    "count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM seen_party p WHERE p.agreement_id = o.agreement_id AND p.party_id = o.owed_by) "
    "OR NOT EXISTS (SELECT 1 FROM seen_party p WHERE p.agreement_id = o.agreement_id AND p.party_id = o.owed_to))"
)
ID = "o.id, o.agreement_id, o.effective_due, o.lifecycle"
ORDER = "ORDER BY effective_due IS NULL, effective_due, agreement_id, id"
WINDOW = "coalesce(bound_date, effective_due) BETWEEN DATE '1997-01-01' AND DATE '1997-04-01'"

ORACLES = {
    "q01_list_agreements": sql(
        "SELECT a.agreement_id, a.filing_date, a.base_agreement_id, a.agreement_type, (SELECT count(*) FROM seen_obligation o WHERE o.agreement_id = a.agreement_id) AS obligations, "
        "(SELECT string_agg(role || ':' || name, '; ' ORDER BY role || ':' || name) FROM seen_party p WHERE p.agreement_id = a.agreement_id) AS parties, s.site, s.location "
        "FROM agreement a LEFT JOIN seen_site s ON s.agreement_id = a.agreement_id"
    ),
    "q02_page": sql(f"SELECT {ID} FROM {LIVE} o WHERE o.type = 't3' {ORDER} LIMIT 50 OFFSET 100"),
    "q02_header": sql(
        "SELECT count(*) AS total, CAST(50 AS BIGINT) AS returned, count(*) > 150 AS truncated, " + UNBOUND + f" AS unresolved FROM {LIVE} o WHERE o.type = 't3'"
    ),
    "q03_party_role": sql(f"SELECT {ID} FROM {LIVE} o WHERE " + PAYEE.format("p.role = 'landlord'")),
    "q03_party_name": sql(f"SELECT {ID} FROM {LIVE} o WHERE " + PAYEE.format("instr(lower(p.name), '00001') > 0")),
    "q03_site": sql(f"SELECT {ID} FROM {LIVE} o WHERE EXISTS (SELECT 1 FROM seen_site s WHERE s.agreement_id = o.agreement_id AND (instr(lower(s.site), 'asia') > 0 OR instr(lower(s.location), 'asia') > 0))"),
    "q04_order": sql(f"SELECT id, row_number() OVER ({ORDER}) AS place FROM {LIVE} WHERE type = 't5' AND status = 'redacted'"),
    "q05_unresolved": sql("SELECT " + UNBOUND + f" AS unresolved FROM {LIVE} o"),
    "q07_hydrated": sql(
        "SELECT o.id, o.agreement_id, (SELECT min(name) FROM seen_party p WHERE p.agreement_id = o.agreement_id AND p.party_id = o.owed_to) AS payee, "
        "(SELECT max(role) FROM seen_party p WHERE p.agreement_id = o.agreement_id AND p.party_id = o.owed_to) AS payee_role, "
        "(SELECT min(role) FROM seen_party p WHERE p.agreement_id = o.agreement_id AND p.party_id = o.owed_to) AS first_role, "
        "CASE o.status WHEN 'redacted' THEN '[REDACTED]' WHEN 'blank' THEN '[BLANK]' END AS marker, "
        "CASE WHEN cents % 100 = 0 THEN CAST(cents // 100 AS VARCHAR) ELSE (cents // 100) || '.' || rtrim(lpad(CAST(cents % 100 AS VARCHAR), 2, '0'), '0') END AS amount, "
        "(SELECT min(char_start) FROM own_ref c WHERE c.obligation_id = o.id) AS first_start, "
        "(SELECT count(*) FROM own_ref c WHERE c.obligation_id = o.id) AS n_clauses, "
        "(SELECT event_date FROM cited_event e WHERE e.agreement_id = o.agreement_id AND o.anchor_agreement = o.agreement_id) AS anchor_date, "
        "CASE WHEN o.timing_kind = 'scheduled' AND o.bound_date IS NOT NULL THEN o.relation || ' ' || strftime(o.bound_date, '%Y-%m-%d') END AS deadline, "
        "coalesce((SELECT string_agg(CAST(s.obligation_id AS VARCHAR), ',' ORDER BY s.obligation_id) FROM eligible_edge s WHERE s.superseded_id = o.id), '') AS superseded_by "
        "FROM seen_obligation o WHERE o.type = 't2'"
    ),
    "q13_due_window": sql(f"SELECT id, agreement_id, lifecycle, coalesce(bound_date, effective_due) AS due FROM seen_obligation WHERE lifecycle = 'scheduled' AND {WINDOW}"),
    "q13_due_window_party": sql(f"SELECT id, agreement_id, lifecycle, coalesce(bound_date, effective_due) AS due FROM seen_obligation o WHERE lifecycle = 'scheduled' AND {WINDOW} AND " + PAYEE.format("p.role = 'provider'")),
    "q14_pending_partition": sql(
        "SELECT count(*) AS pending, count(*) FILTER (WHERE timing_kind = 'contingent') AS contingent, count(*) FILTER (WHERE timing_kind = 'unresolved') AS unresolved, "
        "count(*) FILTER (WHERE timing_kind NOT IN ('contingent', 'unresolved')) AS untimed FROM seen_obligation WHERE lifecycle = 'pending'"
    ),
    "q15_contingent_page": sql(f"SELECT {ID} FROM seen_obligation o WHERE lifecycle = 'pending' AND timing_kind = 'contingent' {ORDER} LIMIT 25 OFFSET 10"),
    "q16_window_unresolved": sql("SELECT " + UNBOUND + f" AS unresolved FROM seen_obligation o WHERE lifecycle = 'pending' OR (lifecycle = 'scheduled' AND {WINDOW})"),
    "q17_resolve_document": (
        "WITH c AS (SELECT c_custkey AS doc, 'd' || c_custkey AS doc_key, 'data/' || c_mktsegment || '/' || (c_custkey % 500) AS path, CAST(c_custkey % 700 AS VARCHAR) AS name, sha256(c_name) AS digest FROM customer), "
        "w AS (SELECT DISTINCT unnest([doc_key, path, name, digest, 'none' || doc]) AS text FROM c), "
        "h AS (SELECT w.text, s.step, count(*) AS n, min(s.doc) AS doc FROM w JOIN (SELECT doc, doc_key AS key, 0 AS step FROM c UNION ALL SELECT doc, path, 1 FROM c "
        "UNION ALL SELECT doc, name, 2 FROM c UNION ALL SELECT doc, digest, 3 FROM c) s ON s.key = w.text GROUP BY ALL) "
        "SELECT w.text, CASE WHEN h.n = 1 THEN h.doc END AS doc, CAST(h.step AS BIGINT) AS step FROM w LEFT JOIN h ON h.text = w.text AND h.step = (SELECT min(step) FROM h i WHERE i.text = w.text)"
    ),
    "q18_run_status": sql(
        "SELECT agreement_id, CASE WHEN agreement_id IN (SELECT run_id FROM fresh_run) THEN 'ok' WHEN agreement_id IN (SELECT run_id FROM change_run WHERE completed) THEN 'stale' ELSE 'missing' END AS run_status "
        "FROM agreement WHERE base_agreement_id IS NOT NULL"
    ),
    "q21_grouped_findings": sql(
        "SELECT run_id, kind, new_ref, old_ref, string_agg(DISTINCT CAST(category AS VARCHAR), ',' ORDER BY CAST(category AS VARCHAR)) AS categories, min(finding_id) AS finding_id FROM seen_finding GROUP BY run_id, kind, new_ref, old_ref"
    ),
    "q22_new_obligations": sql(
        "SELECT o.id, o.agreement_id, c.ref_id, c.char_start FROM seen_obligation o JOIN own_ref c ON c.obligation_id = o.id "
        "WHERE o.agreement_id IN (SELECT run_id FROM fresh_run) AND o.id NOT IN (SELECT obligation_id FROM eligible_edge) QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY c.char_start, c.ref_id) = 1"
    ),
    "q23_unresolved_documents": "SELECT doc_id, alias FROM documents, (VALUES ('License'), ('the and'), ('***'), ('Lizenz')) v(alias) WHERE contains(text, alias)",
}
