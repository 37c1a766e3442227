"""DuckDB oracles of the views: correlated subqueries where the engine joins."""

from __future__ import annotations

from groundline.plans.overlay_sql import with_overlay

VIEWS = {
    "fresh_run": """
SELECT run_id, change_order, chain_size, mode FROM change_run r
WHERE completed AND (SELECT count(*) FROM chain k WHERE k.run_id = r.run_id) = chain_size
  AND EXISTS (SELECT 1 FROM chain k WHERE k.run_id = r.run_id AND k.agreement_id = r.change_order AND k.position = r.chain_size - 1)
  AND NOT EXISTS (SELECT 1 FROM chain k LEFT JOIN extraction e ON e.agreement_id = k.agreement_id AND e.text_hash = k.text_hash AND e.complete
                  WHERE k.run_id = r.run_id AND e.agreement_id IS NULL)""",
    "cited_obligation": """
SELECT o.* FROM obligation o WHERE EXISTS (SELECT 1 FROM clause_ref c WHERE c.obligation_id = o.id AND c.grounded AND c.agreement_id = o.agreement_id)""",
    "own_ref": "SELECT c.* FROM clause_ref c JOIN obligation o ON o.id = c.obligation_id AND o.agreement_id = c.agreement_id WHERE c.grounded",
    "cited_event": "SELECT * FROM event WHERE grounded AND cited_in = agreement_id",
    "seen_timing": """
SELECT t.obligation_id, o.agreement_id, t.kind, t.relation, t.offset_days, t.anchor_agreement, t.bound_date
FROM timing t JOIN cited_obligation o ON o.id = t.obligation_id LEFT JOIN cited_event e ON e.agreement_id = t.anchor_agreement
WHERE (t.trigger_start IS NULL OR t.trigger_grounded AND EXISTS (SELECT 1 FROM own_ref c WHERE c.obligation_id = o.id AND c.char_start <= t.trigger_start AND t.trigger_end <= c.char_end))
  AND (t.anchor_agreement IS NULL OR e.agreement_id IS NOT NULL AND t.anchor_agreement IN (o.agreement_id, coalesce(o.base_agreement_id, o.agreement_id)))
  AND (t.kind <> 'scheduled' OR t.bound_date = e.event_date + coalesce(t.offset_days, 0))""",
    "edge": """
SELECT run_id, new_ref AS obligation_id, min(old_ref) AS superseded_id, new_ref AS ref_id FROM finding
WHERE kind = 'supersedes' AND old_ref IS NOT NULL AND resolution <> 'document' GROUP BY run_id, new_ref HAVING count(*) = 1""",
    "eligible_edge": """
SELECT s.run_id, s.obligation_id, s.superseded_id, ko.position AS old_position, kn.position AS new_position
FROM edge s JOIN fresh_run r ON r.run_id = s.run_id AND r.mode = 'ungated' JOIN clause_ref x ON x.ref_id = s.ref_id AND x.grounded AND x.agreement_id = s.run_id JOIN obligation n ON n.id = s.obligation_id AND n.agreement_id = s.run_id JOIN obligation o ON o.id = s.superseded_id
JOIN chain kn ON kn.run_id = s.run_id AND kn.agreement_id = n.agreement_id JOIN chain ko ON ko.run_id = s.run_id AND ko.agreement_id = o.agreement_id
WHERE ko.position < kn.position AND n.id IN (SELECT id FROM cited_obligation) AND o.id IN (SELECT id FROM cited_obligation)""",
    "seen_obligation": """
SELECT o.id, o.agreement_id, o.type, o.cents, o.status, o.due_date, o.offset_days, o.owed_by, o.owed_to, o.supplier, o.anchor_agreement,
       coalesce(t.kind, 'untimed') AS timing_kind, t.relation, t.bound_date,
       coalesce(o.due_date, e.event_date + o.offset_days, CASE WHEN t.kind = 'scheduled' AND t.relation = 'lte' THEN t.bound_date END) AS effective_due,
       CASE WHEN o.status = 'superseded' OR EXISTS (SELECT 1 FROM eligible_edge s WHERE s.superseded_id = o.id) THEN 'superseded'
            WHEN o.due_date IS NOT NULL OR e.event_date + o.offset_days IS NOT NULL OR t.kind = 'scheduled' THEN 'scheduled' ELSE 'pending' END AS lifecycle
FROM cited_obligation o LEFT JOIN cited_event e ON e.agreement_id = o.anchor_agreement LEFT JOIN seen_timing t ON t.obligation_id = o.id""",
    "seen_party": """
SELECT b.agreement_id, b.party_id, p.name, b.role FROM agreement_party b JOIN party p ON p.party_id = b.party_id WHERE b.grounded""",
    "seen_site": """
SELECT agreement_id, site, location FROM agreement_site s WHERE EXISTS (SELECT 1 FROM clause_ref c WHERE c.agreement_id = s.agreement_id AND c.grounded)""",
    "guarantee": """
SELECT a.id AS guarantee_id, b.id AS guaranteed_id, CASE WHEN a.id % 2 = 0 THEN a.id ELSE b.id END AS ref_id
FROM obligation a JOIN obligation b ON b.id = a.id + 1 WHERE a.id % 3 = 0""",
    "trigger_": """
SELECT o.id, f.by_id, CASE WHEN o.id % 2 = 0 THEN o.id ELSE f.by_id END AS ref_id
FROM obligation o JOIN (SELECT agreement_id, min(id) AS by_id FROM obligation GROUP BY agreement_id) f ON f.agreement_id = o.base_agreement_id WHERE o.id % 5 = 0""",
    "seen_finding": """
SELECT f.* FROM finding f
WHERE f.run_id IN (SELECT run_id FROM fresh_run)
  AND EXISTS (SELECT 1 FROM clause_ref c WHERE c.ref_id = f.new_ref AND c.grounded AND c.agreement_id = f.run_id)
  AND (f.old_ref IS NULL OR f.old_ref IN (SELECT c.ref_id FROM clause_ref c JOIN chain k ON k.agreement_id = c.agreement_id
                                          WHERE k.run_id = f.run_id AND c.grounded AND c.agreement_id <> f.run_id))""",
}


def sql(query: str) -> str:
    return with_overlay(query, VIEWS)


ORACLES = {
    "d01_fresh_change_run": sql("SELECT * FROM fresh_run"),
    "d02_eligible_supersedes": sql("SELECT * FROM eligible_edge"),
    "d03_grounded_obligation": sql("SELECT id, agreement_id, type, cents, status, due_date, offset_days FROM cited_obligation"),
    "d04_visible_timing": sql("SELECT * FROM seen_timing"),
    "d05_visible_obligation": sql("SELECT * FROM seen_obligation"),
    "d06_visible_supersedes": sql("SELECT run_id, obligation_id, superseded_id FROM eligible_edge"),
    "d07_visible_guarantees": sql(
        "SELECT g.* FROM guarantee g JOIN clause_ref c ON c.ref_id = g.ref_id AND c.grounded "
        "WHERE c.agreement_id = (SELECT agreement_id FROM obligation WHERE id = g.guarantee_id) "
        "AND g.guarantee_id IN (SELECT id FROM seen_obligation) AND g.guaranteed_id IN (SELECT id FROM seen_obligation)"
    ),
    "d08_visible_triggers": sql(
        "SELECT t.* FROM trigger_ t JOIN clause_ref c ON c.ref_id = t.ref_id AND c.grounded "
        "WHERE t.id IN (SELECT id FROM seen_obligation) AND t.by_id IN (SELECT id FROM seen_obligation)"
    ),
    "d09_party_binding": sql("SELECT * FROM seen_party"),
    "d10_visible_finding": sql("SELECT finding_id, run_id, kind, category, old_origin, new_ref, old_ref FROM seen_finding"),
    "d11_obligation_clause": sql(
        "SELECT o.id, o.agreement_id, c.ref_id, c.section, c.page, c.char_start, c.char_end FROM seen_obligation o JOIN own_ref c ON c.obligation_id = o.id"
    ),
    "d12_event_binding": sql("SELECT agreement_id AS event_agreement, event_date FROM cited_event"),
    "d12_site_binding": sql("SELECT * FROM seen_site"),
    "d13_finding_refs": sql(
        "SELECT f.finding_id, 'new' AS side, c.ref_id, c.agreement_id, c.section, c.char_start, c.char_end FROM seen_finding f JOIN clause_ref c ON c.ref_id = f.new_ref "
        "UNION ALL SELECT f.finding_id, 'old', c.ref_id, c.agreement_id, c.section, c.char_start, c.char_end FROM seen_finding f JOIN clause_ref c ON c.ref_id = f.old_ref"
    ),
    "d09_defined_term": sql("SELECT d.*, c.section, c.char_start FROM defined_term d JOIN clause_ref c ON c.ref_id = d.ref_id AND c.grounded AND c.agreement_id = d.agreement_id"),
    "d14_citation_violations": sql(
        "SELECT 'clause_ref' AS relation, count(*) AS violations FROM clause_ref c JOIN obligation o ON o.id = c.obligation_id WHERE o.agreement_id <> c.agreement_id "
        "UNION ALL SELECT 'event', count(*) FROM event WHERE cited_in <> agreement_id "
        "UNION ALL SELECT 'defined_term', count(*) FROM defined_term d WHERE NOT EXISTS (SELECT 1 FROM clause_ref c WHERE c.ref_id = d.ref_id AND c.agreement_id = d.agreement_id) "
        "UNION ALL SELECT 'guarantees', count(*) FROM guarantee g JOIN clause_ref c ON c.ref_id = g.ref_id JOIN obligation o ON o.id = g.guarantee_id WHERE o.agreement_id <> c.agreement_id"
    ),
    "d15_constraint_violations": sql(
        "SELECT 'clause_ref.span_not_empty' AS rule, (SELECT count(*) FROM clause_ref WHERE char_end <= char_start) AS violations "
        "UNION ALL SELECT 'obligation.anchor_iff_offset', (SELECT count(*) FROM obligation WHERE (anchor_agreement IS NULL) <> (offset_days IS NULL)) "
        "UNION ALL SELECT 'obligation.due_xor_anchor', (SELECT count(*) FROM obligation WHERE due_date IS NOT NULL AND anchor_agreement IS NOT NULL) "
        "UNION ALL SELECT 'obligation.status', 0 "
        "UNION ALL SELECT 'timing.scheduled_has_bound', (SELECT count(*) FROM timing WHERE kind = 'scheduled' AND bound_date IS NULL) "
        "UNION ALL SELECT 'timing.trigger_in_order', (SELECT count(*) FROM timing WHERE trigger_end <= trigger_start) "
        "UNION ALL SELECT 'change_run.chain_size', (SELECT count(*) FROM change_run WHERE chain_size < 2)"
    ),
    "g07_ungrounded": sql("SELECT count(*) AS ungrounded FROM seen_obligation o WHERE NOT EXISTS (SELECT 1 FROM own_ref c WHERE c.obligation_id = o.id)"),
}
