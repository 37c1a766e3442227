"""The overlay of overlay.py in DuckDB's SQL, as named subqueries for the oracles."""

from __future__ import annotations

import re

CTES = {
    "agreement": """
SELECT o_orderkey AS agreement_id, o_custkey AS customer, CAST(o_orderdate AS DATE) AS filing_date,
       nullif(first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderkey) AS base_agreement_id,
       o_orderstatus = 'P' AS is_form, o_orderpriority AS agreement_type
FROM orders""",
    "line": """
SELECT *, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS id
FROM lineitem""",
    "obligation": """
SELECT id, l_orderkey AS agreement_id, 't' || (l_partkey % 9) AS type, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_partkey % 4 AS k,
       CASE WHEN l_partkey % 4 = 0 THEN CAST(l_shipdate AS DATE) END AS due_date,
       CASE WHEN l_partkey % 4 IN (1, 2) THEN CAST(l_quantity AS INT) * CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END END AS offset_days,
       CASE WHEN l_returnflag = 'R' AND l_partkey % 5 = 0 THEN 'redacted' WHEN l_returnflag = 'A' AND l_partkey % 5 = 1 THEN 'blank' WHEN l_suppkey % 17 = 5 THEN 'superseded' ELSE 'active' END AS status,
       a.customer * 2 AS owed_by, l_suppkey * 2 + 1 AS owed_to, l_suppkey AS supplier, l_linenumber AS line,
       CASE l_partkey % 4 WHEN 1 THEN l_orderkey WHEN 2 THEN coalesce(a.base_agreement_id, l_orderkey) END AS anchor_agreement, a.base_agreement_id
FROM line JOIN agreement a ON a.agreement_id = l_orderkey""",
    "event": """
SELECT o_orderkey AS agreement_id, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS DATE) END AS event_date, o_orderkey % 8 <> 0 AS grounded,
       CASE WHEN o_orderkey % 19 = 7 THEN o_orderkey + 1 ELSE o_orderkey END AS cited_in FROM orders""",
    "clause_ref": """
SELECT ref_id, obligation_id, agreement_id, section, char_start // 2000 + 1 AS page, char_start, char_start + 20 + size AS char_end, grounded FROM (
SELECT id AS ref_id, id AS obligation_id, l_orderkey AS agreement_id, l_partkey % 7 AS section, (l_partkey % 500) * 10 AS char_start, CAST(l_quantity AS BIGINT) AS size, l_suppkey % 10 <> 3 AS grounded FROM line
UNION ALL SELECT id + 1000000000000, id, l_orderkey, (l_partkey % 7 + 1) % 7, (l_partkey % 500) * 10 + 300, CAST(l_quantity AS BIGINT), l_suppkey % 4 <> 1 FROM line WHERE l_linenumber % 3 = 1
UNION ALL SELECT id + 2000000000000, id, l_orderkey % 1000 + 1, l_partkey % 7, (l_partkey % 500) * 10, CAST(l_quantity AS BIGINT), true FROM line WHERE l_partkey % 97 = 0)""",
    "main_ref": "SELECT * FROM clause_ref WHERE ref_id = obligation_id",
    "defined_term": """
SELECT agreement_id, 'Term ' || (agreement_id % 10) AS term, CASE WHEN agreement_id % 13 = 5 THEN coalesce(base_agreement_id, agreement_id) ELSE agreement_id END * 100 + 1 AS ref_id FROM agreement""",
    "timing": """
SELECT t.*, CASE WHEN kind = 'scheduled' THEN e.event_date + offset_days + wrong END AS bound_date FROM (
SELECT l.id AS obligation_id, CASE l_suppkey % 5 WHEN 2 THEN 'contingent' WHEN 3 THEN 'unresolved' ELSE 'scheduled' END AS kind,
       CASE l_suppkey % 5 WHEN 0 THEN 'lt' WHEN 1 THEN 'lte' END AS relation, CAST(l_quantity AS INT) AS offset_days,
       CASE WHEN l_suppkey % 7 <> 3 THEN (l_partkey % 500) * 10 + 2 END AS trigger_start,
       CASE WHEN l_suppkey % 7 <> 3 THEN (l_partkey % 500) * 10 + CASE WHEN l_linenumber % 6 = 5 THEN 100 ELSE 12 END END AS trigger_end, l_suppkey % 9 <> 4 AS trigger_grounded,
       CASE WHEN l_suppkey % 5 < 2 OR l_suppkey % 2 = 1 THEN CASE WHEN l_linenumber % 3 = 0 THEN coalesce(a.base_agreement_id, l_orderkey) WHEN l_linenumber = 5 THEN l_orderkey % 1000 + 1 ELSE l_orderkey END END AS anchor_agreement,
       CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS wrong
FROM line l JOIN agreement a ON a.agreement_id = l_orderkey WHERE l_partkey % 4 = 3 AND l_suppkey % 5 < 4) t LEFT JOIN event e ON e.agreement_id = t.anchor_agreement""",
    "agreement_party": """
SELECT o_orderkey AS agreement_id, o_custkey * 2 AS party_id, 'tenant' AS role, true AS grounded FROM orders WHERE (o_custkey + o_orderkey) % 5 <> 0
UNION ALL
SELECT DISTINCT l_orderkey, l_suppkey * 2 + 1, CASE WHEN l_suppkey % 2 = 0 THEN 'landlord' ELSE 'provider' END, l_suppkey % 10 <> 3
FROM lineitem WHERE (l_suppkey + l_orderkey) % 5 <> 0""",
    "party": """
SELECT c_custkey * 2 AS party_id, c_name AS name FROM customer UNION ALL SELECT s_suppkey * 2 + 1, s_name FROM supplier""",
    "agreement_site": """
SELECT agreement_id, n_name AS site, r_name AS location
FROM agreement JOIN customer ON c_custkey = customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "chain": """
SELECT h.agreement_id AS run_id, m.agreement_id,
       row_number() OVER (PARTITION BY h.agreement_id ORDER BY m.agreement_id = h.agreement_id, m.agreement_id <> h.base_agreement_id, m.filing_date, m.agreement_id) - 1 AS position,
       CASE WHEN m.agreement_id = h.agreement_id THEN 'change_order' WHEN m.agreement_id = h.base_agreement_id THEN 'base' ELSE 'amendment' END AS role,
       CASE WHEN h.agreement_id % 7 = 0 THEN 'old' ELSE 'now' END AS text_hash
FROM agreement h JOIN agreement m ON coalesce(m.base_agreement_id, m.agreement_id) = h.base_agreement_id
WHERE m.base_agreement_id IS NULL OR m.filing_date < h.filing_date OR m.agreement_id = h.agreement_id""",
    "change_run": """
SELECT run_id, run_id AS change_order, run_id % 11 <> 0 AS completed, count(*) + CASE WHEN run_id % 13 = 0 THEN 1 ELSE 0 END AS chain_size,
       CASE WHEN run_id % 5 = 2 THEN 'gated' ELSE 'ungated' END AS mode FROM chain GROUP BY run_id""",
    "extraction": """
SELECT o_orderkey AS agreement_id, 'now' AS text_hash, o_orderkey % 17 <> 0 AS complete FROM orders""",
    "finding": """
SELECT n.ref_id * 100000 + o.ref_id % 100000 AS finding_id, n.agreement_id AS run_id,
       CASE n.ref_id % 4 WHEN 0 THEN 'supersedes' WHEN 1 THEN 'shifted_date' WHEN 2 THEN 'price_change' ELSE 'potential_conflict' END AS kind,
       o.ref_id % 6 AS category, CASE WHEN o.ref_id % 5 = 0 THEN 'unresolved' ELSE 'chain' END AS old_origin,
       n.ref_id AS new_ref, CASE WHEN o.ref_id % 5 <> 0 THEN o.ref_id END AS old_ref,
       CASE n.ref_id % 3 WHEN 0 THEN 'section' WHEN 1 THEN 'range' ELSE 'document' END AS resolution, np.type
FROM main_ref n JOIN obligation np ON np.id = n.obligation_id
JOIN main_ref o ON o.agreement_id = np.base_agreement_id JOIN obligation op ON op.id = o.obligation_id AND op.type = np.type
WHERE o.char_start < n.char_end AND o.char_end > n.char_start""",
}


def with_overlay(query: str, extra: dict[str, str] | None = None) -> str:
    """`query` with the named subqueries it needs, directly or through others, in front of it."""
    known = CTES | (extra or {})
    names = list(known)
    wanted: set[str] = set()
    todo = [query]
    while todo:
        text = todo.pop()
        found = {n for n in names if re.search(rf"\b{n}\b", text)} - wanted
        wanted |= found
        todo += [known[n] for n in found]
    parts = ",\n".join(f"{n} AS ({known[n]})" for n in names if n in wanted)
    return f"WITH {parts}\n{query}" if parts else query
