"""DuckDB oracles of ingest, grounding, verification and timing.

Quotes are laid over the lines' columns, so what a quote must yield is known
from the columns; these oracles read the columns and not the text.
"""

from __future__ import annotations

import re

from groundline.plans.overlay_sql import with_overlay

TEXT = {
    "seg": """
SELECT doc_id, row_number() OVER w - 1 AS at, coalesce(sum(length(span) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, span
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS span, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
WHERE length(span) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)""",
    "headed": """
SELECT doc_id, at, char_start, char_start + length(span) AS char_end,
       CASE WHEN at % 90 = 0 THEN 'article' WHEN at % 30 = 0 THEN 'section' WHEN at % 10 = 0 OR (at BETWEEN 11 AND 29 AND at % 2 = 0) THEN 'numbered' END AS kind,
       CASE WHEN at % 90 = 0 THEN CAST(at // 90 + 1 AS VARCHAR) WHEN at % 30 = 0 THEN CAST(at // 30 AS VARCHAR) WHEN at % 10 = 0 THEN '1.' || (at // 10)
            WHEN at BETWEEN 11 AND 29 AND at % 2 = 0 THEN '2.' || at END AS number, at BETWEEN 11 AND 29 AND at % 2 = 1 AND at % 10 <> 0 AS page_ref, span
FROM seg""",
    "q": """
SELECT *, id % 9 AS form, CAST(l_quantity AS INT) AS n, l_partkey % 4 AS unit, l_suppkey % 6 AS event, l_partkey % 11 AS marked,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_linenumber % 2 = 0 AS dated
FROM line""",
}


def sql(query: str) -> str:
    return re.sub(r"\bat\b", '"at"', with_overlay(query, TEXT))  # a reserved word


ORACLES = {
    "f01_offsets": (
        "WITH m AS (SELECT doc_id, regexp_extract_all(text, 'License|[*#%]{3}|the [a-z]+') AS ms, string_split_regex(text, 'License|[*#%]{3}|the [a-z]+') AS ps FROM documents), "
        "u AS (SELECT doc_id, unnest(ms) AS match, unnest(ps[:len(ms)]) AS gap, generate_subscripts(ms, 1) - 1 AS n FROM m WHERE len(ms) > 0) "
        "SELECT doc_id, n, (sum(length(gap) + length(match)) OVER (PARTITION BY doc_id ORDER BY n) - length(match))::BIGINT AS char_start, match FROM u"
    ),
    "g05_g06_markers": sql("SELECT id, marked = 0 AS redacted, marked = 1 AS blank FROM q"),
    "g05_redacted_documents": "SELECT doc_id FROM documents WHERE contains(text, '***') OR regexp_matches(lower(text), '\\[redacted\\]|\\[\\* \\* \\*\\]|\\[confidential treatment requested\\]')",
    "g03_passages": "SELECT b.item_id, d.doc_id, CAST(strpos(d.text, b.text) - 1 AS BIGINT) AS char_start FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "i02_folded": "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n\\f\\v]+', ' ', 'g')) AS folded FROM documents",
    "i05_segments": sql("SELECT doc_id, at, char_start, char_start + length(span) AS char_end FROM seg"),
    "i06_pages": sql(
        "SELECT doc_id, at // 40 + 1 AS page, min(char_start) AS char_start, coalesce(lead(min(char_start)) OVER (PARTITION BY doc_id ORDER BY at // 40), max(char_start + length(span))) AS char_end FROM seg GROUP BY doc_id, at // 40"
    ),
    "i07_sections": sql(
        "SELECT doc_id, at, kind, number, CASE WHEN at % 90 = 0 THEN '' WHEN at % 30 = 0 THEN trim(regexp_replace(string_split(heading, '. ')[1], '\\.$', '')) WHEN at % 10 = 0 THEN 'Heading of it' ELSE 'Contents line' END AS heading "
        "FROM (SELECT *, (SELECT string_agg(upper(w[1]) || lower(w[2:]), ' ' ORDER BY i) FROM (SELECT unnest(string_split(substr(span, 1, 20), ' ')) AS w, generate_subscripts(string_split(substr(span, 1, 20), ' '), 1) AS i)) || '. More' AS heading FROM headed) WHERE kind IS NOT NULL"
    ),
    "i09_carried": sql(
        "SELECT doc_id, at, last_value(CASE WHEN kind = 'article' THEN number END IGNORE NULLS) OVER w AS article, "
        "coalesce(last_value(CASE WHEN kind IN ('section', 'numbered') THEN number END IGNORE NULLS) OVER w, 's0000') AS section FROM headed WINDOW w AS (PARTITION BY doc_id ORDER BY at)"
    ),
    "i10_contents_runs": sql(
        "SELECT doc_id, min(at) AS first_line, count(*) AS marks FROM (SELECT h.doc_id, h.at FROM headed h JOIN headed p ON p.doc_id = h.doc_id AND p.at = h.at + 1 AND p.page_ref "
        "WHERE h.kind IS NOT NULL AND h.at BETWEEN 10 AND 28) GROUP BY doc_id HAVING count(*) >= 3"
    ),
    "i11_section_intervals": sql("SELECT doc_id, number AS section, char_start, coalesce(lead(char_start) OVER (PARTITION BY doc_id ORDER BY char_start), (SELECT max(char_end) FROM headed x WHERE x.doc_id = h.doc_id)) AS char_end FROM headed h WHERE kind IS NOT NULL"),
    "i14_structure_faults": sql("SELECT count(*) AS intervals, CAST(0 AS BIGINT) AS empty, CAST(0 AS BIGINT) AS gaps FROM (SELECT DISTINCT doc_id, at // 40 FROM seg)"),
    "i15_defined_terms": (
        "SELECT c_custkey AS id, c_name AS term, CAST(4 AS BIGINT) AS char_start FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'Lease', 13 FROM customer WHERE c_custkey % 4 = 1 "
        "UNION ALL SELECT c_custkey, 'Tenant', 33 + length(c_name) FROM customer WHERE c_custkey % 4 = 1"
    ),
    "e01_responses": sql(
        "SELECT id, CASE l_partkey % 7 WHEN 0 THEN 'refused' WHEN 1 THEN 'truncated' WHEN 2 THEN 'not_json' WHEN 3 THEN 'bad_keys' WHEN 4 THEN 'bad_value' ELSE 'ok' END AS outcome, "
        "CASE WHEN l_partkey % 7 > 4 THEN 't' || (l_partkey % 9) END AS type FROM line"
    ),
    "v04_money": sql("SELECT id, cents, CAST(1 AS BIGINT) AS n FROM q"),
    "v05_verified_fields": sql(
        "SELECT id, CASE WHEN id % 7 <> 0 THEN cents END AS amount, CASE WHEN id % 7 <> 0 THEN 'USD' END AS currency, CASE WHEN dated THEN CAST(l_shipdate AS DATE) END AS due_date, "
        "CASE WHEN NOT dated AND unit = 0 AND form IN (1, 2) THEN n WHEN NOT dated AND unit = 0 AND form = 3 THEN CASE WHEN event IN (1, 4) THEN n ELSE -n END END AS offset_days, "
        "CASE marked WHEN 0 THEN 'redacted' WHEN 1 THEN 'blank' ELSE 'active' END AS status, "
        "concat_ws(',', CASE WHEN id % 7 = 0 THEN 'amount' END, CASE WHEN dated AND unit = 0 AND form IN (1, 2, 3) THEN 'offset_days' END) AS corrections FROM q"
    ),
    "i13_lookups": sql(
        "SELECT p.doc_id, p.pos AS \"offset\", CASE WHEN pos < s.char_start + length(s.span) THEN s.at END AS segment, CASE WHEN pos < total THEN s.at // 40 + 1 END AS page "
        "FROM (SELECT doc_id, unnest(generate_series(7, total + 40, 40)) AS pos, total FROM (SELECT doc_id, max(char_start + length(span)) AS total FROM seg GROUP BY doc_id)) p "
        "ASOF LEFT JOIN seg s ON s.doc_id = p.doc_id AND p.pos >= s.char_start"
    ),
    "f06_spelled": (
        "WITH w AS (SELECT ['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen'] AS ones, "
        "['twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety'] AS tens), "
        "s AS (SELECT n, n % 100 AS r, ones, tens FROM (SELECT unnest(range(1, 121)) AS n), w) "
        "SELECT CAST(n AS INT) AS n, CAST(n AS INT) AS back, trim(CASE WHEN n > 99 THEN 'one hundred ' ELSE '' END || CASE WHEN r = 0 THEN '' WHEN r < 20 THEN ones[r] WHEN r % 10 = 0 THEN tens[r // 10 - 1] ELSE tens[r // 10 - 1] || '-' || ones[r % 10] END) AS words FROM s"
    ),
    "f11_formats": sql(
        "SELECT id, CASE WHEN l_linenumber = 3 THEN '-' ELSE format('{:.1f}%', l_linenumber * 12.5) END AS percent, CASE WHEN l_linenumber = 3 THEN '-' ELSE format('{:.4f}', l_linenumber / 8) END AS dollars, "
        "CASE WHEN l_linenumber = 3 THEN '-' ELSE format('{:.3f}', l_linenumber / 8) END AS ratio FROM line"
    ),
}
