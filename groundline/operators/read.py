"""Read API over the visible graph: listings, filters, deadline windows, change reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.operators import views
from groundline.plans.overlay import Graph

MAX_LIMIT = 500
ROLES = ("tenant", "landlord", "provider")


def check_page(limit: int, offset: int) -> None:
    """Q06: 1 <= limit <= MAX_LIMIT and offset >= 0."""
    if not 1 <= limit <= MAX_LIMIT or offset < 0:
        raise ValueError(f"limit must be in 1..{MAX_LIMIT} and offset at least 0")


def ordered(rows: DataFrame) -> DataFrame:
    """Q04: dated rows first, by date, agreement and id."""
    return rows.orderBy(F.col("effective_due").asc_nulls_last(), "agreement_id", "id")


def list_agreements(g: Graph) -> DataFrame:
    """Q01: agreements with counts of visible obligations and their cited parties, by role and id."""
    counts = views.visible_obligation(g).groupBy(F.col("agreement_id").alias("_a")).agg(F.count(F.lit(1)).alias("n"))
    parties = views.visible_party_binding(g).groupBy(F.col("agreement_id").alias("_p")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "role", "name"))), "; ").alias("parties"))
    sites = views.visible_site_binding(g).select(F.col("agreement_id").alias("_s"), "site", "location")
    rows = g.agreement.join(counts, F.col("agreement_id") == F.col("_a"), "left").join(parties, F.col("agreement_id") == F.col("_p"), "left").join(sites, F.col("agreement_id") == F.col("_s"), "left")
    return rows.select("agreement_id", "filing_date", "base_agreement_id", "agreement_type", F.coalesce("n", F.lit(0)).cast("long").alias("obligations"), "parties", "site", "location")


def obligations(
    g: Graph,
    party: str | None = None,
    site: str | None = None,
    type_: str | None = None,
    status: str | None = None,
    lifecycle: str | None = None,
    agreement: int | None = None,
    include_superseded: bool = False,
) -> DataFrame:
    """Q02, Q03: visible obligations under conjunctive filters. `party` is who is owed: a role, or part of a name."""
    rows = views.visible_obligation(g)
    for column, value in (("type", type_), ("status", status), ("lifecycle", lifecycle), ("agreement_id", agreement)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if not include_superseded:
        rows = rows.where("lifecycle <> 'superseded'")
    if party is not None:
        bound = views.visible_party_binding(g)
        fits = bound.where(F.col("role") == party.lower()) if party.lower() in ROLES else bound.where(F.lower("name").contains(party.lower()))
        fits = fits.select(F.col("agreement_id").alias("_a"), F.col("party_id").alias("_p"))
        rows = rows.join(fits, (F.col("agreement_id") == F.col("_a")) & (F.col("owed_to") == F.col("_p")), "left_semi")
    if site is not None:
        places = views.visible_site_binding(g).where(F.lower("site").contains(site.lower()) | F.lower("location").contains(site.lower()))
        rows = rows.join(places.select(F.col("agreement_id").alias("_s")), F.col("agreement_id") == F.col("_s"), "left_semi")
    return rows


def page(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Q02: one page in the order of Q04."""
    check_page(limit, offset)
    return ordered(rows).offset(offset).limit(limit)


def page_header(rows: DataFrame, unresolved: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Q02: total before paging, rows returned, whether more follow, and unresolved parties."""
    check_page(limit, offset)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return total.crossJoin(unresolved).select(
        "total",
        F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - offset)).cast("long").alias("returned"),
        (F.col("total") > offset + limit).alias("truncated"),
        "unresolved",
    )  # two one-row frames


def unresolved_parties(g: Graph, rows: DataFrame) -> DataFrame:
    """Q05: how many obligations lack a visible binding of payer or payee."""
    bound = views.visible_party_binding(g).select("agreement_id", "party_id").distinct()
    by = bound.select(F.col("agreement_id").alias("_a1"), F.col("party_id").alias("_p1"))
    to = bound.select(F.col("agreement_id").alias("_a2"), F.col("party_id").alias("_p2"))
    flagged = rows.join(by, (F.col("agreement_id") == F.col("_a1")) & (F.col("owed_by") == F.col("_p1")), "left").join(
        to, (F.col("agreement_id") == F.col("_a2")) & (F.col("owed_to") == F.col("_p2")), "left"
    )
    return flagged.agg(F.count_if(F.col("_p1").isNull() | F.col("_p2").isNull()).alias("unresolved"))


def hydrated(g: Graph, rows: DataFrame) -> DataFrame:
    """Q07-Q12: obligations with clauses, bindings, anchors, deadlines and what superseded them; each map is aggregated before its join."""
    ids = rows.select(F.col("id").alias("_i"), F.col("agreement_id").alias("_g"))
    clauses = views.visible_obligation_clause(g).join(ids, (F.col("agreement_id") == F.col("_g")) & (F.col("id") == F.col("_i")), "left_semi").groupBy(F.col("agreement_id").alias("_ca"), F.col("id").alias("_c")).agg(
        F.array_sort(F.collect_list(F.struct("char_start", "ref_id", "section", "page", "char_end"))).alias("clauses")
    )
    party = views.visible_party_binding(g).groupBy(F.col("agreement_id").alias("_pa"), F.col("party_id").alias("_pp")).agg(
        F.first("name").alias("payee"), F.max("role").alias("payee_role"), F.min("role").alias("first_role")
    )
    event = views.visible_event_binding(g).select(F.col("event_agreement").alias("_e"), F.col("event_date").alias("_anchor"))
    edge = views.visible_supersedes(g).groupBy(F.col("superseded_id").alias("_s")).agg(F.array_sort(F.collect_list("obligation_id")).alias("superseded_by"))
    out = (
        rows.join(clauses, (F.col("agreement_id") == F.col("_ca")) & (F.col("id") == F.col("_c")))
        .join(party, (F.col("agreement_id") == F.col("_pa")) & (F.col("owed_to") == F.col("_pp")), "left")
        .join(event, (F.col("agreement_id") == F.col("_e")) & (F.col("anchor_agreement") == F.col("agreement_id")), "left")
        .join(edge, F.col("id") == F.col("_s"), "left")
    )
    return out.select(
        "id", "agreement_id", "payee", "payee_role", "first_role", marker(F.col("status")).alias("marker"), amount_text(F.col("cents")).alias("amount"),
        F.element_at("clauses", 1)["char_start"].alias("first_start"), F.size("clauses").cast("long").alias("n_clauses"), F.col("_anchor").alias("anchor_date"),
        F.when((F.col("timing_kind") == "scheduled") & F.col("bound_date").isNotNull(), F.concat_ws(" ", "relation", F.date_format("bound_date", "yyyy-MM-dd"))).alias("deadline"),
        F.coalesce(F.array_join(F.col("superseded_by").cast("array<string>"), ","), F.lit("")).alias("superseded_by"),
    )


def marker(status: Column) -> Column:
    """Q09."""
    return F.when(status == "redacted", "[REDACTED]").when(status == "blank", "[BLANK]")


def amount_text(cents: Column) -> Column:
    """Q24: whole amounts without decimals, others with their significant ones."""
    whole, rest = F.floor(cents / 100).cast("long"), (cents % 100).cast("int")
    decimals = F.when(rest % 10 == 0, (rest / 10).cast("int").cast("string")).otherwise(F.lpad(rest.cast("string"), 2, "0"))
    return F.when(rest == 0, whole.cast("string")).otherwise(F.concat_ws(".", whole.cast("string"), decimals))


def due_window(g: Graph, as_of: str, days: int = 90, party: str | None = None) -> DataFrame:
    """Q13: what falls due in [as_of, as_of + days], both ends included; superseded obligations are left out."""
    due = F.coalesce("bound_date", "effective_due")
    start = F.to_date(F.lit(as_of))
    rows = obligations(g, party=party).where("lifecycle = 'scheduled'").where(due.between(start, F.date_add(start, days)))
    return rows.withColumn("due", due)


def pending_partition(g: Graph) -> DataFrame:
    """Q14: pending obligations by timing; contingent, unresolved and untimed add up to all pending."""
    rows = obligations(g).where("lifecycle = 'pending'")
    return rows.agg(
        F.count(F.lit(1)).alias("pending"),
        *(F.count_if(F.col("timing_kind") == kind).alias(kind) for kind in ("contingent", "unresolved", "untimed")),
    )


def pending_page(g: Graph, kind: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Q15."""
    rows = obligations(g).where("lifecycle = 'pending'")
    return page(rows if kind is None else rows.where(F.col("timing_kind") == kind), limit, offset)


def window_unresolved(g: Graph, as_of: str, days: int = 90) -> DataFrame:
    """Q16: unresolved parties among pending obligations and those in the window, whatever the party filter."""
    start, due = F.to_date(F.lit(as_of)), F.coalesce("bound_date", "effective_due")
    rows = obligations(g).where((F.col("lifecycle") == "pending") | ((F.col("lifecycle") == "scheduled") & due.between(start, F.date_add(start, days))))
    return unresolved_parties(g, rows)


def resolve_document(candidates: DataFrame, wanted: DataFrame) -> DataFrame:
    """Q17: each wanted text by id, else path, else file name, else digest; at each step only if just one fits."""
    keys = candidates.select(
        "doc", F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.col(c).alias("key")) for i, c in enumerate(("doc_key", "path", "name", "digest"))))).alias("k")
    ).select("doc", "k.step", "k.key")
    hits = wanted.join(keys, F.col("text") == F.col("key")).groupBy("text", "step").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"))
    first = hits.groupBy("text").agg(F.min_by(F.struct("n", "doc"), "step").alias("m"), F.min("step").alias("step"))
    return wanted.join(first, "text", "left").select("text", F.when(F.col("m.n") == 1, F.col("m.doc")).alias("doc"), F.col("step").cast("long").alias("step"))


def gate_summary(decisions: DataFrame) -> DataFrame:
    """Q19: decisions by tier and how many checks run or are skipped."""
    return decisions.groupBy("tier").agg(F.count(F.lit(1)).alias("decisions"), F.count_if("run_check").alias("run"), F.count_if(~F.col("run_check")).alias("skipped"))


def grouped_findings(g: Graph) -> DataFrame:
    """Q20, Q21: findings of the fresh runs, one for each kind and pair of spans, with all their categories."""
    return (
        views.visible_change_finding(g)
        .groupBy("run_id", "kind", "new_ref", "old_ref")
        .agg(F.array_join(F.array_sort(F.collect_set(F.col("category").cast("string"))), ",").alias("categories"), F.min("finding_id").alias("finding_id"))
    )


def run_status(g: Graph) -> DataFrame:
    """For each agreement with a base: whether its stored run is fresh, stale or missing."""
    fresh = views.fresh_change_run(g).select(F.col("run_id").alias("_f"))
    stored = g.change_run.where("completed").select(F.col("run_id").alias("_r"))
    rows = g.agreement.where("base_agreement_id IS NOT NULL").select("agreement_id")
    rows = rows.join(stored, F.col("agreement_id") == F.col("_r"), "left").join(fresh, F.col("agreement_id") == F.col("_f"), "left")
    return rows.select("agreement_id", F.when(F.col("_f").isNotNull(), "ok").when(F.col("_r").isNotNull(), "stale").otherwise("missing").alias("run_status"))


def new_obligations(g: Graph) -> DataFrame:
    """Q22: visible obligations of change orders that supersede nothing, with their first clause."""
    orders = views.fresh_change_run(g).select(F.col("run_id").alias("_r"))
    rows = views.visible_obligation_clause(g).join(orders, F.col("agreement_id") == F.col("_r"), "left_semi")
    # an edge's superseding end is in its run's agreement
    superseding = views.visible_supersedes(g).select(F.col("run_id").alias("_in"), F.col("obligation_id").alias("_n"))
    rows = rows.join(superseding, (F.col("agreement_id") == F.col("_in")) & (F.col("id") == F.col("_n")), "left_anti")
    first = F.row_number().over(Window.partitionBy("agreement_id", "id").orderBy("char_start", "ref_id"))
    return rows.withColumn("_at", first).where("_at = 1").select("id", "agreement_id", "ref_id", "char_start")


def unresolved_documents(texts: DataFrame, names: list[str]) -> DataFrame:
    """Q23: which of a chain's configured names of documents outside the corpus occur in each text."""
    found = F.filter(F.array(*map(F.lit, names)), lambda name: F.contains(F.col("text"), name))
    return texts.select("doc_id", F.explode(found).alias("alias"))
