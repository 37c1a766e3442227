"""Four read-only calls over the visible graph, with typed errors."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from groundline.operators import read, records, views
from groundline.plans.overlay import Graph


class NotFound(LookupError):
    """No agreement of that id."""


class Api:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.graph = Graph(spark, sf_dir)

    def list_agreements(self, limit: int = 50, offset: int = 0) -> list[dict]:
        read.check_page(limit, offset)
        return [r.asDict() for r in read.list_agreements(self.graph).orderBy("agreement_id").offset(offset).limit(limit).collect()]

    def get_obligations(self, limit: int = 50, offset: int = 0, **filters) -> dict:
        """A page of obligations with their citations, the total before paging, and unresolved parties."""
        read.check_page(limit, offset)
        rows = read.obligations(self.graph, **filters)
        open_filters = {k: v for k, v in filters.items() if k != "party"}
        header = read.page_header(rows, read.unresolved_parties(self.graph, read.obligations(self.graph, **open_filters)), limit, offset).first()
        shown = read.page(rows, limit, offset)
        items = records.obligation_records(self.graph, shown).orderBy(F.col("effective_due").asc_nulls_last(), "agreement_id", "id")
        return header.asDict() | {"items": [r.asDict(recursive=True) for r in items.collect()]}

    def upcoming_deadlines(self, as_of: str, days: int = 90, party: str | None = None, limit: int = 50, offset: int = 0) -> dict:
        read.check_page(limit, offset)
        rows = read.due_window(self.graph, as_of, days, party).orderBy("due", "agreement_id", "id").offset(offset).limit(limit)
        return {"items": [r.asDict() for r in rows.collect()], **read.pending_partition(self.graph).first().asDict()}

    def check_change_order(self, agreement_id: int, limit: int = read.MAX_LIMIT, offset: int = 0) -> dict:
        """The status of a change order's run, with a page of its findings, and how many there are, only while it is fresh."""
        read.check_page(limit, offset)
        status = read.run_status(self.graph).where(f"agreement_id = {int(agreement_id)}").first()
        if status is None:
            raise NotFound(agreement_id)
        if status["run_status"] != "ok":
            return {"status": status["run_status"], "total": 0, "findings": []}
        findings = views.visible_change_finding(self.graph).where(f"run_id = {int(agreement_id)}")
        shown = findings.orderBy("finding_id").offset(offset).limit(limit)
        return {"status": "ok", "total": findings.count(), "findings": [r.asDict() for r in shown.collect()]}
