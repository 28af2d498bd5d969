"""Per-(session, data folder) plans shared by the queries.

Two things are written once, on first use, as Parquet in the shared
checkpoint folder: the star schema (the initial load) and the upload
pipeline's intermediate tables (numbered rows, cleaned batches, issues,
verdicts).  Everything else is a lazy plan, so each query is one Catalyst
plan from those tables to its result.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import star as star_ops
from ..session import scratch_path
from ..sources import fixtures, tables


class Finance:
    """The fixture inputs and the star schema derived from one data folder."""

    _cache: dict[tuple, Finance] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Finance:
        key = (spark.sparkContext.applicationId, id(spark), sf_dir)
        if key not in cls._cache:
            cls._cache[key] = cls(spark, sf_dir)
        return cls._cache[key]

    # raw files -------------------------------------------------------------
    @cached_property
    def raw_transactions(self) -> DataFrame:
        return fixtures.raw_transactions(self.spark, self.sf_dir)

    @cached_property
    def raw_budgets(self) -> DataFrame:
        return fixtures.raw_budgets(self.spark, self.sf_dir)

    @cached_property
    def raw_invoices(self) -> DataFrame:
        return fixtures.raw_invoices(self.spark, self.sf_dir)

    @cached_property
    def raw_upload(self) -> DataFrame:
        return fixtures.raw_upload(self.spark, self.sf_dir)

    # star schema -------------------------------------------------------------
    def build_star(self) -> star_ops.Star:
        """The star schema over the raw inputs.  The raw transaction join is
        written once (the dimension members and both branches of the fact
        numbering read it) instead of being recomputed three times."""
        from ..session import materialize

        raw_tx = materialize(self.raw_transactions, "raw_transactions")
        raw_budgets = materialize(self.raw_budgets, "raw_budgets")
        return star_ops.build_star(raw_tx, raw_budgets, self.raw_invoices)

    @cached_property
    def star(self) -> star_ops.Star:
        """Initial load once per session, then every query reads the stored Parquet
        tables (column pruning and filter pushdown at the scan)."""
        root = scratch_path(self.spark, "star")
        tables.write_star(self.build_star(), root)
        return tables.read_star(self.spark, root)

    @cached_property
    def rolled_store(self) -> str:
        """A store of its own in which the rollups were refreshed, the uploads appended and the rollups refreshed again."""
        from . import jobs, rollups
        from ..operators import ingest

        root, at = scratch_path(self.spark, "rolled"), fixtures.UPLOAD_SUBMITTED_AT
        tables.write_star(self.star, root, ingest.initial_log(self.fact_transactions, at))
        rollups.refresh(self.spark, root)
        jobs.apply_batches(self.spark, root, self.upload_clean, fixtures.UPLOAD_AS_OF, at)
        rollups.refresh(self.spark, root)
        return root

    @cached_property
    def rolled(self) -> star_ops.Star:
        """That store's star with the rollup by month and ids in the fact's place."""
        from . import rollups

        star = tables.read_star(self.spark, self.rolled_store)
        return replace(star, fact_transactions=rollups.cells(self.spark, self.rolled_store))

    @cached_property
    def rolled_clients(self) -> DataFrame:
        """That store's rollup by client and month."""
        from . import rollups

        return rollups.client_months(self.spark, self.rolled_store)

    @property
    def fact_transactions(self) -> DataFrame:
        return self.star.fact_transactions

    @property
    def fact_budgets(self) -> DataFrame:
        return self.star.fact_budgets

    @property
    def fact_invoices(self) -> DataFrame:
        return self.star.fact_invoices

    @property
    def dim_departments(self) -> DataFrame:
        return self.star.dim_departments

    @property
    def dim_regions(self) -> DataFrame:
        return self.star.dim_regions

    @property
    def dim_products(self) -> DataFrame:
        return self.star.dim_products

    @property
    def dim_expense_categories(self) -> DataFrame:
        return self.star.dim_expense_categories

    @cached_property
    def dim_calendar(self) -> DataFrame:
        return star_ops.dim_calendar(self.fact_transactions)

    # dirty upload stream -------------------------------------------------------
    @cached_property
    def upload_raw(self) -> DataFrame:
        """The upload rows written once: the joins run once, for the numbering and for the stream's files."""
        from ..session import materialize

        return materialize(self.raw_upload, "raw_upload")

    @cached_property
    def upload_numbered(self) -> DataFrame:
        """The upload rows with their row number inside each batch, written
        once: mapping, cleaning and the preview all read them."""
        from ..operators import ingest
        from ..session import materialize

        return materialize(ingest.number_rows(self.upload_raw, ["event_id", "copy"]), "upload_numbered")

    @cached_property
    def upload_mapped(self) -> DataFrame:
        from ..operators import ingest

        return ingest.mapped(self.upload_numbered)

    @cached_property
    def upload_clean(self) -> DataFrame:
        """The cleaned batches, materialized once (reliable checkpoint): the
        audit, the verdict, the merge and the log all read them."""
        from ..operators import ingest
        from ..session import materialize

        return materialize(ingest.clean(self.upload_mapped))

    @cached_property
    def upload_issues(self) -> DataFrame:
        from ..operators import quality

        from ..session import materialize

        return materialize(quality.issues(self.upload_clean, fixtures.UPLOAD_AS_OF), "issues")

    @cached_property
    def upload_verdicts(self) -> DataFrame:
        from ..operators import ingest

        from ..session import materialize

        return materialize(ingest.verdicts(self.upload_clean, fixtures.UPLOAD_AS_OF), "verdicts")

    @cached_property
    def merged_batches(self) -> DataFrame:
        from ..operators import ingest

        return ingest.merged_batches(self.upload_verdicts)

    @cached_property
    def extended_dims(self) -> dict[str, DataFrame]:
        from ..operators import ingest

        dims = {k: v for k, v in self.star.tables().items() if k.startswith("dim_")}
        ext = ingest.extended_dimensions(dims, self.upload_clean, self.merged_batches)
        ext.pop("_added")
        return ext
