"""Keep tables in step with Spark: compare, upsert, mark, capture, replay."""

from rowtide.plans.spec import FieldSpec, FlagSpec, SequenceSpec, SyncJob, TableSpec

__all__ = ["FieldSpec", "FlagSpec", "SequenceSpec", "SyncJob", "TableSpec"]
