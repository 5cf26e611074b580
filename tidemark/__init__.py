"""Versioned-table analytics on plain PySpark."""

from tidemark.functions.scalars import ieee_divide, safe_divide
from tidemark.operators.analytics import (
    below_k_stddev, distinct_values, group_count, histogram, profile, trim_outliers, zscore,
)
from tidemark.operators.audit import AuditError, audit_values
from tidemark.operators.changes import UpsertCounts, delete_partition, delete_where, update_where, upsert
from tidemark.operators.evolve import (
    add_column, comment_column, describe, drop_column, move_column, rename_column, retype_column, union_schema,
)
from tidemark.operators.maintenance import (
    add_partition_field, cluster_by, compact, drop_partition_field, expire, partition_spec, read_range, set_partition_spec,
    stored_rows,
)
from tidemark.operators.snapshots import (
    cherrypick, create_branch, current_snapshot, drop_branch, enable_wap, fast_forward, find_staged, history,
    on_branch, read_at, refs, register_view, rollback, set_properties, snapshots, staged_snapshot_id,
    unset_properties,
)
from tidemark.operators.stats import file_stats, gather_stats, partition_stats
from tidemark.operators.writes import (
    add_derived, append, append_files, attach_history, create_history, detach_history, ensure_history,
    insert_positional, load_history, overwrite, reconcile, refresh_names,
)
from tidemark.plans.history import History
from tidemark.sources.readers import read_json_array, read_parquet, read_stream, scan, union_all
from tidemark.sources.sinks import write_json_arrays, write_partitioned, write_sized
from tidemark.streaming.ingest import stream_append, to_sightings

__all__ = [name for name in dir() if not name.startswith("_")]
