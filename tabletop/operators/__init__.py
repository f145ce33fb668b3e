from tabletop.operators.collections import profile_collections
from tabletop.operators.dominance import overlap_counts, theta_sums
from tabletop.operators.export import export_csv, export_json, json_rows, read_export
from tabletop.operators.fields import field_types
from tabletop.operators.joins import asof_join, range_join
from tabletop.operators.composite import check_composite_reference, discover_composite_references, minimal_keys
from tabletop.operators.keys import candidate_keys, check_reference, discover_keys, discover_references
from tabletop.operators.load import load_file, load_into
from tabletop.operators.ordered import group_sample, with_global_ranks
from tabletop.operators.overlaps import overlap_join
from tabletop.operators.profile import (
    database_totals,
    declared_keys,
    declared_sizes,
    keys_from_catalog,
    list_tables,
    profile_remote,
    profile_tables,
    row_bounds,
    row_counts,
    table_columns,
    table_sizes,
)
from tabletop.operators.query import execute, first_rows, preview, preview_frame, rows_as_json, sql
from tabletop.operators.reach import reachable
from tabletop.operators.selection import exact_percentiles
from tabletop.operators.snapshots import (
    delete_snapshot,
    list_snapshots,
    read_snapshot,
    restore_working,
    total_storage,
    write_snapshot,
    write_working,
)
from tabletop.operators.theta import theta_join
from tabletop.operators.transcripts import assemble, last_messages, split_reply, token_rate
from tabletop.operators.upserts import delete_keys, upsert

__all__ = [
    "asof_join",
    "assemble",
    "candidate_keys",
    "check_composite_reference",
    "check_reference",
    "database_totals",
    "declared_keys",
    "declared_sizes",
    "delete_keys",
    "delete_snapshot",
    "discover_composite_references",
    "discover_keys",
    "discover_references",
    "exact_percentiles",
    "execute",
    "export_csv",
    "export_json",
    "field_types",
    "first_rows",
    "group_sample",
    "json_rows",
    "keys_from_catalog",
    "last_messages",
    "list_snapshots",
    "list_tables",
    "load_file",
    "load_into",
    "minimal_keys",
    "overlap_counts",
    "overlap_join",
    "preview",
    "preview_frame",
    "profile_collections",
    "profile_remote",
    "profile_tables",
    "range_join",
    "reachable",
    "read_export",
    "read_snapshot",
    "restore_working",
    "row_bounds",
    "row_counts",
    "rows_as_json",
    "split_reply",
    "sql",
    "table_columns",
    "table_sizes",
    "theta_join",
    "theta_sums",
    "token_rate",
    "total_storage",
    "upsert",
    "with_global_ranks",
    "write_snapshot",
    "write_working",
]
