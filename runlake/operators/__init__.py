"""DataFrame operators.  Every function takes and returns lazy frames."""

from .analysis import (
    answer_distribution, answer_totals, attention, correct_counts, distinct_learners, engagement_by_group,
    event_flags_per_user, join_external, last_n_snapshots, navigation_trace, navigation_transitions,
    responses_per_question, revision_counts, snapshot_diff, time_on_task, time_on_task_by_session,
    with_previous_event,
)
from .attachments import (
    attachment_content, attachment_index, attachment_index_refs, attachment_refs, attachment_states,
    dedup_refs, pair_results, pending_refs, scan_run_attachments, select_refs, unreferenced_files,
)
from .compare import compare_datasets, union_datasets
from .decode import double_decode
from .inference import data_row_count, describe_csv, infer_csv_schema, infer_json_columns, json_kinds
from .ordered import ordered_columns, position_bucket, time_bucket
from .provenance import (
    attachment_files_dimension, carry_provenance, dataset_listing, dataset_summary, dataset_totals,
    downloads_dimension, drift_report, newest_committed,
)
from .records import (
    MergeResult, coverage, covered_set, dedup_runs, dedup_segment, explain_membership, membership_of,
    membership_summary, merge_counts, merge_store, normalize_identity, order_by_identity, run_view,
)
from .reports import (
    answers_long, answers_long_of_runs, attach_learner, learners, quarantine, recover_report_type, report_prompts, report_rows,
    reports_to_answers, union_by_name, union_runs,
)

__all__ = [name for name in dir() if not name.startswith("_")]
