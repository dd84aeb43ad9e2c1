"""Merge semantics, on the cases a duplicate-free store must survive."""

from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runlake.operators import (
    coverage, dedup_runs, dedup_segment, explain_membership, membership_of, membership_summary, merge_store,
    order_by_identity, run_view,
)

SCHEMA = "source_key string, remote_endpoint string, question_id string, data string, _fetched_at timestamp, _run_id bigint, _position bigint"


def seg(spark, run, items, at=None, schema=SCHEMA):
    """Records of one fetch; an item is ``(endpoint, data)``."""
    stamp = datetime.fromtimestamp(run if at is None else at, timezone.utc)
    return spark.createDataFrame([("s", e, "q", d, stamp, run, i) for i, (e, d) in enumerate(items)], schema)


def counts(result):
    return {r.run_id: (r.fetched, r.new, r.updated, r.removed) for r in result.counts.collect()}


def data(df):
    return {r.remote_endpoint: r.data for r in df.collect()}


def test_first_merge(spark):
    r = merge_store(None, seg(spark, 584, [("e1", "a"), ("e2", "b"), ("e1", "c")]), None, "answers", [584])
    assert data(r.store) == {"e1": "c", "e2": "b"}
    assert counts(r) == {584: (3, 2, 0, 0)}


def test_overlap_then_refresh(spark):
    first = merge_store(None, seg(spark, 584, [("e1", "a"), ("e2", "b")]), None, "answers", [584])
    second = merge_store(first.store, seg(spark, 612, [("e2", "B"), ("e3", "c")]), first.membership, "answers", [612])
    assert data(second.store) == {"e1": "a", "e2": "B", "e3": "c"}
    assert counts(second) == {612: (2, 1, 1, 0)}
    # 584 shrinks to e1; e2 is still covered by 612.
    third = merge_store(second.store, seg(spark, 584, [("e1", "z")]), second.membership, "answers", [584])
    assert data(third.store) == {"e1": "z", "e2": "B", "e3": "c"}
    assert counts(third) == {584: (1, 0, 1, 0)}
    assert data(run_view(third.store, third.membership, "answers", 612)) == {"e2": "B", "e3": "c"}


def test_refresh_alone_removes(spark):
    first = merge_store(None, seg(spark, 584, [("e1", "a"), ("e2", "b")]), None, "answers", [584])
    second = merge_store(first.store, seg(spark, 584, [("e1", "a")]), first.membership, "answers", [584])
    assert data(second.store) == {"e1": "a"}
    assert counts(second) == {584: (1, 0, 1, 1)}
    assert [r.remote_endpoint for r in second.removed.collect()] == ["e2"]


def test_refresh_to_nothing(spark):
    first = merge_store(None, seg(spark, 584, [("e1", "a")]), None, "answers", [584])
    second = merge_store(first.store, seg(spark, 584, []), first.membership, "answers", [584])
    assert data(second.store) == {} and counts(second) == {584: (0, 0, 0, 1)}
    assert second.membership.count() == 0


def test_source_beats_store_whatever_its_stamp(spark):
    first = merge_store(None, seg(spark, 1, [("e1", "new")], at=1000), None, "answers", [1])
    second = merge_store(first.store, seg(spark, 2, [("e1", "old")], at=5), first.membership, "answers", [2])
    assert data(second.store) == {"e1": "old"}


def test_sweep_takes_newest_stamp_then_highest_run(spark):
    both = seg(spark, 1, [("e1", "a"), ("e2", "x")], at=9).unionByName(seg(spark, 2, [("e1", "b"), ("e2", "y")], at=9)).unionByName(
        seg(spark, 3, [("e1", "c")], at=3)
    )
    r = merge_store(None, both, None, "answers", [1, 2, 3])
    assert data(r.store) == {"e1": "b", "e2": "y"}
    assert counts(r) == {1: (2, 0, 0, 0), 2: (2, 2, 0, 0), 3: (1, 0, 0, 0)}
    # A swept run covers all its identities, owned or not.
    assert data(run_view(r.store, r.membership, "answers", 3)) == {"e1": "b"}


def test_columns_may_differ_between_merges(spark):
    first = merge_store(None, seg(spark, 1, [("e1", "a")]), None, "answers", [1])
    wider = seg(spark, 2, [("e2", "b")]).selectExpr("*", "7 as score")
    second = merge_store(first.store, wider, first.membership, "answers", [2])
    assert {(r.remote_endpoint, r.score) for r in second.store.collect()} == {("e1", None), ("e2", 7)}


def test_other_type_keeps_its_membership(spark):
    first = merge_store(None, seg(spark, 1, [("e1", "a")]), None, "answers", [1])
    history = seg(spark, 1, [("e1", "a")]).selectExpr("*", "'h1' as history_id")
    second = merge_store(None, history, first.membership, "history", [1])
    assert {(r.type, r.history_id) for r in second.membership.collect()} == {("answers", None), ("history", "h1")}


def test_absent_identity_fields_merge_as_empty(spark):
    a = seg(spark, 1, [(None, "a"), ("", "b")])
    assert data(dedup_segment(a, "answers")) == {"": "b"}


def test_identity_must_be_text(spark):
    bad = seg(spark, 1, [("e", "a")]).selectExpr("5 as source_key", "* except (source_key)")
    with pytest.raises(TypeError):
        merge_store(None, bad, None, "answers", [1])


def test_coverage_may_go_below_zero(spark, rows):
    members = membership_of(seg(spark, 1, [("e1", ""), ("e2", ""), ("e2", "")]), "answers")
    asked = spark.createDataFrame([("answers", 1, 1), ("answers", 2, 4), ("answers", 3, None)], "type string, run_id bigint, queried bigint")
    assert rows(coverage(members, asked)) == [("answers", 1, 1, 2, -1), ("answers", 2, 4, 0, 4), ("answers", 3, None, 0, None)]


def test_explain_membership(spark, rows):
    both = seg(spark, 1, [("e1", "a")]).unionByName(seg(spark, 2, [("e1", "b"), ("e2", "c")]))
    r = merge_store(None, both, None, "answers", [1, 2])
    assert rows(explain_membership(r.store, r.membership, "answers"), "remote_endpoint", "run_id") == [("e1", 1), ("e1", 2), ("e2", 2)]
    assert rows(membership_summary(r.store, r.membership, "answers"), "remote_endpoint", "n_runs") == [("e1", 2), ("e2", 1)]


def test_order_by_identity_is_bytewise(spark):
    ordered = order_by_identity(seg(spark, 1, [("bb", ""), ("a", ""), ("é", ""), ("c" * 10, "")]), "answers").collect()
    assert [r.remote_endpoint for r in ordered] == ["c" * 10, "a", "bb", "é"]  # "10:" < "1:a" < "2:b" < "2:é"


EVENT = st.tuples(st.sampled_from("abcd"), st.integers(0, 99))
RUNS = st.lists(st.tuples(st.integers(1, 3), st.lists(EVENT, max_size=5)), min_size=1, max_size=3)


@settings(max_examples=4, deadline=None)
@given(RUNS)
def test_any_merge_sequence_matches_a_model(spark, fetches):
    """No duplicate identity after any sequence, and the store is what a dict says."""
    store, members, model, cover = None, None, {}, {}
    for step, (run, items) in enumerate(fetches):
        s = seg(spark, run, [(e, str(v)) for e, v in items], at=step)
        r = merge_store(store, s, members, "answers", [run])
        # A written table cuts the plan between merges, as a dataset does.
        store, members = _written(spark, r.store), _written(spark, r.membership)
        cover[run] = {e for e, _ in items}
        model.update({e: str(v) for e, v in items})
        kept = set().union(*cover.values())
        model = {e: v for e, v in model.items() if e in kept}
    got = [(r.remote_endpoint, r.data) for r in store.collect()]
    assert len(got) == len({e for e, _ in got}) and dict(got) == model


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(EVENT, min_size=1, max_size=5), min_size=2, max_size=3))
def test_one_by_one_equals_one_sweep(spark, runs):
    store, members, segments = None, None, None
    for run, items in enumerate(runs, 1):
        s = seg(spark, run, [(e, str(v)) for e, v in items])
        r = merge_store(store, s, members, "answers", [run])
        store, members = _written(spark, r.store), _written(spark, r.membership)
        segments = s if segments is None else segments.unionByName(s)
    assert data(merge_store(None, segments, None, "answers", list(range(1, len(runs) + 1))).store) == data(store)


def _written(spark, df):
    from runlake.session import work_dir

    path = work_dir(spark, "step")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_dedup_keeps_one_row_per_key_and_task_before_the_shuffle(spark):
    df = seg(spark, 1, [("e", "a")]).repartition(3)
    for deduped in (dedup_runs(df, "answers"), dedup_segment(df, "answers")):
        plan = deduped._jdf.queryExecution().executedPlan().toString()
        # Printed top down: the partial limit is below the exchange on the identity.
        assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange hashpartitioning")


def test_staged_merge_knows_the_size_of_the_changes(spark, tmp_path):
    many = seg(spark, 1, [(f"e{i}", "x" * 50) for i in range(2000)])
    first = merge_store(None, many, None, "answers", [1])
    store, members = _written(spark, first.store), _written(spark, first.membership)
    small = seg(spark, 2, [("e1", "new")])
    kept = merge_store(store, small, members, "answers", [2], stage=str(tmp_path / "a")).store.where("_status = 'kept'")
    assert kept.count() == 1999
    # Planned, before any runtime statistics: the stored payload is scanned and not shuffled.
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:  # changes above the threshold are never broadcast
        kept = merge_store(store, small, members, "answers", [2], stage=str(tmp_path / "b")).store.where("_status = 'kept'")
        assert kept.count() == 1999
        assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
