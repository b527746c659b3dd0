"""Scratch tables go with their scope, those of failed work too."""

import os

import pytest

from tessella import scratch
from tessella.plans.registry import QUERIES

DIR = "/root/testdata/sf0.001"


def files(base):
    return {os.path.join(d, f) for d, _, names in os.walk(base) for f in names}


def test_nothing_is_left_when_a_scope_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_dir", lambda _: f"file://{tmp_path}")
    with scratch.scope(spark):
        for name in ("cycle_check", "page_rows", "partition_scan", "published_generation", "streaming_windows"):
            assert QUERIES[name](spark, DIR).count() > 0
        inner = scratch.materialize(spark.range(3), "inner")
        with scratch.scope(spark):
            scratch.materialize(spark.range(4), "nested")
        assert files(tmp_path) and inner.count() == 3
    assert not files(tmp_path)
    with pytest.raises(ValueError), scratch.scope(spark):
        scratch.materialize(spark.range(3), "failed")
        raise ValueError
    assert not files(tmp_path)
