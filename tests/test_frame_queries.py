"""Queries over the frames of streams, against their SQL."""

from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd
import pytest

from conftest import DATA
from tessera.plans.registry import ORACLES, QUERIES


sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare import rows  # noqa: E402


@pytest.mark.parametrize("name", ["src07_planes", "src08_frame_upsampled", "src09_frames_to_full_range", "src10_first_frame", "cnv05_frames_to_10bit"])
def test_frames_of_streams(spark, name):
    import tessera.plans.queries  # noqa: F401  registers the queries

    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    relation = db.sql(ORACLES[name])
    want = pd.DataFrame(relation.fetchall(), columns=relation.columns)
    ours = QUERIES[name](spark, DATA)
    got = pd.DataFrame([r.asDict() for r in ours.collect()], columns=ours.columns)
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 100 and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["src06_frames", "src07_planes", "src08_frame_upsampled", "src09_frames_to_full_range", "src10_first_frame", "cnv05_frames_to_10bit"])
def test_frames_keep_their_numbers(spark, tmp_path, name):
    """Ids that begin anywhere and have gaps, and images without samples: no frame takes another's number."""
    import tessera.plans.queries  # noqa: F401  registers the queries

    db = duckdb.connect()
    db.sql(f"copy (select * replace (vec_id + 1001 as vec_id, case when vec_id % 9 = 4 then null else embedding end as embedding) from '{DATA}/embeddings.parquet' where vec_id < 60 and vec_id % 7 <> 2) to '{tmp_path}/embeddings.parquet'")
    db.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    relation = db.sql(ORACLES[name])
    want = pd.DataFrame(relation.fetchall(), columns=relation.columns)
    ours = QUERIES[name](spark, str(tmp_path))
    got = pd.DataFrame([r.asDict() for r in ours.collect()], columns=ours.columns)
    assert len(got) > 10 and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["src07_planes", "src08_frame_upsampled", "src09_frames_to_full_range", "src10_first_frame", "pck14_planar_16bit"])
def test_components_that_are_no_numbers(spark, tmp_path, name):
    """NaN is the largest number to least and greatest; infinite and null components are bounded."""
    import tessera.plans.queries  # noqa: F401  registers the queries

    db = duckdb.connect()
    odd = "list_transform(embedding, lambda e, i: case i when 2 then cast('nan' as float) when 3 then cast('inf' as float) when 4 then cast('-inf' as float) when 5 then null else e end)"
    db.sql(f"copy (select * replace (case when vec_id % 3 = 0 then {odd} else embedding end as embedding) from '{DATA}/embeddings.parquet' where vec_id < 48) to '{tmp_path}/embeddings.parquet'")
    db.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    relation = db.sql(ORACLES[name])
    want = pd.DataFrame(relation.fetchall(), columns=relation.columns)
    ours = QUERIES[name](spark, str(tmp_path))
    got = pd.DataFrame([r.asDict() for r in ours.collect()], columns=ours.columns)
    assert len(got) > 10 and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["src07_planes", "src08_frame_upsampled", "src09_frames_to_full_range", "src10_first_frame", "snk03_stream_bytes"])
def test_vectors_of_other_sizes(spark, tmp_path, name):
    """A vector's first 64 components are the image; those it lacks are black."""
    import tessera.plans.queries  # noqa: F401  registers the queries

    db = duckdb.connect()
    odd = "case vec_id % 6 when 0 then embedding[1:40] when 1 then embedding || embedding[1:9] when 2 then [] when 3 then null else embedding end"
    db.sql(f"copy (select * replace ({odd} as embedding) from '{DATA}/embeddings.parquet' where vec_id < 48) to '{tmp_path}/embeddings.parquet'")
    db.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    relation = db.sql(ORACLES[name])
    want = pd.DataFrame(relation.fetchall(), columns=relation.columns)
    ours = QUERIES[name](spark, str(tmp_path))
    got = pd.DataFrame([r.asDict() for r in ours.collect()], columns=ours.columns)
    assert len(got) > 10 and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["src06_frames", "src07_planes", "src08_frame_upsampled", "src09_frames_to_full_range", "src10_first_frame"])
def test_ids_that_stand_twice(spark, tmp_path, name):
    """Other images and whole copies under one id, and rows without an id."""
    import tessera.plans.queries  # noqa: F401  registers the queries

    db = duckdb.connect()
    db.sql(f"create table e as select * replace (case when vec_id % 10 = 9 then null else vec_id end as vec_id) from '{DATA}/embeddings.parquet' where vec_id < 48")
    db.sql(f"copy (select * from e union all select * replace (list_reverse(embedding) as embedding) from e where vec_id % 3 = 0 union all select * from e where vec_id % 6 = 0) to '{tmp_path}/embeddings.parquet'")
    db.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    relation = db.sql(ORACLES[name])
    want = pd.DataFrame(relation.fetchall(), columns=relation.columns)
    ours = QUERIES[name](spark, str(tmp_path))
    got = pd.DataFrame([r.asDict() for r in ours.collect()], columns=ours.columns)
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 10 and rows(got) == rows(want)


def test_streams_of_rows_without_an_id(spark, tmp_path):
    import tessera.plans.queries  # noqa: F401  registers the queries

    db = duckdb.connect()
    db.sql(f"copy (select * replace (case when vec_id % 10 = 9 then null else vec_id end as vec_id) from '{DATA}/embeddings.parquet' where vec_id < 48) to '{tmp_path}/embeddings.parquet'")
    db.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    relation = db.sql(ORACLES["snk03_stream_bytes"])
    want = pd.DataFrame(relation.fetchall(), columns=relation.columns)
    ours = QUERIES["snk03_stream_bytes"](spark, str(tmp_path))
    got = pd.DataFrame([r.asDict() for r in ours.collect()], columns=ours.columns)
    assert len(got) == 12 and rows(got) == rows(want)
