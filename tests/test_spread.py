"""Tables of few bytes are one split: work that costs much a row is dealt out before it, and nothing is pushed below the deal."""

from __future__ import annotations

import pytest
from conftest import DATA
from pyspark.sql import functions as F

import tessera.plans.queries  # noqa: F401  registers the queries
from tessera.functions import texts
from tessera.plans.registry import QUERIES

DEALT = ["str13_colour_box", "meta10_colorimetry", "gen01_packed_pattern", "gen02_pattern_kwrgb", "meta10_colour_of_parameter_sets", "hev01_parameter_sets", "exp11_identity"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", DEALT)
def test_rows_are_dealt_out(spark, name):
    above, deal, below = plan_of(QUERIES[name](spark, DATA)).partition("RepartitionByExpression [p_partkey")
    assert deal and not any(w in below for w in ("xpath", "udf", "Generate", "MapInArrow"))


def test_colour_box_is_parsed_once(spark):
    rows = [
        (0, None, {}), (1, "", {}), (2, "<a/>", {}), (3, '<a><ColourInformationBox colour_type="" full_range_flag="0"/></a>', {"colr:fr": "0"}),
        (4, '<a xmlns="u"><b><ColourInformationBox colour_primaries="9"/><ColourInformationBox colour_type="q" colour_primaries="8" matrix_coefficients="a&amp;b&#10;c"/></b></a>', {"colr:cp": "9", "colr:colour_type": "q", "colr:mc": "a&b\nc"}),
        (5, "<a><!-- <ColourInformationBox colour_type='no'/> --><ColourInformationBox transfer_characteristics=' 1 '/></a>", {"colr:tc": " 1 "}),
    ]
    found = spark.createDataFrame([(k, x) for k, x, _ in rows], "k int, x string").select("k", texts.colour_box(F.col("x")).alias("m"))
    assert {r.k: r.m for r in found.collect()} == {k: m for k, _, m in rows}
    assert plan_of(found).count("xpath_string") <= 1


def test_packed_pattern_needs_no_groups(spark):
    assert "Aggregate" not in plan_of(QUERIES["gen01_packed_pattern"](spark, DATA))


def test_images_together_and_alone(spark):
    """Images of one size are measured together; what fails fails alone, and each row is what the image alone gives."""
    from tessera.operators import experiments

    def codec(planes, depth, quality):
        if int(next(iter(planes.values()))[0, 0]) == 9:
            raise ValueError("a nine")
        return experiments.bits(planes, depth, quality)

    rows = [(str(k), bytes((k * 37 + i * i) % 251 for i in range(w * h - (k == 5))), w, h) for k, (w, h) in enumerate([(4, 4), (6, 4), (4, 4), (2, 2), (4, 4), (4, 4), (6, 4)])]
    rows += [("nine", bytes([9] * 16), 4, 4), ("none", None, 4, 4), ("no size", b"1234", None, 2)]
    run = lambda rows: experiments.run(spark.createDataFrame(rows, "infile string, content binary, w int, h int").coalesce(1), "bayer_rggb8", "w", "h", options=experiments.Options(codec=codec, qualities=(20, 60), averages=False)).collect()
    together = run(rows)
    assert len(together) == len(rows) * 14 and together == [r for row in rows for r in run([row])]
    assert {r.infile for r in together if r.error is not None} == {"5", "nine", "none", "no size"} and all(r.psnr_bayer is not None for r in together if r.error is None)


def test_time_report_is_read_for_what_is_asked(spark):
    report = "\tCommand being timed: a: b\n\tUser time (seconds): 1.25\n\tSystem time (seconds): 0.50\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02:03.5\n\tExit status: 0\n"
    df = spark.createDataFrame([(report,), ("",), (None,)], "t string")
    names = ["usersystemtime", "elapsed", "command"]
    rows = df.select(texts.gnu_time_fields(F.col("t")).alias("a"), texts.gnu_time_fields(F.col("t"), names).alias("b")).collect()
    assert set(rows[0].b.asDict()) == set(names) and all(r.a[k] == r.b[k] for r in rows for k in names) and rows[0].b.elapsed == 3723.5 and rows[0].b.usersystemtime == 1.75
    assert "Swaps" not in plan_of(QUERIES["str07_gnu_time"](spark, DATA))


def test_tiles_are_cut_and_put_together_by_all_tasks(spark):
    from tessera.operators import tiles

    plan = plan_of(QUERIES["dem07_tiled_planes"](spark, DATA))
    assert "FlatMapGroupsInPandas" not in plan and plan.rpartition("MapInArrow")[2].count("RepartitionByExpression") == 1
    rows = [(k, bytes((k * 50 + i) % 256 for i in range(h * w)), h, w) for k, (h, w) in enumerate([(5, 7), (4, 4), (9, 3)])]
    rows.append((None, bytes(range(6)), 2, 3))
    df = spark.createDataFrame(rows, "id int, v binary, h int, w int")
    back = tiles.assemble(tiles.spread(tiles.cut(df, ["id"], ["v"], "w", "h", size=2, before=0, after=0), ["id"]), ["id"], ["v"]).collect()
    assert {(r.id, r.h, r.w, bytes(r.v[::2])) for r in back} == {(k, h, w, v) for k, v, h, w in rows} and len(back) == 4


def test_profiles_are_built_a_few_at_a_time():
    import pyarrow as pa

    from tessera.plans import metadata_queries

    rows = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(["x" * (k % 7) if k % 5 else None for k in range(200)])], names=["doc_id", "text"])
    made = list(metadata_queries._profiled(iter([rows])))
    assert max(map(len, made)) <= 64 and [p for b in made for p in b.column(0).to_pylist()] == [str(k) for k in range(200)]
