"""Scans: predicates, projection, row selection, files that must fit together, and types."""

import math
from datetime import date, datetime, time, timezone
from decimal import Decimal
from uuid import UUID

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessella.plans import predicate as P
from tessella.plans.reader import BadOptions, both, byte_range, open_dataset
from tessella.sources.footer import BadParquet, read_footer
from tessella.sources.schema import SchemaError


@pytest.fixture(scope="module")
def numbers(tmp_path_factory):
    """300 rows in three row groups."""
    path = str(tmp_path_factory.mktemp("numbers") / "n.parquet")
    pq.write_table(pa.table({"id": pa.array(range(1, 301), pa.int64()), "label": [f"l{k % 7}" for k in range(300)], "small": pa.array([None if k % 5 == 0 else k for k in range(300)], pa.int32())}), path, row_group_size=100)
    return path


def ids(scan):
    return [r["id"] for r in scan.projection("id").dataframe().collect()]


def compare(a, b):
    """Total order of doubles: -0.0 < 0.0, NaN greatest and equal to itself."""
    key = lambda v: (2, 0, 0) if math.isnan(v) else (1, v, math.copysign(1, v))
    return (key(a) > key(b)) - (key(a) < key(b))


@pytest.mark.parametrize("group", [7, 1, 2])
def test_float_comparisons_follow_the_total_order(spark, tmp_path, group):
    rows = [0.0, -0.0, math.nan, 1.0, -1.0, 5.0, None]
    path = str(tmp_path / "f.parquet")
    pq.write_table(pa.table({"n": pa.array(range(7), pa.int32()), "x": pa.array(rows, pa.float64())}), path, row_group_size=group)
    tests = {"eq": lambda c: c == 0, "ne": lambda c: c != 0, "lt": lambda c: c < 0, "le": lambda c: c <= 0, "gt": lambda c: c > 0, "ge": lambda c: c >= 0}
    d = open_dataset(spark, path)
    for push in ("true", "false"):
        spark.conf.set("spark.sql.parquet.filterPushdown", push)
        for op, test in tests.items():
            for v in (0.0, -0.0, math.nan, 1.0, 3.0, 99.0):
                got = {r["n"] for r in d.scan().filter(getattr(P, op)("x", v)).projection("n").dataframe().collect()}
                assert got == {k for k, x in enumerate(rows) if x is not None and test(compare(x, v))}, (op, v, push)
    spark.conf.unset("spark.sql.parquet.filterPushdown")


def test_negation_keeps_null_logic(spark, numbers):
    d = open_dataset(spark, numbers)
    small = [None if k % 5 == 0 else k for k in range(300)]
    got = set(ids(d.scan().filter(~(P.lt("small", 100) | P.is_in("small", 201, 202)))))
    assert got == {k + 1 for k, v in enumerate(small) if v is not None and not (v < 100 or v in (201, 202))}
    assert len(ids(d.scan().filter(P.is_null("small")))) == 60
    assert len(ids(d.scan().filter(~P.is_null("small")))) == 240


@pytest.mark.parametrize("predicate", [P.eq("id", P.i32(1)), P.eq("small", P.i64(1)), P.eq("id", "x"), P.eq("id", 1.0), P.eq("label", 3), P.eq("small", 2**40), P.eq("id", True), P.eq("id", Decimal(1)), P.eq("id", time(1))])
def test_literals_of_the_wrong_type_are_errors(spark, numbers, predicate):
    with pytest.raises(ValueError):
        open_dataset(spark, numbers).scan().filter(predicate).dataframe()


def test_unknown_columns_and_empty_arguments_are_errors(spark, numbers):
    d = open_dataset(spark, numbers)
    for bad in (lambda: d.scan().projection("nope").dataframe(), lambda: d.scan().filter(P.eq("nope", 1)).dataframe(), lambda: d.scan().projection(), lambda: P.is_in("id"), lambda: P.all_of(), lambda: P.eq("id", None), lambda: open_dataset(spark)):
        with pytest.raises(ValueError):
            bad()


def test_row_selection_counts_in_file_order(spark, numbers):
    d, two = open_dataset(spark, numbers), open_dataset(spark, numbers, numbers)
    assert ids(d.scan().head(5)) == [1, 2, 3, 4, 5]
    assert sorted(ids(d.scan().skip(295))) == [296, 297, 298, 299, 300]
    assert ids(d.scan().skip(98).head(4)) == [99, 100, 101, 102]
    assert ids(d.scan().tail(3)) == [298, 299, 300]
    assert ids(d.scan().tail(999)) == list(range(1, 301))
    assert ids(d.scan().skip(999)) == []
    assert ids(d.scan().filter(P.gt("id", 150)).skip(10).head(3)) == [161, 162, 163]
    assert ids(two.scan().skip(299).head(3)) == [300, 1, 2]


def test_byte_ranges_keep_row_groups_by_their_middle(spark, numbers):
    f = read_footer(spark, numbers)
    start, size = f.group_span(1)
    middle = start + size // 2
    d = open_dataset(spark, numbers)
    assert sorted(ids(d.scan().row_groups(byte_range(middle, middle + 1)))) == list(range(101, 201))
    assert ids(d.scan().row_groups(byte_range(middle, middle))) == []
    assert ids(d.scan().row_groups(both(byte_range(0, 1 << 30), byte_range(middle, 1 << 30))).skip(1).head(2)) == [102, 103]
    splits = [0, start, middle, f.size]
    parts = [ids(d.scan().row_groups(byte_range(a, b))) for a, b in zip(splits, splits[1:], strict=False)]
    assert sorted(x for p in parts for x in p) == list(range(1, 301))


@pytest.mark.parametrize("bad", [lambda s: s.head(1).tail(1), lambda s: s.tail(1).skip(1), lambda s: s.tail(1).filter(P.eq("id", 1)), lambda s: s.tail(1).row_groups(byte_range(0, 1)), lambda s: s.head(0), lambda s: s.tail(0), lambda s: s.skip(-1)])
def test_options_that_exclude_each_other(spark, numbers, bad):
    with pytest.raises(BadOptions):
        bad(open_dataset(spark, numbers).scan()).dataframe()
    with pytest.raises(BadOptions):
        open_dataset(spark, numbers, numbers).scan().tail(1).dataframe()


def test_projection_and_filter_reach_the_scan(spark, numbers):
    df = open_dataset(spark, numbers).scan().filter(P.gt("id", 250)).projection("label").dataframe()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,250)" in plan and "struct<id:bigint,label:str" in plan


def test_files_must_fit_where_they_are_used(spark, tmp_path):
    a, b, c, e = (str(tmp_path / f"{n}.parquet") for n in "abce")
    pq.write_table(pa.table({"x": pa.array([1], pa.int64()), "y": ["p"]}), a)
    pq.write_table(pa.table({"y": ["q"], "x": pa.array([2], pa.int64())}), b)
    pq.write_table(pa.table({"x": pa.array([3], pa.int32()), "y": ["r"]}), c)
    pq.write_table(pa.table({"y": ["s"]}), e)
    assert sorted(map(tuple, open_dataset(spark, a, b).scan().dataframe().collect())) == [(1, "p"), (2, "q")]
    assert sorted(r["y"] for r in open_dataset(spark, a, c, e).scan().projection("y").dataframe().collect()) == ["p", "r", "s"]
    for other in (c, e):
        with pytest.raises(SchemaError):
            open_dataset(spark, a, other).scan().dataframe()
        with pytest.raises(SchemaError):
            open_dataset(spark, a, other).scan().filter(P.eq("x", 1)).projection("y").dataframe()


def test_bad_files_fail_loudly(spark, tmp_path):
    for name, data in (("short", b"PAR1"), ("magic", b"x" * 50), ("crypt", b"y" * 50 + b"\x04\0\0\0PARE"), ("length", b"PAR1" + b"\xff\xff\xff\x7fPAR1"), ("corrupt", b"PAR1" + b"\xff" * 20 + b"\x14\0\0\0PAR1")):
        path = tmp_path / f"{name}.parquet"
        path.write_bytes(data)
        with pytest.raises(BadParquet):
            open_dataset(spark, str(path))


def test_nested_projection_keeps_the_shell_and_file_order(spark, tmp_path):
    path = str(tmp_path / "s.parquet")
    kind = pa.struct([("city", pa.string()), ("zip", pa.int32())])
    pq.write_table(pa.table({"id": pa.array([1, 2, 3], pa.int32()), "address": pa.array([{"city": "a", "zip": 1}, None, {"city": None, "zip": 3}], kind), "m": pa.array([[("k", 1), ("k", 2)], None, []], pa.map_(pa.string(), pa.int32())), "people": pa.array([[{"city": "x", "zip": 9}], [], None], pa.list_(kind))}), path)
    d = open_dataset(spark, path)
    df = d.scan().projection("people", "address.city", "id").dataframe()
    assert df.columns == ["id", "address", "people"]
    assert [r["address"] and r["address"].asDict() for r in df.orderBy("id").collect()] == [{"city": "a"}, None, {"city": None}]
    assert [r["id"] for r in d.scan().filter(P.is_null("address.city")).projection("id").dataframe().collect()] == [2, 3]
    assert [r["id"] for r in d.scan().filter(P.ge("address.zip", 2)).projection("id").dataframe().collect()] == [3]
    inner = d.scan().projection("people.list.element.zip").dataframe().collect()
    assert inner[0]["people"][0].asDict() == {"zip": 9} and inner[1]["people"] == [] and inner[2]["people"] is None
    for bad in ("address", "people", "m.key_value.key"):
        with pytest.raises(ValueError):
            d.scan().filter(P.is_null(bad)).dataframe()


def test_types_that_spark_does_not_read(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    key = UUID("12345678-1234-5678-9234-56789abcdef0")
    table = pa.table({
        "h": pa.array([1.5, -0.25, None], pa.float16()), "u": pa.array([key.bytes, None, bytes(16)], pa.uuid()), "tm": pa.array([1000, None, 5], pa.time32("ms")),
        "tn": pa.array([1001, None, 5], pa.time64("ns")), "ns": pa.array([1_700_000_000_000_000_001, None, 0], pa.timestamp("ns", "UTC")), "u32": pa.array([2**32 - 1, None, 0], pa.uint32()),
        "u64": pa.array([2**64 - 1, None, 0], pa.uint64()), "ms": pa.array([1500, None, 0], pa.timestamp("ms", "UTC")), "d": pa.array([Decimal("1.25"), None, Decimal("-3.00")], pa.decimal128(10, 2)), "day": pa.array([date(2020, 1, 2), None, date(1970, 1, 1)]),
        "f": pa.array([b"abc", None, b"xyz"], pa.binary(3)), "i8": pa.array([-5, None, 5], pa.int8()), "list": pa.array([[1.5], None, []], pa.list_(pa.float16())),
    })
    pq.write_table(table, path)
    d = open_dataset(spark, path)
    r = d.scan().head(1).dataframe().collect()[0]
    assert (r["h"], r["u"], r["tm"], r["tn"], r["ns"]) == (1.5, str(key), 1_000_000_000, 1001, 1_700_000_000_000_000_001)
    assert (r["u32"], r["u64"], r["d"], r["day"], bytes(r["f"]), r["i8"], r["list"]) == (2**32 - 1, 2**64 - 1, Decimal("1.25"), date(2020, 1, 2), b"abc", -5, [1.5])
    count = lambda p: d.scan().filter(p).dataframe().count()
    assert count(P.eq("u", key)) == 1 and count(P.lt("u", key)) == 1
    assert count(P.gt("h", P.f32(0.0))) == 1 and count(P.eq("tm", time(0, 0, 1))) == 1 and count(P.ge("tn", time(0, 0, 0, 1))) == 1
    assert count(P.eq("ms", datetime(1970, 1, 1, 0, 0, 1, 500_900, tzinfo=timezone.utc))) == 1
    assert count(P.eq("d", Decimal("1.250"))) == 1 and count(P.ge("day", date(2020, 1, 1))) == 1 and count(P.eq("u32", 2**32 - 1)) == 1
    for bad in (P.eq("d", Decimal("1.255")), P.eq("d", Decimal("123456789.0")), P.eq("f", 3), P.eq("u", "x" if False else 3.0)):
        with pytest.raises(ValueError):
            count(bad)
    raw = open_dataset(spark, path, raw_values=True).scan().projection("u32", "day", "d", "h").dataframe().collect()[0]
    assert (raw["u32"], raw["day"], int.from_bytes(raw["d"], "big")) == (-1, 18263, 125) and len(raw["h"]) == 2


def test_byte_stream_split_and_memory(spark, tmp_path):
    import io

    from tessella.sources.memory import from_buffers, records

    path = str(tmp_path / "b.parquet")
    pq.write_table(pa.table({"x": pa.array([1.5, 2.5], pa.float64())}), path, use_dictionary=False, column_encoding={"x": "BYTE_STREAM_SPLIT"})
    assert [r["x"] for r in open_dataset(spark, path).scan().dataframe().collect()] == [1.5, 2.5]
    spark.conf.unset("spark.sql.parquet.enableVectorizedReader")
    out = io.BytesIO()
    pq.write_table(pa.table({"x": [1, 2]}), out, compression="brotli")
    assert [r["x"] for r in records(from_buffers(spark, out.getvalue(), out.getvalue()))] == [1, 2, 1, 2]


def test_unknown_options_are_warned_of(spark, numbers):
    with pytest.warns(UserWarning):
        open_dataset(spark, numbers, options={"no-such": "1"})


def test_streaming_takes_the_same_predicates(spark, numbers, tmp_path):
    import shutil

    from tessella.streaming.files import arriving

    folder = tmp_path / "in"
    folder.mkdir()
    shutil.copy(numbers, folder / "n.parquet")
    df = arriving(open_dataset(spark, numbers), str(folder), P.gt("id", 290), ["id"])
    q = df.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("arrived").count() == 10


def test_a_datasets_settings_stay_its_own(spark, numbers, tmp_path):
    path = str(tmp_path / "n.parquet")
    pq.write_table(pa.table({"id": pa.array(range(10), pa.int64()), "t": pa.array([k * 1000 + 1 for k in range(10)], pa.timestamp("ns"))}), path)
    names = ("spark.sql.parquet.filterPushdown", "spark.sql.parquet.enableVectorizedReader", "spark.sql.legacy.parquet.nanosAsLong", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(k) for k in names]
    odd = open_dataset(spark, path, options={"metadata-filtering": "false", "vectorized": "false"})
    df = odd.scan().filter(P.ge("id", 4)).dataframe()
    assert [r["t"] for r in df.orderBy("id").collect()] == [k * 1000 + 1 for k in range(4, 10)]
    assert odd._session.conf.get("spark.sql.parquet.filterPushdown") == "false" and "Batched: false" in df._jdf.queryExecution().executedPlan().toString()
    plain = open_dataset(spark, numbers)
    sizes = plain.scan().projection("id").batches(lambda it: (pa.record_batch({"n": pa.array([b.num_rows])}) for b in it), "n long", size=7).collect()
    assert max(r["n"] for r in sizes) == 7 and sum(r["n"] for r in sizes) == 300
    assert plain._session is spark and "Batched: true" in plain.scan().dataframe()._jdf.queryExecution().executedPlan().toString()
    assert [spark.conf.get(k) for k in names] == before
    assert df.join(plain.scan().projection("id").dataframe(), "id").count() == 6


def test_skip_behind_a_predicate_neither_sorts_nor_gathers(spark, numbers, monkeypatch):
    from tessella.plans import reader

    two = open_dataset(spark, numbers, numbers, numbers)
    want = [k for _ in range(3) for k in range(1, 301) if k % 7 == 3]
    scan = two.scan().filter(P.eq("label", "l2"))
    for stretch, skips in ((1 << 20, (1, 43, 100)), (64, (42, 44, 128, 500))):
        monkeypatch.setattr(reader, "STRETCH", stretch)
        for n in skips:
            assert sorted(ids(scan.skip(n))) == sorted(want[n:]), (stretch, n)
    assert ids(scan.skip(60).head(5)) == want[60:65]
    plan = scan.skip(60).dataframe()._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan and "Limit" not in plan and "Exchange" not in plan


def test_selection_lists_each_row_group(spark, numbers):
    data = open_dataset(spark, numbers, numbers)
    start, size = data.footers[0].group_span(1)
    got = [tuple(r)[1:] for r in data.scan().row_groups(byte_range(start, start + size)).selection().collect()]
    assert got == 2 * [(0, 100, False), (1, 100, True), (2, 100, False)]
