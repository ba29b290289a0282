"""Metadata relations, command line, nested access, writer policies and schema notations."""

import io
import json
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import cli
from tessella.functions import nested, render, schemas, variant
from tessella.operators import metadata
from tessella.plans.reader import open_dataset
from tessella.sources import writer
from tessella.sources.footer import read_footer


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    out = str(tmp_path_factory.mktemp("m") / "m.parquet")
    table = pa.table({"id": pa.array(range(1000), pa.int64()), "kind": [f"k{k % 3}" for k in range(1000)], "tags": pa.array([[k, None] if k % 2 else [] for k in range(1000)], pa.list_(pa.int32()))})
    pq.write_table(table.replace_schema_metadata({"who": "me"}), out, row_group_size=400, write_page_index=True, data_page_size=512, data_page_version="2.0")
    return out


def test_relations_agree_with_arrow(spark, path):
    meta = pq.ParquetFile(path).metadata
    f = metadata.files(spark, path).first()
    assert (f["num_rows"], f["row_groups"], f["columns"], f["key_values"]["who"], f["created_by"]) == (1000, 3, 3, "me", meta.created_by)
    groups = metadata.row_groups(spark, path).orderBy("row_group").collect()
    assert [(r["num_rows"], r["first_row"]) for r in groups] == [(400, 0), (400, 400), (200, 800)]
    for r in metadata.column_chunks(spark, path).collect():
        c = meta.row_group(r["row_group"]).column(r["column"])
        assert (r["name"], r["num_values"], r["compressed_size"], r["codec"]) == (c.path_in_schema, c.num_values, c.total_compressed_size, c.compression)
        if r["name"] == "id":
            assert (int(r["min"]), int(r["max"]), r["null_count"]) == (c.statistics.min, c.statistics.max, 0)
    leaves = {r["name"]: r for r in metadata.leaf_schema(spark, path).collect()}
    assert leaves["tags.list.element"]["max_repetition"] == 1 and leaves["id"]["physical"] == "INT64"
    assert metadata.layer_shape(read_footer(spark, path), "tags.list.element") == ["REPEATED"]


def test_pages_indexes_and_dictionaries(spark, path):
    pages = metadata.pages(spark, path)
    data = pages.where(F.col("type").startswith("DATA") & (F.col("name") == "id"))
    assert data.agg(F.sum("num_values")).first()[0] == 1000
    index = metadata.page_index(spark, path).where("name = 'id'")
    assert index.count() == data.count() and index.agg(F.max(F.col("max").cast("long"))).first()[0] == 999
    assert {r["value"] for r in metadata.dictionary(spark, path, "kind").collect()} == {"k0", "k1", "k2"}
    assert cli.find_entries(spark, path, "kind", "2").count() == 3
    assert cli.find_columns(spark, path, "TAG").count() == 1
    shares = metadata.column_summary(spark, path).collect()
    assert abs(sum(r["share"] for r in shares) - 1) < 1e-9


def test_columns_sum_up_chunks(spark, tmp_path):
    table = pa.table({"n": pa.array([None, 5, 7, None], pa.int32()), "l": pa.array([[1, None], [], None, [2]], pa.list_(pa.int64()))})
    pq.write_table(table, tmp_path / "a.parquet", row_group_size=1)
    pq.write_table(table.slice(1, 2), tmp_path / "b.parquet")
    got = {r["name"]: r for r in metadata.columns(spark, str(tmp_path)).collect()}
    assert [(r["column"], r["physical"], r["chunks"], r["num_values"], r["null_count"]) for r in (got["n"], got["l.list.element"])] == [(0, "INT32", 5, 6, 2), (1, "INT64", 5, 7, 5)]
    pq.write_table(table, tmp_path / "c.parquet", write_statistics=["l.list.element"])
    got = {r["name"]: r for r in metadata.columns(spark, str(tmp_path)).collect()}
    assert (got["n"]["num_values"], got["n"]["null_count"], got["l.list.element"]["null_count"]) == (10, None, 8)
    pq.write_table(table.slice(0, 0), tmp_path / "none.parquet")
    assert [tuple(r)[5:7] for r in metadata.columns(spark, str(tmp_path / "none.parquet")).collect()] == [(0, 0), (0, 0)]


def test_bounds_of_chunks_compare_as_their_type(spark, tmp_path):
    table = pa.table({
        "n": pa.array([-20, 999, 1000, None], pa.int64()), "u": pa.array([4_294_967_295, 5, 70, 8], pa.uint32()), "d": pa.array([Decimal("-3.50"), Decimal("20.00"), None, Decimal("100.00")], pa.decimal128(30, 2)),
        "x": [2.5, -10.0, 9.0, None], "s": ["b", "é", "aa", None], "flag": [True, False, True, None], "f16": pa.array(np.array([2, -4, 1, 3], np.float16)), "nul": pa.array([None] * 4, pa.int32()),
    })
    pq.write_table(table, tmp_path / "a.parquet", row_group_size=1)
    got = {r["name"]: (r["min"], r["max"]) for r in metadata.columns(spark, str(tmp_path)).collect()}
    assert got.pop("f16") == (np.float16(-4).tobytes().hex(), np.float16(3).tobytes().hex())
    assert got == {"n": ("-20", "1000"), "u": ("5", "4294967295"), "d": ("-3.50", "100.00"), "x": ("-10.0", "9.0"), "s": ("aa", "é"), "flag": ("false", "true"), "nul": (None, None)}
    pq.write_table(table, tmp_path / "b.parquet", write_statistics=["s"])
    got = {r["name"]: (r["min"], r["max"]) for r in metadata.columns(spark, str(tmp_path)).collect()}
    assert got["n"] == (None, None) and got["s"] == ("aa", "é")


def run(spark, *arguments):
    out = io.StringIO()
    assert cli.main(list(arguments), spark, out) == 0
    return out.getvalue()


def test_commands(spark, path, tmp_path):
    assert "rows: 1000" in run(spark, "info", "-f", path) and run(spark, "info", "-f", path, "--kv-key", "who") == "me\n"
    assert "optional int64 id" in run(spark, "schema", "-f", path)
    assert json.loads(run(spark, "schema", "-f", path, "-F", "AVRO"))["fields"][1]["type"] == ["null", "string"]
    assert "repeated int32 tags = 3;" in run(spark, "schema", "-f", path, "-F", "PROTO")
    assert "| 999" in run(spark, "print", "-f", path, "-n", "-2", "-c", "id") and "column" in run(spark, "print", "-f", path, "-n", "1", "-t")
    assert run(spark, "convert", "-f", path, "-F", "csv", "-n", "2", "-c", "id,kind") == "id,kind\n0,k0\n1,k1\n"
    out = tmp_path / "o.json"
    cli.main(["convert", "-f", path, "-F", "json", "-n", "2", "-o", str(out)], spark)
    assert json.loads(out.read_text())[1] == {"id": "1", "kind": "k1", "tags": ["1", None]}
    assert "tail:" in run(spark, "footer", "-f", path) and "DATA_PAGE_V2" in run(spark, "inspect", "pages", "-f", path, "-c", "id")
    assert "k1" in run(spark, "inspect", "dictionary", "-f", path, "-c", "kind") and "400" in run(spark, "inspect", "rowgroups", "-f", path) and "share" in run(spark, "inspect", "columns", "-f", path)
    with pytest.raises(SystemExit):
        cli.main(["print", "-f", path, "-n", "0"], spark)


def test_csv_flattens_and_quotes(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('b', 'x,\"y\"', 'c', CAST(NULL AS INT)) AS s, TIMESTAMP'2020-01-02 03:04:05.5' AS t, CAST('1.50' AS DECIMAL(3,2)) AS d, X'ff' AS raw")
    assert list(cli.convert(df, "csv")) == ["a,s.b,s.c,t,d,raw", '1,"x,""y""",null,2020-01-02T03:04:05.5Z,1.50,0xff']


def test_nested_access(spark):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    df = spark.sql("SELECT array(array(1, 2), array(3)) AS ll, array(5, 6) AS l, map('a', 1) AS m, parse_json('{\"k\": [1, null]}') AS v")
    r = df.select(nested.leaf_total(F.col("ll"), 2).alias("t"), nested.item(F.col("l"), 1).alias("i"), nested.map_value(F.col("m"), "b").alias("none"), variant.get(F.col("v"), "$.k[0]", "int").alias("k"), variant.try_get(F.col("v"), "$.k", "int").alias("bad"), variant.to_text(F.col("v")).alias("text")).first()
    assert (r["t"], r["i"], r["none"], r["k"], r["bad"], r["text"]) == (6, 6, None, 1, None, '{"k":[1,null]}')
    with pytest.raises(Exception, match="out of bounds"):
        df.select(nested.item(F.col("l"), 2)).collect()


def test_repeated_map_keys_last_entry_counts(spark, tmp_path):
    out = str(tmp_path / "d.parquet")
    pq.write_table(pa.table({"m": pa.array([[("a", 1), ("b", 2), ("a", 3)]], pa.map_(pa.string(), pa.int32()))}), out)
    df = open_dataset(spark, out).scan().dataframe()
    assert df.select(nested.map_value(F.col("m"), "a")).first()[0] == 3


def test_writer_policies(spark, tmp_path):
    df = spark.sql("SELECT CAST('-1.239' AS DECIMAL(10,3)) AS d, TIMESTAMP'1969-12-31 23:59:59.9995' AS t, 300 AS n")
    cut = df.select(writer.decimal_to(F.col("d"), T.DecimalType(10, 3), 10, 2, writer.TRUNCATE).alias("d"), F.unix_micros(writer.timestamp_to(F.col("t"), "MILLIS", writer.TRUNCATE)).alias("t")).first()
    assert cut["d"] == Decimal("-1.23") and cut["t"] == -1000
    for bad in (writer.decimal_to(F.col("d"), T.DecimalType(10, 3), 10, 2), writer.timestamp_to(F.col("t"), "MILLIS"), writer.ranged(F.col("n"), 8, False), writer.nulls_only(F.col("n"))):
        with pytest.raises(Exception, match="loses|range|nulls only"):
            df.select(bad).collect()
    assert df.select(writer.ranged(F.col("n"), 16, True)).first()[0] == 300


def test_writer_files(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), F.col("id").cast("string").alias("s"), F.col("id").cast("double").alias("x"))
    for codec in writer.CODECS:
        out = str(tmp_path / f"{codec}.parquet")
        writer.write_file(df, out, writer.WriterConfig(codec=codec))
        assert open_dataset(spark, out).count() == 100 and metadata.column_chunks(spark, out).first()["codec"] == codec
    out = str(tmp_path / "e.parquet")
    writer.write_file(df, out, writer.WriterConfig(encodings={"id": "DELTA_BINARY_PACKED", "s": "DELTA_BYTE_ARRAY", "x": "BYTE_STREAM_SPLIT"}))
    used = {r["name"]: set(r["encodings"]) for r in metadata.column_chunks(spark, out).collect()}
    assert "DELTA_BINARY_PACKED" in used["id"] and "DELTA_BYTE_ARRAY" in used["s"] and "BYTE_STREAM_SPLIT" in used["x"]
    assert open_dataset(spark, out).scan().dataframe().count() == 100
    got = open_dataset(spark, out).scan().dataframe()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        writer.write(df, str(tmp_path / "bad"), writer.WriterConfig(encodings={"id": "PLAIN"}, bloom=("s",)))
    for bad in (writer.WriterConfig(codec="LZO"), writer.WriterConfig(encodings={"s": "DELTA_BINARY_PACKED"}), writer.WriterConfig(encodings={"nope": "PLAIN"}), writer.WriterConfig(page_size=0), writer.WriterConfig(precision_loss="x")):
        with pytest.raises(ValueError):
            writer.write(df, str(tmp_path / "bad"), bad)


def test_schema_names_are_made_safe(spark, tmp_path):
    out = str(tmp_path / "n.parquet")
    pq.write_table(pa.table({"1a b": [1], "ok": [b"x"]}), out)
    f = read_footer(spark, out)
    assert schemas.safe("1a b") == "_1a_b" and "_1a_b" in schemas.proto(f) and "_1a_b" in schemas.avro(f)


def test_text_of_intervals(spark):
    df = spark.sql("SELECT named_struct('months', 1L, 'days', 2L, 'milliseconds', 3L) AS i")
    assert render.csv_rows(df).first()[0] == "1mo 2d 3ms"


def test_encodings_are_those_asked_for(spark, tmp_path):
    df = spark.range(3000).select("id", F.col("id").cast("string").alias("s"), F.col("id").cast("string").alias("t"), (F.col("id") % 3).alias("n")).repartition(3)
    out = str(tmp_path / "e")
    writer.write(df, out, writer.WriterConfig(encodings={"s": "DELTA_LENGTH_BYTE_ARRAY", "t": "PLAIN"}))
    used = {}
    for r in metadata.column_chunks(spark, out).collect():
        used.setdefault(r["name"], set()).update(r["encodings"])
    assert "DELTA_LENGTH_BYTE_ARRAY" in used["s"] and not used["t"] & {"DELTA_BYTE_ARRAY", "RLE_DICTIONARY"} and "RLE_DICTIONARY" in used["n"]
    assert spark.read.parquet(out).agg(F.sum("id"), F.count("t")).first() == (3000 * 2999 // 2, 3000)
    with pytest.raises(FileExistsError):
        writer.write(df, out, writer.WriterConfig(encodings={"t": "PLAIN"}))
    writer.write(df.limit(5), out, writer.WriterConfig(encodings={"t": "PLAIN"}), mode="overwrite")
    assert spark.read.parquet(out).count() == 5


def test_policies_hold_when_writing(spark, tmp_path):
    df = spark.sql("SELECT CAST('-1.239' AS DECIMAL(10,3)) AS d, TIMESTAMP'1969-12-31 23:59:59.9995' AS t, 300 AS n, NULL AS nothing")
    cut = writer.WriterConfig(types={"d": "decimal(10,2)", "t": "timestamp(MILLIS)", "n": "uint16"}, precision_loss=writer.TRUNCATE)
    writer.write(df, str(tmp_path / "cut"), cut)
    r = spark.read.parquet(str(tmp_path / "cut")).select("d", F.unix_micros("t"), "n", "nothing").first()
    assert tuple(r) == (Decimal("-1.23"), -1000, 300, None)
    for k, bad in enumerate(({"d": "decimal(10,2)"}, {"t": "timestamp(MILLIS)"}, {"n": "int8"}, {"d": "decimal(3,3)"})):
        with pytest.raises(Exception, match="loses|range"):
            writer.write(df, str(tmp_path / f"bad{k}"), writer.WriterConfig(types=bad))
    with pytest.raises(ValueError):
        writer.write(df, str(tmp_path / "no"), writer.WriterConfig(types={"n": "decimal(3,1)"}))


def test_rows_and_batches_build_a_file(spark, tmp_path):
    out = str(tmp_path / "r.parquet")
    schema = pa.schema([pa.field("id", pa.int64(), nullable=False), pa.field("tags", pa.list_(pa.string()))])
    with writer.FileWriter(out, schema, writer.WriterConfig(row_group_size=100)) as w:
        w.row(id=1, tags=["a", None])
        w.row(id=2)
        w.batch({"id": range(3, 40), "tags": [[]] * 37})
    assert [r["id"] for r in open_dataset(spark, out).scan().head(3).dataframe().collect()] == [1, 2, 3] and open_dataset(spark, out).count() == 39
    for bad in (lambda w: w.row(nope=1), lambda w: w.batch({"id": [1]}), lambda w: w.batch({"id": [None], "tags": [None]})):
        with pytest.raises(ValueError), writer.FileWriter(str(tmp_path / "x.parquet"), schema) as w:
            bad(w)
        assert not (tmp_path / "x.parquet").exists()


def test_checksums_tell_damaged_pages(spark, tmp_path):
    out = tmp_path / "c.parquet"
    pq.write_table(pa.table({"x": list(range(1000)), "s": ["word"] * 1000}), out, write_page_checksum=True, compression="none", use_dictionary=False)
    assert metadata.checksums(spark, str(out)).where("not right").count() == 0
    assert open_dataset(spark, str(out), options={"verify-checksums": "true"}).count() == 1000
    raw = bytearray(out.read_bytes())
    raw[raw.index(b"word") + 400] ^= 1
    out.write_bytes(bytes(raw))
    assert [r["name"] for r in metadata.checksums(spark, str(out)).where("not right").collect()] == ["s"]
    with pytest.raises(OSError, match="wrong checksum"):
        open_dataset(spark, str(out), options={"verify-checksums": "true"})


def test_bloom_filters_hold_what_was_written(spark, tmp_path):
    from tessella.sources import bloom

    out = str(tmp_path / "b.parquet")
    writer.write_file(spark.range(0, 4000, 2).select("id", F.concat(F.lit("v"), "id").alias("s")), out, writer.WriterConfig(bloom=("id", "s")))
    got = dict(bloom.probe(spark, out, "id", list(range(400))))
    assert all(got[k] for k in range(0, 400, 2)) and sum(got[k] for k in range(1, 400, 2)) < 40
    assert dict(bloom.probe(spark, out, "s", ["v10", "w10", "nothing"]))["v10"] and not all(x for _, x in bloom.probe(spark, out, "s", [f"w{k}" for k in range(50)]))
