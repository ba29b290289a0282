"""Command line: ``python -m tessella.cli COMMAND -f FILE``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import render, schemas
from tessella.operators import metadata
from tessella.plans.reader import open_dataset
from tessella.sources.files import FileBytes
from tessella.sources.footer import read_footers


def limit(text: str) -> int | None:
    """ALL, N first rows, or -N last rows; 0 is an error."""
    if text.upper() == "ALL":
        return None
    n = int(text)
    if n == 0:
        raise argparse.ArgumentTypeError("0 rows make no table")
    return n


def selected(spark: SparkSession, path: str, columns: str | None, rows: int | None) -> DataFrame:
    scan = open_dataset(spark, path).scan()
    if columns:
        scan = scan.projection(*(c.strip() for c in columns.split(",")))
    if rows is not None:
        scan = scan.head(rows) if rows > 0 else scan.tail(-rows)
    return scan.dataframe()


def table(header: list[str], rows: list[list[str]], width: int | None = None, lines: bool = False) -> str:
    """Aligned columns under a header; cells longer than ``width`` are cut."""
    cut = lambda v: v if width is None or len(v) <= width else v[: max(1, width - 1)] + "…"
    cells = [[cut(v.replace("\n", " ")) for v in r] for r in [header, *rows]]
    widths = [max(len(r[k]) for r in cells) for k in range(len(header))]
    show = lambda r: "| " + " | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) + " |"
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    body = [x for r in cells[1:] for x in ([show(r), rule] if lines else [show(r)])]
    return "\n".join([rule, show(cells[0]), rule, *body, *([] if lines and body else [rule])])


def shown(df: DataFrame, width: int | None = None, transpose: bool = False, index: bool = False, lines: bool = False) -> str:
    flat = render.csv_rows(df)
    rows = [list(r) for r in flat.collect()]
    header = list(flat.columns)
    if index:
        header, rows = ["#", *header], [[str(k), *r] for k, r in enumerate(rows)]
    if transpose:
        header, rows = ["column", *(str(k) for k in range(len(rows)))], [[h, *(r[k] for r in rows)] for k, h in enumerate(header)]
    return table(header, rows, width, lines)


def convert(df: DataFrame, form: str) -> Iterator[str]:
    """Lines of CSV, or of a JSON array, in row order; a partition at a time passes through the driver."""
    if form == "csv":
        flat = render.csv_rows(df)
        yield render.csv_line(flat.columns)
        for r in flat.toLocalIterator():
            yield render.csv_line(list(r))
        return
    yield "["
    last = None
    for r in render.json_rows(df).toLocalIterator():
        if last is not None:
            yield f"  {last},"
        last = r["json"]
    if last is not None:
        yield f"  {last}"
    yield "]"


def info(spark: SparkSession, path: str, key: str | None = None) -> str:
    f = read_footers(spark, path)[0]
    if key is not None:
        for k, v in f.key_values:
            if k == key:
                return v or ""
        raise KeyError(f"no metadata entry {key!r}")
    chunks = [c[3] for g in f.row_groups for c in g[1]]
    packed, plain = sum(m[7] for m in chunks), sum(m[6] for m in chunks)
    said = {"file": f.path, "size": f.size, "version": f.version, "created by": f.created_by, "rows": f.num_rows, "row groups": len(f.row_groups), "columns": len(f.leaves), "compressed": packed, "uncompressed": plain}
    return "\n".join([f"{k}: {v}" for k, v in said.items()] + [f"metadata {k}: {v}" for k, v in f.key_values])


def footer(spark: SparkSession, path: str) -> str:
    f = read_footers(spark, path)[0]
    tail = FileBytes(spark, f.path).read(f.size - 8, 8)
    return f"footer offset: {f.size - 8 - f.footer_length}\nfooter length: {f.footer_length}\ntail: {tail.hex(' ')}\n{info(spark, path)}"


def find_columns(spark: SparkSession, path: str, part: str) -> DataFrame:
    """Leaves whose name holds ``part``, in any case."""
    return metadata.leaf_schema(spark, path).where(F.lower("name").contains(part.lower()))


def find_entries(spark: SparkSession, path: str, column: str, part: str) -> DataFrame:
    """Dictionary entries that hold ``part``."""
    return metadata.dictionary(spark, path, column).where(F.col("value").contains(part))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("tessella")
    sub = top.add_subparsers(dest="command", required=True)

    def command(parent, name: str, *more) -> argparse.ArgumentParser:
        p = parent.add_parser(name)
        p.add_argument("-f", "--file", required=True)
        for flags, options in more:
            p.add_argument(*flags, **options)
        return p

    rows, cols = (("-n",), {"type": limit, "default": None}), (("-c", "--columns"), {})
    command(sub, "info", (("--kv-key",), {}))
    command(sub, "schema", (("-F", "--format"), {"default": "NATIVE", "choices": ("NATIVE", "AVRO", "PROTO")}))
    command(sub, "print", (("-n",), {"type": limit, "default": 10}), cols, (("-w", "--width"), {"type": int}), (("-t", "--transpose"), {"action": "store_true"}), (("-i", "--index"), {"action": "store_true"}), (("-d", "--lines"), {"action": "store_true"}))
    command(sub, "convert", (("-F", "--format"), {"required": True, "choices": ("csv", "json")}), (("-o", "--output"), {}), cols, rows)
    command(sub, "footer")
    inspect = sub.add_parser("inspect").add_subparsers(dest="what", required=True)
    command(inspect, "pages", cols, (("--no-stats",), {"action": "store_true"}))
    command(inspect, "dictionary", (("-c", "--column"), {"required": True}), (("--limit",), {"type": int, "default": 50}))
    command(inspect, "columns", cols)
    command(inspect, "rowgroups")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    if a.command == "info":
        lines = [info(spark, a.file, a.kv_key)]
    elif a.command == "schema":
        f = read_footers(spark, a.file)[0]
        lines = [{"NATIVE": metadata.schema_text, "AVRO": schemas.avro, "PROTO": schemas.proto}[a.format](f)]
    elif a.command == "print":
        lines = [shown(selected(spark, a.file, a.columns, a.n), a.width, a.transpose, a.index, a.lines)]
    elif a.command == "convert":
        lines = convert(selected(spark, a.file, a.columns, a.n), a.format)
        if a.output:
            with open(a.output, "w", encoding="utf-8") as f:
                f.writelines(x + "\n" for x in lines)
            return 0
    elif a.command == "footer":
        lines = [footer(spark, a.file)]
    elif a.what == "pages":
        df = metadata.pages(spark, a.file, columns=a.columns.split(",") if a.columns else None).drop("path")
        lines = [shown(df.drop("min", "max", "null_count") if a.no_stats else df)]
    elif a.what == "dictionary":
        lines = [shown(metadata.dictionary(spark, a.file, a.column, a.limit))]
    elif a.what == "columns":
        df = metadata.column_summary(spark, a.file)
        lines = [shown(df.where(F.col("name").isin(a.columns.split(","))) if a.columns else df)]
    else:
        lines = [shown(metadata.row_groups(spark, a.file).drop("path"))]
    for x in lines:
        print(x, file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
