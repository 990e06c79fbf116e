"""Readers and writers by address: tables, queries, files by suffix, programs that emit Arrow."""

from __future__ import annotations

import json
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_SCHEMAS: dict[tuple[str, int], StructType] = {}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder whose schema is read once for each time it was written: reading it again is a job of its own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    key = path, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).getModificationTime()
    if key not in _SCHEMAS:
        if len(_SCHEMAS) > 1000:
            _SCHEMAS.clear()
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def read_files(spark: SparkSession, paths: list[str], schema: str | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """Files of one kind, told by the first one's suffix.

    Text files without a schema get the given types of columns, where all that are asked for have one (only the header
    is read ahead then); else theirs are inferred, which reads the files twice.
    """
    kind = paths[0].rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        r = spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",")
        if schema:
            return r.schema(schema).csv(paths)
        if types and all(types.values()):
            names = r.csv(paths).columns
            return r.schema(", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)).csv(paths)
        return r.option("inferSchema", True).csv(paths)
    if kind == "json":
        return (spark.read.schema(schema) if schema else spark.read).json(paths)
    if kind == "orc":
        return spark.read.orc(paths)
    if kind == "sql":
        return spark.sql("\n".join(r[0] for r in spark.read.option("wholetext", True).text(paths[0]).collect()))
    if kind == "py":
        return read_script(spark, paths[0])
    return spark.read.parquet(*paths)


def request(columns: list[str] = (), filters: list[tuple[str, str, object]] = (), limit: int | None = None) -> list[str]:
    """What is asked of a program, as its arguments: a narrowing that it may leave to the engine."""
    out = ["--columns", ",".join(columns)] if columns else []
    for column, op, value in filters:
        out += ["--filter", f"{column} {op} {json.dumps(value, default=str)}"]
    return out + (["--limit", str(limit)] if limit is not None else [])


def started(path: str, arguments: list[str]) -> subprocess.Popen:
    command = [sys.executable, path] if path.endswith(".py") else [path]
    return subprocess.Popen([*command, *arguments], stdout=subprocess.PIPE)


def read_script(spark: SparkSession, path: str, arguments: list[str] = ()) -> DataFrame:
    """The table that a program writes to its standard output as an Arrow stream.

    The program runs in a task, which passes the stream on batch by batch; the driver only reads the stream's schema, of
    a run that is asked for no rows and ended after it. Spark brings the program's file to the executors. A program that
    refuses arguments is run without.
    """
    import pyarrow as pa
    from pyspark import SparkFiles
    from pyspark.sql.pandas.types import from_arrow_schema

    def opened(where: str, wanted: list[str]):
        run = started(where, wanted)
        try:
            return run, pa.ipc.open_stream(run.stdout)
        except pa.ArrowInvalid:
            run.stdout.close()
            if run.wait() == 0 or not wanted:
                raise
            return opened(where, [])

    arguments, name = list(arguments), path.rsplit("/", 1)[-1]
    spark.sparkContext.addFile(path)
    run, stream = opened(path, [*arguments, "--limit", "0"])
    schema = stream.schema
    run.kill()
    run.stdout.close()
    run.wait()

    def rows(_):
        here, got = opened(SparkFiles.get(name), arguments)
        with here:
            yield from got
        if here.returncode:
            raise RuntimeError(f"{name} ended with {here.returncode}")

    return spark.range(0, 1, 1, 1).mapInArrow(rows, from_arrow_schema(schema))


def write_files(df: DataFrame, kind: str, path: str, options: dict | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode).options(**{k: str(v) for k, v in (options or {}).items()})
    if kind in ("csv", "tsv"):
        w.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind == "json":
        w.json(path)
    elif kind == "orc":
        w.orc(path)
    elif kind == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"can't write {kind}")


def write_slices(spark: SparkSession, df: DataFrame, table: str, keys: list[str]) -> None:
    """Writes rows to a table by slices of keys: the slices that the rows have are replaced, the others stay."""
    if not spark.catalog.tableExists(table):
        df.write.partitionBy(*keys).format("parquet").saveAsTable(table)
        return
    at = next(r[1] for r in spark.sql(f"describe formatted {table}").collect() if r[0] == "Location")
    df = df.select(*spark.table(table).columns)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(at)
    spark.sql(f"msck repair table {table}")
    spark.catalog.refreshTable(table)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file, in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
