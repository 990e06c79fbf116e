"""python -m millrace COMMAND FILE [--tables DIR] [--param NAME=VALUE] [--env NAME].

run, plan, scopes and summary show each select's rows, its plan, what its outputs range over, or a line a column;
validate counts what shouldn't be; stale and refresh are about written datasources; state keeps a snapshot of them in
FILE.state and tells what changed since the last one; promote puts an environment's tables in use; fmt lays a file out;
ingest writes a model of the tables in --tables to FILE.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from .engine import Engine
from .lang.render import formatted
from .sources.introspect import model_of
from .streaming.refresh import changed, refresh, snapshot, stale


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("command", choices=["run", "plan", "scopes", "summary", "validate", "refresh", "stale", "state", "promote", "fmt", "ingest"])
    p.add_argument("file", type=Path)
    p.add_argument("--tables", help="folder of <table>.parquet")
    p.add_argument("--param", action="append", default=[], help="name=value, any number of times")
    p.add_argument("--rows", type=int, default=20, help="rows shown of each result")
    p.add_argument("--env", help="environment whose tables are written and read first")
    a = p.parse_args(args)
    if a.command == "fmt":
        a.file.write_text(formatted(a.file.read_text()))
        return
    spark = spark or SparkSession.builder.appName("millrace").getOrCreate()
    if a.command == "ingest":
        found = sorted(Path(a.tables).glob("*.parquet"))
        a.file.write_text(model_of(spark, {f.stem: spark.read.parquet(str(f)) for f in found}))
        return
    e = Engine(spark, str(a.file.parent), a.tables, dict(x.split("=", 1) for x in a.param), environment=a.env)
    if a.command == "promote":
        print("\n".join(e.environment.promote()))
        return
    text = a.file.read_text()
    if a.command in ("scopes", "summary"):
        getattr(e, a.command)(text).show(1000, False)
        return
    results = e.run(text)
    if a.command == "state":
        now, path = snapshot(e), a.file.with_suffix(".state")
        before = json.loads(path.read_text()) if path.exists() else {}
        path.write_text(json.dumps(now, indent=1, sort_keys=True))
        for place, what in sorted(changed(before, now).items()):
            print(f"{place}: {what}")
    if a.command == "validate":
        e.do_validate("all", []).where("failures > 0").show(a.rows, False)
    elif a.command in ("refresh", "stale"):
        for name, why in (refresh if a.command == "refresh" else stale)(e).items():
            print(f"{name}: {why}")
    for df in results:
        if a.command == "plan":
            df.explain("formatted")
        elif a.command == "run":
            df.show(a.rows, False)


if __name__ == "__main__":
    main()
