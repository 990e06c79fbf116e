"""How statements are run: with a time limit, with retries, with callbacks, in an environment of their own."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession


class TimeLimit(RuntimeError):
    """A query that was cancelled because it took longer than it may."""


@dataclass
class Policy:
    """seconds: the time limit of one try. retries: further tries of an error whose text has one of the patterns, after wait, twice wait, ... seconds."""

    seconds: float | None = None
    retries: int = 0
    patterns: tuple[str, ...] = ("FetchFailed", "ExecutorLost", "Connection re(set|fused)", "timed out")
    wait: float = 1.0


def collect(df: DataFrame, policy: Policy) -> list[Row]:
    """df's rows. A try that takes too long has its jobs cancelled, and isn't made again."""
    for n in range(policy.retries + 1):
        try:
            return _limited(df, policy.seconds)
        except TimeLimit:
            raise
        except Exception as e:
            if n == policy.retries or not any(re.search(p, str(e)) for p in policy.patterns):
                raise
            time.sleep(policy.wait * 2**n)
    raise AssertionError


def _limited(df: DataFrame, seconds: float | None) -> list[Row]:
    if seconds is None:
        return df.collect()
    sc, group, over = df.sparkSession.sparkContext, f"millrace-{uuid.uuid4().hex}", threading.Event()

    def cancel() -> None:
        over.set()
        sc._jsc.sc().cancelJobGroupAndFutureJobs(group)  # a broadcast under way ends by itself, what follows it doesn't begin

    timer = threading.Timer(seconds, cancel)
    sc.setJobGroup(group, "a query with a time limit", interruptOnCancel=True)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if over.is_set():
            raise TimeLimit(f"took more than {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


@dataclass
class Hooks:
    """Callbacks: each statement before it runs, the datasources that rows come from, each select's result."""

    statement: list[Callable] = field(default_factory=list)
    sources: list[Callable] = field(default_factory=list)
    result: list[Callable] = field(default_factory=list)

    def call(self, what: str, *args) -> None:
        for f in getattr(self, what):
            f(*args)


class Environment:
    """A set of written tables under a prefix, beside the ones in use, until they are promoted.

    What is written gets the prefix; what is read has it where such a table is there, else it is the one in use.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.prefix = spark, f"{name}__"

    def write(self, table: str) -> str:
        head, _, last = table.rpartition(".")
        return f"{head}.{self.prefix}{last}" if head else self.prefix + last

    def read(self, table: str) -> str:
        return own if self.spark.catalog.tableExists(own := self.write(table)) else table

    def tables(self) -> list[str]:
        """The tables of this environment, by the names they would have in use."""
        return sorted(t.name.removeprefix(self.prefix) for t in self.spark.catalog.listTables() if t.name.startswith(self.prefix))

    def promote(self, *tables: str) -> list[str]:
        """Puts this environment's tables (all, or some) in use: renames, which move no rows. What they replace is dropped."""
        done = []
        for t in tables or self.tables():
            self.spark.sql(f"drop table if exists {t}")
            self.spark.sql(f"alter table {self.write(t)} rename to {t}")
            done.append(t)
        return done

    def drop(self) -> None:
        for t in self.tables():
            self.spark.sql(f"drop table if exists {self.write(t)}")
