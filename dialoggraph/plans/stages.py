"""A chain of stages whose tables outlive the job: a restart goes on behind the last complete one.

Each stage is a written table with a manifest, a small file that appears when the table is whole.  A
manifest's name holds a key of the stage, of the caller's ``version`` (which says what data and what
code) and of the stages it reads, so a change upstream leads to new tables and never to old rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir, stored_table
from ..sources.store import exists, read_text, write_once


class StageGraph:
    """Stages under one shared folder; without a folder a new one that nothing resumes."""

    def __init__(self, spark: SparkSession, folder: str | None = None, version: str = ""):
        self.spark, self.version = spark, version
        self.folder = folder or f"{ensure_checkpoint_dir(spark)}/build-{uuid.uuid4().hex}"
        self.keys: dict[str, str] = {}
        self.reused: list[str] = []
        self.made: list[str] = []

    def table(self, name: str, make: Callable[[], DataFrame], *after: str) -> DataFrame:
        """The table of a stage that reads the stages ``after``: read if it is complete, else made."""
        text = json.dumps([self.version, name, [self.keys[a] for a in after]])
        key = self.keys[name] = hashlib.sha256(text.encode()).hexdigest()
        manifest = f"{self.folder}/_complete/{name}-{key[:24]}.json"
        if not exists(self.spark, manifest):
            rows, place = make(), f"{name}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.folder}/{place}")
            # Of two jobs that made one stage the first one's table counts.
            write_once(self.spark, manifest, json.dumps({"table": place, "schema": rows.schema.jsonValue()}))
            self.made.append(name)
        else:
            self.reused.append(name)
        found = json.loads(read_text(self.spark, manifest))
        schema = StructType.fromJson(found["schema"])
        return stored_table(self.spark, f"{self.folder}/{found['table']}", schema)
