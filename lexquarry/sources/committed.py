"""Tables that grow by whole batches, each published in one step.

A batch's rows go to a folder of their own.  Then a manifest that names all batches,
the new one included, is put in place by one rename that fails if another writer was
there first.  Readers see the batches of the newest manifest and nothing else: what a
killed or repeated writer has left in the folder is not there for them.

    path/data/<uuid>/...               rows of a batch
    path/manifest/<version>.json       {"batches": [{"name", "folder", "rows", ...}]}
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has published first."""


class Committed:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The newest version, 0 before the first batch."""
        folder = self._at("manifest")
        found = folder.getFileSystem(self._conf).globStatus(self._at("manifest/*.json")) or []
        return max((int(s.getPath().getName().split(".")[0]) for s in found), default=0)

    def batches(self, version: int | None = None) -> list[dict]:
        """The batches of a version, in the order in which they came."""
        version = self.version() if version is None else version
        if not version:
            return []
        text = self.spark.read.text(f"{self.path}/manifest/{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)["batches"]

    def read(self, version: int | None = None, only: Callable[[dict], bool] | None = None) -> DataFrame | None:
        """The rows of the published batches with the name of their `batch`; None before the first one."""
        parts = [b for b in self.batches(version) if only is None or only(b)]
        out = None
        for b in parts:
            part = self.spark.read.schema(b["schema"]).parquet(f"{self.path}/data/{b['folder']}").withColumn("batch", F.lit(b["name"]))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def append(self, rows: DataFrame, name: str, instead_of: list[str] | None = None, **facts) -> bool:
        """Publishes rows as a batch; False if one of this name is there already, or was.  `facts` are kept with it.

        With instead_of, the named batches leave in the same step; their names stay taken.
        """
        version = self.version()
        before = self.batches(version)
        if any(name == b["name"] or name in b["held"] for b in before):
            return False
        folder, seen = uuid.uuid4().hex, Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.path}/data/{folder}")
        kept = [b for b in before if b["name"] not in (instead_of or [])]
        held = sorted({n for b in before if b["name"] in (instead_of or []) for n in (b["name"], *b["held"])})
        own = {"name": name, "held": held, "folder": folder, "rows": seen.get["rows"], "schema": _ddl(rows), **facts}
        self._publish(version + 1, [*kept, own])
        return True

    def _publish(self, version: int, batches: list[dict]) -> None:
        draft, final = self._at(f"draft-{uuid.uuid4().hex}"), self._at(f"manifest/{version:012d}.json")
        fs = draft.getFileSystem(self._conf)
        fs.mkdirs(final.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"batches": batches}).encode()))
        out.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.valueOf("NONE")
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(draft, final, none)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {version} of {self.path} exists") from e
            raise


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def append_rest(rows: DataFrame, table: Committed, name: str, key: str = "query_id") -> int:
    """Publishes the rows whose key the table lacks as one batch; returns how many keys that were.

    The table must be one of this input: a key in it that `rows` lacks is an error, as is a
    row without a key.  The rows are evaluated once, before anything is written to the table.
    """
    from lexquarry.sources.scratch import scratch

    files = scratch(rows.sparkSession)
    own, (nameless,) = files.counted(rows, "input", F.count_if(F.col(key).isNull()))
    try:
        if nameless:
            raise ValueError(f"{nameless} rows without {key}")
        saved = table.read()
        todo = own
        if saved is not None:
            foreign = saved.join(own, key, "left_anti").select(key).first()
            if foreign:
                raise ValueError(f"{table.path} holds {key} {foreign[0]}, which the input lacks")
            todo = own.join(saved.select(key).distinct(), key, "left_anti")
        n = todo.select(key).distinct().count()
        if n:
            table.append(todo, name)
        return n
    finally:
        files.drop(own)
