"""Tables that readers always find whole: data in folders that never change, and commits that name the current ones.

A store is a folder. A change writes new folders under ``data`` and then one small file under ``commits``, by a rename that
fails where the name is taken; readers take the commit with the highest number. What a run leaves without a commit is not
seen by anybody, and the next run does its work again. One commit may change several tables, so a document's state and its
chunks can't part. Rows lie in ``buckets`` by the hash of their key; a change rewrites the buckets of its keys only.

Defined cases: a store without a commit has no tables; a change without keys commits nothing; null keys have a bucket of their
own hash; two writers at once: the second one's rename fails, and it raises ``Conflict`` before anything of it can be seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.helpers import written
from lodestar.operators.writes import _files, to_reindex

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


@dataclass
class Store:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _commits(self) -> list[str]:
        fs, at = _files(self.spark, f"{self.path}/commits")
        folder = at(f"{self.path}/commits")
        return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []

    def state(self) -> tuple[int, dict[str, dict]]:
        """The number of the last commit (0: none), and what it says of each table: schema and folders by bucket."""
        last = self._commits()[-1:]
        if not last:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/commits/{last[0]}", wholetext=True).first()[0]
        return int(last[0]), json.loads(text)

    def read(self, table: str, of: dict[str, dict] | None = None, buckets: set[str] | None = None) -> DataFrame | None:
        """The table's rows (of some buckets); None where no commit has named it."""
        known = (self.state()[1] if of is None else of).get(table)
        if known is None:
            return None
        paths = [f"{self.path}/data/{folder}" for b, folder in sorted(known["folders"].items()) if buckets is None or b in buckets]
        schema = known["schema"]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("string")

    def replace(self, tables: dict[str, DataFrame], keys: DataFrame, key: str) -> int:
        """For the keys, the rows of each table become those given (none: they go); the number of the commit, or of the last one
        where there are no keys. A table has its key in the column ``key``."""
        number, state = self.state()
        touched = {r[0] for r in keys.select(self._bucket(key)).distinct().collect()}  # at most buckets
        if not touched:
            return number
        after = dict(state)
        for name, rows in tables.items():
            old = self.read(name, state, touched)
            if old is not None:
                gone = keys.select(F.col(key).alias("_key")).distinct()
                rows = old.join(gone, old[key].eqNullSafe(gone["_key"]), "left_anti").unionByName(rows)
            folder = f"{name}-{uuid.uuid4().hex}"
            rows.withColumn("_bucket", self._bucket(key)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
            fs, at = _files(self.spark, self.path)
            made = {s.getPath().getName().split("=")[1] for s in fs.listStatus(at(f"{self.path}/data/{folder}")) if "=" in s.getPath().getName()}
            kept = {b: f for b, f in state.get(name, {"folders": {}})["folders"].items() if b not in touched}
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
            after[name] = {"schema": schema, "folders": kept | {b: f"{folder}/_bucket={b}" for b in made}}
        self._commit(number + 1, after)
        return number + 1

    def _commit(self, number: int, state: dict) -> None:
        fs, at = _files(self.spark, self.path)
        fs.mkdirs(at(f"{self.path}/commits"))
        part, final = at(f"{self.path}/commits/.{uuid.uuid4().hex}"), at(f"{self.path}/commits/{number:012d}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(part, final):
            fs.delete(part, False)
            raise Conflict(f"commit {number} of {self.path} is taken")

    def vacuum(self, keep: int = 2) -> int:
        """Delete commits but the last ``keep`` and the folders that none of those names; how many folders went. Readers of an
        older commit, and changes that haven't committed yet, must have ended."""
        fs, at = _files(self.spark, self.path)
        names = self._commits()
        for name in names[:-keep]:
            fs.delete(at(f"{self.path}/commits/{name}"), False)
        used = set()
        for name in names[-keep:]:
            state = json.loads(self.spark.read.text(f"{self.path}/commits/{name}", wholetext=True).first()[0])
            used |= {f.split("/")[0] for t in state.values() for f in t["folders"].values()}
        gone = [s.getPath() for s in fs.listStatus(at(f"{self.path}/data")) if s.getPath().getName() not in used]
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def reindex(store: Store, documents: DataFrame, split: Callable[[Column], Column], embed: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Index anew the documents (handle, sha, text) that are new, have changed, or whose stored row isn't whole; the number of
    documents. split gives a text's chunks; embed adds a vector to rows of handle, ordinal, chunk.

    The tables ``documents`` (handle, sha, chunks) and ``chunks`` change in one commit: a run that ends early leaves the old
    sha, so the next one takes the document up again, and no reader ever sees some of its chunks."""
    stored = store.read("documents")
    # what is stale is told by narrow rows, and only its keys, written and so of known size, meet the texts
    told = documents.select("handle", "sha")
    told = told if stored is None else to_reindex(told, stored.select("handle", "sha", F.lit(True).alias("has_vector")))
    keys = written(told.select("handle").distinct())
    stale = documents if stored is None else documents.join(keys.select(F.col("handle").alias("_key")), F.col("handle").eqNullSafe(F.col("_key")), "left_semi")
    chunks = stale.select("handle", F.posexplode(split(F.col("text"))).alias("ordinal", "chunk"))
    chunks = chunks if embed is None else embed(chunks)
    rows = stale.select("handle", "sha", F.size(split(F.col("text"))).alias("chunks"))
    n = keys.count()
    store.replace({"chunks": chunks, "documents": rows}, keys, "handle")
    return n
