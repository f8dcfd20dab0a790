"""Fingerprints, versioned publication, staged rebuilds with rollback, and resumable runs.

An artifact is a root folder with one directory a version and a log of pointers, numbered files of which
each names a version and its facts. A pointer appears whole by one rename and is never replaced, so
readers always find a current version: the newest pointer that can be read.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(frame: DataFrame) -> DataFrame:
    """One row that doesn't depend on row order or partitions: row count n, exclusive-or x of the row hashes, and the sum s, in full width as text, of independent ones."""
    columns = [F.col(c) for c in sorted(frame.columns)]
    hashes = frame.select(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(1), *columns).cast("decimal(20,0)").alias("g"))
    return hashes.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.coalesce(F.sum("g"), F.lit(0)).cast("decimal(38,0)").cast("string").alias("s"))


def files(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share; a temporary one only on a local master without that setting."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: executors would write where nobody else reads")
        folder = f"file://{tempfile.mkdtemp(prefix='lakeloom-')}"
    return f"{folder}/lakeloom-{uuid.uuid4().hex}"


def settled(frame: DataFrame) -> DataFrame:
    """The frame as a table in the session's folder for such files: computed once, however often it is read."""
    frame.write.parquet(path := scratch(frame.sparkSession))
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = files(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file that appears whole; false if it is there already."""
    fs, p = files(spark, path)
    if fs.exists(p):
        return False
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    done = not fs.exists(p) and fs.rename(part, p)
    if not done:
        fs.delete(part, False)
    return done


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, p = files(spark, f"{root}/_pointers")
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return sorted((int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit()), reverse=True)


def stage(frame: DataFrame, root: str, **facts) -> dict:
    """Writes a new version that nobody reads yet; its facts, with version, row count and hashes."""
    version = uuid.uuid4().hex
    frame.write.parquet(f"{root}/{version}")
    row = fingerprint(frame.sparkSession.read.parquet(f"{root}/{version}")).first()
    return facts | row.asDict() | {"version": version}


def point(spark: SparkSession, root: str, facts: dict) -> None:
    """Makes a staged version the current one."""
    while True:
        number = max([0, *_pointers(spark, root)]) + 1
        if write_once(spark, f"{root}/_pointers/{number:012d}.json", json.dumps(facts, sort_keys=True)):
            return


def publish(frame: DataFrame, root: str, **facts) -> str:
    """A new current version; readers see the old or the new one, never a mixture and never none."""
    staged = stage(frame, root, **facts)
    point(frame.sparkSession, root, staged)
    return staged["version"]


def manifest(spark: SparkSession, root: str) -> tuple[str, dict]:
    """The current version and its facts; a pointer that can't be read gives way to the one before."""
    for number in _pointers(spark, root):
        try:
            facts = json.loads(read_text(spark, f"{root}/_pointers/{number:012d}.json"))
            return facts["version"], facts
        except (ValueError, KeyError, TypeError):
            continue
    raise FileNotFoundError(f"{root}: nothing is published")


def load(spark: SparkSession, root: str, verify: bool = False, at: str | None = None, **expected) -> DataFrame:
    """The current version; a manifest that lacks an expected fact, or rows that don't match it, are errors. at: where the files lie now, if they were moved."""
    version, facts = manifest(spark, root)
    for k, v in expected.items():
        if facts.get(k) != v:
            raise ValueError(f"{root}: {k} is {facts.get(k)!r}, not {v!r}")
    frame = spark.read.parquet(f"{at or root}/{version}")
    if verify and {k: facts[k] for k in ("n", "x", "s")} != fingerprint(frame).first().asDict():
        raise ValueError(f"{root}: rows differ from the manifest")
    return frame


def point_all(spark: SparkSession, staged: Mapping[str, dict]) -> None:
    """Makes staged versions, root -> facts, current together: if a pointer can't be set, those set before are set back."""
    before: dict[str, dict | None] = {}
    try:
        for root, facts in staged.items():
            try:
                before[root] = manifest(spark, root)[1]
            except FileNotFoundError:
                before[root] = None
            point(spark, root, facts)
    except Exception:
        for root, old in before.items():
            if old is not None and manifest(spark, root)[1] != old:
                point(spark, root, old)
            elif old is None:
                fs, p = files(spark, f"{root}/_pointers")
                fs.delete(p, True)
        raise


def rebuild(spark: SparkSession, parts: Mapping[str, tuple[str, Callable[[], DataFrame], dict]], check: Callable[[dict[str, DataFrame]], None] | None = None) -> dict[str, str]:
    """Builds several artifacts, name -> (root, builder, facts), checks them together, and only then makes them current together: name -> version."""
    staged = {name: (root, stage(build(), root, **facts)) for name, (root, build, facts) in parts.items()}
    if check is not None:
        check({name: spark.read.parquet(f"{root}/{facts['version']}") for name, (root, facts) in staged.items()})
    point_all(spark, dict(staged.values()))
    return {name: facts["version"] for name, (_, facts) in staged.items()}


def todo(wanted: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(*keys), list(keys), "left_anti")


class Checkpoint:
    """Results of a run in batches that appear whole, under a header that says what the run is.

    A run with another header is refused. A batch that was torn off (no success mark) doesn't count and is written again.
    """

    def __init__(self, spark: SparkSession, root: str, header: dict):
        self.spark, self.root = spark, root
        text = json.dumps(header, sort_keys=True, ensure_ascii=False)
        if not write_once(spark, f"{root}/header.json", text) and read_text(spark, f"{root}/header.json") != text:
            raise ValueError(f"{root}: the checkpoint belongs to another run")

    def _batches(self) -> list[str]:
        fs, p = files(self.spark, self.root)
        paths = [x.getPath() for x in fs.listStatus(p) if x.isDirectory()]
        return sorted(x.toString() for x in paths if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def append(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.root}/{len(self._batches()):08d}-{uuid.uuid4().hex}")

    def rows(self) -> DataFrame | None:
        """All rows of whole batches; null if there is none yet."""
        found = self._batches()
        return self.spark.read.parquet(*found) if found else None

    def todo(self, wanted: DataFrame, *keys: str) -> DataFrame:
        done = self.rows()
        return wanted if done is None else todo(wanted, done, *keys)


def audit(spark: SparkSession, roots: dict[str, dict]) -> DataFrame:
    """(name, status, detail) of each artifact: ok, missing, stale (a fact differs) or corrupt (rows differ)."""

    def state(root: str, **want) -> tuple[str, str]:
        try:
            load(spark, root, **want)
        except FileNotFoundError:
            return "missing", root
        except ValueError as e:
            return "stale", str(e)
        except Exception as e:
            return "corrupt", type(e).__name__
        try:
            load(spark, root, verify=True).count()
        except Exception as e:
            return "corrupt", type(e).__name__
        return "ok", ""

    return spark.createDataFrame([(name, *state(**want)) for name, want in roots.items()], "name string, status string, detail string")


def valid_index_facts(facts: dict) -> bool:
    """Whether lexical index metadata make sense."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < float("inf")
    return (
        facts.get("format") == 1
        and facts.get("scope") in ("abstract", "full_text", "full_text_chunk")
        and isinstance(facts.get("documents"), int) and not isinstance(facts["documents"], bool) and facts["documents"] > 0
        and number(facts.get("k1")) and facts["k1"] > 0 and number(facts.get("b")) and 0 <= facts["b"] <= 1
        and number(facts.get("avg_length")) and facts["avg_length"] >= 0
    )
