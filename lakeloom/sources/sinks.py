"""Sinks: chunk files, and a feed fetched once to a file."""

from __future__ import annotations

import hashlib
import time
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunk import STYLES, chunk
from ..plans import artifacts


def publish_chunks(parents: DataFrame, root: str, style: str = "legacy", size: int | None = None, overlap: int | None = None) -> dict:
    """Chunks of parents (doc_id, text, title, abstract) as a new version at root; its facts, which bind them to the parents."""
    _, _, _, s, o, _, _ = STYLES[style]
    source = artifacts.fingerprint(parents).first()
    facts = {"kind": "chunks", "style": style, "size": size or s, "overlap": o if overlap is None else overlap, "parents_n": source.n, "parents_x": source.x, "parents_s": source.s}
    staged = artifacts.stage(chunk(parents, style, size, overlap), root, **facts)
    artifacts.point(parents.sparkSession, root, staged)
    return staged


def chunks_of(parents: DataFrame, root: str) -> DataFrame:
    """The published chunks, if they were made from these parents."""
    source = artifacts.fingerprint(parents).first()
    return artifacts.load(parents.sparkSession, root, kind="chunks", parents_n=source.n, parents_x=source.x, parents_s=source.s)


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Rows as JSON lines, one file a partition; how many there are."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
    return rows.sparkSession.read.text(path).count()


def fetch_feed(
    spark, target: str, query: str, limit: int = 100, base: str = "https://export.arxiv.org/api/query", pause_s: float = 3.1, most_bytes: int = 5 << 20,
    opener: Callable = urllib.request.urlopen, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, last: list[float] | None = None,
) -> str:
    """Fetches one page of an Atom feed to a file that appears whole; its SHA-256. last: times of earlier calls, for the pause between two.

    A driver-side connector: one polite request, 1 to 200 entries, refused beyond most_bytes.
    """
    if not 1 <= limit <= 200 or not query.strip():
        raise ValueError("limit is 1 to 200 and the query not blank")
    if last and clock() - last[-1] < pause_s:
        sleep(pause_s - (clock() - last[-1]))
    address = f"{base}?{urllib.parse.urlencode({'search_query': query, 'start': 0, 'max_results': limit})}"
    with opener(address, timeout=60) as answer:
        body = answer.read(most_bytes + 1)
    if last is not None:
        last.append(clock())
    if len(body) > most_bytes:
        raise ValueError(f"the feed has more than {most_bytes} bytes")
    if not artifacts.write_once(spark, target, body.decode("utf-8")):
        raise FileExistsError(target)
    return hashlib.sha256(body).hexdigest()


def read_with_retries(read: Callable[[], DataFrame], target: str, attempts: int = 3, wait_s: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """What read() gives, copied to target: a failed attempt leaves nothing behind and is tried again after 1, 2, 4 ... waits.

    Errors of the data (ValueError) are not tried again.
    """
    for k in range(attempts):
        rows = read()
        spark = rows.sparkSession
        try:
            rows.write.mode("errorifexists").parquet(target)
            return spark.read.parquet(target)
        except ValueError:
            raise
        except Exception:
            fs, p = artifacts.files(spark, target)
            fs.delete(p, True)
            if k + 1 == attempts:
                raise
            sleep(wait_s * 2**k)
    raise ValueError("attempts must be at least 1")


def empty_files(rows: DataFrame) -> DataFrame:
    """Paths of read files without any text."""
    return rows.where(F.trim(F.coalesce("text", F.lit(""))) == "").select("path")
