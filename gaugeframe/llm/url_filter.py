"""URL rules in a sorted digest array that executors memory-map.

The rules are hashed with 64-bit xxhash and written by Spark as segment files in
the order of the digest. Every executor maps the segments in the shared folder and
probes them with vectorised binary search, so pages are neither shuffled nor
joined. A digest that is found counts only if the stored full string agrees.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.llm.common import small_batches
from gaugeframe.session import scratch_dir

RULES = "host string, path string, verdict string"
SEGMENT_RULES = 1 << 20


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One segment per partition: counts, sorted digests, string offsets, path lengths, strings."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    digests = table["digest"].to_numpy().astype("<i8")
    strings = [x.encode() for x in table["entry"].to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in strings])]).astype("<i8")
    reach = np.unique(table["reach"].to_numpy()).astype("<i8")
    head = np.array([len(digests), len(reach)], "<i8")
    blob = b"".join([*(x.tobytes() for x in (head, digests, offsets, reach)), *strings])
    yield pa.RecordBatch.from_pydict({"segment": pa.array([blob], pa.binary())})


def build_index(rules: DataFrame, segment_rules: int = SEGMENT_RULES) -> list[str]:
    """Write the digest array of ``rules`` (host, path, verdict) and name its files for the executors.

    Segments hold ``segment_rules`` rules on average, so no task and no file grows
    with the list. In a shared folder that is mounted (``file:``) executors map them in
    place, and the list never passes through the driver; from another store each
    executor and the driver fetch a copy. Hosts lose their
    case; null counts as empty; of contrary rules for one string, block wins.
    """
    spark = rules.sparkSession
    clean = rules.select(
        F.translate(F.coalesce("host", F.lit("")), ascii_uppercase, ascii_lowercase).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.coalesce("verdict", F.lit("block")).alias("verdict"),
    )
    one = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    key = F.concat_ws("\x00", "host", "path")
    entries = one.select(
        F.xxhash64(key).alias("digest"), F.concat_ws("\x00", key, "verdict").alias("entry"), F.length("path").cast("bigint").alias("reach")
    )
    segments = entries.count() // segment_rules + 1
    packed = (
        entries.repartitionByRange(segments, "digest")
        .sortWithinPartitions("digest", "entry")
        .mapInArrow(_pack, "segment binary")
    )
    folder = scratch_dir(spark, "url-rules")
    # The text writer puts the bytes of a string out as they are, so this writes raw files; its line end comes last.
    packed.select(F.col("segment").cast("string").alias("value")).write.text(folder)
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path").collect()
    names = []
    for row in files:
        if row.path.startswith("file:"):
            names.append("/" + row.path.removeprefix("file:").lstrip("/"))
        else:
            spark.sparkContext.addFile(row.path)
            names.append(os.path.basename(row.path))
    return names


class Segment:
    """A mapped segment file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        count, reaches = (int(x) for x in raw[:16].view("<i8"))
        at = 16
        self.digests = raw[at : (at := at + 8 * count)].view("<i8")
        self.offsets = raw[at : (at := at + 8 * (count + 1))].view("<i8")
        self.reach = raw[at : (at := at + 8 * reaches)].view("<i8").tolist()
        self.strings = raw[at:]

    def probe(self, digests: np.ndarray, keys: list[bytes]) -> dict[int, str]:
        """Verdict by position of the key, for the keys that are stored."""
        found = {}
        left = np.searchsorted(self.digests, digests, side="left")
        right = np.searchsorted(self.digests, digests, side="right")
        for i in np.flatnonzero(right > left):
            for j in range(left[i], right[i]):  # several only if digests collide
                entry = self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes()
                if entry.startswith(keys[i] + b"\x00"):
                    found[int(i)] = entry[len(keys[i]) + 1 :].decode()
        return found


@functools.lru_cache(maxsize=64)
def _segment(name: str) -> Segment:
    return Segment(name if os.path.isabs(name) else SparkFiles.get(name))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [i for i in (rest.find("?"), rest.find("#")) if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def _candidates(host: str, path: str, reach: list[int]) -> list[tuple[str, str]]:
    """What a fitting rule can look like, the longest string first, then the longest host."""
    hosts = [host, *(host[i + 1 :] for i, c in enumerate(host) if c == ".")]
    pairs = [(h, path[:n]) for h in hosts for n in reach if n <= len(path)]
    return sorted(pairs, key=lambda p: (-len(p[0]) - len(p[1]), -len(p[0])))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str, url_col: str, default: str = "allow") -> DataFrame:
    """Id, host, path, rule and verdict of every row of ``pages``.

    The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in
    lower case; the path from there to ``?``, ``#`` or the end. A url that is null or
    has no ``://`` has both empty and gets the default. A rule fits its host and all
    subdomains if the path starts with the rule's path; the longest string wins, and
    of equally long ones that with the longer host. Without a rule: null and
    ``default``. Repeated rows and null ids come out as they are; other columns of
    ``pages`` are not read, so their names cannot clash. An empty table gives none.
    """
    small_batches(pages.sparkSession)
    names = build_index(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = [_segment(n) for n in names]
        reach = sorted({n for s in segments for n in s.reach}, reverse=True)
        for batch in batches:
            split = [split_url(u) for u in batch.column("url").to_pylist()]
            places = list(dict.fromkeys(split))
            owner, pairs = [], []
            for i, (host, path) in enumerate(places):
                own = _candidates(host, path, reach)
                pairs += own
                owner += [i] * len(own)
            keys = [f"{h}\x00{p}".encode() for h, p in pairs]
            digests = np.array([xxhash.xxh64_intdigest(k, 42) for k in keys], np.uint64).view(np.int64)
            verdicts: dict[int, str] = {}
            for segment in segments:
                verdicts |= segment.probe(digests, keys)
            best: dict[int, int] = {}
            for i in sorted(verdicts):
                best.setdefault(owner[i], i)
            hit = [best.get(i) for i in range(len(places))]
            answer = {p: (None, default) if i is None else ("".join(pairs[i]), verdicts[i]) for p, i in zip(places, hit)}
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([h for h, _ in split], pa.string()),
                    pa.array([p for _, p in split], pa.string()),
                    pa.array([answer[s][0] for s in split], pa.string()),
                    pa.array([answer[s][1] for s in split], pa.string()),
                ],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    schema = T.StructType(
        [T.StructField(id_col, pages.schema[id_col].dataType)]
        + [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]
    )
    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    return chosen.mapInArrow(judge, schema)
