"""Near duplicates by HyperMinHash sketches, banding and exact verification.

A sketch splits the shingles of a text into buckets by their hash and keeps, of
the smallest hash of each bucket, the number of leading zeros and a few bits after
them. Bands of registers give candidate groups. Pairs are never spelled out within
a group: members are held against one member of the group, the components found so
far are merged, and only groups that still hold several components are looked at
again. In what is still apart every text is taken as its difference to a hub of its band:
similar texts differ from the hub in the same shingles, while texts that were edited apart
have no difference in common, so a prefix filter on the differences finds all links there without
comparing every two members. Pairs that share a band are in the end in one component or not similar enough.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import body, exact_shingles, flat, mix, numbered, release, shingles, shuffle_partitions, slices, small_batches, store
from gaugeframe.llm.components import components
from gaugeframe.session import check_warehouse

BANDS = 60
ROWS = 5
MANTISSA = 10
SALTS = 32
BRIEF = 256


def sketch(hashes: np.ndarray, registers: int) -> np.ndarray:
    """Registers of one non-empty set of sorted distinct 64-bit hashes, 16 bits each.

    The bucket is the hash scaled to the number of registers, so the sorted hashes
    run through the buckets in order. The rest is hashed anew; of the smallest
    value of a bucket 6 bits count the leading zeros and ``MANTISSA`` bits follow
    them. An empty bucket takes the register of the first filled bucket in a fixed
    random order of its own, which keeps the chance of agreement at the similarity.
    """
    bucket = ((hashes >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    least = np.minimum.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
    out = np.zeros(registers, np.uint16)
    filled = np.zeros(registers, bool)
    filled[bucket[first]] = True
    out[bucket[first]] = compress(least)
    empty = np.flatnonzero(~filled)
    turn = 0
    while len(empty):
        draw = mix(empty.astype(np.uint64) << np.uint64(32) | np.uint64(turn + 1))
        donor = (draw % np.uint64(registers)).astype(np.int64)
        ok = filled[donor]
        out[empty[ok]] = out[donor[ok]]
        empty, turn = empty[~ok], turn + 1
    return out


def compress(values: np.ndarray) -> np.ndarray:
    """Leading zeros (at most 63) and the ``MANTISSA`` bits after the first one, of 64-bit values."""
    safe = np.maximum(values, np.uint64(1))
    zeros = np.full(len(safe), 63, np.uint64)
    left = safe.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = left >> np.uint64(step) > 0
        zeros = np.where(high, zeros - np.uint64(step), zeros)
        left = np.where(high, left >> np.uint64(step), left)
    # Drop the leading one by shifting it out, then keep the top bits.
    tail = np.where(zeros == 63, np.uint64(0), safe << np.minimum(zeros + np.uint64(1), np.uint64(63)))
    return (zeros << np.uint64(MANTISSA) | tail >> np.uint64(64 - MANTISSA)).astype(np.uint16)


def chance_agreement(a: np.ndarray, b: np.ndarray, registers: int) -> np.ndarray:
    """Chance that a register agrees for two disjoint sets of ``a`` and ``b`` shingles.

    With m shingles to a bucket the least value lies in [2^-(z+1), 2^-z) with chance
    exp(-m / 2^(z+1)) - exp(-m / 2^z); the bits that follow are as good as even.
    """
    z = np.arange(63)
    lies = [np.exp(-m[:, None] / 2.0 ** (z + 1)) - np.exp(-m[:, None] / 2.0**z) for m in (np.maximum(a / registers, 1), np.maximum(b / registers, 1))]
    return (lies[0] * lies[1]).sum(axis=1) / 2**MANTISSA


def estimate(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of rows of registers of sets with ``a`` and ``b`` shingles, corrected for chance agreement."""
    agree, chance = (x == y).mean(axis=1), chance_agreement(a, b, x.shape[1])
    return np.clip((agree - chance) / (1 - chance), 0, 1)


def _sign(width: int, registers: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, offsets = shingles(*flat(batch.column("text")), width)
            size = np.diff(offsets)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes)])
            other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes))])
            digests = [mix(s[offsets[1:]] - s[offsets[:-1]]) for s in (sums, other)]
            regs = [sketch(hashes[a:b], registers).tobytes() if b > a else None for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("id"), pa.array(size), *(pa.array(d.view(np.int64)) for d in digests), pa.array(regs, pa.binary())],
                names=["rid", "id", "n", "s1", "s2", "regs"],
            )

    return sign


def _likely(threshold: float):
    """Keep pairs whose estimate is within six standard errors of the threshold."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(flat(batch.column(n))[0].tobytes(), np.uint16).reshape(batch.num_rows, -1) for n in ("x", "y"))
                a, b = (batch.column(n).to_numpy() for n in ("nx", "ny"))
                least = threshold - 6 * math.sqrt(threshold * (1 - threshold) / x.shape[1])
                yield batch.select(["a", "b"]).filter(pa.array(estimate(x, y, a, b) >= least))

    return likely


def _difference_rows(width: int, percent: int):
    """Per text whether it is linked with its hub, its shingles that are in it or the hub but not in both, and how many of them, rarest first, can hold a link.

    Let D(x) be the difference of x to its hub h. Texts x and y of n and m shingles are linked if they differ in at
    most (n + m) (1 - t) / (1 + t) shingles, and D(x) and D(y) differ in the same ones: so they share
    c = (|D(x)| + |D(y)| - that) / 2. If both ends are linked with h, they are in one component by these two links, which the
    caller takes as they are found here; else one end is not linked with h. For that end
    c >= |D| - n (1 - t) / t, as m <= n / t; for its partner c > (|D| + (|h| - n) (1 - t) / (1 + t)) / 2 as well. In any
    order of the shingles the first |D| - c + 1 of both then have one in common.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "x"), "h"):
            (x, ox), (h, oh) = (shingles(*flat(batch.column(n)), width) for n in ("x", "h"))
            found, near, probe, index = [], [], [], []
            for i in range(batch.num_rows):
                own, hub = x[ox[i] : ox[i + 1]], h[oh[i] : oh[i + 1]]
                apart = np.setxor1d(own, hub, assume_unique=True)
                n, m, d = len(own), len(hub), len(apart)
                same = (n + m - d) // 2
                widest = n * (100 - percent) // percent
                linked = 100 * same >= percent * (n + m - same)
                half = (d * (100 + percent) + (m - n) * (100 - percent)) // (2 * (100 + percent)) + 1
                found.append(apart.view(np.int64))
                near.append(linked)
                probe.append(0 if linked else min(d, widest + 1))
                index.append(max(d - max(d - widest, half, 1) + 1, 0))
            sizes = np.diff(ox)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("hub", "node", "label", "alien")] + [pa.array(sizes), pa.array(near, pa.bool_()), pa.array(probe, pa.int32()), pa.array(index, pa.int32()), pa.array(found, pa.list_(pa.int64()))],
                names=["hub", "node", "label", "alien", "n", "near", "probe", "index", "apart"],
            )

    return spell


def _verify(width: int, percent: int):
    """Keep pairs whose full shingle sets are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "x"), "y"):
            (x_data, x_ends), (y_data, y_ends) = (flat(batch.column(n)) for n in ("x", "y"))
            # Both sides together, so that equal numbers mean equal shingles.
            sets, ends = exact_shingles(np.concatenate([x_data, y_data]), np.concatenate([x_ends, y_ends[1:] + len(x_data)]), width)
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                j = i + batch.num_rows
                x, y = sets[ends[i] : ends[i + 1]], sets[ends[j] : ends[j + 1]]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return verify


def near_classes(
    docs: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id`` and ``kept``.

    A text's set holds its distinct ``width``-word shingles, A-Z as a-z; with fewer words
    the whole sequence is one. Texts are linked if the Jaccard similarity of their
    sets is at least ``percent`` / 100; ``component_id`` is the smallest id that can be
    reached. A text without words, or null, is linked with nothing. ``kept`` tells rows
    whose id is the component's. Ids are of any type that has an order and name a text, so
    repeated rows are one document. Rows with a null id are linked like others; they
    are kept if no row of their component has an id, which then is null. Other columns
    are not read; an empty table gives none. ``docs`` is read once.

    At the threshold t a pair shares no band with a chance of (1 - t^rows)^bands: 4e-11 for
    the defaults, 5e-16 at 0.85. Pairs that share one are decided on the shingles themselves.
    """
    stored, rid = numbered(docs.select(id_col, text_col))
    answer = _answer(*_components(stored, rid, id_col, text_col, width, percent, bands, rows))
    return answer.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame, id_col: str, text_col: str, **more) -> DataFrame:
    """The rows of ``docs``, as they are, of one document per component; of repeated rows the first stays."""
    stored, rid = numbered(docs)
    answer = _answer(*_components(stored, rid, id_col, text_col, **({"width": 5, "percent": 80, "bands": BANDS, "rows": ROWS} | more)))
    kept = answer.where("kept")
    named = F.col("id").isNotNull() & (F.col("n_shingles") > 0)
    first = kept.where(named).groupBy("id").agg(F.min("rid").alias(rid)).select(rid)
    stay = first.union(kept.where(~named).select(F.col("rid").alias(rid)))
    return stored.join(stay, rid, "left_semi").drop(rid)


def _answer(signed: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Per row its component, named by the smallest id in it."""
    held = nodes.join(found, "node", "left").select("n", "s1", "s2", "least", F.coalesce("label", "node").alias("label"))
    names = held.groupBy("label").agg(F.min("least").alias("component"))
    labels = held.drop("least").join(names, "label").select("n", "s1", "s2", "component")
    placed = signed.join(labels, ["n", "s1", "s2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    shown = placed.select("rid", "id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return shown.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _components(docs: DataFrame, rid: str, id_col: str, text_col: str, width: int, percent: int, bands: int, rows: int):
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(rid).alias("rid"), F.col(id_col).alias("id"), body(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"rid bigint, id {kind}, n bigint, s1 bigint, s2 bigint, regs binary"
    signed = store(own.mapInArrow(_sign(width, bands * rows), schema), "sketches")
    # One node per set, named by the number of its first row.
    sets = signed.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("least"), F.first("regs").alias("regs"), F.min("rid").alias("node"))
    nodes = store(sets, "sets")
    signed = signed.drop("regs")

    size = 2 * rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * size + 1, F.lit(size))))
    banded = nodes.select("node", F.explode(keys).alias("band"))
    crowd = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = store(banded.join(crowd.select("band", "low"), "band"), "members")
    sketches = nodes.select("node", "n", "regs")

    # The texts that take part, once, in a table bucketed by node: pairs are brought to them.
    taking = members.select("node").distinct()
    check_warehouse(spark)
    table = f"near_{uuid.uuid4().hex[:12]}"
    parts = shuffle_partitions(spark)
    chosen = own.select(F.col("rid").alias("node"), "text").join(taking, "node", "left_semi")
    # Dealt by bucket first: a file to a bucket, and not one to every task and bucket.
    chosen.repartition(parts, "node").write.bucketBy(parts, "node").option("compression", "zstd").saveAsTable(table)
    release(spark)
    texts = spark.table(table)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar enough; the estimate spares most others the reading of their texts."""
        side = lambda a, n, x: sketches.select(F.col("node").alias(a), F.col("n").alias(n), F.col("regs").alias(x))
        likely = (
            pairs.join(side("a", "nx", "x"), "a").join(side("b", "ny", "y"), "b")
            .select("a", "b", "nx", "ny", "x", "y").mapInArrow(_likely(percent / 100), "a bigint, b bigint")
        )
        text = lambda a, x: texts.select(F.col("node").alias(a), F.col("text").alias(x))
        both = store(likely, "likely").join(text("a", "x"), "a").join(text("b", "y"), "b").select("a", "b", "x", "y")
        return store(both.mapInArrow(_verify(width, percent), "a bigint, b bigint"), "links")

    def mixed(found: DataFrame) -> DataFrame:
        """The members of bands that hold several components, with their label."""
        marked = store(members.join(found, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label")), "marked")
        several = marked.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        return store(marked.join(several.select("band"), "band"), "mixed")

    # First everything is held against the lowest member of its band.
    tried = store(members.where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "tried")
    links = confirmed(tried)
    found = components(links)
    apart = mixed(found)
    if not apart.take(1):
        return signed, nodes, found
    fresh = store(_by_difference(apart, links, texts, width, percent).join(tried, ["a", "b"], "left_anti"), "tried")
    if not fresh.take(1):
        return signed, nodes, found
    return signed, nodes, components(links.union(confirmed(fresh)))


def _by_difference(apart: DataFrame, links: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, among the members of each band (``band``, ``node``, ``label``).

    The hub of a band is the text with the most links in the component of that member that has most of them, so that a crowd
    of copies has one hub or few. Any text would do: both ends of a pair only need the same. Its text is sent to
    ``SALTS`` places, so that the members of a hub are spread. A member that is linked with the hub and has
    another label is a pair with it, as the two may never have been compared. Where both differences hold at most ``BRIEF`` shared shingles, the join
    itself decides on them; longer ones are decided on the texts later.
    """
    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    held = apart.select("band", "node", "label").join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = F.max(F.struct("degree", (-F.col("node")).alias("down"), "label")).alias("top")
    centre = held.select("label", "node", "degree").distinct().groupBy("label").agg(F.max(F.struct("degree", (-F.col("node")).alias("down"))).alias("top"))
    centre = centre.select("label", (-F.col("top.down")).alias("hub"))
    hubs = held.groupBy("band").agg(top).select("band", F.col("top.label").alias("label")).join(centre, "label").select("band", "hub", F.col("label").alias("home"))
    pairs = store(held.join(hubs, "band").select("hub", "node", "label", (F.col("label") != F.col("home")).alias("alien")).distinct(), "hubs")
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    centres = pairs.select(F.col("hub").alias("node")).distinct().join(texts, "node").select(F.col("node").alias("hub"), spread, F.col("text").alias("h"))
    both = pairs.join(texts, "node").withColumn("salt", salt).join(centres, ["hub", "salt"]).select("hub", "node", "label", "alien", F.col("text").alias("x"), "h")
    schema = "hub bigint, node bigint, label bigint, alien boolean, n bigint, near boolean, probe int, index int, apart array<bigint>"
    taken = store(both.mapInArrow(_difference_rows(width, percent), schema), "differences")
    spelt = taken.where("probe > 0 OR index > 0").select("hub", "node", F.explode("apart").alias("shingle"))
    # A shingle that no other difference has comes first in the order and can't be shared.
    often = spelt.groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ordered = spelt.join(often, ["hub", "shingle"]).groupBy("hub", "node").agg(F.array_sort(F.collect_list(F.struct("c", "shingle"))).alias("shared"))
    rows = store(taken.select("hub", "node", "label", "n", "probe", "index", F.size("apart").alias("d")).join(ordered, ["hub", "node"]), "prefixes")
    lone = F.col("d") - F.size("shared")
    brief = F.when(F.size("shared") <= BRIEF, F.col("shared")["shingle"])

    def prefix(name: str, *columns) -> DataFrame:
        most = F.greatest(F.col(name) - lone, F.lit(0))
        return rows.select("hub", *columns, F.explode(F.slice("shared", F.lit(1), most)["shingle"]).alias("shingle"))

    probes = prefix("probe", F.col("node").alias("x"), F.col("label").alias("own"), F.col("n").alias("size"), F.col("d").alias("far"), brief.alias("mine"))
    index = prefix("index", "node", "label", "n", "d", brief.alias("brief"))
    alike = (F.col("label") != F.col("own")) & (F.least("n", "size") * 100 >= F.greatest("n", "size") * percent)
    differ = F.col("d") + F.col("far") - 2 * F.size(F.array_intersect("mine", "brief"))
    enough = 100 * (F.col("n") + F.col("size") - differ) >= percent * (F.col("n") + F.col("size") + differ)
    known = F.col("mine").isNotNull() & F.col("brief").isNotNull()
    met = probes.join(index, ["hub", "shingle"]).where(alike & (~known | enough))
    pair = lambda one, other: [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]
    to_hub = taken.where("near AND alien").select(*pair("hub", "node"))
    return met.select(*pair("x", "node")).union(to_hub).distinct()
