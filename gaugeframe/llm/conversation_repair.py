"""Cheapest repair of conversations by a min-plus program over a grammar of role and fault sequences.

1. Rows are sorted over all conversations by range, so a long conversation lies in several partitions,
   and get a number that follows the order.
2. Each row becomes one symbol: its role's initial and whether it is truncated, or that it must go.
   A task replaces the most frequent pair of symbols of all its conversations by a new one, again and again
   (Re-Pair). Every symbol has a transfer matrix: for each state before and after, the lowest cost
   and the audit string of the edits. A rule's matrix is the min-plus product of those of its two parts, worked
   out once for all conversations that use it; its strings are ropes over those of its parts.
3. The pieces of a conversation are joined in order by the same product; the winning path gives each piece its
   edits, and the rows are rewritten as they stream by.

Of two strings of equal cost for the same rows and the same state before, neither begins with the other (more inserts cost
more), so the lesser one stays the lesser one whatever follows, and ties can be settled rule by rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.llm.common import WHITE, shuffle_partitions, small_batches, store

SEGMENT_ROWS = 1 << 16
DELETE_COST, CHANGE_COST = 3, 2
# States by the last initial: nothing yet, s, u, a. Roles: s, u, a, any other.
START, S, U, A = range(4)
STATES = range(4)
GONE = 8  # symbols: 2 * role + truncated, or GONE
SYMBOLS = 9
LEGAL = ((0, 1), (1, 2), (2, 1))
ROLE_NAMES = {U: "user", A: "assistant"}


class Rope:
    """A string that shares the strings of its parts."""

    __slots__ = ("left", "right", "size", "text")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        self.size = len(text) if left is None else left.size + right.size

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return other if not self.size else self
        if self.size + other.size <= 32:
            return Rope(str(self) + str(other))
        return Rope(left=self, right=other)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                out.append(node.text)
            else:
                todo += [node.right, node.left]
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        """By characters; parts that both share at the same place are passed over."""
        one, two = [(self, 0)], [(other, 0)]
        while one and two:
            (x, i), (y, j) = one.pop(), two.pop()
            if x is y and i == j:
                continue
            if x.left is not None:
                one += [(x.right, 0), (x.left, 0)]
                two.append((y, j))
            elif y.left is not None:
                one.append((x, i))
                two += [(y.right, 0), (y.left, 0)]
            else:
                n = min(len(x.text) - i, len(y.text) - j)
                a, b = x.text[i : i + n], y.text[j : j + n]
                if a != b:
                    return a < b
                if i + n < len(x.text):
                    one.append((x, i + n))
                if j + n < len(y.text):
                    two.append((y, j + n))
        return not one and bool(two)


Best = tuple[int, Rope] | None
Matrix = list[list[Best]]


def lesser(x: Best, y: Best) -> Best:
    if x is None or y is None:
        return y if x is None else x
    return y if y[0] < x[0] or (y[0] == x[0] and y[1] < x[1]) else x


def after(state: int) -> int:
    """The state after a turn that was inserted or given another role."""
    return A if state == U else U


def product(x: Matrix, y: Matrix) -> Matrix:
    """Min-plus product, with the strings of the edits."""
    out: Matrix = [[None] * 4 for _ in STATES]
    for i in STATES:
        for j in STATES:
            ways = [(x[i][m], y[m][j]) for m in STATES if x[i][m] and y[m][j]]
            if ways:
                low = min(a[0] + b[0] for a, b in ways)
                best = None
                for a, b in ways:
                    if a[0] + b[0] == low:
                        best = lesser(best, (low, a[1] + b[1]))
                out[i][j] = best
    return out


def inserts() -> Matrix:
    """No insert, one, or two; more come back to a state that fewer reach."""
    out: Matrix = [[None] * 4 for _ in STATES]
    for i in STATES:
        state = i
        for n in range(3):
            out[i][state] = lesser(out[i][state], (CHANGE_COST * n, Rope("I" * n)))
            state = after(state)
    return out


def row_matrix(symbol: int) -> Matrix:
    """Edits of one row, inserts before it included."""
    own: Matrix = [[None] * 4 for _ in STATES]
    for state in STATES:
        own[state][state] = (DELETE_COST, Rope("D"))
        if symbol == GONE:
            continue
        role, extra = symbol // 2, symbol % 2
        to = {0: S if state == START else None, 1: U if state != U else None, 2: A if state == U else None}.get(role)
        if to is not None:
            own[state][to] = lesser(own[state][to], (extra, Rope("K")))
        to = after(state)
        own[state][to] = lesser(own[state][to], (CHANGE_COST + extra, Rope("R")))
    return product(inserts(), own)


NOTHING: Matrix = [[(0, Rope()) if i == j else None for j in STATES] for i in STATES]


def re_pair(row: np.ndarray, symbols: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """``row`` with its most frequent pairs replaced until no pair is there twice, and the pairs; negative numbers divide sequences."""
    rules: list[tuple[int, int]] = []
    alone: set[int] = set()  # equal neighbours in a row of three, which is one pair only
    while True:
        k = symbols + len(rules) + 1
        code = np.where((row[:-1] >= 0) & (row[1:] >= 0), row[:-1] * (1 << 31) + row[1:], -1)
        values, counts = np.unique(code[code >= 0], return_counts=True)
        order = np.argsort(-counts, kind="stable")
        hit = None
        for n in order:
            if counts[n] < 2:
                break
            if int(values[n]) in alone:
                continue
            at = np.flatnonzero(code == values[n])
            run = np.concatenate([[True], np.diff(at) > 1])
            at = at[(at - at[run][np.cumsum(run) - 1]) % 2 == 0]  # of overlapping pairs every second
            if len(at) > 1:
                hit = at, int(values[n])
                break
            alone.add(int(values[n]))
        if hit is None:
            return row, rules
        at, value = hit
        rules.append((value >> 31, value & (1 << 31) - 1))
        row = row.copy()
        row[at] = k - 1
        row = np.delete(row, at + 1)


def matrices(sequences: list[np.ndarray]) -> list[Matrix]:
    """The transfer matrix of every sequence of symbols; rules and equal sequences are worked out once."""
    if not sequences:
        return []
    row = np.concatenate([np.append(s, -1) for s in sequences]).astype(np.int64)
    row, rules = re_pair(row, SYMBOLS)
    known = [row_matrix(s) for s in range(SYMBOLS)]
    for x, y in rules:
        known.append(product(known[x], known[y]))
    done: dict[bytes, Matrix] = {}
    out = []
    for piece in np.split(row, np.flatnonzero(row < 0) + 1)[:-1]:
        key = piece.tobytes()
        if key not in done:
            whole = NOTHING
            for symbol in piece[:-1]:
                whole = product(whole, known[symbol])
            done[key] = whole
        out.append(done[key])
    return out


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per piece of a conversation with its matrix; rows come in order of their numbers."""

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        pos, symbol, role = (np.concatenate([h[n] for h in held]) for n in (1, 2, 3))
        conv = pa.concat_arrays([h[0] for h in held])
        names = conv.to_pylist()
        new = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1] or pos[i] >> 33 != pos[i - 1] >> 33]
        ends = [*new[1:], len(names)]
        found = matrices([symbol[a:b] for a, b in zip(new, ends)])
        pair = role[:-1] * 4 + role[1:]
        bad = np.concatenate([[0], np.cumsum(~np.isin(pair, [4 * x + y for x, y in LEGAL]))])
        cells = [[cell for line in m for cell in line] for m in found]
        yield pa.RecordBatch.from_arrays(
            [conv.take(pa.array(new, pa.int64())), pa.array(pos[new]), pa.array(role[new].astype(np.int32)), pa.array(role[np.array(ends) - 1].astype(np.int32)),
             pa.array([int(bad[b - 1] - bad[a]) for a, b in zip(new, ends)], pa.int64()),
             pa.array([[c[0] if c else None for c in row] for row in cells], pa.list_(pa.int64())),
             pa.array([[str(c[1]) if c else None for c in row] for row in cells], pa.list_(pa.string()))],
            names=["conv", "seg", "head", "tail", "illegal", "costs", "audits"],
        )

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("conv"), *(batch.column(n).to_numpy().astype(np.int64) for n in ("pos", "symbol", "role"))))
            size += batch.num_rows
        if size >= SEGMENT_ROWS:
            yield from flush()
            held, size = [], 0
    yield from flush()


def cheapest(pieces: list[tuple[list, list]]) -> tuple[int, list[tuple[int, str]]]:
    """Lowest cost and, for each piece, the state before it and its edits; ``pieces`` are costs and audits of matrices."""
    best: list[Best] = [(0, Rope()), None, None, None]
    steps: list[list[int]] = []
    for costs, audits in pieces:
        nxt: list[Best] = [None] * 4
        came = [0] * 4
        for i in STATES:
            for j in STATES:
                if best[i] and costs[4 * i + j] is not None:
                    way = best[i][0] + costs[4 * i + j], best[i][1] + Rope(audits[4 * i + j])
                    if lesser(nxt[j], way) is way:
                        nxt[j], came[j] = way, i
        best = nxt
        steps.append(came)
    closing = inserts()
    end: tuple[Best, int, int] = (None, 0, 0)
    for i in STATES:
        for j in (START, A):
            if best[i] and closing[i][j]:
                way = best[i][0] + closing[i][j][0], best[i][1] + closing[i][j][1]
                if lesser(end[0], way) is way:
                    end = way, i, j
    (cost, _), state, last = end
    out = []
    tail = str(closing[state][last][1])
    for (costs, audits), came in zip(pieces[::-1], steps[::-1]):
        before = came[state]
        out.append((before, audits[4 * before + state] + tail))
        state, tail = before, ""
    return cost, out[::-1]


def _path_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece its state and edits, per conversation (at its first piece) cost, audit and illegal neighbours; pieces come by conversation, in order."""

    def answer(kind: pa.DataType) -> pa.RecordBatch:
        out = []
        for conv, pieces in done:
            cost, path = cheapest([(p["costs"], p["audits"]) for p in pieces])
            joints = sum((x["tail"], y["head"]) not in LEGAL for x, y in zip(pieces, pieces[1:]))
            audit, illegal = "".join(a for _, a in path), joints + sum(p["illegal"] for p in pieces)
            for n, (p, (state, edits)) in enumerate(zip(pieces, path)):
                out.append((conv, p["seg"], state, edits, *((None,) * 3 if n else (cost, audit, illegal))))
        kinds = (kind, pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv", "seg", "state", "edits", "cost", "audit", "illegal"])

    done: list[tuple] = []
    kind = None
    for batch in batches:
        kind = batch.schema.field("conv").type
        for piece in batch.to_pylist():
            if not done or done[-1][0] != piece["conv"]:
                if len(done) >= 1000:
                    yield answer(kind)
                    done = []
                done.append((piece["conv"], []))
            done[-1][1].append(piece)
    if done:
        yield answer(kind)


def _repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns after the edits; a piece's edits come before its rows."""
    conv, first, state, edits, at, place = None, True, START, "", 0, 0
    for batch in batches:
        out: list[tuple] = []

        def insert() -> None:
            nonlocal at, state, place
            while at < len(edits) and edits[at] == "I":
                state = after(state)
                out.append((conv, place, "I", ROLE_NAMES[state], ""))
                at, place = at + 1, place + 1

        columns = [batch.column(n).to_pylist() for n in ("conv", "edits", "state", "role", "text")]
        for c, new, begin, role, text in zip(*columns):
            if new is not None:
                insert()
                if first or c != conv:
                    conv, first, place = c, False, 0
                state, edits, at = begin, new, 0
                continue
            insert()
            edit = edits[at]
            at += 1
            if edit != "D":
                state = after(state) if edit == "R" else {"s": S, "u": U, "a": A}[role[0]]
                out.append((conv, place, edit, ROLE_NAMES[state] if edit == "R" else role, text))
                place += 1
        yield _turns(out, batch.schema.field("conv").type)
        kind = batch.schema.field("conv").type
    if not first:
        out = []
        while at < len(edits):  # inserts after the last row
            state = after(state)
            out.append((conv, place, "I", ROLE_NAMES[state], ""))
            at, place = at + 1, place + 1
        yield _turns(out, kind)


def _turns(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 5, kinds)], names=["conv", "place", "edit", "role", "text"])


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of ``role:text`` lines per conversation; rows come by conversation, in order."""
    conv, digest, kind = None, None, None
    for batch in batches:
        kind = batch.schema.field("conv").type
        done = []
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "text"))):
            if digest is not None and c == conv:
                digest.update(b"\n")
            else:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], names=["conv", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])


def damaged(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` after the damage that the checksum of ``conv:turn`` says; nulls are one space there, in roles and in texts."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(word(conv_col), F.lit(":"), word(turn_col))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(word(text_col), ".!?", "")).otherwise(word(text_col))
    role = F.when(fate == 4, "user").otherwise(word(role_col))
    times = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), times.alias("times"))
    return rows.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


class Repair:
    """The repair of a table of turns (``conv``, ``turn``, ``role``, ``text`` without nulls in the last two).

    Turns of a conversation are taken by ``turn``, nulls first; of equal ones by role, then by a digest of role and text, so the
    result doesn't depend on where rows lie. A null ``conv`` is a conversation of its own. A turn is blank if its text has no
    character besides white space, else a duplicate if role and text came earlier, else truncated if its last character is
    no full stop, exclamation or question mark. A conversation may be of any length: its rows, and the pieces of its
    sequence, are spread over tasks; only its audit string, which is one cell, and the stream of its repaired turns
    come together.
    """

    def __init__(self, turns: DataFrame):
        spark = turns.sparkSession
        small_batches(spark)
        self.parts = shuffle_partitions(spark)
        self.kind = turns.schema["conv"].dataType
        digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
        keys = ["conv", "turn", "role", "digest", "salt"]
        # The salt only spreads equal rows, which may change places.
        keyed = turns.withColumn("digest", digest).withColumn("salt", F.monotonically_increasing_id())
        ordered = keyed.repartitionByRange(self.parts, *keys).sortWithinPartitions(*keys).drop("salt")
        self.rows = store(ordered.withColumn("pos", F.monotonically_increasing_id()), "turns", "zstd")
        rows = self.rows
        trimmed = F.rtrim("text", F.lit(WHITE))
        initial = F.substring("role", 1, 1)
        role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
        firsts = rows.groupBy("conv", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
        light = rows.select("conv", "turn", "pos", role.alias("role"), (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("open"))
        light = light.join(firsts, "pos", "left").withColumn("duplicate", ~F.col("blank") & F.col("first").isNull())
        light = light.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open"))
        symbol = F.when(F.col("blank") | F.col("duplicate"), GONE).otherwise(2 * F.col("role") + F.col("truncated").cast("int"))
        self.light = store(light.select("conv", "turn", "pos", "role", "blank", "duplicate", "truncated", symbol.alias("symbol")), "faults")
        self.paths = self._paths()

    def _schema(self, *fields: tuple) -> T.StructType:
        return T.StructType([T.StructField("conv", self.kind), *(T.StructField(n, t) for n, t in fields)])

    def _paths(self) -> DataFrame:
        many, text = T.LongType(), T.StringType()
        pieces = self._schema(
            ("seg", many), ("head", T.IntegerType()), ("tail", T.IntegerType()), ("illegal", many), ("costs", T.ArrayType(many)), ("audits", T.ArrayType(text))
        )
        sequence = self.light.select("conv", "pos", "symbol", "role", F.shiftright("pos", 33).alias("span")).repartition(self.parts, "span").sortWithinPartitions("pos")
        segments = sequence.select("conv", "pos", "symbol", "role").mapInArrow(_segment_rows, pieces)
        path = self._schema(("seg", many), ("state", T.IntegerType()), ("edits", text), ("cost", many), ("audit", text), ("illegal", many))
        return store(segments.repartition(self.parts, "conv").sortWithinPartitions("conv", "seg").mapInArrow(_path_rows, path), "paths")

    def turns(self) -> DataFrame:
        """``conv``, ``place``, ``edit`` (Keep, Rerole, Insert by initial), ``role``, ``text`` of all turns after the repair, by conversation and in order within a task."""
        none = lambda t: F.lit(None).cast(t)
        edits = self.paths.select("conv", F.col("seg").alias("pos"), F.lit(0).alias("kind"), "edits", "state", none("string").alias("role"), none("string").alias("text"))
        rows = self.rows.select("conv", "pos", F.lit(1).alias("kind"), none("string").alias("edits"), none("int").alias("state"), "role", "text")
        both = edits.union(rows).repartition(self.parts, "conv").sortWithinPartitions("conv", "pos", "kind")
        text = T.StringType()
        return both.mapInArrow(_repaired_rows, self._schema(("place", T.LongType()), ("edit", text), ("role", text), ("text", text)))

    def digests(self) -> DataFrame:
        """``conv`` and the SHA-256 of its repaired turns as ``role:text`` lines; conversations without turns are left out."""
        return self.turns().mapInArrow(_digest_rows, self._schema(("repaired_sha256", T.StringType())))

    def faults(self) -> DataFrame:
        """Per conversation ``gaps``, ``blank``, ``duplicate``, ``truncated``."""
        count = lambda n: F.sum(F.col(n).cast("bigint")).alias(n)
        by_turn = self.light.groupBy("conv", "turn").agg(count("blank"), count("duplicate"), count("truncated"))
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps")
        return by_turn.groupBy("conv").agg(gaps, *(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")))


def summarize(turns: DataFrame, conv_col: str, repair: Repair) -> DataFrame:
    """Per conversation of ``turns``: id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    Conversations that have no turn left have zeros, an empty audit and the digest of nothing. An empty table gives none.
    """
    side = lambda df, n: df.withColumnRenamed("conv", n)
    out = turns.select(F.col(conv_col).alias("conv")).distinct()
    costs = repair.paths.where("cost IS NOT NULL").select("conv", "cost", "audit", "illegal")
    for n, more in enumerate((repair.faults(), costs, repair.digests())):
        out = out.join(side(more, f"conv{n}"), F.col("conv").eqNullSafe(F.col(f"conv{n}")), "left").drop(f"conv{n}")
    zero: list[Column] = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select(F.col("conv").alias(conv_col), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
