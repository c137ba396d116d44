"""Token alignment of two tokenizers and corpus-wide counts of linked token pairs, by external spill counting.

1. A task encodes its texts with both tokenizers and cuts them into groups where tokens
   of both end. Every pair of an A and a B token of one group is a link.
2. The distinct (pair, document) records of some ``RUN_BYTES`` of text are sorted side-major
   (A, then B, then document) and spilled as a run: one compressed piece per radix of the A id.
   A run's head lists its pairs with their number of documents.
3. The heads of one radix meet in one task. A heap over the ends of the loaded blocks says which run
   is read on; equal pairs of all runs are added. As pairs come side-major, an A id is done when the
   next one starts: then its highest count is known, and each run gets the counts of its pairs back.
4. Counts and records of a run meet again and are added up per document.

A pair is one entry in a run however many documents hold it, so a pair that occurs everywhere costs
one entry a run. A task holds one run, or one block of each run of a radix.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.llm.bpe import WIDE_WHITE, Bpe
from gaugeframe.llm.common import KNOWN_BYTES, Known, flat, gather, shuffle_partitions, slices, small_batches, store

RUN_BYTES = 16 << 20
RUN_DOCS = 1 << 20
BLOCK_PAIRS = 4096
CHUNK_LINKS = 1 << 20
SPILL_RECORDS = 1 << 23
BLANK = "▁"  # fixed: the sign that stands for a space in the pieces


class ByteTokens:
    """Side A: a byte-level vocabulary; special tokens written in a text are plain text."""

    def __init__(self, path: str):
        self.bpe = Bpe(path)
        self.bpe.special, self.bpe.mark, self.bpe.odd = {}, None, regex.compile(WIDE_WHITE)
        self.start, self.length, self.bytes, self.size = self.bpe.start, self.bpe.length, self.bpe.bytes, self.bpe.size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.bpe.encode(data, offsets)


class PieceTokens:
    """Side B: a piece vocabulary with byte fallback.

    The library encodes; the space that it would add is in the texts already. Texts are cut
    before every run of spaces and around line ends, which no piece crosses, and units met before are looked up.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a vocabulary that rewrites texts can't be encoded in units")
        model.normalizer_spec.add_dummy_prefix = False
        self.processor = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.size = self.processor.get_piece_size()
        names = [self._bytes(i) for i in range(self.size)]
        if any(b"\n" in n[1:] or b" " in n.lstrip(b" ") for n in names):
            raise ValueError("a piece goes on after a space or line end")
        self.bytes = np.frombuffer(b"".join(names), np.uint8)
        self.length = np.array([len(n) for n in names], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.known = Known(KNOWN_BYTES)

    def _bytes(self, i: int) -> bytes:
        piece = self.processor.id_to_piece(i)
        if self.processor.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        if self.processor.is_control(i) or self.processor.is_unknown(i):
            return b""
        return piece.replace(BLANK, " ").encode()

    def unit_ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.processor.encode([u.decode() for u in units], num_threads=1)
        sizes = np.array([len(x) for x in ids], np.int64)
        return sizes, np.concatenate([np.array(x, np.uint32) for x in ids])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the n + 1 offsets."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(data), bool)
        cut[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20) | (data[1:] == 0x0A) | (data[:-1] == 0x0A)
        firsts = offsets[:-1]
        cut[firsts[firsts < len(data)]] = True
        starts = np.flatnonzero(cut)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(np.ascontiguousarray(data))])
        coded = units.dictionary_encode()
        at, sizes, pool = self.known.look_up(coded.dictionary.to_pylist(), self.unit_ids)
        unit = coded.indices.to_numpy()
        row, ends = gather(at[unit], sizes[unit], pool)
        return row, ends[np.searchsorted(starts, offsets)]


_SIDES: dict[tuple[str, str], tuple[ByteTokens, PieceTokens]] = {}


def sides(byte_path: str, piece_path: str) -> tuple[ByteTokens, PieceTokens]:
    """Both vocabularies, once per worker."""
    if (byte_path, piece_path) not in _SIDES:
        _SIDES[byte_path, piece_path] = ByteTokens(byte_path), PieceTokens(piece_path)
    return _SIDES[byte_path, piece_path]


class Aligned:
    """The groups of some texts. Texts whose tokens do not spell them have no tokens."""

    def __init__(self, a: ByteTokens, b: PieceTokens, data: np.ndarray, offsets: np.ndarray):
        self.rows = len(offsets) - 1
        size = np.diff(offsets)
        ids, counts = [], []
        good = np.ones(self.rows, bool)
        for side in (a, b):
            own, ends = side.encode(data, offsets)
            count = np.diff(ends)
            spelt = np.zeros(self.rows, np.int64)
            np.add.at(spelt, np.repeat(np.arange(self.rows), count), side.length[own])
            good &= spelt == size
            ids.append(own.astype(np.int64))
            counts.append(count)
        for n, side in enumerate((a, b)):
            own = ids[n][np.repeat(good, counts[n])]
            made = gather(side.start[own], side.length[own], side.bytes)[0]
            wrong = made != data[np.repeat(good, size)]
            if wrong.any():
                row = np.repeat(np.flatnonzero(good), size[good])
                good[row[wrong]] = False
        self.a, self.b = (x[np.repeat(good, c)] for x, c in zip(ids, counts))
        self.n_a, self.n_b = (np.where(good, c, 0) for c in counts)
        end_a, end_b = np.cumsum(a.length[self.a]), np.cumsum(b.length[self.b])
        marks = np.zeros(int(size[good].sum()) + 1, bool)
        marks[end_b] = True
        common = end_a[marks[end_a]]  # where tokens of both end; the end of a text is always one
        self.group_a, self.group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        self.size_a, self.size_b = (np.bincount(g, minlength=len(common)) for g in (self.group_a, self.group_b))
        text_end = np.cumsum(np.where(good, size, 0))
        self.row_of = np.searchsorted(text_end, common)  # of each group; empty texts end where the one before ends
        self.n_groups = np.bincount(self.row_of, minlength=self.rows)
        links = np.zeros(self.rows, np.int64)
        np.add.at(links, self.row_of, self.size_a * self.size_b)
        self.n_links = links

    def spelled(self, letters: Letters) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        total = len(self.a) + len(self.b)
        place_a = np.arange(len(self.a)) + (np.cumsum(self.size_b) - self.size_b)[self.group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(self.size_a)[self.group_b]
        last_a = np.append(self.group_a[1:] != self.group_a[:-1], True)[: len(self.a)]
        last_b = np.append(self.group_b[1:] != self.group_b[:-1], True)[: len(self.b)]
        unit = np.empty(total, np.int64)
        unit[place_a] = letters.number(self.a, np.where(last_a, 1, 0))
        unit[place_b] = letters.number(self.b, np.where(last_b, 2, 0))
        row, ends = gather(letters.start[unit], letters.length[unit], letters.bytes)
        cut = ends[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        whole = row.tobytes()
        return [whole[x : max(y - 1, x)] for x, y in zip(cut[:-1], cut[1:])]

    def links(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(row << 2 * bits | A id << bits | B id) of links, with how often each is meant if not once, in bounded chunks."""
        first_a, first_b = (np.cumsum(s) - s for s in (self.size_a, self.size_b))
        made = self.size_a * self.size_b
        wide = made > CHUNK_LINKS
        lead = self.row_of.astype(np.int64) << 2 * bits
        total = np.cumsum(np.where(wide, 0, made))
        at = 0
        while at < len(made):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK_LINKS, side="right")))
            token = np.arange(first_a[at], first_a[to - 1] + self.size_a[to - 1])
            token = token[~wide[self.group_a[token]]]
            group = self.group_a[token]
            many = self.size_b[group]
            other = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - first_b[group], many)
            keys = np.repeat(lead[group] | self.a[token] << bits, many) | self.b[other]
            yield keys, None
            at = to
        # A long stretch without a common end: its distinct ids meet, weighed by how often they occur.
        for g in np.flatnonzero(wide):
            a, times_a = np.unique(self.a[first_a[g] : first_a[g] + self.size_a[g]], return_counts=True)
            b, times_b = np.unique(self.b[first_b[g] : first_b[g] + self.size_b[g]], return_counts=True)
            step = max(CHUNK_LINKS // len(b), 1)
            for i in range(0, len(a), step):
                keys = (lead[g] | a[i : i + step, None] << bits | b[None]).ravel()
                yield keys, (times_a[i : i + step, None] * times_b[None]).ravel()


class Letters:
    """Decimal ids with each of the separators ``,`` ``|`` ``;``."""

    def __init__(self, size: int):
        names = [f"{i}{mark}".encode() for mark in ",|;" for i in range(size)]
        self.size = size
        self.bytes = np.frombuffer(b"".join(names), np.uint8)
        self.length = np.array([len(n) for n in names], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def number(self, ids: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return mark * self.size + ids


def added(keys: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sum of their weights, one each if none are given."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
    elif weights.max() < 1 << 11 and keys.max() < 1 << 52:
        both = np.sort(keys << 11 | weights)  # much faster than an order and two look-ups
        keys, weights = both >> 11, both & (1 << 11) - 1
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys))) if weights is None else np.add.reduceat(weights, first)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8)
    used = int(np.flatnonzero(planes.any(axis=0))[-1]) + 1 if planes.any() else 0
    return zstandard.compress(len(values).to_bytes(8, "little") + planes[:, :used].T.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    plain = zstandard.decompress(raw)
    count = int.from_bytes(plain[:8], "little")
    out = np.zeros((count, 8), np.uint8)
    if count:
        planes = np.frombuffer(plain, np.uint8, offset=8).reshape(-1, count)
        out[:, : len(planes)] = planes.T
    return out.reshape(-1).view("<i8")


class Run:
    """Records of some texts, to be spilled: sorted by radix, A, B and document."""

    def __init__(self, bits: int, radix: int):
        self.bits, self.radix = bits, radix
        self.docs = self.bytes = self.held = 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, aligned: Aligned, n_bytes: int) -> None:
        for keys, weights in aligned.links(self.bits):
            row, pair = keys >> 2 * self.bits, keys & (1 << 2 * self.bits) - 1
            self.parts.append(added(turned(pair, self.bits, self.radix) * RUN_DOCS + row + self.docs, weights))
            self.held += len(self.parts[-1][0])
            if self.held > SPILL_RECORDS:
                self.parts = [self.whole()]
                self.held = len(self.parts[0][0]) // 2
        self.docs += aligned.rows
        self.bytes += n_bytes

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        keys, weights = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 2
        return added(keys, weights)

    def pieces(self) -> Iterator[tuple[int, list[bytes], bytes]]:
        """Radix, head blocks and records of every piece."""
        keys, weights = self.whole()
        pair, doc = keys // RUN_DOCS, keys % RUN_DOCS
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        heads, count = pair[first], np.diff(np.append(first, len(pair)))
        cut = np.searchsorted(heads >> 2 * self.bits - self.radix, np.arange((1 << self.radix) + 1))
        ends = np.append(first, len(pair))
        for part in np.flatnonzero(np.diff(cut)):
            x, y = cut[part], cut[part + 1]
            blocks = [pack(np.concatenate([np.diff(heads[i : min(i + BLOCK_PAIRS, y)], prepend=0), count[i : min(i + BLOCK_PAIRS, y)]])) for i in range(x, y, BLOCK_PAIRS)]
            records = [pack(v) for v in (count[x:y], doc[ends[x] : ends[y]], weights[ends[x] : ends[y]])]
            sizes = b"".join(len(r).to_bytes(8, "little") for r in records)
            yield int(part), blocks, sizes + b"".join(records)


def turned(pair: np.ndarray, bits: int, radix: int) -> np.ndarray:
    """The pair with the low ``radix`` bits of its A id moved to the top."""
    a, b = pair >> bits, pair & (1 << bits) - 1
    return ((a & (1 << radix) - 1) << bits - radix | a >> radix) << bits | b


def straight(pair: np.ndarray, bits: int, radix: int) -> np.ndarray:
    """Undoes ``turned``."""
    a, b = pair >> bits, pair & (1 << bits) - 1
    return ((a & (1 << bits - radix) - 1) << radix | a >> bits - radix) << bits | b


BASE = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType())]


def _spill(byte_path: str, piece_path: str, bits: int, radix: int):
    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(byte_path, piece_path)
        letters = Letters(max(a.size, b.size))
        number = TaskContext.get().partitionId() << 32
        run = Run(bits, radix)
        for batch in slices(batches, "text"):
            if run.bytes >= RUN_BYTES or run.docs + batch.num_rows > RUN_DOCS:
                yield from spilled(run, number, kind)
                run, number = Run(bits, radix), number + 1
            data, offsets = flat(batch.column("text"))
            aligned = Aligned(a, b, data, offsets)
            digests = [hashlib.sha256(t).hexdigest() if t else "" for t in aligned.spelled(letters)]
            n = batch.num_rows
            kind = batch.schema.field("id").type
            yield rows(
                n, kind, run=pa.array(np.full(n, number)), doc=pa.array(run.docs + np.arange(n)), id=batch.column("id"), groups_sha256=pa.array(digests, pa.string()),
                **{c: pa.array(getattr(aligned, c).astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")},
            )
            run.add(aligned, len(data))
        if run.docs:
            yield from spilled(run, number, kind)

    def spilled(run: Run, number: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for part, heads, records in run.pieces():
            yield rows(
                1, kind, run=pa.array([number]), part=pa.array([part], pa.int32()), doc=pa.array([run.docs]),
                heads=pa.array([heads], pa.list_(pa.binary())), records=pa.array([records], pa.binary()),
            )

    def rows(n: int, kind: pa.DataType, **columns) -> pa.RecordBatch:
        kinds = {"run": pa.int64(), "part": pa.int32(), "doc": pa.int64(), "id": kind} | {c: pa.string() if t == T.StringType() else pa.int64() for c, t in BASE}
        kinds |= {"heads": pa.list_(pa.binary()), "records": pa.binary()}
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in kinds.items()], names=list(kinds))

    return spill


class Cursor:
    """A run's head, one block at a time."""

    def __init__(self, run: int, blocks: list[bytes]):
        self.run, self.blocks, self.next = run, blocks, 0
        self.keys = self.counts = np.zeros(0, np.int64)

    def load(self) -> bool:
        """Append the next block; False at the end."""
        if self.next == len(self.blocks):
            return False
        both = unpack(self.blocks[self.next])
        self.next += 1
        keys, counts = np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]
        self.keys, self.counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        return True

    def take(self, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """The entries up to ``bound``, removed."""
        n = int(np.searchsorted(self.keys, bound, side="right"))
        out = self.keys[:n], self.counts[:n]
        self.keys, self.counts = self.keys[n:], self.counts[n:]
        return out


def merged(cursors: list[Cursor], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Key, run place, total and whether it is the highest of its A id, of the entries of whole A ids, in order of (run place, key).

    The heap holds the last loaded key of every run that goes on. Up to a bound, runs that end
    below it are read on; then all entries up to the bound are there.
    """
    heap = []
    for place, cursor in enumerate(cursors):
        if cursor.load():
            heapq.heappush(heap, (int(cursor.keys[-1]), place))
    kept = tuple(np.zeros(0, np.int64) for _ in range(3))
    while True:
        over = not heap
        bound = (1 << 62) if over else sorted(h[0] for h in heap)[len(heap) // 2]
        while heap and heap[0][0] < bound:
            _, place = heapq.heappop(heap)
            if cursors[place].load():
                heapq.heappush(heap, (int(cursors[place].keys[-1]), place))
        # A run whose block ends at the bound goes on after it.
        while heap and heap[0][0] == bound:
            _, place = heapq.heappop(heap)
            if cursors[place].load():
                heapq.heappush(heap, (int(cursors[place].keys[-1]), place))
        taken = [c.take(bound) for c in cursors]
        keys = np.concatenate([kept[0], *(k for k, _ in taken)])
        counts = np.concatenate([kept[1], *(c for _, c in taken)])
        place = np.concatenate([kept[2], np.repeat(np.arange(len(cursors)), [len(k) for k, _ in taken])])
        side = keys >> bits
        whole = np.ones(len(keys), bool) if over else side < (bound >> bits)
        kept = keys[~whole], counts[~whole], place[~whole]
        keys, counts, place, side = keys[whole], counts[whole], place[whole], side[whole]
        if len(keys):
            distinct, entry = np.unique(keys, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, entry, counts)
            own = distinct >> bits
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            highest = np.repeat(np.maximum.reduceat(total, first), np.diff(np.append(first, len(own))))
            order = np.lexsort((keys, place))
            yield keys[order], place[order], total[entry][order], (total == highest)[entry][order]
        if over:
            return


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Cursor]]]:
    """The heads of each radix; rows come sorted by it."""
    part, held = None, []
    for batch in batches:
        for p, run, heads in zip(*(batch.column(n).to_pylist() for n in ("part", "run", "heads"))):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append(Cursor(run, heads))
    if held:
        yield part, held


def _back(bits: int):
    """Totals (doubled, plus one where highest) for the pairs of each run, piece by piece."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cursors in _parts(batches):
            for step, (_, place, total, best) in enumerate(merged(cursors, bits)):
                values = total << 1 | best
                cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                ends = np.append(cut[1:], len(place))
                n = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cursors[place[x]].run for x in cut], pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, step, np.int32)),
                     pa.array([pack(values[x:y]) for x, y in zip(cut, ends)], pa.binary())],
                    names=["run", "part", "step", "payload"],
                )

    return merge


def _pair_rows(bits: int, radix: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cursors in _parts(batches):
            for keys, _, total, best in merged(cursors, bits):
                keys, first = np.unique(keys, return_index=True)
                pair = straight(keys, bits, radix)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair >> bits), pa.array(pair & (1 << bits) - 1), pa.array(total[first]), pa.array(best[first])],
                    names=["a_id", "b_id", "n_docs", "best"],
                )

    return merge


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document of a run the links with a highest count and the sum of counts; rows come by run, radix and step, records last."""
    run, best, total, values = None, None, None, []
    for batch in batches:
        for r, docs, step, payload in zip(*(batch.column(n).to_pylist() for n in ("run", "docs", "step", "payload"))):
            if r != run:
                if best is not None:
                    yield _doc_rows(run, best, total)
                run, best, values = r, None, []
            if step >= 0:
                values.append(unpack(payload))
                continue
            if best is None:
                best, total = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
            sizes = [int.from_bytes(payload[i : i + 8], "little") for i in (0, 8, 16)]
            at = np.cumsum([24, *sizes])
            count, doc, times = (unpack(payload[x:y]) for x, y in zip(at[:-1], at[1:]))
            value = np.repeat(np.concatenate(values), count)
            values = []
            np.add.at(best, doc, times * (value & 1))
            np.add.at(total, doc, times * (value >> 1))
    if best is not None:
        yield _doc_rows(run, best, total)


def _doc_rows(run: int, best: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    n = len(best)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, run)), pa.array(np.arange(n)), pa.array(best), pa.array(total)], names=["run", "doc", "n_best", "count_sum"])


def _spilled(docs: DataFrame, id_col: str, text_col: str, byte_path: str, piece_path: str) -> tuple[DataFrame, int, int]:
    """The stored rows of documents and of run pieces, the bits of an id, and those of the radix."""
    small_batches(docs.sparkSession)
    a, b = sides(byte_path, piece_path)
    bits = (max(a.size, b.size) - 1).bit_length()
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).otherwise("").cast("binary").alias("text"))
    # More input makes more runs, so the pieces of one radix are kept as small by more of them.
    radix = min(bits, max(6, (docs.rdd.getNumPartitions() - 1).bit_length() + 2))
    fields = [T.StructField("run", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("id", docs.schema[id_col].dataType)]
    fields += [T.StructField(n, t) for n, t in BASE]
    fields += [T.StructField("heads", T.ArrayType(T.BinaryType())), T.StructField("records", T.BinaryType())]
    schema = T.StructType(fields)
    return store(texts.mapInArrow(_spill(byte_path, piece_path, bits, radix), schema), "runs"), bits, radix


def _heads(spilled: DataFrame) -> DataFrame:
    parts = shuffle_partitions(spilled.sparkSession)
    return spilled.where("part IS NOT NULL").select("part", "run", "heads").repartition(parts, "part").sortWithinPartitions("part", "run")


def score_links(docs: DataFrame, id_col: str, text_col: str, byte_path: str, piece_path: str) -> DataFrame:
    """Per row of ``docs``: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    Side A encodes a space and the text, side B the text with the space that its library adds.
    A pair's count is the number of rows that hold it linked; ``n_best`` are the links whose count is the
    highest of their A id, ``count_sum`` adds the counts of all links. Texts that are null, empty or not
    spelled by the tokens of both sides have zeros and an empty digest. Repeated rows and rows with
    null ids count as rows of their own; other columns are not read; an empty table gives none.
    """
    spilled, bits, _ = _spilled(docs, id_col, text_col, byte_path, piece_path)
    back = _heads(spilled).mapInArrow(_back(bits), "run bigint, part int, step int, payload binary")
    none = F.lit(None).cast("bigint")
    records = spilled.where("part IS NOT NULL").select("run", "part", F.col("doc").alias("docs"), F.lit(-1).alias("step"), F.col("records").alias("payload"))
    both = records.unionByName(back.withColumn("docs", none)).withColumn("late", F.col("step") < 0)
    parts = shuffle_partitions(docs.sparkSession)
    sums = both.repartition(parts, "run").sortWithinPartitions("run", "part", "late", "step").mapInArrow(
        _sum_rows, "run bigint, doc bigint, n_best bigint, count_sum bigint"
    )
    rows = spilled.where("part IS NULL").select("run", "doc", "id", *(n for n, _ in BASE))
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("bigint").alias(n)
    joined = rows.join(sums, ["run", "doc"], "left")
    return joined.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def pair_counts(docs: DataFrame, id_col: str, text_col: str, byte_path: str, piece_path: str) -> DataFrame:
    """``a_id``, ``b_id``, ``n_docs`` and ``best`` (highest of its A id, ties included) of every linked pair."""
    spilled, bits, radix = _spilled(docs, id_col, text_col, byte_path, piece_path)
    return _heads(spilled).mapInArrow(_pair_rows(bits, radix), "a_id bigint, b_id bigint, n_docs bigint, best boolean")


def aligned_groups(docs: DataFrame, id_col: str, text_col: str, byte_path: str, piece_path: str) -> DataFrame:
    """Id and ``groups`` (``a1,a2|b1;a3|b2,b3``) of every row; empty where a text has no tokens."""
    small_batches(docs.sparkSession)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(byte_path, piece_path)
        letters = Letters(max(a.size, b.size))
        for batch in slices(batches, "text"):
            texts = Aligned(a, b, *flat(batch.column("text"))).spelled(letters)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([t.decode() for t in texts], pa.string())], names=[id_col, "groups"])

    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).otherwise("").cast("binary").alias("text"))
    return texts.mapInArrow(spell, T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("groups", T.StringType())]))
