"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.llm.common import Known, body, flat, gather, slices, small_batches

ENCODED_BYTES = 4 << 20
LONG_WORD = 2048
# Fixed: Unicode white space, and the pre-tokens of the byte-level scheme.
WIDE = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WHITE = r"\t-\r " + WIDE
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+|[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + "]+"
)
UNIT = regex.compile(" ?[^" + WHITE + "]+|[" + WHITE + "]+(?![^" + WHITE + "])|[" + WHITE + "]+")
ASCII_WHITE = np.zeros(256, bool)
ASCII_WHITE[list(b"\t\n\x0b\x0c\r ")] = True
WIDE_WHITE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in shown):
        letters[chr(0x100 + n)] = b
    return letters


class Bpe:
    """A byte-level vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.base = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.base[byte] = vocab[letter]
        names = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.bytes = np.frombuffer(b"".join(names.get(i, b"") for i in range(self.size)), np.uint8)
        self.length = np.array([len(names.get(i, b"")) for i in range(self.size)], np.int64)
        self.start = np.cumsum(self.length) - self.length
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(self.size, -1)
        born[made[::-1]] = np.arange(len(made))[::-1]
        if (np.maximum(born[keys // self.size], born[keys % self.size]) >= np.arange(len(keys))).any():
            raise ValueError("a merge comes before the merges that make its parts")
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        marks = b"|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.mark = regex.compile(marks) if marks else None
        self.odd = regex.compile(WIDE_WHITE + (b"|" + marks if marks else b""))
        self.known = Known()

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair by binary search, ``NONE`` if it never merges."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of every word. Each round merges, in all words at once, the occurrences of the word's lowest pair.

        A pair's parts come from earlier merges, so no merge makes a lower pair and
        equal pairs can merge together, from the left, without overlap. Words that
        have no pair left drop out; very long ones run alone, so that a round costs
        no more than that word.
        """
        done: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG_WORD]
        for group in [short, *([i] for i, w in enumerate(words) if len(w) > LONG_WORD)]:
            self._rounds(words, group, done)
        return done

    def _rounds(self, words: list[bytes], group: list[int], done: list[np.ndarray]) -> None:
        live = np.array(group, np.int64)
        symbols = self.base[np.frombuffer(b"".join(words[i] for i in group), np.uint8)]
        sizes = np.array([len(words[i]) for i in group], np.int64)
        ranks = self._all_ranks(symbols, sizes)
        while len(live):
            starts = np.cumsum(sizes) - sizes
            lowest = np.minimum.reduceat(ranks, starts)
            over = lowest == NONE
            if over.any():
                for w in np.flatnonzero(over):
                    done[live[w]] = symbols[starts[w] : starts[w] + sizes[w]].astype(np.uint32)
                keep = np.repeat(~over, sizes)
                live, sizes, symbols, ranks, lowest = live[~over], sizes[~over], symbols[keep], ranks[keep], lowest[~over]
                if not len(live):
                    return
            hit = ranks == np.repeat(lowest, sizes)
            at = np.flatnonzero(hit)
            # In a run of neighbouring hits (equal symbols) every second one would overlap.
            run = np.concatenate([[True], np.diff(at) > 1])
            first = at[run][np.cumsum(run) - 1]
            at = at[(at - first) % 2 == 0]
            word = np.repeat(np.arange(len(live)), sizes)
            symbols[at] = self.made[ranks[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            moved = at - np.arange(len(at))
            sizes = sizes - np.bincount(word[at], minlength=len(live))
            symbols, ranks, word = symbols[~gone], ranks[~gone], word[~gone]
            near = np.zeros(len(symbols), bool)
            near[moved] = True
            near[moved[moved > 0] - 1] = True
            touched = np.flatnonzero(near)
            ranks[touched] = NONE
            inner = touched[touched + 1 < len(symbols)]
            inner = inner[word[inner] == word[inner + 1]]
            ranks[inner] = self.pair_ranks(symbols[inner], symbols[inner + 1])

    def _all_ranks(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ranks = np.full(len(symbols), NONE)
        if len(symbols) > 1:
            ranks[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
        ranks[np.cumsum(sizes) - 1] = NONE
        return ranks

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the units of all texts: a word with the blank before it, or white space that stays alone.

        Pre-tokens never cross a unit. ASCII white space is found in one pass; texts
        with other white space or special tokens are cut by a pattern.
        """
        white = ASCII_WHITE[data]
        cut = np.zeros(len(data), bool)
        word = np.flatnonzero(~white[1:] & white[:-1]) + 1
        word = word[offsets[np.searchsorted(offsets, word)] != word]  # white space before it ends another text
        cut[word - 1] = True
        cut[word[data[word - 1] != 0x20]] = True
        cut[1:] |= white[1:] & ~white[:-1]
        raw = data.tobytes()
        odd = np.searchsorted(offsets, [m.start() for m in self.odd.finditer(raw)], side="right") - 1
        for row in np.unique(odd):
            a, b = offsets[row], offsets[row + 1]
            cut[a:b] = False
            at = a
            for text, special in self._segments(raw[a:b]):
                for unit in [text] if special else [m.group().encode() for m in UNIT.finditer(text.decode("utf-8", "replace"))]:
                    cut[at] = True
                    at += len(unit)
        starts = offsets[:-1]
        cut[starts[starts < len(data)]] = True
        return np.flatnonzero(cut)

    def _segments(self, raw: bytes) -> Iterator[tuple[bytes, bool]]:
        at = 0
        for m in self.mark.finditer(raw) if self.mark else ():
            if m.start() > at:
                yield raw[at : m.start()], False
            yield m.group(), True
            at = m.end()
        if at < len(raw):
            yield raw[at:], False

    def unit_ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of units that are not known yet."""
        split = [[u] if u in self.special else [m.group().encode() for m in PRETOKEN.finditer(u.decode())] for u in units]
        every = list(chain.from_iterable(split))
        words = list(dict.fromkeys(every))
        merged = self.merge([w if w not in self.special else b"" for w in words])
        ids = [np.array([self.special[w]], np.uint32) if w in self.special else m for w, m in zip(words, merged)]
        sizes = np.array([len(x) for x in ids], np.int64)
        number = dict(zip(words, range(len(words))))
        own = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
        row, ends = gather((np.cumsum(sizes) - sizes)[own], sizes[own], np.concatenate(ids))
        last = np.cumsum([len(c) for c in split])
        return np.diff(np.concatenate([[0], ends[last]])), row

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the n + 1 offsets."""
        starts = self.cuts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(np.ascontiguousarray(data))])
        coded = units.dictionary_encode()
        at, sizes, pool = self.known.look_up(coded.dictionary.to_pylist(), self.unit_ids)
        unit = coded.indices.to_numpy()
        row, ends = gather(at[unit], sizes[unit], pool)
        return row, ends[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids in a row, and the offset of each id."""
        return gather(self.start[ids], self.length[ids], self.bytes)


_LOADED: dict[str, Bpe] = {}


def vocabulary(path: str) -> Bpe:
    """One vocabulary per worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """Id, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every row.

    Whole texts are encoded; special tokens written in a text become their id. Null
    counts as empty and has no ids. Null ids and repeated rows come out as they are,
    other columns are not read, an empty table gives none. A worker holds
    ``ENCODED_BYTES`` of text, or one longer text, and a bounded memory of units met before.
    """
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in slices(batches, "text", ENCODED_BYTES):
            ids, offsets = bpe.encode(*flat(batch.column("text")))
            raw = ids.astype("<u4").tobytes()
            parts = [raw[4 * a : 4 * b] for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(offsets)), pa.array(parts, pa.binary())], names=[id_col, "n_tokens", "ids"]
            )

    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )
    return docs.select(F.col(id_col).alias("id"), body(text_col).cast("binary").alias("text")).mapInArrow(encode, schema)


def decode_ids(coded: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """All columns of ``coded`` with the text of its ids; bytes that are not UTF-8 become U+FFFD, null ids a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in slices(batches, ids_col):
            raw, offsets = flat(batch.column(ids_col).fill_null(b""))
            data, ends = bpe.decode(np.frombuffer(raw.tobytes(), "<u4"))
            whole, at = data.tobytes(), ends[offsets // 4]
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
            known = batch.column(ids_col).is_valid().to_pylist()
            column = pa.array([t if k else None for t, k in zip(texts, known)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, to])

    return coded.mapInArrow(decode, T.StructType([*coded.schema.fields, T.StructField(to, T.StringType())]))
