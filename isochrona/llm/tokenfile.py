"""Token ids in binary shards with a minimal perfect hash index.

A shard file holds, for a run of ascending document keys, the raw ids of all its documents one after another, and an index from
key to place: a minimal perfect hash (levels of bit arrays; a key sits at the first level where no other key wants its bit, its
slot is the number of bits set before) leads to a slot with a stored 32-bit fingerprint of the key and its records. A look-up
reads a few words, whatever the shard's size; a key that was never stored fails on its fingerprint (but for one in 2^32).

Layout, little-endian: 8 bytes magic; header of 12 uint64 (records, distinct keys, null-key records, ids, bytes an id, levels,
and the places of the sections levels, bits, ranks, slots, records, payload, the last followed by keys); the sections.

Shards are written by the tasks that encode, under names of their own; the manifest lists the files of the attempts that
succeeded, so a repeated task leaves at worst an unlisted file. Files go to a folder that driver and executors share.

Defined results: a null or empty text has only the end id; null keys come first and have no index entry; records of equal keys
stay together in the order of their texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import fresh_path, stage

MAGIC, END_ID, SHARD_IDS, CACHE, SLACK = b"IDSHARD1", 0, 1 << 22, 600_000, 1.6
VOCABULARY = "byte_bpe_50k.json"
#: Most tasks that read shards back.
READERS = 20_000
#: Single spaces between words.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Within a part: between a Latin letter and a mark or line end, and around a single line end.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_INNER = re.compile(f"(?<=[{_LETTER}])(?=[.,;:!?\n][^{_LETTER}]|[.,;:!?\n]$|\n)|(?<=[.,;:!?])(?=\n[{_LETTER}])|(?<=[{_LETTER}.,;:!?]\n)(?=[{_LETTER}])")
_LETTERS = re.compile(f" ?[{_LETTER}]+")
#: A word and signs without an apostrophe, which the pre-tokenizer takes as one run.
_SIGNED = re.compile(f"( ?[{_LETTER}]+)([!-&(-/:-@\\[-`{{-~]+)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else those from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: The letter of a space.
_SPACE = byte_letters()[32]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """The library's ids of whole texts. A text is cut before single spaces between words, where its pre-tokenizer always cuts,
    so that the library sees each distinct part once as long as a bounded store of parts lasts. The store has a part that begins
    with a space without it, any other with a space before it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.step = self.model.model.tokenize
        self.letters = str.maketrans({i: c for i, c in enumerate(byte_letters())})

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _library(self, text: str) -> bytes:
        return self.pack(self.model.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return self._library(text)
        first, space, rest = text.partition(" ")
        words = rest.split(" ") if space else []
        found = list(map(self.known.get, words))
        if None in found:
            found = [self._word(w) if x is None else x for w, x in zip(words, found, strict=True)]
        if None in found or first[-1:].isspace():  # white space next to a space: there a text is not cut
            first, *words = _CUT.split(text)
            found = [self._part(" " + w) for w in words]
        return self._part(first) + b"".join(found)

    def _word(self, word: str) -> bytes | None:
        """The ids of a space and word; None if word is empty or has white space at an end, such as is never stored."""
        if (x := self.known.get(word)) is not None:
            return x
        if (x := self.old.get(word)) is None:
            if word.isascii() and word.isalpha():  # one pre-token: the library's model step alone
                x = self.pack([t.id for t in self.step(_SPACE + word)])
            elif not word or word[0].isspace() or word[-1].isspace():
                return None
            else:
                x = self._new(" " + word)
        return self._stored(word, x)

    def _part(self, part: str) -> bytes:
        """The ids of a part, from the store or the library."""
        if part[:1] == " " and not part[1:2].isspace() and (x := self._word(part[1:])) is not None:
            return x
        if (x := self.known.get(key := " " + part)) is not None:
            return x
        return self._stored(key, self._new(part) if (x := self.old.get(key)) is None else x)

    def _new(self, part: str) -> bytes:
        if _LETTERS.fullmatch(part):  # one pre-token as well
            return self.pack([t.id for t in self.step(part.encode().decode("latin-1").translate(self.letters))])
        if m := _SIGNED.fullmatch(part):
            return self._part(m[1]) + self._part(m[2])
        if len(cuts := _INNER.split(part)) > 1:
            return b"".join(map(self._part, cuts))
        return self._library(part)

    def _stored(self, key: str, x: bytes) -> bytes:
        """Of the store, the generation before the last goes when one is full."""
        if len(self.known) >= CACHE:
            self.known, self.old = {}, self.known
        self.known[key] = x
        return x


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder a worker process: its store of parts is kept from task to task."""
    return Encoder(path)


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 mixed bits of each 64-bit key (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def perfect_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Levels of bit arrays (uint64 words) for distinct keys."""
    levels = []
    while len(keys):
        bits = max(64, int(len(keys) * SLACK) + 63 & ~63)
        at = (_mixed(keys, len(levels)) % np.uint64(bits)).astype(np.int64)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        keys = keys[~alone[at]]
    return levels


class Shard:
    """A shard's bytes: get(keys) by the index, ids(record)."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a shard of token ids")
        self.records, self.n_keys, self.nulls, self.n_ids, self.width, n_levels, *places = struct.unpack_from("<12Q", data, 8)
        take = lambda kind, place, n: np.frombuffer(data, kind, n, place)
        a, b, c, d, e, f = places
        self.sizes = take("<u8", a, n_levels)
        words = int(self.sizes.sum()) // 64
        self.bits, self.ranks = take("<u8", b, words), take("<u8", c, words)
        self.slots = take([("print", "<u4"), ("first", "<u4"), ("n", "<u4")], d, self.n_keys)
        self.ends = take("<u8", e, self.records + 1)
        self.payload = take(f"<u{self.width}", f, self.n_ids)
        self.keys = take("<i8", f + self.width * self.n_ids, self.n_keys)

    def get(self, keys) -> tuple[np.ndarray, np.ndarray]:
        """(first record, number of records) of each key; number 0 if the shard has no such key."""
        keys = np.asarray(keys, np.int64)
        slot, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, bits in enumerate(self.sizes):
            at = (_mixed(keys[open_], level) % bits).astype(np.int64)
            word, bit = base + at // 64, (at % 64).astype(np.uint64)
            hit = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            slot[open_[hit]] = self.ranks[word[hit]].astype(np.int64) + np.bitwise_count(below)
            open_, base = open_[~hit], base + int(bits) // 64
        s = self.slots[np.maximum(slot, 0)] if self.n_keys else np.zeros(len(keys), self.slots.dtype)
        right = (slot >= 0) & (s["print"] == (_mixed(keys, -2) >> np.uint64(32)).astype(np.uint32))
        return s["first"].astype(np.int64), np.where(right, s["n"], 0).astype(np.int64)

    def ids(self, record: int) -> np.ndarray:
        return self.payload[int(self.ends[record]) : int(self.ends[record + 1])]


def shard_bytes(keys: list, payloads: list[bytes], width: int) -> bytes:
    """A shard of records in ascending order of keys, null keys (None) first."""
    nulls = sum(k is None for k in keys)
    own, first, n = np.unique(np.asarray(keys[nulls:], np.int64), return_index=True, return_counts=True)
    levels = perfect_hash(own)
    bits = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))[:-1]]).astype("<u8") if len(bits) else np.zeros(0, "<u8")
    slots = np.zeros(len(own), [("print", "<u4"), ("first", "<u4"), ("n", "<u4")])
    sizes = np.array([64 * len(x) for x in levels], "<u8")
    open_, base = np.arange(len(own)), 0
    for level, size in enumerate(sizes):
        at = (_mixed(own[open_], level) % size).astype(np.int64)
        word, bit = base + at // 64, (at % 64).astype(np.uint64)
        hit = (bits[word] >> bit & np.uint64(1)).astype(bool)
        slot = ranks[word[hit]].astype(np.int64) + np.bitwise_count(bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
        k = open_[hit]
        slots["print"][slot], slots["first"][slot], slots["n"][slot] = (_mixed(own[k], -2) >> np.uint64(32)).astype(np.uint32), first[k] + nulls, n[k]
        open_, base = open_[~hit], base + int(size) // 64
    ends = np.concatenate([[0], np.cumsum([len(p) // width for p in payloads])]).astype("<u8")
    sections = [sizes.tobytes(), bits.astype("<u8").tobytes(), ranks.tobytes(), slots.tobytes(), ends.tobytes(), b"".join(payloads), own.astype("<i8").tobytes()]
    places, at = [], 8 + 12 * 8
    for x in sections[:-1]:
        places.append(at)
        at += len(x)
    return MAGIC + struct.pack("<12Q", len(keys), len(own), nulls, int(ends[-1]), width, len(sizes), *places) + b"".join(sections)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _written(folder: str, path: str):
    def run(parts):
        encode, task, done = _encoder(path), TaskContext.get().partitionId(), 0
        end = END_ID.to_bytes(encode.width, "little")
        keys, payloads, size = [], [], 0

        def flush():
            nonlocal keys, payloads, size, done
            store, at = _store(f"{folder}/shard-{task:06d}-{done:06d}-{uuid.uuid4().hex}.ids")
            with store.open_output_stream(at) as f:
                f.write(shard_bytes(keys, payloads, encode.width))
            row = pd.DataFrame({"part": [task], "seq": [done], "file": [at.rpartition("/")[2]], "docs": [len(keys)], "ids": [size // encode.width]})
            keys, payloads, size, done = [], [], 0, done + 1
            return row

        for p in parts:
            for key, text in zip(p["k"], p["t"], strict=True):
                keys.append(None if pd.isna(key) else int(key))
                payloads.append(encode(text or "") + end)
                size += len(payloads[-1])
                if size >= SHARD_IDS * encode.width:
                    yield flush()
        if keys:
            yield flush()

    return run


def write_ids(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> tuple[str, DataFrame]:
    """Writes shards in ascending key order; the folder and the manifest (part, seq, file, docs, ids, base: ids before it)."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "ids")
    store, at = _store(folder)
    store.create_dir(at, recursive=True)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    sorted_ = rows.repartitionByRange("k").sortWithinPartitions("k", "t").select(F.col("k").cast("string").alias("k"), "t")
    # One task writes the manifest, which is read as one window anyway: a file of a row or two from each encoding task costs more than its rows.
    listed = sorted_.mapInPandas(_written(folder, vocabulary or vocabulary_path()), "part int, seq int, file string, docs long, ids long").repartition(1)
    manifest = stage(listed, "ids-manifest")
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    return folder, manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _read(folder: str):
    def run(parts):
        for p in parts:
            for name, base in zip(p["file"], p["base"], strict=True):
                store, at = _store(f"{folder}/{name}")
                with store.open_input_stream(at) as f:
                    shard = Shard(f.read())
                first, n = shard.get(shard.keys)
                if (n == 0).any():
                    raise ValueError(f"{name}: a key is missing from its index")
                records = np.concatenate([np.arange(shard.nulls), np.repeat(first, n) + np.concatenate([np.arange(x) for x in n] or [np.zeros(0, np.int64)])]).astype(np.int64)
                ids = pd.array(np.concatenate([np.zeros(shard.nulls, np.int64), np.repeat(shard.keys, n)]), dtype="Int64")
                ids[: shard.nulls] = pd.NA
                crc = [zlib.crc32(shard.ids(r).astype("<u4").tobytes()) for r in records]
                ends = shard.ends.astype(np.int64)
                yield pd.DataFrame({"doc_id": ids, "start": base + ends[records], "n_tokens": ends[records + 1] - ends[records], "ids_crc32": np.asarray(crc, np.int64)})

    return run


def read_ids(folder: str, manifest: DataFrame) -> DataFrame:
    """Per record: doc_id, start, n_tokens, ids_crc32, looked up by key in each file's index."""
    # A given number of partitions: the rows are tiny, the files they name are not, so adaptive execution must not put them together.
    # A task for each full shard's ids, not for each shard, of which many may be small.
    n = -(-(manifest.agg(F.sum("ids")).first()[0] or 0) // SHARD_IDS)
    files = manifest.select("file", "base").repartition(max(1, min(n, READERS)))
    return files.mapInPandas(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenfile_report(docs: DataFrame) -> DataFrame:
    return read_ids(*write_ids(docs))
