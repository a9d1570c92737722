"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs of the training texts are quantised on a logarithmic scale; a filter holds each n-gram once for
every level up to its own, so that probing level 1, 2, ... until one is absent gives the level back, and false positives can only
raise it, to the greatest stored level at most. The filter is cut into segments by the n-gram's hash; all bits of an n-gram lie in
one, so a segment is built by the task in which the partial counts of its n-grams meet, and is as long as its own entries need.
The number of segments follows the size of the texts. Every n-gram is kept at every size. A filter of up to MOST_BITS is broadcast;
a larger one stays a table of segments: the hashes of each batch of texts are dealt by segment, probed there, and their levels
return to the batch. Both ways give the same scores.

What is shuffled of an n-gram is a 48-bit hash, as the difference to the one before it in its segment, and a count, each in the
least whole bytes; so equal hashes of different pairs (about n / 2^48 of n pairs) count as one pair. Words are counted exactly.

A text's score is the sum of log10 p(word | word before), p = (c(before, word) + MU p(word)) / (c(before) + MU), where p(word) =
(c(word) + DELTA) / (N + DELTA (V + 1)), all c from probes. Beside it stands the exact add-one unigram score, for which the
commonest words, TOP_WORDS at most, are looked up in a broadcast table and all others joined.

Defined results: a null or empty text is one end token; a null key is training; repeated rows count as often as they occur; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import ctypes
import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stage

SEED, PROBES, MOST_BITS, BITS_AN_ENTRY = 11, 3, 96 << 23, 8
#: Bits of an n-gram's hash, and bytes of text a segment.
HASH_BITS, SEGMENT_BYTES = 48, 1 << 22
WORD_BASE, PAIR_BASE, MU, DELTA = 1.3, 2.0, 200.0, 0.5
TOP_WORDS, TOP_LENGTH, PAIRS_HELD, WORDS_HELD, BATCH, PIECE = 200_000, 64, 1 << 20, 100_000, 1 << 18, 1 << 16
END = b"\n"
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(defaultdict):
    """Words numbered as they appear."""

    def __init__(self):
        super().__init__()
        self.default_factory = self.__len__

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def hashes(self) -> np.ndarray:
        return _word_hashes(self)


def _word_hashes(words) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))


_END_HASH = _word_hashes([END])


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * _A
        x = (x ^ x >> np.uint64(27)) * _B
        return x ^ x >> np.uint64(31)


def _words(h: np.ndarray) -> np.ndarray:
    """The n-gram hash of single words."""
    return _mix(h ^ _C) >> np.uint64(64 - HASH_BITS)


def _pairs(h: np.ndarray) -> np.ndarray:
    """The n-gram hash of each word with the one before it; the end comes before the first."""
    out = np.empty_like(h)
    for at in range(0, len(h), PIECE):
        before = np.concatenate([_END_HASH, h[:PIECE - 1]]) if at == 0 else h[at - 1 : at + PIECE - 1]
        own = h[at : at + PIECE]
        with np.errstate(over="ignore"):
            out[at : at + PIECE] = _mix(before[: len(own)] * _C + own) >> np.uint64(64 - HASH_BITS)
    return out


def words_of(text: str | bytes | None) -> list[bytes]:
    """Tokens: words, A-Z lower-cased, and the end."""
    text = text or b""
    words = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower().split()
    words.append(END)
    return words


def _level(n: np.ndarray, base: float) -> np.ndarray:
    return np.floor(np.log(n) / math.log(base) + 1e-9).astype(np.int64) + 1


def _estimate(level: np.ndarray, base: float) -> np.ndarray:
    """Middle of the counts of a level; 0 for level 0, 1 for level 1 of a base up to 2."""
    lo = np.ceil(base ** (level - 1.0) - 1e-9)
    hi = np.maximum(lo, np.ceil(base**level - 1e-9) - 1)
    return np.where(level == 0, 0.0, (lo + hi) / 2)


#: The counts that levels stand for.
WORD_N, PAIR_N = (_estimate(np.arange(256, dtype=np.int64), b) for b in (WORD_BASE, PAIR_BASE))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the least bytes that hold them all, after a byte that says how many."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    own = np.frombuffer(b, np.uint8, offset=1).reshape(-1, b[0])
    out = np.zeros((len(own), 8), np.uint8)
    out[:, : b[0]] = own
    return out.view("<u8")[:, 0]


class Segments:
    """2^bits segments of the n-gram hashes, each a run of them."""

    def __init__(self, bits: int):
        self.bits, self.shift = bits, np.uint64(HASH_BITS - bits)

    def of(self, g: np.ndarray) -> np.ndarray:
        return (g >> self.shift).astype(np.int64)

    def cut(self, g: np.ndarray):
        """(segment, slice) of each segment of sorted hashes."""
        segment = self.of(g)
        ends = np.concatenate([[0], np.nonzero(np.diff(segment))[0] + 1, [len(g)]]) if len(g) else [0]
        return [(int(segment[a]), slice(int(a), int(b))) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def pack(self, segment: int, g: np.ndarray) -> bytes:
        return _packed(np.diff(g, prepend=np.uint64(segment) << self.shift))

    def unpack(self, segment: int, b: bytes) -> np.ndarray:
        return np.cumsum(_unpacked(b), dtype=np.uint64) + (np.uint64(segment) << self.shift)


def _probes(g: np.ndarray, level: int, size: np.ndarray):
    """The PROBES bit places of each n-gram at a level, below its segment's size."""
    with np.errstate(over="ignore"):
        x = _mix(g + np.uint64(level) * _C)
        a, b = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1)
        for i in range(PROBES):
            yield ((a + np.uint64(i) * b & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)


def _levels(found: np.ndarray, start: np.ndarray, size: np.ndarray, g: np.ndarray, top: int) -> np.ndarray:
    """Level of each n-gram by repeated probes; its segment is `size` bits from bit `start` of found on."""
    if len(g) > PIECE:
        cuts = [slice(at, at + PIECE) for at in range(0, len(g), PIECE)]
        return np.concatenate([_levels(found, start[x], size[x], g[x], top) for x in cuts])
    out, alive = np.zeros(len(g), np.uint8), np.nonzero(size)[0]
    for level in range(1, top + 1):
        if not len(alive):
            break
        s, hit = start[alive], np.ones(len(alive), bool)
        for at in _probes(g[alive], level, size[alive]):
            at += s
            hit &= (found[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        alive = alive[hit]
        out[alive] = level
    return out


class Filter:
    """Read side of whole filters: levels(g)."""

    def __init__(self, bits: int, top: int, sizes: np.ndarray, found: bytes):
        self.segments, self.top, self.sizes, self.found = Segments(bits), top, sizes.astype(np.uint64), np.frombuffer(found, np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def levels(self, g: np.ndarray) -> np.ndarray:
        out = np.empty(len(g), np.uint8)
        for at in range(0, len(g), PIECE):
            own = g[at : at + PIECE]
            s = self.segments.of(own)
            out[at : at + PIECE] = _levels(self.found, self.starts[s], self.sizes[s], own, self.top)
        return out


#: Rows that are taken from an Arrow batch at a time.
ROWS = 256


def _arrow(run, schema: pa.Schema):
    """run, from data frames to data frames, over Arrow batches, of which a few rows at a time become Python's."""

    def over(batches):
        parts = (b.slice(at, ROWS).to_pandas() for b in batches for at in range(0, b.num_rows, ROWS))
        for out in run(parts):
            yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

    return over


def _give_back() -> None:
    """Freed memory goes back to the system before the worker process waits for its next task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _gathered(parts):
    """Partial counts: (w, null, n) of words, (null, h, n) of pairs in the order of h; what is held is bounded."""
    held, words, streams = 0, Vocabulary(), []

    def flush():
        # Each text ends with the end, so that in the joined stream the end stands before the first word of the next one.
        at, names = np.concatenate(streams), list(words)
        yield pd.DataFrame({"w": names, "h": 0, "n": np.bincount(at, minlength=len(names)).astype(np.int64)})
        g = _pairs(words.hashes()[at])
        del at, names
        g.sort()
        first = np.nonzero(np.concatenate([[True], g[1:] != g[:-1]]))[0]
        yield pd.DataFrame({"w": None, "h": g[first].view(np.int64), "n": np.diff(first, append=len(g))})

    for p in parts:
        for text in p["t"]:
            streams.append(words.numbers(words_of(text)))
            held += len(streams[-1])
            if held >= PAIRS_HELD or len(words) >= WORDS_HELD:
                yield from flush()
                held, words, streams = 0, Vocabulary(), []
    if held:
        yield from flush()


def _dealt_counts(bits: int):
    """The partial counts by segment, packed."""
    segments = Segments(bits)

    def run(parts):
        for found in _gathered(parts):
            h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
            if (words := found["w"]).notna().any():
                own = _words(_word_hashes(words))
                order = np.argsort(own)
                own, n, words = own[order], n[order], words.to_numpy()[order]
                rows = [(s, None, _packed(n[x]), b" ".join(words[x])) for s, x in segments.cut(own)]
            else:
                rows = [(s, segments.pack(s, h[x]), _packed(n[x]), None) for s, x in segments.cut(h)]
            yield pd.DataFrame(rows, columns=["segment", "pairs", "n", "words"])
        _give_back()

    return run


BUILT = "segment int, found binary, size long, top int, tokens long, n_words long, words binary, word_n binary"


def _built(bits: int):
    """A segment from its partial counts: its bits, and the exact counts of its words."""
    segments = Segments(bits)

    def run(key, p: pd.DataFrame) -> pd.DataFrame:
        segment, words = int(key[0]), Counter()
        g, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for pairs, m, some in zip(p["pairs"], p["n"], p["words"], strict=True):
            if some is None:
                g.append(segments.unpack(segment, pairs))
                n.append(_unpacked(m))
            else:
                for w, x in zip(some.split(b" "), _unpacked(m).tolist(), strict=True):
                    words[w] += x
        g, at = np.unique(np.concatenate(g), return_inverse=True)
        pair_level = _level(np.bincount(at, np.concatenate(n).astype(np.float64), len(g)), PAIR_BASE)
        word_n = np.fromiter(words.values(), np.int64, len(words))
        g = np.concatenate([g, _words(_word_hashes(words))])
        level = np.concatenate([pair_level, _level(word_n, WORD_BASE)])
        size = max(64, int(level.sum()) * BITS_AN_ENTRY + 63 & ~63)
        marks = np.zeros(size, bool)
        for x in range(1, int(level.max(initial=0)) + 1):
            for at in _probes(g[level >= x], x, np.uint64(size)):
                marks[at.view(np.int64)] = True
        found = np.packbits(marks, bitorder="little").tobytes()
        return pd.DataFrame([(segment, found, size, int(level.max(initial=0)), int(word_n.sum()), len(words), b" ".join(words), _packed(word_n))], columns=[c.split()[0] for c in BUILT.split(", ")])

    return run


def _word_rows(parts):
    for p in parts:
        for words, n in zip(p["words"], p["word_n"], strict=True):
            yield pd.DataFrame({"w": words.split(b" "), "n": _unpacked(n).astype(np.int64)})


def _log_p(pair: np.ndarray, before: np.ndarray, word: np.ndarray, n_all: int, n_words: int) -> np.ndarray:
    p_word = (word + DELTA) / (n_all + DELTA * (n_words + 1))
    return np.log10(np.minimum((np.minimum(pair, before) + MU * p_word) / (before + MU), 1.0))


def _sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, np.cumsum(n) - n)


COUNTS = pa.schema([("segment", pa.int32()), ("pairs", pa.binary()), ("n", pa.binary()), ("words", pa.binary())])
READ_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_sure", pa.int64()), ("base_sure", pa.float64()), ("rest", pa.list_(pa.binary())), ("rest_n", pa.list_(pa.int64()))])
READ = "row long, doc_id string, held_out boolean, n_tokens long, n_sure long, base_sure double, rest array<binary>, rest_n array<long>"


def _read(parts, top: bytes, counts: np.ndarray, n_all: int, n_words: int):
    """(rows of READ, tokens a text, word hashes, the stream of tokens as places in these) of whole texts, as many together as hold
    BATCH tokens, or one."""
    known = dict(zip(top.split(b" "), counts.tolist(), strict=True)) if len(counts) else {}
    whole = math.log10(n_all + n_words + 1)

    def batch(heads, streams, words: Vocabulary):
        names = list(words)
        c = np.fromiter((known.get(w, -1) for w in names), np.int64, len(names))
        at, n = np.concatenate(streams), np.array([len(x) for x in streams], np.int64)
        sure = c >= 0
        token = sure[at]
        n_sure, base = _sums(token.astype(np.int64), n), _sums(np.where(sure, np.log10(np.maximum(c, 0) + 1.0) - whole, 0.0)[at], n)
        rest = []
        for x in streams:
            own, k = np.unique(x[~sure[x]], return_counts=True)
            rest.append(([names[i] for i in own], k))
        rows = pd.DataFrame({"row": [h[0] for h in heads], "doc_id": [h[1] for h in heads], "held_out": [h[2] for h in heads], "n_tokens": n, "n_sure": n_sure, "base_sure": base, "rest": [r[0] for r in rest], "rest_n": [r[1] for r in rest]})
        return rows, n, words.hashes(), at

    heads, streams, words, held = [], [], Vocabulary(), 0
    for p in parts:
        for row, key, out, text in zip(p["row"], p["doc_id"], p["held_out"], p["t"], strict=True):
            heads.append((row, key, out))
            streams.append(words.numbers(words_of(text)))
            held += len(streams[-1])
            if held >= BATCH or len(words) >= WORDS_HELD:
                yield batch(heads, streams, words)
                heads, streams, words, held = [], [], Vocabulary(), 0
    if heads:
        yield batch(heads, streams, words)
    _give_back()


def _scored(shared):
    def run(parts):
        size, known = shared.value
        found, (n_all, n_words) = Filter(*size), known[2:]
        for rows, n, h, at in _read(parts, *known):
            # The end stands before the first word of a batch, as each text's end before the next one's.
            word = WORD_N[found.levels(_words(h))]
            end = WORD_N[found.levels(_words(_END_HASH))]
            pair = PAIR_N[found.levels(_pairs(h[at]))]
            before = np.concatenate([end, word[at[:-1]]])
            yield rows.assign(score=_sums(_log_p(pair, before, word[at], n_all, n_words), n))

    return run


def _batches(shared):
    """Rows of texts, and after those of a batch one row of the batch: its texts' rows and lengths, word hashes, their places."""
    batch_columns = ["own", "n", "words", "at"]

    def run(parts):
        for rows, n, h, at in _read(parts, *shared.value):
            yield rows.assign(**dict.fromkeys(batch_columns))
            batch = dict(zip(batch_columns, (rows["row"].to_numpy(np.int64).tobytes(), n.tobytes(), h.tobytes(), _packed(at)), strict=True))
            yield pd.DataFrame([dict.fromkeys(rows.columns) | {"row": rows["row"].iloc[0]} | batch], dtype=object)

    return run


def _grams(words: bytes, at: bytes):
    """A batch's word hashes, their places in the stream, the stream's pairs, and the sorted distinct n-grams of both."""
    h, at = np.frombuffer(words, np.uint64), _unpacked(at).view(np.int64)
    pairs = _pairs(h[at])
    return h, at, pairs, np.unique(np.concatenate([_words(_END_HASH), _words(h), pairs]))


def _dealt(bits: int):
    """Distinct n-grams of each batch by segment."""
    segments = Segments(bits)

    def run(parts):
        for p in parts:
            for batch, words, at in zip(p["batch"], p["words"], p["at"], strict=True):
                g = _grams(words, at)[3]
                yield pd.DataFrame([(s, batch, segments.pack(s, g[x])) for s, x in segments.cut(g)], columns=["segment", "batch", "held"])

    return run


def _probed(bits: int, top: int):
    """Levels of the n-grams of batches; each segment's bits come before them (no batch), none if it has no such row. The rows of a
    segment are probed together: with many segments each has few n-grams of a batch."""
    segments = Segments(bits)

    def run(parts):
        segment, found, rows, held_n = -1, None, [], 0

        def levels():
            if not rows:
                return []
            n, g = [len(g) for _, g in rows], np.concatenate([g for _, g in rows])
            size = np.full(len(g), 0 if found is None else len(found) * 8, np.uint64)
            level = _levels(found, np.zeros(len(g), np.uint64), size, g, top).tobytes()
            ends = np.cumsum(n).tolist()
            return [(batch, segment, level[end - k : end]) for (batch, _), k, end in zip(rows, n, ends, strict=True)]

        for p in parts:
            out = []
            for s, batch, held in zip(p["segment"], p["batch"], p["held"], strict=True):
                if s != segment or held_n >= BATCH:
                    out += levels()
                    rows, held_n = [], 0
                    if s != segment:
                        segment, found = s, None
                if pd.isna(batch):
                    found = np.frombuffer(held, np.uint8)
                    continue
                rows.append((int(batch), segments.unpack(s, held)))
                held_n += len(rows[-1][1])
            out += levels()
            rows, held_n = [], 0
            yield pd.DataFrame(out, columns=["batch", "segment", "levels"])

    return run


def _joined(n_all: int, n_words: int):
    """row, score of the texts of batches: each batch's row (segment -1), then its levels in the segments' order."""

    def scores(own: bytes, n: bytes, words: bytes, at: bytes, levels: list) -> pd.DataFrame:
        h, at, pairs, grams = _grams(words, at)
        level = np.frombuffer(b"".join(levels), np.uint8)
        word = WORD_N[level[np.searchsorted(grams, _words(h))]]
        end = WORD_N[level[np.searchsorted(grams, _words(_END_HASH))]]
        pair = PAIR_N[level[np.searchsorted(grams, pairs)]]
        before = np.concatenate([end, word[at[:-1]]])
        return pd.DataFrame({"row": np.frombuffer(own, np.int64), "score": _sums(_log_p(pair, before, word[at], n_all, n_words), np.frombuffer(n, np.int64))})

    def run(parts):
        batch, levels = None, []
        for p in parts:
            for segment, own, n, words, at, level in zip(p["segment"], p["own"], p["n"], p["words"], p["at"], p["levels"], strict=True):
                if segment >= 0:
                    levels.append(level)
                    continue
                if batch:
                    yield scores(*batch, levels)
                batch, levels = (own, n, words, at), []
        if batch:
            yield scores(*batch, levels)

    return run


def _scored_by_table(rows: DataFrame, built: DataFrame, bits: int, top: int, known: tuple) -> DataFrame:
    """The same as of _scored, by a filter that is not broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(known)
    read = stage(rows.mapInArrow(_arrow(_batches(shared), pa.schema([*READ_ARROW, *[(c, pa.binary()) for c in ("own", "n", "words", "at")]])), f"{READ}, own binary, n binary, words binary, at binary"), "lm-batches")
    batches = read.where("words IS NOT NULL").select(F.col("row").alias("batch"), "own", "n", "words", "at")
    hashes = batches.select("batch", "words", "at").mapInPandas(_dealt(bits), "segment int, batch long, held binary")
    both = hashes.unionByName(built.select("segment", F.lit(None).cast("long").alias("batch"), F.col("found").alias("held")))
    levels = both.repartition("segment").sortWithinPartitions("segment", F.asc_nulls_first("batch")).mapInPandas(_probed(bits, top), "batch long, segment int, levels binary")
    back = batches.withColumn("segment", F.lit(-1)).unionByName(levels, allowMissingColumns=True).repartition("batch").sortWithinPartitions("batch", "segment")
    scores = stage(back.select("batch", "segment", "own", "n", "words", "at", "levels").mapInPandas(_joined(*known[2:]), "row long, score double"), "lm-scores")
    return read.where("words IS NULL").drop("own", "n", "words", "at").join(scores, "row")


def _commonest(words: DataFrame) -> pd.DataFrame:
    """(w, n) of the words that occur at least as often as leaves TOP_WORDS of them at most."""
    level = F.floor(F.log(F.col("n")) * 20)
    short = words.where(F.octet_length("w") <= TOP_LENGTH)
    steps = sorted(short.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True)  # a row for each level of a long: under 900
    held, least = 0, None
    for s in steps:
        held += s["k"]
        if held > TOP_WORDS:
            break
        least = s["l"]
    return short.where(level >= least).toPandas() if least is not None else pd.DataFrame({"w": [], "n": []})


def lm_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    spark, kind = docs.sparkSession, docs.select(F.col(f"`{key}`")).schema[0].dataType
    own = F.col(f"`{key}`").cast("string")
    held = F.coalesce(F.crc32(own) % 7 == 2, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), own.alias("doc_id"), held.alias("held_out"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"))
    train = rows.where("NOT held_out").select("t")
    size = train.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    bits = min(24, max(4, math.ceil(math.log2(size / SEGMENT_BYTES + 1))))
    counts = train.mapInArrow(_arrow(_dealt_counts(bits), COUNTS), "segment int, pairs binary, n binary, words binary")
    built = stage(counts.groupBy("segment").applyInPandas(_built(bits), BUILT), "lm-filter")
    n_all, n_words, top, total = built.agg(*[F.coalesce(f, F.lit(0)) for f in (F.sum("tokens"), F.sum("n_words"), F.max("top"), F.sum("size"))]).first()
    words = built.select("words", "word_n").where("n_words > 0").mapInPandas(_word_rows, "w binary, n long")
    common = _commonest(words)
    known = b" ".join(map(bytes, common["w"])), common["n"].to_numpy(np.int64), int(n_all), int(n_words)
    if total <= MOST_BITS:
        sizes, found = np.zeros(1 << bits, np.int64), {}
        for s in built.select("segment", "size", "found").collect():
            sizes[s["segment"]], found[s["segment"]] = s["size"], s["found"]
        shared = spark.sparkContext.broadcast(((bits, top, sizes, b"".join(found[s] for s in sorted(found))), known))
        del found
        scored = stage(rows.mapInArrow(_arrow(_scored(shared), pa.schema([*READ_ARROW, ("score", pa.float64())])), f"{READ}, score double"), "lm-scored")
        shared.destroy()  # what it served for is written
    else:
        scored = _scored_by_table(rows, built, bits, top, known)
    rest = scored.selectExpr("row", "inline(transform(rest, (w, i) -> named_struct('w', w, 'k', rest_n[i])))")
    whole = math.log10(n_all + n_words + 1)
    more = rest.join(words, "w", "left").groupBy("row").agg(F.sum(F.expr("IF(n IS NULL, 0L, k)")).alias("k"), F.sum(F.expr(f"k * (log10(coalesce(n, 0L) + 1D) - {whole!r}D)")).alias("base"))
    out = scored.drop("rest", "rest_n").join(more, "row", "left")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", F.expr("n_sure + coalesce(k, 0L)").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), F.expr("base_sure + coalesce(base, 0D)").alias("base_score"), "score")
