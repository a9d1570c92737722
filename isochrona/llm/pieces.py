"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A byte-pair model merges adjacent symbols in the order of an agenda, best score first, leftmost on ties. Here a keyed hash of
(seed, place in the text, piece) decides for each candidate merge that comes up whether it is skipped; a skipped one comes up
again only if a neighbour has changed. So each occurrence of a word is cut in its own way, yet alike in every run. Without dropout
the result is the library's own. Characters that no piece covers become byte pieces; so does the mark that stands for a space, if
a text holds it.

Runs of characters between places that no piece spans have agendas of their own. Those of a block of text are worked off together:
a column each, one merge of every column a step. Runs beyond LONG characters take a heap each.

Decoding joins the pieces' bytes and drops the space that stands before every text: it gives back each text exactly.

Defined results: a null text gives null ids, an empty one none; repeated rows are encoded alike; an empty table gives an empty
result; other columns are carried along.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokenfile import vocabulary_path

VOCABULARY, DROPOUT, SEED, SPACE = "piece_bpe_32k.model", 0.1, 5, "▁"
#: Characters of a run that fit a column (6 bits of a candidate are its place), of a block of runs, and the width limits of columns.
LONG, BLOCK, WIDTHS = 63, 1 << 17, (3, 5, 7, 9, 12, 16, 24, 40, 63)
PLACE, NONE, FREE = LONG, np.int32(1 << 30), np.int64(-1)


class PairTable:
    """Open-addressed table from pairs of symbols to a value, looked up for whole arrays; NONE where a pair is not held."""

    def __init__(self, left, right, *values):
        keys = np.asarray(left, np.int64) << 32 | np.asarray(right, np.int64)
        self.bits = max(8, int(4 * len(keys) + 1).bit_length())
        self.keys = np.full(1 << self.bits, FREE)
        self.values = [np.full(1 << self.bits, NONE, np.int32) for _ in values]
        open_, at = np.arange(len(keys)), self._home(keys)
        while len(open_):
            free = self.keys[at] == FREE
            self.keys[at[free]] = keys[open_[free]]  # the last of those that want a place gets it
            won = self.keys[at] == keys[open_]
            for own, v in zip(self.values, values, strict=True):
                own[at[won]] = np.asarray(v, np.int32)[open_[won]]
            open_, at = open_[~won], at[~won] + 1 & (1 << self.bits) - 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair's values are: its own place, or a free one."""
        keys = left.astype(np.int64) << 32 | right
        at = self._home(keys)
        held = self.keys[at]
        open_ = np.nonzero((held != keys) & (held != FREE))[0]
        while len(open_):
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held != FREE)]
        return at


class Pieces:
    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        names = [m.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        score = {i: m.get_score(i) for i in plain}
        # Merge order: place of a piece by score, best first.
        places = {s: at for at, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.bytes = np.zeros(256, np.int32)
        self.text = [b""] * len(ids)
        for i in plain:
            self.text[i] = names[i].replace(SPACE, " ").encode()
        for i in ids:
            if m.is_byte(i):
                b = int(names[i][1:-1], 16)
                self.bytes[b], self.text[i] = i, bytes([b])
        if any(SPACE in names[i].lstrip(SPACE) for i in plain) or len(places) << 6 >= NONE:
            raise ValueError("a piece goes on behind a space, or there are too many")
        # Symbols: the pieces by id, then single characters that only stand inside pieces; any other character is the last symbol.
        symbol = {names[i]: i for i in plain}
        self.n_ids = len(ids)
        for c in sorted({c for p in symbol for c in p} - set(symbol)):
            symbol[c] = self.n_ids + len(symbol)
        self.other = max(self.n_ids, *symbol.values()) + 1
        self.symbol = np.full(0x110000, self.other, np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[ord(" ")], self.symbol[ord(SPACE)] = symbol[SPACE], self.other
        found = [(a, b, places[score[i]], i) for i in plain for k in range(1, len(names[i])) if (a := symbol.get(names[i][:k])) is not None and (b := symbol.get(names[i][k:])) is not None]
        self.pairs = PairTable(*zip(*found, strict=True))
        self.rank, self.piece = self.pairs.values
        inside = sorted({(symbol[a], symbol[b]) for i in plain for a, b in zip(names[i], names[i][1:], strict=False)})
        self.inside = PairTable(*zip(*inside, strict=True), np.ones(len(inside)))
        self.threshold, self.seed = int(dropout * (1 << 32)), seed

    def _skipped(self, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Whether the keyed hash skips the merges to pieces of these ranks that begin at these places of a text."""
        with np.errstate(over="ignore"):
            x = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rank.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64((self.seed + 1) * 0x8CB92BA72F3D8DD7 & (1 << 64) - 1)
            x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(32)) < np.uint64(self.threshold)

    def _columns(self, symbols: np.ndarray, place: np.ndarray, first: np.ndarray, length: np.ndarray, head: np.ndarray) -> None:
        """Merges runs (first, length) of symbols in place; head marks where a symbol that is left begins."""
        width = int(length.max())
        size, back = np.ones(len(symbols), np.int8), np.ones(len(symbols), np.int8)
        made = np.zeros(len(symbols), np.int32)
        at = first + np.arange(width - 1)[:, None]
        in_run = np.arange(width - 1)[:, None] < length - 1
        row, column = np.nonzero(in_run)
        i = at[row, column]
        found = self.pairs.places(symbols[i], symbols[i + 1])
        made[i] = self.piece[found]
        rank = self.rank[found]
        best = np.full((width, len(first)), NONE, np.int32)  # the last row stays empty
        best[row, column] = np.where(rank == NONE, NONE, rank << 6 | row.astype(np.int32))
        end = first + length
        while True:
            least = best.min(axis=0)
            a = np.nonzero(least != NONE)[0]
            if not len(a):
                return
            if len(a) < 0.8 * len(first):
                best, first, end, least = best[:, a], first[a], end[a], least[a]
                a = np.arange(len(a))
            c = least[a]
            row, rank = c & PLACE, c >> 6
            i = first[a] + row
            if self.threshold:
                skip = self._skipped(place[i], rank)
                best[row[skip], a[skip]] = NONE
                a, row, i = a[~skip], row[~skip], i[~skip]
            j = i + size[i]
            n = size[i] + size[j]
            symbols[i] = made[i]
            head[j] = False
            best[j - first[a], a] = NONE
            size[i] = n
            q = i + n
            back[q - 1] = n
            best[row, a] = NONE
            for there, left, right in ((q < end[a], i, q), (row > 0, i - back[i - 1], i)):
                k = np.nonzero(there)[0]
                left, right = left[k], right[k]
                found = self.pairs.places(symbols[left], symbols[right])
                made[left] = self.piece[found]
                rank, row_ = self.rank[found], (left - first[a[k]]).astype(np.int32)
                best[row_, a[k]] = np.where(rank == NONE, NONE, rank << 6 | row_)

    def _heap(self, symbols: np.ndarray, place: np.ndarray, first: int, length: int, head: np.ndarray) -> None:
        """The same for one run of any length."""
        own = symbols[first : first + length].tolist()
        left, right = list(range(-1, length - 1)), list(range(1, length + 1))

        def candidates(i: np.ndarray, a, b) -> list[tuple]:
            found = self.pairs.places(np.asarray(a), np.asarray(b))
            rank = self.rank[found]
            real = (rank != NONE) & ~self._skipped(place[first + i], rank)
            return list(zip(rank[real].tolist(), i[real].tolist(), np.asarray(a)[real].tolist(), np.asarray(b)[real].tolist(), self.piece[found][real].tolist(), strict=True))

        agenda = candidates(np.arange(length - 1), own[:-1], own[1:])
        heapq.heapify(agenda)
        while agenda:
            _, i, a, b, piece = heapq.heappop(agenda)
            if own[i] != a or (j := right[i]) >= length or own[j] != b:
                continue
            own[i], own[j], head[first + j] = piece, -1, False
            right[i] = k = right[j]
            near = []
            if k < length:
                left[k] = i
                near.append((i, piece, own[k]))
            if (k := left[i]) >= 0:
                near.append((k, own[k], piece))
            if near:
                at, a, b = zip(*near, strict=True)
                for x in candidates(np.asarray(at), a, b):
                    heapq.heappush(agenda, x)
        symbols[first : first + length] = own

    def _block(self, codes: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of characters that begin at `first`, and the number of ids before each character."""
        symbols, head = self.symbol[codes], np.ones(len(codes), bool)
        length = np.diff(first, append=len(codes))
        least = 2
        for width in WIDTHS:
            fits = np.nonzero((length >= least) & (length <= width))[0]
            if len(fits):
                self._columns(symbols, place, first[fits], length[fits], head)
            least = width + 1
        for k in np.nonzero(length > LONG)[0]:
            self._heap(symbols, place, int(first[k]), int(length[k]), head)
        odd = head & (symbols >= self.n_ids)
        n = head.astype(np.int64)
        n[odd] = 1 + (codes[odd] > 0x7F) + (codes[odd] > 0x7FF) + (codes[odd] > 0xFFFF)
        out = np.repeat(symbols[head], n[head])
        if odd.any():
            plain = codes[odd].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            out[np.repeat(odd[head], n[head])] = self.bytes[np.frombuffer(plain, np.uint8)]
        return out.astype(np.int32), np.cumsum(n) - n

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the texts are taken as one stream of characters, in blocks of whole runs, so that what is held beside
        the characters and ids is bounded by a block, or by the longest run."""
        codes = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.asarray([len(t) + 1 if t else 0 for t in texts], np.int64)
        own = np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0]  # where the texts that are not empty begin
        ids, before, lo, total = [np.zeros(0, np.int32)], np.zeros(len(own) + 1, np.int64), 0, 0
        while lo < len(codes):
            hi = min(lo + BLOCK, len(codes))
            while True:
                symbols = self.symbol[codes[lo:hi]]
                begins = np.concatenate([[True], self.inside.values[0][self.inside.places(symbols[:-1], symbols[1:])] == NONE])
                a, b = np.searchsorted(own, [lo, hi])
                begins[own[a:b] - lo] = True
                first = np.nonzero(begins)[0]
                if hi == len(codes):
                    break
                if len(first) > 1:  # the last run may go on: it opens the next block
                    hi, first = lo + int(first[-1]), first[:-1]
                    b = int(np.searchsorted(own, hi))
                    break
                hi = min(2 * hi - lo, len(codes))
            start = own[np.searchsorted(own, np.arange(lo, hi), "right") - 1]
            out, n = self._block(codes[lo:hi], np.arange(lo, hi) - start, first)
            before[a:b] = n[own[a:b] - lo] + total
            ids.append(out)
            lo, total = hi, total + len(out)
        before[-1] = total
        whole, found = np.concatenate(ids), iter(zip(before[:-1], before[1:], strict=True))
        return [whole[slice(*next(found))] if s else whole[:0] for s in sizes]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.text.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=1)
def _model(path: str, dropout: float = DROPOUT, seed: int = SEED) -> Pieces:
    """One model a worker process, kept from task to task."""
    return Pieces(path, dropout, seed)


def _encoded(path: str, dropout: float, seed: int, text: str):
    def run(batches):
        model = _model(path, dropout, seed)
        for b in batches:
            texts, at = b.column(text).to_pylist(), 0
            ends = np.cumsum([0 if t is None else len(t) for t in texts])
            while at < len(texts):
                # Rows of about 2^20 characters at a time, one at least.
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
                own = model.encode_all([t or "" for t in texts[at:to]])
                places = np.cumsum([0, *map(len, own)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(own)), mask=pa.array([t is None for t in texts[at:to]]))
                yield b.slice(at, to - at).drop_columns([text]).append_column("ids", ids)
                at = to

    return run


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """docs with array column `ids` in place of the text; an own column of that name gives way. Rows pass through Python as Arrow,
    so that carried columns of any type stay as they are."""
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "ids"])
    schema = T.StructType([f for f in rows.schema if f.name != text] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_encoded(vocabulary or vocabulary_path(VOCABULARY), dropout, seed, text), schema)


def _decoded(path: str):
    def run(batches):
        model = _model(path)
        for b in batches:
            ids = b.column("ids")
            places, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            texts = [model.decode(values[x:y].tolist()) if ok else None for x, y, ok in zip(places[:-1], places[1:], ids.is_valid().to_pylist(), strict=True)]
            yield b.drop_columns(["ids"]).append_column("text", pa.array(texts, pa.string()))

    return run


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The rows of encode() with column `text` in place of the ids; an own column of that name gives way."""
    rows = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c.lower() != "text"])
    schema = T.StructType([f for f in rows.schema if f.name != "ids"] + [T.StructField("text", T.StringType())])
    return rows.mapInArrow(_decoded(vocabulary or vocabulary_path(VOCABULARY)), schema)


def pieces_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids_hash, lossless: texts are encoded, decoded from the ids alone, and compared by checksum and length."""
    rows = docs.select("doc_id", F.crc32("text").alias("was"), F.char_length("text").alias("chars"), "text")
    ids = encode(rows).withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0)).cast("long")).withColumn("ids_hash", F.xxhash64("ids"))
    back = decode(ids)
    return back.select("doc_id", F.greatest("n_pieces", F.lit(0)).alias("n_pieces"), "ids_hash", (F.crc32("text").eqNullSafe(F.col("was")) & F.char_length("text").eqNullSafe(F.col("chars"))).alias("lossless"))
