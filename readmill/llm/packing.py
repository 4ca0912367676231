"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Documents become token ids; each whole window of a document is a sequence of its own, and what is
left of it (less than a window) goes into a shared one. The leftovers are dealt into shards of a
bounded number of tokens by the rarest token that another document has too (document frequencies
are counted over all documents first), so that documents that share a rare token mostly meet in
one shard; a token whose documents exceed a shard is dealt into several. A shard holds a BM25
inverted index (document frequencies and mean length over all documents); the longest unused
leftover is a seed, its best-weighted terms are the query (the leaders by them are scored by all its
terms), and unused neighbours join it by descending score while they fit. What room is left goes to the best neighbour that does not fit,
cut at a multiple of GRID ids, or to the next unused leftover where the index returns none.

Checksums of pieces come from running ones at each multiple of GRID, so ids are never stored or
shuffled: crc(B) = crc(AB) ^ shift(crc(A), |B|).
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, no_cache, only, table, text_or_empty, tidy, written

GRID = 32
_K1, _B = 1.2, 0.75


class Parts:
    """Ids of parts of texts, found by two hashes of a part (64 and 32 bits); about 30 bytes a part.

    Entries lie in sorted levels, each several times as long as the next; a new level is merged
    with those that aren't.
    """

    def __init__(self, wide: bool):
        self.levels: list[tuple[np.ndarray, ...]] = []  # (hash, check, start of its ids, their number)
        self.ids, self.used, self.n = np.zeros(1 << 14, np.uint32 if wide else np.uint16), 0, 0

    def find(self, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each part start (-1: not here), and their number; h ascending."""
        start, n = np.full(len(h), -1, np.int32), np.zeros(len(h), np.int32)
        for keys, checks, starts, counts in self.levels:
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.flatnonzero((keys[at] == h) & (checks[at] == check))
            start[hit], n[hit] = starts[at[hit]], counts[at[hit]]
        return start, n

    def add(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Takes in parts with their ids one after the other, h ascending; returns where each one's start."""
        end = self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(end, 2 * len(self.ids)) - len(self.ids), self.ids.dtype)])
        self.ids[self.used : end] = ids
        start = (self.used + np.cumsum(n) - n).astype(np.int32)
        self.used, self.n = end, self.n + len(h)
        level = (h, check, start, n.astype(np.int32))
        while self.levels and len(self.levels[-1][0]) < 3 * len(level[0]):
            level = tuple(np.concatenate(x) for x in zip(self.levels.pop(), level, strict=True))
            order = np.argsort(level[0])
            level = tuple(x[order] for x in level)
        self.levels.append(level)
        return start


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


class Encoder:
    """Ids by the tokenizers library, remembered for each part.

    The library's pre-tokeniser takes a lower-cased text apart into contractions, runs of letters,
    single numerals and runs of other marks, and each part is encoded for itself. Texts of the
    characters in _PLAIN only (composed Latin letters, digits, common marks) are taken apart here
    by the same rule, and each part is encoded by the library once, many together; any other text
    goes to the library whole, as do all texts where the file's own steps aren't those imitated.
    Parts are remembered in two generations, so that those in use outlive a change.
    """

    REMEMBERED = 600_000  # parts of a generation, about 30 bytes each
    _LETTERS, _NUMERALS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
    _PLAIN = "[\n\x20-\x7e\xa1-\xac\xae-\u024f\u2010-\u2027]*"
    #: The steps that the part-wise way imitates, and the added tokens, which all start with <|
    _NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    _SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    _BEFORE = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.plain = re.compile(self._PLAIN).fullmatch if self.imitated(self.library) else lambda text: None
        self.apart = f"('(?:s|t|re|ve|m|ll|d)|[^{self._LETTERS}{self._NUMERALS}\\s]+|[{self._NUMERALS}])"
        self.ends = np.zeros(self.library.get_vocab_size() + 1, bool)
        for token, i in self.library.get_vocab(False).items():
            self.ends[i] = token.endswith("</w>")
        self.wide = len(self.ends) > 1 << 16
        self.now, self.before = Parts(self.wide), Parts(self.wide)
        self.letters, self.steps = [_random(256, i) for i in (1, 2)], _random(2, 3)

    @classmethod
    def imitated(cls, library) -> bool:
        """Whether the library's steps before the model are those that are imitated here."""
        state = lambda x: json.loads(x.__getstate__()) if x else None
        added = all(x.content.startswith("<|") for x in library.get_added_tokens_decoder().values())
        return added and not library.post_processor and (state(library.normalizer), state(library.pre_tokenizer)) == (cls._NORMALIZER, cls._BEFORE)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def _learned(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts one after the other, and the number of each one's."""
        n, flat, rest = np.zeros(len(new), np.int64), [], []
        words = [i for i, p in enumerate(new) if p.isalpha()]
        for a in range(0, len(words), 1000):
            some = words[a : a + 1000]
            ids = np.array(self.library.encode_batch_fast([" ".join([new[i] for i in some])], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(some):
                n[some] = np.diff(at, prepend=0)
                flat.append((some, ids))
            else:
                rest += some
        rest += [i for i, p in enumerate(new) if not p.isalpha()]
        found = self._encode([new[i] for i in rest])
        n[rest] = [len(x) for x in found]
        out, start = np.empty(n.sum(), np.uint32), np.cumsum(n) - n
        for which, ids in (*flat, (rest, np.concatenate([np.zeros(0, np.uint32), *found]))):
            k = n[which]
            out[np.repeat(start[which] - np.cumsum(k) + k, k) + np.arange(len(ids))] = ids
        return out, n

    def _hashes(self, parts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of random numbers for a part's bytes, each times a power for its place."""
        _, offsets, data = parts.buffers()
        at = np.frombuffer(offsets, np.int64)[parts.offset : parts.offset + len(parts) + 1]
        size = np.diff(at)
        x = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at[:-1] - at[0]
        place = np.arange(len(x)) - np.repeat(at, size)
        out, filled = [], np.flatnonzero(size)
        for letters, step in zip(self.letters, self.steps, strict=True):
            powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, step, np.uint64))
            h = size.astype(np.uint64)
            if len(filled):
                h[filled] += np.add.reduceat(letters[x] * powers[place], at[filled])
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(h ^ (h >> np.uint64(32)))
        return out[0], out[1].astype(np.uint32)

    def _found(self, parts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Where in self.now.ids the ids of each part start, and their number; parts are all different."""
        if self.now.n > self.REMEMBERED:
            self.before, self.now = self.now, Parts(self.wide)
        h, check = self._hashes(parts)
        order = np.argsort(h)
        h, check = h[order], check[order]
        start, n = self.now.find(h, check)
        if len(gone := np.flatnonzero(start < 0)):
            old, k = self.before.find(h[gone], check[gone])
            back, new = np.flatnonzero(old >= 0), np.flatnonzero(old < 0)
            for which, (ids, count) in ((back, (_pieces(self.before.ids, old[back], k[back]), k[back])), (new, self._learned(parts.take(pa.array(order[gone[new]])).to_pylist()))):
                at = gone[which]
                if len(at):
                    start[at], n[at] = self.now.add(h[at], check[at], ids, count), count
        out = np.empty((2, len(h)), np.int32)
        out[0, order], out[1, order] = start, n
        return out[0], out[1]

    def ids(self, texts: list[str], chars: int = 2_000_000) -> Iterator[np.ndarray]:
        """Of each text, as unsigned 32-bit numbers."""
        at = 0
        while at < len(texts):
            end, n = at, 0
            while end < len(texts) and (end == at or n + len(texts[end]) <= chars):
                n += len(texts[end])
                end += 1
            yield from self._some(texts[at:end])
            at = end

    def _some(self, texts: list[str]) -> Iterator[np.ndarray]:
        import pyarrow.compute as pc

        plain = [bool(self.plain(t)) and "<|" not in t for t in texts]
        lower = pa.array([t.lower() if p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string())
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, pattern=self.apart, replacement=r" \1 "))
        coded = split.flatten().dictionary_encode()
        start, size = self._found(coded.dictionary)
        part = coded.indices.to_numpy()
        lengths = size[part]
        ids = _pieces(self.now.ids, start[part], lengths).astype(np.uint32)
        of_text = np.concatenate([[0], np.cumsum(lengths)])[split.offsets.to_numpy()].tolist()
        for i, p in enumerate(plain):
            yield ids[of_text[i] : of_text[i + 1]] if p else self._encode([texts[i]])[0]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of ranges that are so long, one after the other."""
    end = np.cumsum(n)
    return np.repeat(start - end + n, n) + np.arange(end[-1] if len(end) else 0)


def _pieces(x: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The pieces of x that start there and are so long, one after the other."""
    end = np.cumsum(n, dtype=np.int32)  # far fewer than 2^31 at a time
    return x[np.repeat(start - end + n, n) + np.arange(end[-1] if len(end) else 0, dtype=np.int32)]


_encoders: dict[str, Encoder] = {}


def _encoder(file: str) -> Encoder:
    """One for each worker process."""
    if file not in only(_encoders):
        _encoders[file] = Encoder(file)
    return _encoders[file]


def _shifts() -> list[list[int]]:
    """The matrices over GF(2) that carry a CRC-32 past 1, 2, 4, ... zero bytes."""
    square = lambda m: [_apply(m, m[i]) for i in range(32)]
    bit = [0xEDB88320, *(1 << i for i in range(31))]
    byte = square(square(square(bit)))
    out = [byte]
    for _ in range(40):
        out.append(square(out[-1]))
    return out


def _apply(m: list[int], v: int) -> int:
    x, i = 0, 0
    while v:
        if v & 1:
            x ^= m[i]
        v >>= 1
        i += 1
    return x


_SHIFT = _shifts()


def crc_after(whole: int, first: int, n: int) -> int:
    """CRC-32 of the last n bytes, given that of all and that of those before them."""
    i = 0
    while n:
        if n & 1:
            first = _apply(_SHIFT[i], first)
        n >>= 1
        i += 1
    return whole ^ first


_ENCODED = "row long, doc_id long, n long, crcs binary, rest int, grid binary, terms binary, tfs binary"


def encoded(docs: DataFrame, file: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """Length, checksums of whole windows, running checksums of the rest and term frequencies of each row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, row = _encoder(file), TaskContext.get().partitionId() << 40
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for ids in e.ids(b.column("t").to_pylist()):
                ids = np.append(ids, np.uint32(end_id))
                data, cut = memoryview(ids.tobytes()), len(ids) // window * window
                crcs = [zlib.crc32(data[4 * i : 4 * (i + window)]) for i in range(0, cut, window)]
                grid, crc = [], 0
                for i in range(4 * cut, len(data), 4 * GRID):
                    crc = zlib.crc32(data[i : i + 4 * GRID], crc)
                    grid.append(crc)
                terms, tf = _counted(ids)
                for c, x in zip(cols, (len(ids), np.array(crcs, "<u4").tobytes(), len(ids) - cut, np.array(grid, "<u4").tobytes(), terms.astype("<u4").tobytes(), tf.astype("<u4").tobytes()), strict=True):
                    c.append(x)
            types = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b.num_rows)), b.column("id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [f.split()[0] for f in _ENCODED.split(", ")])
            row += b.num_rows

    docs = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    return docs.mapInArrow(run, _ENCODED)


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids ascending, and how often each occurs; 16 bits sort by radix."""
    s = np.sort(ids.astype(np.uint16) if ids.max() < 65536 else ids, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[at], np.diff(np.append(at, len(s)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The unsigned 32-bit numbers of a binary column without nulls, and where each row's begin and end."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    numbers = np.frombuffer(data, "<u4", count=int(at[-1])) if len(column) and at[-1] else np.zeros(0, "<u4")
    return numbers[int(at[0]) if len(at) else 0 :], at - (at[0] if len(at) else 0)


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, df): summed in each task before the shuffle."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1, np.int64)
        for b in batches:
            n = np.bincount(_flat(b.column("terms"))[0])
            if len(n) > len(df):
                df = np.concatenate([df, np.zeros(len(n) - len(df), np.int64)])
            df[: len(n)] += n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["term", "df"])

    return rows.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def rarest(df: np.ndarray) -> np.ndarray:
    """Of each term its place in ascending order of frequency; terms that one row has alone come last, all in one place."""
    place, shared = np.full(len(df), len(df), np.int32), np.flatnonzero(df > 1)
    place[shared[np.argsort(df[shared], kind="stable")]] = np.arange(len(shared), dtype=np.int32)
    return place


def with_shards(rows: DataFrame, df: np.ndarray, shard_tokens: int) -> tuple[DataFrame, int]:
    """rows with `shard`, and the number of shards, each of about shard_tokens leftover ids at most."""
    place = rarest(df)

    def least(b: pa.RecordBatch) -> np.ndarray:
        terms, at = _flat(b.column("terms"))
        return np.minimum.reduceat(place[terms], at[:-1]) if b.num_rows else np.zeros(0, np.int32)  # a row has a term at least

    @tidy
    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(place) + 1, np.int64)
        for b in batches:
            np.add.at(total, least(b), b.column("rest").to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "rest"])

    mass = rows.select("terms", "rest").mapInArrow(masses, "k long, rest long").groupBy("k").agg(F.sum("rest").alias("rest")).orderBy("k").toPandas()  # bounded by the vocabulary
    # neighbouring places share a shard while its tokens last; a place with more has shards of its own, dealt by the row
    first, parts, shards, size = np.zeros(len(place) + 1, np.int64), np.ones(len(place) + 1, np.int64), 0, 0
    for k, rest in zip(mass["k"].tolist(), mass["rest"].tolist(), strict=True):
        if size and size + rest > shard_tokens:
            shards, size = shards + 1, 0
        first[k], parts[k] = shards, max(1, -(-rest // shard_tokens))
        if parts[k] > 1:
            shards += int(parts[k])
        else:
            size += rest
    shards += bool(size)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, row = least(b), b.column("row").to_numpy().astype(np.uint64)
            dealt = (row * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) % parts[k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((first[k] + dealt).astype(np.int32))], [*b.schema.names, "shard"])

    return rows.mapInArrow(run, _ENCODED + ", shard int"), shards


class Shard:
    """The inverted index of a shard's leftovers, and its packing."""

    def __init__(self, rest: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, at: np.ndarray, idf: np.ndarray, mean: float, query_terms: int):
        """terms and tfs of all leftovers one after the other; at: where each one's begin, and the end."""
        self.rest, self.query_terms, self.at = rest, query_terms, at
        self.term = terms.astype(np.uint16) if len(idf) <= 1 << 16 else terms  # 16 bits sort by radix
        doc = np.repeat(np.arange(len(rest), dtype=np.int32), np.diff(at))
        self.weight = tfs.astype(np.float32)
        norm = (_K1 * (1 - _B + _B * lengths / mean)).astype(np.float32)[doc]
        norm += self.weight
        self.weight *= np.float32(_K1 + 1)
        self.weight /= norm
        del norm
        self.weight *= idf[self.term]
        order = np.argsort(self.term, kind="stable").astype(np.int32)  # a shard has far fewer terms than 2^31
        self.doc, self.impact = doc[order], self.weight[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.term, minlength=len(idf)))]).tolist()

    FEW = 8  # neighbours of a seed that are looked for one by one
    RESCORED = 128  # leaders that are scored by all of a seed's terms

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every leftover for the seed's best-weighted terms; of the leaders by those, for all its terms."""
        lo, hi = self.at[seed], self.at[seed + 1]
        w = self.weight[lo:hi]
        best = np.argpartition(-w, self.query_terms)[: self.query_terms] if len(w) > self.query_terms else np.arange(len(w))
        score = np.zeros(len(self.rest), np.float32)
        for t in self.term[lo:hi][best].tolist():
            a, b = self.first[t], self.first[t + 1]
            score[self.doc[a:b]] += self.impact[a:b]
        if len(best) < len(w):
            lead = np.argpartition(score, len(score) - self.RESCORED)[-self.RESCORED :] if len(score) > self.RESCORED else np.arange(len(score))
            asked = np.zeros(len(self.first), bool)
            asked[self.term[lo:hi]] = True
            n = self.at[lead + 1] - self.at[lead]
            at = _ranges(self.at[lead], n)
            score[lead] = np.add.reduceat(self.weight[at] * asked[self.term[at]], np.cumsum(n) - n)
        return score

    def pack(self, window: int) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences as (leftover, start in it, length); each leftover goes once, in one piece or cut at the grid."""
        rest, start = self.rest, np.zeros(len(self.rest), np.int64)
        order = np.argsort(-rest, kind="stable").tolist()
        unused = len(order) - 1  # the shortest that may be left
        for seed in order:
            if rest[seed] <= 0:
                continue
            room, out = window, []

            def take(d: int, n: int) -> None:
                nonlocal room
                out.append((d, int(start[d]), n))
                start[d] += n
                rest[d] -= n
                room -= n

            take(seed, int(rest[seed]))
            score = self.scores(seed) if room >= GRID else None
            picks = 0
            while room >= GRID:
                # the best that fits, of equals the first; else the best is cut
                fits = np.where((rest > 0) & (rest <= room), score, 0)
                d = int(fits.argmax())
                if fits[d] > 0:
                    take(d, int(rest[d]))
                    picks += 1
                    if picks == self.FEW:  # many small ones: the same order, sorted once
                        some = np.flatnonzero(np.where((rest > 0) & (rest <= room), score, 0) > 0)
                        some = some[np.argsort(-score[some], kind="stable")]
                        while len(some) and room >= GRID:
                            filled = np.cumsum(rest[some[:window]])
                            n = min(int(np.searchsorted(filled, room, "right")), 1 + int(np.searchsorted(filled, room - GRID, "right")))
                            for d in some[:n].tolist():
                                take(d, int(rest[d]))
                            some = some[n:]
                            some = some[rest[some] <= room]
                    continue
                d = int(np.where(rest > 0, score, 0).argmax())
                if score[d] > 0 and rest[d] > 0:
                    take(d, room // GRID * GRID)
                    break
                while unused >= 0 and rest[order[unused]] <= 0:
                    unused -= 1
                if unused < 0:
                    break
                d = order[unused]
                take(d, int(rest[d]) if rest[d] <= room else room // GRID * GRID)
            yield out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, file: str, end_id: int = 2, window: int = 4096, shard_tokens: int = 8_000_000, query_terms: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every id of every row lies in exactly one piece; a row's last id is end_id. Null and empty
    texts have that id alone; null ids are kept, repeated rows are packed each for itself, other
    columns are ignored. A sequence holds at most `window` ids. An empty table gives no rows.
    """
    if window % GRID:
        raise ValueError(f"window must be a multiple of {GRID}")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = written(encoded(docs, file, end_id, window, id_col, text_col))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n:
        return spark.createDataFrame([], _PIECES)
    counts = term_counts(rows).toPandas()  # bounded by the vocabulary
    df = np.zeros(int(counts["term"].max()) + 1, np.int64)
    df[counts["term"]] = counts["df"]
    idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32), total / n
    dealt, shards = with_shards(rows, df, shard_tokens)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        only(no_cache)
        held = list(batches)  # a shard, about 6 bytes for each of its tokens
        if not held:
            return
        t, rows = pa.Table.from_batches(held), {}
        del held
        order = pa.array(np.argsort(t.column("row").to_numpy()))  # the same whatever order the shuffle gave
        for c in ("doc_id", "n", "crcs", "rest", "grid", "terms", "tfs"):
            rows[c] = t.column(c).take(order).combine_chunks()
            t = t.drop_columns([c])
        doc_id, n = rows["doc_id"].to_pylist(), rows["n"].to_pylist()
        out: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [f.split()[0] for f in _PIECES.split(", ")])
                out.clear()

        sequence = TaskContext.get().partitionId() << 36
        crcs, at = _flat(rows["crcs"])
        for d in np.flatnonzero(np.diff(at)).tolist():
            for i, crc in enumerate(crcs[at[d] : at[d + 1]].tolist()):
                out.append((doc_id[d], i * window, window, crc, n[d], sequence, 0))
                sequence += 1
            if len(out) > 20_000:
                yield from flush()
        grid, grid_at = _flat(rows["grid"])
        (terms, at), (tfs, _) = _flat(rows["terms"]), _flat(rows["tfs"])
        whole = rows["rest"].to_pylist()
        shard = Shard(np.array(whole, np.int64), np.array(n, np.float32), terms, tfs, at, idf, mean, query_terms)
        del terms, tfs, rows["terms"], rows["tfs"]
        for pieces in shard.pack(window):
            offset = 0
            for d, a, k in pieces:
                g = grid_at[d]
                crc = int(grid[grid_at[d + 1] - 1] if a + k == whole[d] else grid[g + (a + k) // GRID - 1])
                if a:
                    crc = crc_after(crc, int(grid[g + a // GRID - 1]), 4 * k)
                out.append((doc_id[d], n[d] - whole[d] + a, k, crc, n[d], sequence, offset))
                offset += k
            sequence += 1
            if len(out) > 20_000:
                yield from flush()
        yield from flush()

    return dealt.repartitionById(shards, "shard").mapInArrow(run, _PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
