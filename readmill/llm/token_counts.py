"""Token counts from a finite-state transducer compiled from a byte-fallback BPE piece vocabulary.

The transducer reads characters. Its state is what the past can still mean for the future: for each
start from which a longer piece may yet be completed, the characters since, the last token before it
and the tokens emitted since. Each transition carries the change of the token count of the prefix
read so far; it is negative where a longer piece replaces several shorter ones. States and
transitions are made when first reached, so only those that occur are ever built.

The last token of a prefix is the one vocabulary suffix that is compatible with the last token
before it: two neighbours are compatible when tokenising their concatenation gives the two back.

A chunk's state map: no piece spans certain pairs of characters (a non-space followed by a space,
a character unknown to the vocabulary, ...); behind such a pair the state is the start state,
whatever was before. So a chunk maps every incoming state to the same outgoing state and adds a
constant, but for the head before its first such pair. A map is (head, count, tail): the head is
still to be read from the incoming state, the tail is the access string of the outgoing state.
Maps compose associatively; a long document's chunks are mapped in parallel and their maps are
composed in order by a balanced scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, bounded_batches, only, table, tasks, text_or_empty, tidy

SPACE = "▁"
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class CountTransducer:
    """Compiled from (piece, score) of the normal pieces; other characters count their UTF-8 bytes."""

    LONG = 200  # longer words are not remembered
    REMEMBERED = 200_000  # words of a generation
    STATES = 250_000  # beyond so many, states are dropped and made anew when reached

    def __init__(self, pieces: dict[str, float], bytes_fall_back: bool = True):
        self.score, self.fall_back = pieces, bytes_fall_back
        self.prefixes = {p[:i] for p in pieces for i in range(1, len(p))}  # proper ones: can grow to a piece
        self.inside = {(p[i], p[i + 1]) for p in pieces for i in range(len(p) - 1)}
        self.splits_words = not any(b == SPACE != a for a, b in self.inside)
        self.pair: dict[tuple, bool] = {}
        self.words = Remembered(self.run, self.REMEMBERED)
        self._forget()

    def _forget(self) -> None:
        self.pair.clear()
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.start = self._state((("", None, 0),))

    @classmethod
    def from_model(cls, model_file: str) -> CountTransducer:
        """A sentencepiece BPE model whose normaliser only escapes spaces and adds one in front."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if m.encode("ab  éﬁ ", out_type=str) and m.decode(m.encode("ﬁ  é ")) != "ﬁ  é ":
            raise ValueError("only models that leave the text's characters as they are can be compiled")
        normal = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        return cls({m.id_to_piece(i): m.get_score(i) for i in normal}, any(m.is_byte(i) for i in range(m.get_piece_size())))

    def _merge(self, text: str) -> list[str]:
        """The defining procedure: merge the best-scored neighbours, the leftmost first, until none can be."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, last: str | None, token: str) -> bool:
        key = (last, token)
        if (got := self.pair.get(key)) is None:
            got = self.pair[key] = self._merge((last or "") + token) == ([last, token] if last else [token])
        return got

    def _state(self, live: tuple) -> int:
        if (i := self.ids.get(live)) is None:
            i = self.ids[live] = len(self.states)
            self.states.append(live)
            self.moves.append({})
        return i

    def move(self, state: int, c: str) -> tuple[int, int]:
        """Next state and emitted tokens; made on first use."""
        if c not in self.score:
            got = self.start, len(c.encode()) if self.fall_back else 1
        else:
            live, token, emitted = self.states[state], None, 0
            for grown, last, since in live:  # longest first
                if (t := grown + c) in self.score and self._fits(last, t):
                    token, emitted = t, 1 - since
                    break
            after = [(g + c, last, since + emitted) for g, last, since in live if g + c in self.prefixes]
            got = self._state((*after, ("", token, 0))), emitted
        self.moves[state][c] = got
        return got

    def run(self, text: str) -> int:
        """Tokens of text read from the start state."""
        if len(self.states) > self.STATES:
            self._forget()
        state, n, moves = self.start, 0, self.moves
        for c in text:
            state, d = moves[state].get(c) or self.move(state, c)
            n += d
        return n

    def count(self, text: str) -> int:
        """Tokens of normalised text (spaces as U+2581) from the start state."""
        if not self.splits_words:
            return self.run(text)
        words = _WORDS.findall(text)
        if len(max(words, key=len, default="")) > self.LONG:
            return sum(self.words[w] if len(w) <= self.LONG else self.run(w) for w in words)
        return sum(map(self.words.__getitem__, words))

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, count, tail); count is None where nothing in the chunk resets the state."""
        inside, pairs = self.inside, range(1, len(chunk))
        cut = lambda order: next((i for i in order if (chunk[i - 1], chunk[i]) not in inside), None)
        if (first := cut(pairs)) is None:
            return chunk, None, ""
        last = cut(reversed(pairs))
        return chunk[:first], self.count(chunk[first:last]), chunk[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """a, then b; associative."""
        if a[1] is None:
            return (a[0] + b[0], None, "") if b[1] is None else (a[0] + b[0], b[1], b[2])
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> tuple:
        """All maps composed in order, as a balanced tree."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0] if maps else ("", None, "")

    def finish(self, a: tuple) -> int:
        return self.count(a[0]) + (0 if a[1] is None else a[1] + self.count(a[2]))


_compiled: dict[str, CountTransducer] = {}


def _transducer(model_file: str) -> CountTransducer:
    """One for each worker process."""
    if model_file not in only(_compiled):
        _compiled[model_file] = CountTransducer.from_model(model_file)
    return _compiled[model_file]


def _normalised(text: str) -> str:
    return (" " + text).replace(" ", SPACE) if text else ""


_MAP = "head string, n long, tail string"


def _columns(maps: list[tuple]) -> list[pa.Array]:
    head, n, tail = zip(*maps, strict=True) if maps else ((), (), ())
    return [pa.array(head, pa.string()), pa.array(n, pa.int64()), pa.array(tail, pa.string())]


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 1 << 13, piece_chars: int = 1 << 17, limit: int = 4096, together: int = 256) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit), one row for each row of docs, in no order.

    Null text counts as empty: 0 bytes, 0 tokens, false. Null ids are kept, repeated rows give
    repeated results, other columns are ignored whatever their names. Every text is read in chunks
    of chunk_chars whose state maps are composed. Texts above piece_chars are cut into pieces that
    are mapped by any task; the maps of `together` pieces in a row compose in a task, and those in
    turn, until one is left. No text is cut short. An empty table gives none.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    docs = docs.withColumn("n_bytes", F.octet_length("t").cast("long"))
    kind = docs.schema["id"].dataType.simpleString()

    def of_text(m: CountTransducer, t: str) -> tuple:
        return m.scan([m.chunk_map(t[i : i + chunk_chars]) for i in range(0, len(t), chunk_chars)])

    @tidy
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _transducer(model_file)
        for b in batches:
            n = [m.finish(of_text(m, _normalised(t))) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    short = docs.where(F.length("t") <= piece_chars).mapInArrow(whole, f"id {kind}, n_bytes long, n_tokens long")

    @tidy
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _transducer(model_file)
        for b in batches:
            texts = [t.replace(" ", SPACE) if k else _normalised(t) for t, k in zip(b.column("t").to_pylist(), b.column("k").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.select(["row", "k", "id", "n_bytes"]).columns, *_columns([of_text(m, t) for t in texts])], ["row", "k", "id", "n_bytes", "head", "n", "tail"])

    def composed(t: pa.Table) -> pa.Table:
        m, t = _transducer(model_file), t.sort_by("k")
        one = m.scan(list(zip(*(t.column(c).to_pylist() for c in ("head", "n", "tail")), strict=True)))
        return pa.table([t.column("row")[:1], pa.array([t.column("k")[0].as_py() // together], pa.int32()), t.column("id")[:1], t.column("n_bytes")[:1], *_columns([one])], ["row", "k", "id", "n_bytes", "head", "n", "tail"])

    @tidy
    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _transducer(model_file)
        for b in batches:
            n = [m.finish(x) for x in zip(*(b.column(c).to_pylist() for c in ("head", "n", "tail")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    pieces = docs.where(F.length("t") > piece_chars).withColumn("row", F.monotonically_increasing_id())
    pieces = pieces.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / piece_chars).cast("int"))))
    pieces = pieces.withColumn("t", F.substring("t", F.col("k") * piece_chars + 1, F.lit(piece_chars)))
    schema = f"row long, k int, id {kind}, n_bytes long, {_MAP}"
    maps = pieces.repartition(tasks(spark), "row", "k").mapInArrow(mapped, schema)
    places = (1 << 31) // piece_chars + 1  # a text has 2^31 characters at most
    while places > 1:
        maps = maps.groupBy("row", F.floor(F.col("k") / together).alias("of")).applyInArrow(composed, schema)
        places = -(-places // together)
    long = maps.mapInArrow(finished, f"id {kind}, n_bytes long, n_tokens long")
    return short.unionByName(long).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
