"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is cut into vocabulary pieces so that the sum of their scores is the
largest (Viterbi).  Scores are whole numbers, so sums are exact and the
result does not depend on how a text is cut into chunks; of equal sums the
one with the longest last piece wins, then the longest before it, and so on.

Most texts are encoded at once.  A text of more than two chunks' length is
cut into chunks.  The state at a border is how far the piece across it
reaches into the next chunk.  Each chunk yields the matrix of best scores
from every entry state to every exit state; the matrices are combined
associatively (maximum of sums) into the scores at every border.  With these
each chunk yields, for every exit state, the entry state its best path comes
from; these maps are combined from the end, and then every chunk is
backtraced on its own.

Between two characters that no piece holds side by side every path has a
border.  Words are such units, so a word is cut once per task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.llm.common import append_columns, col, without, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 16  # characters
CACHED = 400_000  # words a task remembers
SCALE = 1000  # scores are whole thousandths
NONE = -math.inf


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with ' ' for the space mark; a literal mark is no piece."""

    scores: dict[str, int]
    ids: dict[str, int]
    byte_ids: tuple[int, ...]  # empty: unknown characters become ``unknown_id``
    unknown: int
    unknown_id: int
    table: tuple[bytes, ...]  # by id
    longest: int
    starts: frozenset[str]  # all beginnings of pieces
    joined: frozenset[str]  # pairs of characters that some piece holds side by side
    prefix: bool  # a space is put before the text

    @property
    def by_words(self) -> bool:
        """Whether every path has a border before a run of spaces."""
        return all(p[1] != " " or p[0] == " " for p in self.joined)


@lru_cache(maxsize=4)
def load(path: str = MODEL) -> Vocabulary:
    """Read a model file on the driver; tasks get the vocabulary itself.

    A unigram model's scores are log probabilities.  Those of a BPE model are
    minus the rank of a merge, which are not; its pieces get the log
    probability of their rank under Zipf's law.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    plain = {i: p for i, p in enumerate(model.pieces) if p.type in (p.NORMAL, p.USER_DEFINED)}
    zipf = lambda s: -math.log(-s + 2.7)
    if model.trainer_spec.model_type == model.trainer_spec.BPE:
        total = math.log(sum(math.exp(zipf(p.score)) for p in plain.values()))
        score = {i: zipf(p.score) - total for i, p in plain.items()}
    else:
        score = {i: p.score for i, p in plain.items()}
    scores, ids, table = {}, {}, []
    bytes_of = {}
    for i, p in enumerate(model.pieces):
        if i in plain:
            text = p.piece.replace("▁", " ")
            scores[text], ids[text] = round(SCALE * score[i]), i
            table.append(text.encode())
        elif p.type == p.BYTE:
            bytes_of[int(p.piece[3:5], 16)] = i
            table.append(bytes([int(p.piece[3:5], 16)]))
        else:
            table.append("⁇".encode() if p.type == p.UNKNOWN else b"")
    return Vocabulary(
        scores, ids, tuple(bytes_of[b] for b in range(256)) if len(bytes_of) == 256 else (),
        min(scores.values()) - 10 * SCALE, next(i for i, p in enumerate(model.pieces) if p.type == p.UNKNOWN),
        tuple(table), max(map(len, scores)),
        frozenset(t[:k] for t in scores for k in range(1, len(t) + 1)), frozenset(t[k:k + 2] for t in scores for k in range(len(t) - 1)),
        model.normalizer_spec.add_dummy_prefix)


def forward(v: Vocabulary, text: str, own: int, entry: Sequence[float] = (0,)) -> tuple[list, list]:
    """Best scores at every border and the start of the piece that ends there
    (-1: an entry).  Pieces start before ``own``."""
    n, scores, starts, longest = len(text), v.scores, v.starts, v.longest
    best, back = [NONE] * (n + 1), [-1] * (n + 1)
    best[:len(entry)] = entry
    for start in range(own):
        here = best[start]
        if here == NONE:
            continue
        for end in range(start + 1, min(n, start + longest) + 1):
            part = text[start:end]
            if part not in starts:
                break
            s = scores.get(part)
            if s is not None and here + s > best[end]:
                best[end], back[end] = here + s, start
        if text[start] not in scores and here + v.unknown > best[start + 1]:
            best[start + 1], back[start + 1] = here + v.unknown, start
    return best, back


def backtrace(v: Vocabulary, text: str, back: Sequence[int], end: int) -> tuple[int, list[int]]:
    """The entry border and the ids of the path that ends at ``end``."""
    out = []
    while back[end] >= 0:
        piece = text[back[end]:end]
        found = v.ids.get(piece)
        if found is not None:
            out.append(found)
        elif v.byte_ids:
            out += [v.byte_ids[b] for b in reversed(piece.encode("utf-8", "replace"))]
        else:
            out.append(v.unknown_id)
        end = back[end]
    return end, out[::-1]


def cut_text(v: Vocabulary, text: str) -> list[int]:
    """The ids of a text, in one go."""
    _, back = forward(v, text, len(text))
    return backtrace(v, text, back, len(text))[1]


class _Words(dict):
    """Word to packed ids, computed when first asked for.  Frequent words
    come early, so a full memory keeps what it has."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        # Beginnings of pieces: with score and packed id if they are pieces, else None.
        pack = lambda i: np.int32(i).tobytes()
        self.trie = {t: (v.scores[t], pack(v.ids[t])) if t in v.scores else None for t in v.starts}

    def __missing__(self, word: str) -> bytes:
        joined = self.v.joined
        # Every path has a border at these; a stretch between two holds none, so this goes one level deep.
        cuts = [k for k in range(1, len(word)) if word[k - 1:k + 1] not in joined]
        if cuts:
            packed = b"".join([self[word[a:b]] for a, b in zip([0, *cuts], [*cuts, len(word)])])
        else:
            packed = self._cut(word)
        if len(self) < CACHED and len(word) <= 64:
            self[word] = packed
        return packed

    def _cut(self, word: str) -> bytes:
        """``cut_text`` of a word, packed."""
        n, find = len(word), self.trie.get
        if n == 1:
            return (self.trie.get(word) or (0, np.array(cut_text(self.v, word), np.int32).tobytes()))[1]
        best, last = [NONE] * (n + 1), [None] * (n + 1)
        best[0] = 0
        for start in range(n):
            here = best[start]
            if here == NONE:
                continue
            end = start + 1
            found = find(word[start:end], 0)
            if not found and here + self.v.unknown > best[end]:
                best[end], last[end] = here + self.v.unknown, (start, None)
            while found != 0:
                if found is not None and here + found[0] > best[end]:
                    best[end], last[end] = here + found[0], (start, found[1])
                end += 1
                if end > n:
                    break
                found = find(word[start:end], 0)
        out = []
        while n:
            start, packed = last[n]
            out.append(packed or np.array(cut_text(self.v, word[start:n]), np.int32).tobytes())
            n = start
        return b"".join(reversed(out))


def encoder(v: Vocabulary) -> Callable[[str], np.ndarray]:
    """The function from a text to its ids, with a memory for words."""
    words = _Words(v)
    # A line feed outside all pieces is a unit of its own.
    line = not any("\n" in s for s in v.scores)
    units = re.compile(r" +[^ \n]*|[^ \n]+|\n" if line else r" +[^ ]*|[^ ]+") if v.by_words else None

    def encode(text: str) -> np.ndarray:
        if not text:
            return np.array([], np.int32)
        text = " " + text if v.prefix else text
        if units is None:
            return np.array(cut_text(v, text), np.int32)
        return np.frombuffer(b"".join(map(words.__getitem__, units.findall(text))), np.int32)

    return encode


def _lists(parts: Sequence[np.ndarray | None]) -> pa.Array:
    """int32 lists from arrays; null for None."""
    sizes = [0 if p is None else len(p) for p in parts]
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    values = np.concatenate([p for p in parts if p is not None and len(p)] or [np.array([], np.int32)])
    return pa.ListArray.from_arrays(offsets, pa.array(values), mask=pa.array([p is None for p in parts], pa.bool_()))


def transfer(v: Vocabulary, text: str, own: int) -> np.ndarray:
    """Best scores from every entry state to every exit state of a chunk of
    ``own`` characters (what follows in ``text`` belongs to the next)."""
    n = v.longest
    out = np.full((n, n), NONE)
    # From a forced border on all entries share one path.
    cut = next((c for c in range(n, own) if text[c - 1:c + 1] not in v.joined), None)
    rest = forward(v, text[cut:], own - cut)[0][own - cut:] if cut is not None else None
    for i in range(n):
        if rest is None:
            ends = forward(v, text[i:], own - i)[0][own - i:]
        else:
            head = forward(v, text[i:cut], cut - i)[0][-1]
            ends = [head + r for r in rest]
        out[i, :len(ends)] = ends[:n]
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two (stacks of) matrices."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def scan(matrices: np.ndarray) -> np.ndarray:
    """All prefixes of the product, by doubling."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = combine(out[:-step], out[step:])
        step *= 2
    return out


def _giants(docs: DataFrame, text: str, v: Vocabulary, chunk: int) -> DataFrame:
    """(_ff_uid, pieces) of texts that are cut into chunks."""
    n, binary = v.longest, pa.binary()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                t = " " + t if v.prefix else t
                count = max(1, len(t) // chunk)  # the last takes what is left
                for c in range(count):
                    end = (c + 1) * chunk if c + 1 < count else len(t)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid]), pa.array([c]), pa.array([count]), pa.array([end - c * chunk]),
                         pa.array([t[c * chunk:end + n - 1]])], names=["uid", "c", "count", "own", "part"])

    parts = written(docs.select("_ff_uid", col(text)).mapInArrow(chunks, "uid long, c long, count long, own long, part string"))

    def per_chunk(schema: pa.Schema, each: Callable[[dict], object]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["uid"]]), pa.array([row["c"]]), pa.array([row["count"]]),
                         pa.array([each(row)], schema.field(3).type)], schema=schema)
        return run

    head = [("uid", pa.int64()), ("c", pa.int64()), ("count", pa.int64())]
    as_bytes, as_ids = pa.schema([*head, ("m", binary)]), pa.schema([*head, ("ids", pa.list_(pa.int32()))])
    matrices = parts.mapInArrow(per_chunk(as_bytes, lambda r: transfer(v, r["part"], r["own"]).tobytes()),
                                "uid long, c long, count long, m binary")

    def borders(pdf):
        pdf = pdf.sort_values("c")
        prefix = scan(np.stack([np.frombuffer(m).reshape(n, n) for m in pdf["m"]]))[:, 0, :]
        first = np.full((1, n), NONE)
        first[0, 0] = 0.0
        return pdf.assign(m=[e.tobytes() for e in np.concatenate([first, prefix[:-1]])])

    entries = written(matrices.groupBy("uid").applyInPandas(borders, matrices.schema))
    ready = parts.join(entries.select("uid", "c", F.col("m").alias("entry")), ["uid", "c"])

    def paths(r: dict) -> tuple[list, list]:
        return forward(v, r["part"], r["own"], np.frombuffer(r["entry"]).tolist())

    def sources(r: dict) -> bytes:
        best, back = paths(r)
        out = np.full(n, -1, np.int32)
        for j in range(len(r["part"]) - r["own"] + 1):
            if best[r["own"] + j] != NONE:
                out[j] = backtrace(v, r["part"], back, r["own"] + j)[0]
        return out.tobytes()

    maps = ready.mapInArrow(per_chunk(as_bytes, sources), "uid long, c long, count long, m binary")

    def exits(pdf):
        pdf = pdf.sort_values("c")
        state, out = 0, []
        for m in reversed(list(pdf["m"])):
            out.append(state)
            state = int(np.frombuffer(m, np.int32)[state])
        return pdf.assign(m=[np.int32(s).tobytes() for s in reversed(out)])

    leave = written(maps.groupBy("uid").applyInPandas(exits, maps.schema))

    def ids_of(r: dict) -> list[int]:
        _, back = paths(r)
        return backtrace(v, r["part"], back, r["own"] + int(np.frombuffer(r["leave"], np.int32)[0]))[1]

    ids = (ready.join(leave.select("uid", "c", F.col("m").alias("leave")), ["uid", "c"])
           .mapInArrow(per_chunk(as_ids, ids_of), "uid long, c long, count long, ids array<int>"))
    return ids.groupBy(F.col("uid").alias("_ff_uid")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "ids"))), lambda x: x["ids"])).alias("pieces"))


def decoder(v: Vocabulary) -> Callable[[Sequence[int]], str]:
    """The function from ids to a text."""
    table, drop = v.table, 1 if v.prefix else 0

    def text_of(ids: Sequence[int]) -> str:
        whole = b"".join(map(table.__getitem__, ids))
        return whole[drop if whole[:1] == b" " else 0:].decode("utf-8", "replace")

    return text_of


PIECES = T.StructField("pieces", T.ArrayType(T.IntegerType()))


def _encoded(docs: DataFrame, text: str, model: str, chunk: int, checked: str | None) -> DataFrame:
    """``encode``; with ``checked``, also a column of that name that says
    whether the ids of each text were decoded to it."""
    v = load(model)
    chunk = max(chunk, 2 * v.longest)
    fields = [PIECES, *([T.StructField(checked, T.BooleanType())] if checked else [])]
    base = without(docs, *[f.name for f in fields])
    giant = F.coalesce(F.length(col(text)) > 2 * chunk, F.lit(False))

    def make():
        run, back = encoder(v), decoder(v)

        def compute(column: pa.Array) -> list[pa.Array]:
            ids, right = [], []
            for t in column:
                t = t.as_py()
                ids.append(None if t is None else run(t))
                if checked:
                    right.append(t is None or back(ids[-1].tolist()) == t)
            return [_lists(ids), *([pa.array(right, pa.bool_())] if checked else [])]

        return compute

    small = append_columns(base.where(~giant), text, fields, make)
    large = written(base.where(giant).withColumn("_ff_uid", F.monotonically_increasing_id()))
    if large.isEmpty():
        return small
    whole = large.join(_giants(large, text, v, chunk), "_ff_uid").drop("_ff_uid")
    if checked:
        whole = (decode(whole, "pieces", "_ff_decoded", model)
                 .withColumn(checked, col(text).eqNullSafe(F.col("_ff_decoded"))).drop("_ff_decoded"))
    return small.unionByName(whole)


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``pieces``, the list of ids of each text.

    Null texts have null, empty ones an empty list.  Characters outside the
    vocabulary become their UTF-8 bytes, so ``decode`` gives the text back
    exactly.  Texts of more than ``2 * chunk`` characters are cut into chunks
    (at least as long as the longest piece).  Repeated rows are encoded each;
    an input column ``pieces`` is replaced.
    """
    return _encoded(docs, text, model, chunk, None)


def decode(encoded: DataFrame, pieces: str = "pieces", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of each list of ids: null for null, empty for
    empty, bytes that are no UTF-8 replaced.  Lists of any length are read whole,
    rows that repeat are decoded each, an input column ``out`` is replaced, and
    an empty table gives no rows.  Ids outside the vocabulary raise."""
    v = load(model)

    def make():
        back = decoder(v)
        return lambda column: [pa.array([None if x.as_py() is None else back(x.as_py()) for x in column], pa.string())]

    return append_columns(encoded, pieces, [T.StructField(out, T.StringType())], make)


def round_trip(docs: DataFrame, text: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``pieces``, their number ``n_pieces`` (0 for null) and
    ``round_trip``: whether decoding gives the text back."""
    whole = _encoded(without(docs, "n_pieces"), text, model, chunk, "round_trip")
    return whole.withColumn("n_pieces", F.coalesce(F.size("pieces"), F.lit(0)))
