"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search runs over the lattice of pieces. It keeps back pointers for a window no longer than the
longest piece, plus what is not yet decided: whenever all surviving paths pass through one boundary,
the ids up to it are committed and their back pointers dropped.

* Unigram models: a path's value is the sum of its pieces' scores.
* BPE models: a path survives only where each two neighbours are what byte-pair merging makes of their
  concatenation. Of all segmentations exactly the merged one has that property throughout, so one path
  survives to each boundary, and its ids equal those that merging the whole text would give.

A boundary between two characters that no piece has side by side is always crossed by every path. Texts
are cut there (at white space, in most models) and what lies between is looked up among segments
encoded before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit
from graphloom.llm.durable import map_arrow

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments kept for look-up in each worker, and the longest that is kept.
KEPT, KEPT_CHARS = 300_000, 48
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


@dataclass
class Codec:
    """A vocabulary with its rules; plain data, so that it can be sent to executors."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    bpe: bool
    dummy_prefix: bool = True
    pairs: dict = field(default_factory=dict)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("pieces", "scores", "types", "bpe", "dummy_prefix")} | {"pairs": {}} | ({"made": self.made} if self.bpe else {})

    @staticmethod
    def load(path: str = MODEL) -> Codec:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models with the identity normalizer are supported")
        return Codec([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces], m.trainer_spec.model_type == 2, n.add_dummy_prefix)

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (_NORMAL, _USER)}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @cached_property
    def joints(self) -> set[str]:
        """Two characters side by side in some piece."""
        return {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}

    @cached_property
    def unknown(self) -> int:
        return self.types.index(_UNKNOWN)

    @cached_property
    def bytes_at(self) -> dict[int, int] | None:
        found = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == _BYTE}
        return found if len(found) == 256 else None

    @cached_property
    def cuts_at_space(self) -> bool:
        return not any(j[1] == SPACE and j[0] != SPACE for j in self.joints) and not any("\n" in j for j in self.joints) and "\n" not in self.ids

    @cached_property
    def worst(self) -> float:
        return min(self.scores[i] for i in self.ids.values()) - 10

    def spelled(self, char: str) -> list[int]:
        """Ids of a character that no piece covers."""
        return [self.bytes_at[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes_at else [self.unknown]

    def merged(self, text: str, wall: int = 0) -> list[str] | None:
        """Byte-pair merging by its definition: the best pair first, the left one of equals. With a wall,
        None as soon as a piece crosses that place."""
        ids, scores = self.ids, self.scores
        parts, at = list(text), list(range(len(text)))
        rank = [ids.get(text[i : i + 2]) for i in range(len(text) - 1)]
        while True:
            best, where = None, -1
            for i, k in enumerate(rank):
                if k is not None and (best is None or scores[k] > best):
                    best, where = scores[k], i
            if best is None:
                return parts
            if at[where + 1] == wall:
                return None
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
            del at[where + 1], rank[where]
            if where:
                rank[where - 1] = ids.get(parts[where - 1] + parts[where])
            if where < len(rank):
                rank[where] = ids.get(parts[where] + parts[where + 1])

    def fit(self, left: str, right: str) -> bool:
        """Whether merging left + right gives just these two."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = left[-1] + right[0] not in self.joints or self.merged(left + right, len(left)) == [left, right]
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    @cached_property
    def made(self) -> dict[str, int]:
        """Pieces that merging makes of their own characters; other pieces never occur."""
        return {p: i for p, i in self.ids.items() if self.merged(p) == [p]}

    @cached_property
    def starts(self) -> set[str]:
        return {p[:i] for p in self.made for i in range(1, len(p) + 1)}


class Stream:
    """Viterbi over characters as they come: feed() returns the ids decided by then, finish() the rest."""

    STEP = 64

    def __init__(self, codec: Codec):
        self.codec = codec
        self.text = ""  # from the committed boundary on
        self.value: list[float | None] = [0.0]  # of the best path to each boundary
        self.piece: list[str | None] = [None]  # its last piece
        self.before: str | None = None  # the last committed piece

    @property
    def held(self) -> int:
        return len(self.value)

    def feed(self, chars: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(chars), self.STEP):
            part = chars[at : at + self.STEP]
            self.text += part
            for _ in part:
                self._extend()
            out += self._commit(final=False)
        return out

    def finish(self) -> list[int]:
        out = self._commit(final=True)
        self.before = None
        return out

    def _extend(self) -> None:
        c, i, text = self.codec, len(self.value), self.text
        best, chosen = None, None
        for j in range(max(0, i - c.longest), i):
            v = self.value[j]
            if v is None:
                continue
            t = text[j:i]
            k = c.ids.get(t)
            if k is None:
                if i - j > 1:
                    continue
                v += c.worst
            elif c.bpe:
                p = self.piece[j] if j else self.before
                if t not in c.made or (p is not None and not c.fit(p, t)):
                    continue
            else:
                v += c.scores[k]
            if i - j == 1 and k is None and c.bpe:
                p = self.piece[j] if j else self.before
                if p is not None and not c.fit(p, t):
                    continue
            if best is None or v > best or c.bpe:
                best, chosen = v, t
        self.value.append(best)
        self.piece.append(chosen)

    def _commit(self, final: bool) -> list[int]:
        """Ids up to the last boundary on all surviving paths. A path survives while a later piece may
        still start where it ends."""
        n = len(self.value) - 1
        ends = [n] if final else [i for i in range(max(0, n - self.codec.longest + 1), n + 1) if self.value[i] is not None]
        at = set(ends)
        while len(at) > 1:  # step the furthest path back until all stand on one boundary
            i = max(at)
            at.remove(i)
            at.add(i - len(self.piece[i]))
        stop = at.pop() if at else 0
        out: list[str] = []
        i = stop
        while i:
            out.append(self.piece[i])
            i -= len(self.piece[i])
        if not out:
            return []
        out.reverse()
        self.before = out[-1]
        self.text = self.text[stop:]
        base = self.value[stop]
        self.value = [None if v is None else v - base for v in self.value[stop:]]
        self.piece = [None, *self.piece[stop + 1 :]]
        c = self.codec
        return [i for p in out for i in ([c.ids[p]] if p in c.ids else c.spelled(p))]


class _Cores(dict):
    """Packed ids of segments that no boundary cuts; what is not there is searched, and kept while there is room."""

    def __init__(self, codec: Codec, kept: int):
        super().__init__()
        self.codec, self.kept = codec, kept

    def __missing__(self, text: str) -> bytes:
        if self.codec.bpe and len(text) <= KEPT_CHARS:
            ids = self._short(text)
        else:
            stream = Stream(self.codec)
            ids = stream.feed(text) + stream.finish()
        out = np.array(ids, np.int32).tobytes()
        if len(self) < self.kept and len(text) <= KEPT_CHARS:
            self[text] = out
        return out

    def _short(self, text: str) -> list[int]:
        """The search of Stream for a segment that fits its window whole, forward from each live boundary."""
        c = self.codec
        made, starts, ids, known, fit, n = c.made, c.starts, c.ids, c.pairs.get, c.fit, len(text)
        last: list[str | None] = [None] * (n + 1)
        for i in range(n):
            p = last[i]
            if p is None and i:
                continue
            for j in range(i + 1, n + 1):
                t = text[i:j]
                if t not in starts:
                    if j == i + 1 and t not in ids and (p is None or fit(p, t)):
                        last[j] = t
                    break
                if t in made:
                    if p is not None:
                        good = known((p, t))
                        if not (fit(p, t) if good is None else good):
                            continue
                    last[j] = t
        out: list[int] = []
        i = n
        while i:
            t = last[i]
            i -= len(t)
            out[:0] = [made[t]] if t in made else c.spelled(t)
        return out


class _Segments(dict):
    """Packed ids by segment. What is not there is cut between characters that no piece has side by side."""

    def __init__(self, cores: _Cores, prefix: str):
        super().__init__()
        self.cores, self.prefix = cores, prefix

    def __missing__(self, segment: str) -> bytes:
        text, joints, cores, at = self.prefix + segment, self.cores.codec.joints, self.cores, 0
        parts = []
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in joints:
                parts.append(cores[text[at:k]])
                at = k
        parts.append(cores[text[at:]])
        out = b"".join(parts)
        if len(self) < self.cores.kept and len(segment) <= KEPT_CHARS:
            self[segment] = out
        return out


class Encoder:
    def __init__(self, codec: Codec, kept: int = KEPT):
        self.codec = codec
        cores = _Cores(codec, kept)
        self.spaced, self.bare = _Segments(cores, SPACE), _Segments(cores, "")
        self.newline = np.array(codec.spelled("\n"), np.int32).tobytes()
        table = [p.replace(SPACE, " ").encode() for p in codec.pieces]
        for b, i in (codec.bytes_at or {}).items():
            table[i] = bytes([b])
        self.table = [b"" if t == _CONTROL else b" \xe2\x81\x87 " if t == _UNKNOWN else x for x, t in zip(table, codec.types, strict=True)]

    def packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        if not text:
            return b""
        if not self.codec.cuts_at_space:
            return self.bare[(SPACE if self.codec.dummy_prefix else "") + text.replace(" ", SPACE)]
        parts: list[bytes] = []
        for n, line in enumerate(text.split("\n")):
            if n:
                parts.append(self.newline)
            lead = n == 0 and self.codec.dummy_prefix
            if "  " in line or line[-1:] == " " or SPACE in line or (line[:1] == " " and lead):
                run = (SPACE if lead else "") + line.replace(" ", SPACE)
                at = 0
                while at < len(run):  # a run of spaces and the characters after it
                    stop = at
                    while stop < len(run) and run[stop] == SPACE:
                        stop += 1
                    nxt = run.find(SPACE, stop)
                    nxt = len(run) if nxt < 0 else nxt
                    parts.append(self.bare[run[at:nxt]])
                    at = nxt
            elif line:
                head, *rest = line.split(" ")
                if head or lead:
                    parts.append((self.spaced if lead else self.bare)[head])
                parts.extend(map(self.spaced.__getitem__, rest))
            elif lead:
                parts.append(self.spaced[""])
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decoded(self, ids: list[int]) -> bytes:
        out = b"".join(map(self.table.__getitem__, ids))
        return out[1:] if self.codec.dummy_prefix and out[:1] == b" " else out

    def decode(self, ids: list[int]) -> str:
        return self.decoded(ids).decode("utf-8", "replace")


_encoders: dict[tuple, Encoder] = {}


def _encoder(codec: Codec, kept: int = KEPT) -> Encoder:
    """The worker's encoder for this vocabulary: what it has looked up serves later tasks too."""
    key = (kept, codec.bpe, codec.dummy_prefix, hash((tuple(codec.pieces), tuple(codec.scores))))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(codec, kept)
    return _encoders[key]


def encode(docs: DataFrame, codec: Codec, kept: int = KEPT) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) of every row of docs (doc_id, text).

    round_trip: the decoded ids are the text, with U+2581 as a space, which the model cannot tell apart.
    Null and empty texts have no ids. Null and repeated ids of documents stay as they are; other columns
    are not read. kept: how many segments a worker looks up again; more take memory and save time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(codec, kept)
        for batch in batches:
            column = batch.column(1).fill_null("")
            for i, j, *_ in textkit.chunks(column):
                packed, same = [], []
                for text in column.slice(i, j - i).to_pylist():
                    packed.append(encoder.packed(text))
                    back = encoder.decoded(np.frombuffer(packed[-1], np.int32).tolist())
                    same.append(back == text.replace(SPACE, " ").encode())
                ends = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), ids, pa.array(np.diff(ends)), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "round_trip"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>, n_ids int, round_trip boolean")


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, text) of every row of encoded (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(codec)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, text string")
