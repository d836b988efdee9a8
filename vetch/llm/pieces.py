"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A text gets a leading space, spaces become the marker U+2581, and the segmentation with the largest sum of log scores is found by
dynamic programming, all positions of many chunks at a time. A character that no piece covers costs 10 below the least
score and is written as byte pieces. No piece has a marker after another character, nor a line end, so a text falls apart
into chunks (markers and what follows them) that are segmented one by one; repeated chunks are looked up.

The vocabulary comes from a model file given as a parameter; it is read on the driver and its arrays, whose size is that of the
vocabulary, are broadcast. Where the file holds merge ranks in place of log probabilities, as models of kind BPE do, the log
score of a piece is that of Zipf's law for its rank.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks of up to so many bytes are segmented together, and remembered; longer ones are first cut where no piece can cross.
WIDE = 64
#: Chunks that a worker remembers of late; as many older ones stay until these are full again.
REMEMBERED = 80_000


def read_model(path: str = MODEL) -> dict:
    """Pieces (bytes), log scores and byte pieces of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    scores = {i: sp.get_score(i) for i in plain}
    if min(scores.values()) < -1000:  # ranks
        norm = math.log(sum(1 / (k + 2) for k in range(len(plain))))
        scores = {i: -math.log(k + 2) - norm for k, i in enumerate(plain)}
    bytes_at = np.full(256, sp.unk_id(), np.int32)
    for i in range(size):
        if sp.is_byte(i):
            bytes_at[int(names[i][1:-1], 16)] = i
    surface = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(n[1:-1], 16)]) if sp.is_byte(i) else n.encode() for i, n in enumerate(names)]
    return {"scores": scores, "bytes": bytes_at, "surface": surface, **double_array({names[i].encode(): i for i in plain})}


def double_array(words: dict[bytes, int]) -> dict:
    """A double-array trie: from state s, byte c leads to t = base[s] + c if check[t] == s; value[t] is the word's id or -1."""
    root: dict = {}
    for w, i in words.items():
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[-1] = i
    size = 1 << 16
    base, check, value, used = [0] * size, [-1] * size, [-1] * size, bytearray(size)
    used[0], forks, single, free, cursor = 1, [(0, root)], [], 256, 1
    while forks or single:  # states with one child fill the holes that the others leave
        state, node = (forks or single).pop()
        value[state] = node.get(-1, -1)
        below = [c for c in node if c >= 0]
        if not below:
            continue
        if len(below) > 1:
            b = cursor
        else:
            while used[free]:
                free += 1
            b = free - below[0]
        while any(used[b + c] for c in below):
            b += 1
        if len(below) > 1:
            cursor = b
        if b + 1024 >= size:
            base, check, value, used = base + [0] * size, check + [-1] * size, value + [-1] * size, used + bytearray(size)
            size *= 2
        base[state] = b
        for c in below:
            used[b + c] = 1
            check[b + c] = state
            (forks if sum(k >= 0 for k in node[c]) > 1 else single).append((b + c, node[c]))
    base, check, value = (np.array(x, np.int32) for x in (base, check, value))
    return {"base": base, "check": check, "value": value}


class Encoder:
    """Encodes and decodes with what read_model() returned."""

    CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def __init__(self, model: dict):
        self.base, self.check, self.value, self.bytes = (model[k] for k in ("base", "check", "value", "bytes"))
        self.score = np.full(len(model["surface"]), -np.inf)
        for i, s in model["scores"].items():
            self.score[i] = s
        self.unknown = min(model["scores"].values()) - UNKNOWN_PENALTY
        self.surface = model["surface"]
        self.byte_ids = frozenset(self.bytes.tolist())
        #: Ids of chunks as bytes of 32-bit numbers: what was met since the last change of generations, and in the one before it.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        names = [self.surface[i].decode() for i in model["scores"]]
        #: Neighbours within a piece: between two characters that are none, every segmentation has a boundary.
        self.inside = frozenset(n[k : k + 2] for n in names for k in range(len(n) - 1))

    def _back(self, chunk: bytes, start: list[int], piece: list[int]) -> np.ndarray:
        at, out = len(chunk), []
        while at:
            a = start[at]
            out.append([piece[at]] if piece[at] >= 0 else self.bytes[list(chunk[a:at])].tolist())
            at = a
        return np.array([i for part in reversed(out) for i in part], np.int32)

    def _one(self, chunk: bytes) -> np.ndarray:
        size, base, check, value, score = len(chunk), self.base, self.check, self.value, self.score
        best, start, piece = [-math.inf] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
        best[0] = 0.0
        for i in range(size):
            if chunk[i] & 0xC0 == 0x80:
                continue
            width = 1 + sum(1 for j in range(i + 1, min(i + 4, size)) if all(chunk[k] & 0xC0 == 0x80 for k in range(i + 1, j + 1)))
            state, single = 0, False
            for j in range(i, size):
                to = int(base[state]) + chunk[j]
                if check[to] != state:
                    break
                state = to
                v = int(value[state])
                if v >= 0:
                    single |= j + 1 - i == width
                    if best[i] + score[v] > best[j + 1]:
                        best[j + 1], start[j + 1], piece[j + 1] = best[i] + score[v], i, v
            if not single and best[i] + self.unknown > best[i + width]:
                best[i + width], start[i + width], piece[i + width] = best[i] + self.unknown, i, -1
        return self._back(chunk, start, piece)

    def _many(self, chunks: list[bytes]) -> list[np.ndarray]:
        """The same for many short chunks at once."""
        size = np.array([len(c) for c in chunks])
        wide, n = int(size.max()), len(chunks)
        m = np.frombuffer(b"".join(c.ljust(wide, b"\0") for c in chunks), np.uint8).reshape(n, wide).astype(np.int32)
        lead = (m & 0xC0) != 0x80
        best, start, piece = np.full((n, wide + 1), -np.inf), np.zeros((n, wide + 1), np.int32), np.full((n, wide + 1), -1, np.int32)
        best[:, 0] = 0
        for i in range(wide):
            rows = np.flatnonzero((i < size) & lead[:, i])
            if not len(rows):
                continue
            first = m[rows, i]
            width = 1 + (first >= 0xC0).astype(np.int32) + (first >= 0xE0) + (first >= 0xF0)
            single = np.zeros(n, bool)
            here, state, left = rows, np.zeros(len(rows), np.int32), width
            for j in range(i, wide):
                to = self.base[state] + m[here, j]
                ok = (self.check[to] == state) & (j < size[here])
                here, state, left = here[ok], to[ok], left[ok]
                if not len(here):
                    break
                v = self.value[state]
                hit = v >= 0
                at, v = here[hit], v[hit]
                single[at[left[hit] == j + 1 - i]] = True
                s = best[at, i] + self.score[v]
                up = s > best[at, j + 1]
                at, v = at[up], v[up]
                best[at, j + 1], start[at, j + 1], piece[at, j + 1] = s[up], i, v
            lone = ~single[rows]
            at, end = rows[lone], i + width[lone]
            s = best[at, i] + self.unknown
            up = s > best[at, end]
            at, end = at[up], end[up]
            best[at, end], start[at, end], piece[at, end] = s[up], i, -1
        # All ways back at once, a piece of each a step; from right to left they fill the rows of found.
        rows, at, found, count = np.arange(n), size, [], np.zeros(n, np.int32)
        while len(rows):
            step = np.zeros(n, np.int32)
            step[rows] = piece[rows, at]
            found.append(step)
            count[rows] += 1
            at = start[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        found = np.stack(found[::-1], axis=1) if found else np.zeros((n, 0), np.int32)
        out = [found[k, found.shape[1] - c :] for k, c in enumerate(count.tolist())]
        for k in np.flatnonzero((found < 0).any(axis=1)).tolist():  # characters in bytes
            out[k] = self._back(chunks[k], start[k].tolist(), piece[k].tolist())
        return out

    def _cut(self, chunk: str) -> list[str]:
        """A long chunk in parts that are segmented one by one: cut between characters that no piece has next to each other."""
        if len(chunk.encode("utf-8", "surrogatepass")) <= WIDE:
            return [chunk]
        inside, at = self.inside, 0
        cuts = [k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in inside]
        parts = []
        for k in [*cuts, len(chunk)]:
            parts.append(chunk[at:k])
            at = k
        return parts

    def _learn(self, chunks: list[str]) -> None:
        coded = sorted(((c.encode("utf-8", "surrogatepass"), c) for c in chunks), key=lambda x: len(x[0]))
        short = [x for x in coded if len(x[0]) <= WIDE]
        for k in range(0, len(short), 4096):
            part = short[k : k + 4096]
            self.known.update((c, ids.tobytes()) for (_, c), ids in zip(part, self._many([b for b, _ in part])))
        self.known.update((c, self._one(b).tobytes()) for b, c in coded[len(short) :])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = set().union(*split).difference(known)
        known.update((c, older[c]) for c in new.intersection(older))
        new.difference_update(known)
        parts = {c: p for c in new if len(c) > WIDE // 4 and len(p := self._cut(c)) > 1}
        self._learn([c for c in new if c not in parts] + [p for p in {p for x in parts.values() for p in x} if p not in known and p not in new])
        known.update((c, b"".join([known[p] for p in x])) for c, x in parts.items())
        out = [np.frombuffer(b"".join(map(known.__getitem__, s)), np.int32) for s in split]
        for c in [*parts, *new, *(p for x in parts.values() for p in x)]:
            if len(c) > WIDE // 4 and len(c.encode("utf-8", "surrogatepass")) > WIDE:
                known.pop(c, None)  # what is remembered is short
        return out

    def decode(self, ids: np.ndarray) -> str:
        surface = self.surface
        out = b"".join([surface[i] for i in ids.tolist()]).replace(MARK.encode(), b" ")
        return out.removeprefix(b" ").decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def _shared(spark: SparkSession, path: str):
    model = spark.sparkContext.broadcast(read_model(path))
    number = uuid.uuid4().hex

    def encoder() -> Encoder:
        """The worker's encoder; one is kept from task to task."""
        if number not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[number] = Encoder(model.value)
        return _ENCODERS[number]

    return encoder


def _parts(texts: pd.Series, rows: int = 256) -> Iterator[list[str]]:
    for k in range(0, len(texts), rows):
        yield texts.iloc[k : k + rows].tolist()


def encode(spark: SparkSession, text: Column, model: str = MODEL) -> Column:
    """The ids of the text's pieces, array<int>; null and empty texts have none."""
    encoder = _shared(spark, model)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder()
        for texts in batches:
            for part in _parts(texts):
                yield pd.Series(e.encode([t or "" for t in part]), dtype=object)

    return ids(text)


def decode(spark: SparkSession, ids: Column, model: str = MODEL) -> Column:
    """The text that array<int> ids stand for; null and empty arrays give an empty text, bytes that are no UTF-8 U+FFFD."""
    encoder = _shared(spark, model)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder()
        for arrays in batches:
            yield pd.Series([e.decode(np.asarray(x if x is not None else [], np.int32)) for x in arrays], dtype=object)

    return text(ids)


def digest(spark: SparkSession, text: Column, model: str = MODEL) -> Column:
    """n_tokens, n_byte_tokens, the SHA-256 of the ids as little-endian 32-bit numbers, and whether decoding gives the text back."""
    encoder = _shared(spark, model)

    @F.pandas_udf("n_tokens long, n_byte_tokens long, ids_sha256 string, decoded boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder()
        in_bytes = np.isin(np.arange(len(e.surface)), list(e.byte_ids))
        for texts in batches:
            for part in _parts(texts):
                rows = []
                for t, x in zip(part, e.encode([t or "" for t in part])):
                    rows.append((len(x), int(in_bytes[x].sum()), hashlib.sha256(x.astype("<i4").tobytes()).hexdigest(), e.decode(x) == (t or "")))
                yield pd.DataFrame(rows, columns=["n_tokens", "n_byte_tokens", "ids_sha256", "decoded"])

    return of(text)


def tokenize(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows of docs with token_ids and n_tokens (replacing columns of these names)."""
    out = docs.withColumn("token_ids", encode(docs.sparkSession, text_of(), model))
    return out.withColumn("n_tokens", F.size("token_ids").cast("long"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all documents: null and empty texts have no piece, very long ones are encoded whole, repeated rows alike; an empty table gives no rows. A U+2581 of the text decodes to a space."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", digest(spark, text_of()).alias("d")).select("doc_id", "d.*")
