"""Harmonic packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EOS = 1
#: A length fills its class if its bins' waste is at most this share; otherwise a piece is cut off.
MAX_WASTE = 1 / 128
#: Lengths below this are cut into powers of two, whose bins fill exactly.
SMALL = 64
#: Words whose ids a task remembers; a full memory is started anew, and none outlives its task.
REMEMBERED = 800_000
#: Bytes of ids after which a worker hands rows on.
FLUSH_BYTES = 8 << 20

_SAFE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Fixed value: the vocabulary's own pattern of words, for texts of the characters above.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of a text by a vocabulary that drops white space: its words are encoded apart and remembered.

    A word of plain Latin letters, digits and marks is cut by the vocabulary's pattern and its
    parts go to the vocabulary's merges directly; any other word takes the whole way.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        alphabet = byte_alphabet()
        self.letters = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(256)}
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            ids = self.parts[part] = np.array([t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.letters))], "<u4").tobytes()
        return ids

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8", "surrogatepass")
        if _SAFE.fullmatch(word) and "<|" not in word:
            ids = b"".join(map(self._part, _PARTS.findall(word.lower())))
        else:
            ids = np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        if len(raw) <= 64:
            self.words[raw] = ids
        return ids

    def forget(self) -> None:
        self.words.clear()
        self.parts.clear()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        known = self.words.get
        return b"".join([known(w) or self._word(w) for w in text.encode("utf-8", "surrogatepass").split()])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Pieces of a document of n ids: (length, how many such fill a sequence).

    A length in (capacity / (k + 1), capacity / k] is of class k, k to a sequence. One that
    would waste more than MAX_WASTE of it gives a piece of the next class's capacity and
    goes on with the rest; what is below SMALL is cut into powers of two.
    """
    while n:
        if n >= capacity:
            size = capacity
        elif n < SMALL:
            size = 1 << n.bit_length() - 1
        elif (k := capacity // n) * n >= capacity * (1 - MAX_WASTE):
            size = n
        else:
            size = capacity // (k + 1)
        yield size, capacity // size
        n -= size


class Packer:
    """Open bins of one worker, one for each class; a bin is closed at its fixed number of pieces."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for key, start, ids, total in pieces:
            yield key, start, len(ids) // 4, ids, total, self.next_id, at
            at += len(ids) // 4
        self.next_id += 1

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        """Rows of the sequences that a document's pieces fill."""
        total, at = len(ids) // 4, 0
        for size, k in cut(total, self.capacity):
            pieces = self.open.setdefault(k, [])
            pieces.append((key, at, ids[4 * at: 4 * (at + size)], total))
            at += size
            if len(pieces) == k:
                yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        """Rows of the bins still open: cut anew into full sequences and, at the end, powers of two, so nothing is padded."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        rest = sum(len(p[2]) // 4 for p in left)
        room, pieces = 0, []
        for key, start, ids, total in left:
            while ids:
                if not room:
                    room = self.capacity if rest >= self.capacity else 1 << rest.bit_length() - 1
                n = min(room, len(ids) // 4)
                pieces.append((key, start, ids[: 4 * n], total))
                ids, start, room, rest = ids[4 * n:], start + n, room - n, rest - n
                if not room:
                    yield from self._close(pieces)
                    pieces = []


def harmonic_pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = 2048) -> DataFrame:
    """Tokenise every text and pack the ids into sequences of at most `capacity`.

    Returns a row per piece: key, start and length (in its document's ids, the closing id 1
    included), ids (little-endian 32-bit numbers), doc_tokens, sequence_id and offset. Every
    id lies in exactly one piece; a sequence is gapless from 0. Workers pack their own
    partitions without exchanging anything; each holds one open bin per class, 38 sequences
    at most. sequence_id is the partition's number times 2**32 plus a count.

    Null and empty texts have the closing id alone. Repeated rows are packed as often as they
    come, with a null key too. An empty table gives an empty result; other columns are left out.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity is a power of two")
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        encode = words.encode
        packer = Packer(capacity, TaskContext.get().partitionId() << 32)
        end = np.array([EOS], "<u4").tobytes()
        rows: list[tuple] = []
        size, key_type = 0, None

        def out():
            cols = list(zip(*rows))
            types = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in packer.add(k, encode(x.as_py() or "") + end):
                    rows.append(row)
                    size += len(row[3]) + 64
                if size >= FLUSH_BYTES:
                    yield out()
                    rows, size = [], 0
        words.forget()  # an idle worker holds the vocabulary alone
        rows += packer.finish()
        if rows:
            yield out()

    found = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return found.withColumnRenamed("key", key)
