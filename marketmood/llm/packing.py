"""Harmonic packing of token sequences.

A piece of length l belongs to class j = floor(capacity / l): j pieces of the
class fill a bin, and no more fit. Every worker fills the bins of each class
with exactly j pieces on its own, without a shuffle. Documents may be cut: whole
capacities go first, and a rest is cut down to the reciprocal length
floor(capacity / (j + 1)) as long as j pieces like it would leave more than
``1 - min_fill`` of a bin empty; so a full bin is at least ``min_fill`` full.
Pieces whose bin is still open when a worker ends (fewer than j for each of the
at most 90 classes) are put together by first fit.

Tokens come from a public word-level BPE file. Its ids depend on each pre-token
alone, so ids are remembered by word, and only new words go through the
tokenizer's model. Texts with characters beyond Latin Extended-A, where normalisation
needs the library, or with the strings of special tokens are encoded whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.llm.common import read_table, rows_of, text_pieces, worker_memory

CAPACITY = 2048
MIN_FILL = 0.97
END_ID = 1
VOCABULARY = "word_bpe_49k.json"

# Up to U+017F without the dotted capital I, where case mapping is by single characters and NFC changes
# nothing, and without the separators that only Python takes for white space.
BEYOND = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u017f]")
_LETTERS, _NUMBERS, _SPACES = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r\x20\x85\xa0"
PRETOKEN = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}{_SPACES}]+")
CACHE_WORDS, CACHE_PARTS = 300_000, 600_000


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself if it is a visible character, else as the next of U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Memory(dict):
    """Values of a function by key, in two generations of at most ``limit`` keys.

    A full generation becomes the old one; keys that are asked for again move
    back, the others go when the next one is full.
    """

    def __init__(self, made, limit: int):
        super().__init__()
        self.made, self.limit, self.old = made, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.made(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Little-endian 32-bit ids of whole texts, with a bounded memory of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        tokenize, letters = self.tok.model.tokenize, _byte_letters()

        def of_word(word: str) -> bytes:
            written = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(letters)
            return b"".join([t.id.to_bytes(4, "little") for t in tokenize(written)])

        words = Memory(of_word, CACHE_WORDS).__getitem__

        def of_part(part: str) -> bytes:
            low = part.lower()
            if low.isalpha():  # a single pre-token
                return words(low)
            if low[-1] in ".,;:!?" and low[:-1].isalpha():
                return words(low[:-1]) + words(low[-1])
            return b"".join(map(words, PRETOKEN.findall(low)))

        # by what stands between white space
        self.parts = Memory(of_part, CACHE_PARTS).__getitem__

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        out = []
        for block in text_pieces(text):
            if BEYOND.search(block) or ("<|" in block and any(s in block for s in self.special)):
                out.append(self.whole(block))
            else:
                out.append(b"".join(map(self.parts, block.split())))
        return b"".join(out)


def cuts(length: int, capacity: int = CAPACITY, min_fill: float = MIN_FILL) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        j = capacity // rest
        take = rest if j * rest >= min_fill * capacity else capacity // (j + 1)
        out.append(take)
        rest -= take
    return out


def first_fit(open_pieces: list[tuple], capacity: int, next_id):
    """Place pieces (longest first) in the first sequence with room; yields (piece, sequence, offset)."""
    bins: list[list[int]] = []  # sequence, filled
    for piece in sorted(open_pieces, key=lambda p: -p[2]):
        for b in bins:
            if b[1] + piece[2] <= capacity:
                break
        else:
            bins.append(b := [next_id(), 0])
        yield piece, b[0], b[1]
        b[1] += piece[2]


FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
          ("sequence_id", pa.int64()), ("offset", pa.int64())]


def pack(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY,
         min_fill: float = MIN_FILL, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``path`` names the tokenizer file, present on all workers. Null and empty
    texts are the end id alone. Repeated rows and ids are packed row by row, a
    null id stays null; other columns are ignored. ``ids`` (binary, little-endian
    32-bit) is the piece's content, to be laid out by sequence and offset.
    """
    id_type = docs.schema[id_col].dataType
    end = np.array([end_id], "<u4").tobytes()

    def work(batches):
        from pyspark import TaskContext
        counter = [TaskContext.get().partitionId() << 40]
        kept = worker_memory()  # words met by earlier tasks of this worker stay known
        encoder = kept.get(path) or kept.setdefault(path, Encoder(path))
        waiting: dict[int, list] = {}

        def next_id():
            counter[0] += 1
            return counter[0] - 1

        def batch_of(rows):
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], id_arrow), *[pa.array(c, f[1]) for c, f in zip([*cols[1:5], *cols[-2:]], FIELDS)]]
            if with_ids:
                arrays.append(pa.array(cols[5], pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, *[f[0] for f in FIELDS], *["ids"] * with_ids])

        id_arrow = pa.int64()
        for batch in batches:
            rows, id_arrow = [], batch.schema.field(0).type
            for key, t in rows_of(batch):
                data = encoder.encode(t) + end
                total, at = len(data) // 4, 0
                for n in cuts(total, capacity, min_fill):
                    body = data[4 * at:4 * (at + n)]
                    piece = (key, at, n, zlib.crc32(body), total, body if with_ids else None)
                    at += n
                    group = waiting.setdefault(capacity // n, [])
                    group.append(piece)
                    if len(group) == capacity // n:  # the bin is full
                        seq, filled = next_id(), 0
                        for p in group:
                            rows.append((*p, seq, filled))
                            filled += p[2]
                        group.clear()
                if len(rows) >= 2000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)
        left = [p for group in waiting.values() for p in group]
        if left:
            yield batch_of([(*p, seq, at) for p, seq, at in first_fit(left, capacity, next_id)])

    schema = (f"`{id_col}` {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long" + (", ids binary" if with_ids else ""))
    return docs.select(id_col, text).mapInArrow(work, schema)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op3_packing(spark, sf_dir) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary_path())
