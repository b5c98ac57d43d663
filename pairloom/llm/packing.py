"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised in place, and whole windows are cut off the front of
long ones; what is left is cut into pieces of a quarter of a window at most.
Each piece goes to one of many groups of bounded size. Inside a group the
largest differencing method deals the pieces into k windows of near-equal load: two partial partitions are
merged so that the heavy windows of one meet the light windows of the other.
k starts at the fewest windows that could hold the group and rises until no
window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep, rows_a_batch

CAPACITY = 1024
#: Pieces of a group, on average.
GROUP_PIECES = 3072
#: What is left of a document is cut into pieces of this size at most: small pieces balance with little padding.
TAIL_PIECE = 256
END_ID = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"

# White space other than single spaces and line breaks between words, or the start of a special token.
ODD_SPACE = r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]|  | \n|\n |\n\n|[ \n]\Z|\A[ \n]|<\|"
CACHE_WORDS = 250_000
CACHE_LENGTH = 48
_encoders: dict[str, "Encoder"] = {}


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Words(dict):
    """Ids of " word" (or of a line break and a line's first word), found once and kept up to a bound."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(word if word[:1] == "\n" else " " + word)).tobytes()
        if len(self) < CACHE_WORDS and len(word) <= CACHE_LENGTH:
            self[word] = ids
        return ids


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    A byte-level BPE with the usual split pattern never merges across the
    start of a " word" or of a line, so the ids of a text are those of its
    words in a row. A word is encoded with the ranks of the same vocabulary
    file by a faster library; a text with white space of other kinds, or
    with what may be a special token, goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.odd = re.compile(ODD_SPACE)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        byte = byte_of_character()
        ranks = {bytes(byte[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in special}
        # The split pattern of this family of tokenizers (a fixed value).
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.words = Words(tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not text or self.odd.search(text):
            return self.whole(text)
        # a line break stays with the first word of its line; the one put before the text is cut off again
        words = ("\n" + text).replace("\n", " \n").split(" ")
        return b"".join(map(self.words.__getitem__, words[1:]))[self.line :]

    @cached_property
    def line(self) -> int:
        return len(self.whole("\n"))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _cut(path: str, id_col: str, text_col: str, capacity: int, tail_piece: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            encode = encoder(path).encode
            for doc, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col), strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                tail = total - total % capacity
                for at in [*range(0, tail, capacity), *range(tail, total, tail_piece)]:
                    piece = ids[4 * at : 4 * min(at + (capacity if at < tail else tail_piece), total)]
                    rows.append((doc, at, len(piece) // 4, zlib.crc32(piece), total, piece if with_ids else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            arrays = [pa.array(columns[k], type=pa.int64()) for k in range(5)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays.append(pa.array(columns[5], type=pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tail_piece: int = TAIL_PIECE, with_ids: bool = False) -> DataFrame:
    """Tokenise each text, add the end id and cut off whole windows; what is left is cut every ``tail_piece`` tokens.

    A null text is empty: its one token is the end id. ``with_ids`` adds the
    ids of a piece as little-endian unsigned 32-bit bytes.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_cut(tokenizer_path, "doc_id", "text", capacity, tail_piece, with_ids), PIECES + (", ids binary" if with_ids else ""))


def difference(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Deal items into ``k`` windows by the largest differencing method; returns (load, items) of each non-empty one.

    A partial partition is a list of (load, tree of items) in ascending order
    that leaves out its empty windows; its imbalance is the largest load less
    the smallest of all k.
    """

    def entry(part: list) -> tuple:
        low = part[0][0] if len(part) == k else 0
        return (low - part[-1][0], part[0][1], part)

    heap = [entry([(size, i, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        spare = k - len(a)
        # b's heaviest windows take the places of a's empty ones while there are some;
        # its lighter ones meet windows of a, the heaviest of these the lightest of a
        if len(b) <= spare:
            if len(b) == 1:
                insort(a, b[0])
            else:
                a = sorted(a + b)
        else:
            alone, met = b[len(b) - spare :] if spare else [], b[: len(b) - spare]
            joined = [(x[0] + y[0], min(x[1], y[1]), (x[2], y[2])) for x, y in zip(a, reversed(met), strict=False)]
            a = sorted(joined + a[len(met) :] + alone)
        heapq.heappush(heap, entry(a))
    out = []
    for load, _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            else:
                items.append(node)
        out.append((load, sorted(items)))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of near-equal windows, as few as the differencing finds room for."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, k)
        if all(load <= capacity for load, _ in found):
            return [items for _, items in found]
        k += 1


def _pack(capacity: int, with_ids: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        length = table.column("length").to_numpy()
        full = int((length == capacity).sum())
        sequence = np.zeros(len(length), dtype=np.int64)
        offset = np.zeros(len(length), dtype=np.int64)
        sequence[:full] = np.arange(full)
        tails = [int(x) for x in length[full:]]
        for n, items in enumerate(windows(tails, capacity) if tails else []):
            at = 0
            for i in items:
                sequence[full + i], offset[full + i] = full + n, at
                at += tails[i]
        base = key[0].as_py() << 32  # room for the sequences of a group
        out = table.drop_columns(["_group"])
        return out.append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tail_piece: int = TAIL_PIECE, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` tokens.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` (and ``ids`` if asked for). Every token is in exactly one piece.
    Documents with null ids, repeated ids or equal texts are packed like any
    others; an empty table gives no pieces. Other columns are not read.
    The pieces are written once. A piece's group is a hash of its place in
    that table, so neither one id, null or not, nor copies of one text gather
    in a group, and groups are bounded in pieces, whatever the documents.
    Rerun on the same input files, the same pieces meet.
    """
    with rows_a_batch(docs.sparkSession):
        pieces = keep(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, tail_piece, with_ids), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(_pack(capacity, with_ids), PACKED if not with_ids else PIECES + ", ids binary, sequence_id long, offset long")
