"""Alignment of two tokenizers: minimal groups of overlapping tokens, and corpus-wide pair counts.

Tokenizer A is a byte-level BPE, B a piece BPE with byte fallback. The tokens
of a text are nodes of a bipartite graph; an A token and a B token are linked
when their byte ranges overlap. Union-find merges linked nodes: its
components are the minimal groups, that is, the text cut wherever a token of
either side ends at the same byte. The links inside the components are then
counted by id pair over all documents, as a shuffle.

Both tokenizers start anew at a space or line break that follows other text,
so a text is aligned chunk by chunk, and a chunk that comes back is looked up.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import byte_of_character
from .storage import keep, rows_a_batch

CACHE_CHUNKS = 300_000
CACHE_LENGTH = 48
#: Pairs, the most frequent ones, that are sent to all tasks; the rest are joined by shuffle.
HEAVY_PAIRS = 1_000_000
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
NO_TOKENS = (0, 0, 0, 0, "", [], [])
START = re.compile(r"(?<=\S)(?=[ \n])")
_aligners: dict[tuple[str, str], "Aligner"] = {}


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of tokens whose byte ranges overlap; both sides cover the same bytes and are given by the tokens' ends."""
    ends = np.union1d(a_ends, b_ends)  # each piece between two ends lies in one token of either side
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


def components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Union-find over ``n`` nodes and the links ``x, y``, all at once: the smallest node of each node's component.

    In each round roots that a link joins are merged, the larger under the
    smaller, and every path is then halved until nodes point at their roots.
    """
    parent = np.arange(n)
    while True:
        r, s = parent[x], parent[y]
        apart = r != s
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(r, s)[apart], np.minimum(r, s)[apart])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def starts(labels: np.ndarray) -> list[int]:
    """Where runs of equal labels start, and the end of the last."""
    return [*np.flatnonzero(np.diff(labels, prepend=-1)).tolist(), len(labels)]


class Aligner(dict):
    """Alignments of chunks, found once and kept up to a bound; None where a tokenizer does not give the chunk's bytes back."""

    def __init__(self, a_path: str, b_path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        byte = byte_of_character()
        self.a_bytes = {i: bytes(byte[c] for c in token if c in byte) for token, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_size = np.array(list(map(len, self.b_bytes)))
        self.shown = list(map(str, range(max(len(self.a_size), len(self.b_size)))))
        # chunks stand for themselves if no B piece crosses their start and A splits by the usual pattern
        rules = json.loads(self.a.to_str())
        own = rules.get("normalizer") is None and (rules.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.by_chunk = own and not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)

    def chunks(self, text: str) -> list[str]:
        """``" " + text`` cut before spaces and line breaks that follow other text."""
        if not self.by_chunk:
            return [" " + text]
        if " ".join(text.split()) != text.replace("\n", " "):  # white space of other kinds, or several in a row
            return START.split(" " + text)
        return [w if w[0] == "\n" else " " + w for w in text.replace("\n", " \n").split(" ")]

    def b_ids(self, chunks: list[str]) -> list[list[int]]:
        """B puts a space before its input: the chunk's own first space, else one to be cut off again."""
        out = []
        for chunk, ids in zip(chunks, self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1), strict=True):
            if chunk == " ":
                ids = [self.space]
            elif chunk[0] != " ":
                ids = ids[1:] if ids[:1] == [self.space] else []
            out.append(ids)
        return out

    def find(self, chunks: list[str]) -> dict[str, tuple | None]:
        """For each chunk its groups as text, the id pair of each link as 64-bit numbers (A's id in the upper half), and both numbers of tokens."""
        out: dict[str, tuple | None] = dict.fromkeys(chunks)
        of_b = {c: b for c, b in zip(chunks, self.b_ids(chunks), strict=True) if b"".join([self.b_bytes[x] for x in b]) == c.encode()}
        # those that end in a letter or mark can follow each other as in a text
        line = [c for c in of_b if self.by_chunk and not c[-1].isspace()]
        found = self.align(line, self.a.encode("".join(line), add_special_tokens=False).ids, [of_b[c] for c in line]) if line else {}
        out |= found
        for c in of_b.keys() - found.keys():
            out |= self.align([c], self.a.encode(c, add_special_tokens=False).ids, [of_b[c]])
        return out

    def align(self, chunks: list[str], a_line: list[int], b_each: list[list[int]]) -> dict[str, tuple]:
        """Chunks that lie one after the other, as one line of bytes, aligned together; nothing where A's tokens are not cut as the chunks are."""
        sizes = np.cumsum([len(c.encode()) for c in chunks])
        b_line = [x for ids in b_each for x in ids]
        a, b = np.array(a_line), np.array(b_line)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_cuts = np.searchsorted(a_ends, sizes)
        if b"".join([self.a_bytes[x] for x in a_line]) != "".join(chunks).encode() or (a_ends[a_cuts] != sizes).any():
            return {}
        x, y = overlaps(a_ends, b_ends)
        group = components(len(a) + len(b), x, len(a) + y)
        left, right = [self.shown[i] for i in a_line], [self.shown[i] for i in b_line]
        # a group's tokens of one side lie next to each other
        a_at, b_at = starts(group[: len(a)]), starts(group[len(a) :])
        groups = [f"{','.join(left[s:t])}|{','.join(right[u:v])}" for s, t, u, v in zip(a_at, a_at[1:], b_at, b_at[1:], strict=False)]
        pairs = (a[x] << 32 | b[y]).astype("<i8").tobytes()
        n_a = np.diff(a_cuts + 1, prepend=0).tolist()
        g = [0, *np.searchsorted(a_at, a_cuts + 1).tolist()]
        link = [0, *(np.searchsorted(x, a_cuts, side="right") * 8).tolist()]
        return {c: (";".join(groups[g[k] : g[k + 1]]), pairs[link[k] : link[k + 1]], n_a[k], len(b_each[k])) for k, c in enumerate(chunks)}

    def rows(self, texts: list[str | None]) -> list[tuple]:
        """One row of figures for each text; all chunks of the batch that are new are tokenised together."""
        cut = [self.chunks(t) if t else [] for t in texts]
        new = self.find(list(set().union(*cut).difference(self)))
        self.update(new)
        out = []
        for chunks in cut:
            parts = list(map(self.__getitem__, chunks))
            if not parts or None in parts:
                out.append(NO_TOKENS)
                continue
            shown, links, n_a, n_b = zip(*parts, strict=True)
            groups = ";".join(shown)
            pairs = np.frombuffer(b"".join(links), dtype="<i8")
            ids, times = np.unique(pairs, return_counts=True)
            out.append((sum(n_a), sum(n_b), groups.count(";") + 1, len(pairs), hashlib.sha256(groups.encode()).hexdigest(), ids, times))
        room = CACHE_CHUNKS - (len(self) - len(new))
        for chunk in new:
            if room <= 0 or len(chunk) > CACHE_LENGTH:
                del self[chunk]
            else:
                room -= 1
        return out


def aligner(a_path: str, b_path: str) -> Aligner:
    key = (a_path, b_path)
    if key not in _aligners:
        _aligners[key] = Aligner(a_path, b_path)
    return _aligners[key]


def _aligned(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = aligner(a_path, b_path).rows(batch.column("text").to_pylist())
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            arrays = [batch.column("row"), batch.column("doc_id")]
            arrays += [pa.array(c, type=pa.int64()) for c in columns[:4]] + [pa.array(columns[4], type=pa.string())]
            arrays += [pa.array(c, type=pa.list_(pa.int64())) for c in columns[5:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


def aligned_rows(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures of each document with its id pairs and their numbers, written once; ``row`` tells rows apart."""
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with rows_a_batch(docs.sparkSession, 256):
        return keep(narrow.mapInArrow(_aligned(a_path, b_path), ALIGNED), "aligned", compression="zstd")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, a_id, b_id, links, best``: links of each id pair over all documents; ``best`` where no other A id has more with that B id."""
    each = aligned.select(F.inline(F.arrays_zip("pairs", "times"))).toDF("pair", "n")
    counts = each.groupBy("pair").agg(F.sum("n").alias("links"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    of_b = Window.partitionBy("b_id")  # as many rows as A has ids, at most
    return counts.select("pair", F.shiftright("pair", 32).alias("a_id"), b_id.alias("b_id"), "links").withColumn("best", F.col("links") == F.max("links").over(of_b))


def heavy_from(counts: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs reach with their links."""
    size = F.floor(F.log2("links")).cast("int").alias("size")
    room, least = most, 0
    for size_, n in sorted(counts.groupBy(size).count().collect(), reverse=True):  # 63 rows at most
        room -= n
        if room < 0:
            return 1 << (size_ + 1)
        least = 1 << size_
    return least


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", heavy_pairs: int = HEAVY_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row of ``docs``.

    A null or empty text, and one that a tokenizer does not give back byte by
    byte, has no tokens: zeros and an empty ``groups_sha256``, and it counts
    nothing. Null and repeated ids and equal texts are rows like any others;
    an empty table gives none; other columns are not read. Texts are taken
    whole. The pairs of the documents meet their counts by broadcast for the
    ``heavy_pairs`` most frequent pairs and by shuffle for all others, none of
    which is frequent, so no key is hot.
    """
    aligned = aligned_rows(docs, a_path, b_path, id_col, text_col)
    counts = keep(pair_counts(aligned), "pair_counts").select("pair", "links", "best")
    least = heavy_from(counts, heavy_pairs)
    heavy, light = counts.where(F.col("links") >= least), counts.where(F.col("links") < least)
    each = aligned.select("row", F.inline(F.arrays_zip("pairs", "times"))).toDF("row", "pair", "n")
    met = each.join(F.broadcast(heavy), "pair")
    if least > 1:
        rare = each.join(F.broadcast(heavy.select("pair")), "pair", "left_anti")
        met = met.unionByName(rare.join(light, "pair"))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    figures = aligned.drop("pairs", "times").join(sums, "row", "left")
    return figures.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
