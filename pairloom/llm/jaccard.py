"""Near duplicates: exact Jaccard join of word n-grams, light sets apart from heavy ones.

A document's set holds 64-bit hashes of its distinct five-word shingles.
Documents with one and the same set form a node, so copies meet once. Sets are
the same when 128 bits of hash are; a node is then known by 64 of them, or by
the other 64 where two nodes share these.

Two linked sets of sizes n and m share at least c(n, m) shingles. A light set,
of few shingles, enumerates its subsets of each size c that a light partner
may call for; linked light sets have such a subset in common. Any other set
goes to inverted lists with the first shingles of a global order, just so
many that linked sets have one of them in common. The order puts frequent
shingles last: their lists would be long. Where light ends is chosen by
comparing the subsets of a size with its postings and the pairs that these
lead to, as counted in the lists of the small sets.

Short lists give all their pairs. In a long list every node is paired with a
leader; what is left between the components that this makes likely is paired
in blocks. Parity sketches, as wide as their sets are large, drop the pairs
that they prove too different. The
others are verified on the full sets, nearest first, until none is left
between components; where two blocks have many, as of documents that share a
template and little more, the sets are sent there and no pair is written. So no link is missed or invented, short of two shingles
of one pair of sets that share a 64-bit hash.

What is sent to blocks and pairs may grow faster than the input. It goes in
rounds of a bounded share of the sets' bytes, and the shuffle files of a round
are freed at its end.

Texts are shingled anew by each of the four passes that need sets: kept sets
would take more disk than the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import freed_shuffles, keep, rows_a_batch
from .textarrays import mix, row_chunks, shingle_sets

#: 100 * intersection >= PERCENT * union links two sets.
PERCENT = 80
#: Sets of more shingles than this are never light.
LARGEST_LIGHT = 16
#: A list of more nodes than this is long.
SHORT_LIST = 4
#: A shingle in more lists' worth of postings than this counts as frequent ...
FREQUENT = 32
#: ... unless there could be more frequent shingles than this (16 bytes each go to every executor).
MOST_FREQUENT = 1_000_000
LEADER_ROUNDS = 2
#: Rounds in which a component verifies its nearest pair only.
NEAREST_ROUNDS = 2
BLOCK = 2048
#: Pairs of two blocks are written up to so many for each member, or in all; where there are more they are verified inside the blocks.
LOOSE, MANY_PAIRS = 8, 1 << 16
#: Bytes of sets that a part of a block holds, about.
BLOCK_BYTES = 16 << 20
POSTINGS_PER_BUCKET = 400_000
#: Bits of a sketch: a power of two, not below the set's size; from the first number to the second (16 KB).
SKETCH_BITS, WIDEST_SKETCH = 1024, 1 << 17
#: Bytes of sketches that are compared at once.
COMPARED_BYTES = 8 << 20
#: Bytes that a round sends to blocks or pairs: a quarter of all sets' (the first), but so many at least.
ROUND_SHARE, ROUND_BYTES = 4, 256 << 20
#: Postings carry sizes in two bytes; larger ones look alike there, and are told apart when a pair is verified.
CLIPPED = 0xFFFF
#: Bits of the filter that spares the join most sets of other nodes: 8 MB at most. With more than some
#: ten million nodes it lets more through, which the join drops; at worst it moves every set once.
FILTER_BITS = 1 << 26
#: Bits of a hash that choose a bucket, so that there may be 16 million of them.
BUCKET_BITS = 24

NODES = "doc_id long, n int, sig long, check long, sketch binary, small binary"


def common(n: int, m: int) -> int:
    """Fewest shared shingles with which sets of n and m link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def prefix(n):
    """How many first shingles of a set must be looked at: any linked partner has one of them."""
    return n - -(-PERCENT * n // 100) + 1


def signature(x: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set."""
    with np.errstate(over="ignore"):
        names = []
        for salt in (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)):
            y = mix(x + salt)
            names.append(np.add.reduce(y) ^ (np.bitwise_xor.reduce(y) * np.uint64(len(x) * 2 + 1)))
        return tuple(int(v) for v in mix(np.array(names, dtype=np.uint64)).view(np.int64))


class Names:
    """Names of sets by 64 bits: the first half of the signature, or the second where two nodes share the first.

    Among N nodes about N * N / 2**65 pairs share a half (three of ten billion
    nodes), so the set of shared halves is small.
    """

    def __init__(self, shared: frozenset[int] = frozenset()):
        self.shared = shared

    def __call__(self, x: np.ndarray) -> int:
        a, b = signature(x)
        return b if a in self.shared else a


def sketch(x: np.ndarray) -> bytes:
    """Parity of the number of shingles that fall to each bit: it differs in at most as many bits as sets in shingles.

    With fewer bits than shingles, sketches of any two sets would differ in
    half of their bits, which proves nothing.
    """
    bits = min(WIDEST_SKETCH, max(SKETCH_BITS, 1 << (len(x) - 1).bit_length()))
    return np.packbits((np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, of ``width`` bytes: wider ones as they would be with so many bits."""
    lengths = np.array([len(x) for x in sketches])
    out = np.empty((len(sketches), width // 8), dtype=np.uint64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        out[at] = np.bitwise_xor.reduce(np.frombuffer(b"".join([sketches[i] for i in at]), dtype=np.uint64).reshape(len(at), -1, width // 8), axis=1)
    return out


def find_nodes(docs: DataFrame) -> DataFrame:
    """One row per document; ``small`` are the first shingles of a set that may be light."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_chunks(batch, "text"):
                sets = list(shingle_sets(part.column("text")))
                names = [signature(x) if len(x) else (0, 0) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) for x in sets], type=pa.int32()),
                        pa.array([a for a, _ in names], type=pa.int64()),
                        pa.array([b for _, b in names], type=pa.int64()),
                        pa.array([sketch(x) if len(x) else b"" for x in sets], type=pa.binary()),
                        pa.array([x[: prefix(len(x))].tobytes() if 0 < len(x) <= LARGEST_LIGHT else None for x in sets], type=pa.binary()),
                    ],
                    names=["doc_id", "n", "sig", "check", "sketch", "small"],
                )

    return docs.mapInArrow(run, NODES)


def shared_halves(rows: DataFrame) -> frozenset[int]:
    pairs = rows.where("n > 0").select("sig", "check").distinct()
    return frozenset(r[0] for r in pairs.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("sig").collect())


def renamed(rows: DataFrame, shared: frozenset[int]) -> DataFrame:
    return rows.withColumn("sig", F.when(F.col("sig").isin(list(shared)), F.col("check")).otherwise(F.col("sig"))) if shared else rows


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys & np.uint64((1 << BUCKET_BITS) - 1)) % np.uint64(buckets)


def count_key(keys: np.ndarray, buckets: int) -> np.ndarray:
    """32 bits of a hash behind its bucket: enough to count by, as counts only order the shingles."""
    return (bucket_of(keys, buckets) << np.uint64(32)) | ((keys >> np.uint64(BUCKET_BITS)) & np.uint64(0xFFFFFFFF))


def in_buckets(keys: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows ``(bucket, bytes, bytes, ...)`` of the columns of the keys."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    present, first = np.unique(bucket[order], return_index=True)
    for b, at in zip(present.tolist(), np.split(order, first[1:]), strict=True):
        yield (b, *(c[at].tobytes() for c in columns))


def counted(n):
    """How many first shingles of a set of ``n`` are counted."""
    return prefix(n) * 3 // 2 + 8


def frequent_shingles(docs: DataFrame, buckets: int, rows: DataFrame, name: Names) -> np.ndarray:
    """Shingles with many postings, and how many each has: a structured array sorted by shingle.

    Counts cover the first shingles of all documents, half again as many as a
    search needs, so that those that move up as frequent ones move back are
    counted too. A frequent shingle has more than the threshold of these
    postings, so there are at most ``MOST_FREQUENT``. A task counts a set once
    (it remembers 8 bytes a set).
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in row_chunks(batch, "text"):
                heads = []
                for x in shingle_sets(part.column("text")):
                    if len(x) and (own := name(x)) not in seen:
                        seen.add(own)
                        heads.append(x[: counted(len(x))])
                if heads:
                    keys = np.concatenate(heads)
                    rows = list(in_buckets(keys, buckets, (keys >> np.uint64(BUCKET_BITS)).astype(np.uint32)))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.int32()), pa.array([r[1] for r in rows], type=pa.binary())], names=["bucket", "keys"])

    n = F.col("n")
    first = n - F.floor((PERCENT * n + 99) / 100) + 1
    postings = rows.where("n > 0").agg(F.sum(F.least(n, F.floor(first * 3 / 2) + 8))).first()[0] or 0
    least = max(FREQUENT, -(-postings // MOST_FREQUENT))

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, n = np.unique(np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32) for x in table.column("keys")]), return_counts=True)
        often = n > least
        return pa.table({"key": pa.array(keys[often].astype(np.int64) | key[0].as_py() << 32), "postings": pa.array(n[often])})

    found = docs.mapInArrow(emit, "bucket int, keys binary").groupBy("bucket").applyInArrow(count, "key long, postings long").toArrow()
    out = np.zeros(found.num_rows, dtype=[("key", np.uint64), ("postings", np.int64)])
    for c in ("key", "postings"):
        out[c] = found.column(c).to_numpy()
    return np.sort(out, order="key")


def pairs_a_posting(rows: DataFrame) -> float:
    """Pairs that a posting of the small sets leads to, counted in the lists of all of them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("small").to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    small = rows.where("small is not null").select("sig", "small").dropDuplicates(["sig"]).mapInArrow(emit, "key long")
    k = F.col("k").cast("double")
    return small.groupBy("key").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(k * (k - 1) / 2) / F.sum(k)).first()[0] or 0.0


def light_boundary(sizes: dict[int, int], pairs: float) -> int:
    """The largest size up to which subsets cost no more than postings and the pairs that each leads to."""
    best = 0
    for n in range(1, LARGEST_LIGHT + 1):
        subsets = sum(comb(n, c) for c in wanted(n, n))
        if sizes.get(n, 0) and subsets > prefix(n) * (1 + pairs):
            break
        best = n
    return best


def wanted(n: int, most: int) -> list[int]:
    """Sizes of the subsets that a set of n shares with linked partners of up to ``most`` shingles."""
    low = -(-PERCENT * n // 100)
    high = min(most, 100 * n // PERCENT)
    return sorted({c for m in range(low, high + 1) if (c := common(n, m)) <= min(n, m)})


def head(x: np.ndarray, frequent: np.ndarray, buckets: int) -> np.ndarray:
    """First shingles of a set in the global order: infrequent ones by hash, then frequent ones by postings."""
    n = prefix(len(x))
    if not len(frequent):
        return x[:n]
    key = count_key(x, buckets)
    at = np.minimum(np.searchsorted(frequent["key"], key), len(frequent) - 1)
    hot = frequent["key"][at] == key
    cool = x[~hot]
    if len(cool) >= n:
        return cool[:n]
    warm = x[hot]
    return np.concatenate([cool, warm[np.lexsort((warm, frequent["postings"][at[hot]]))][: n - len(cool)]])


def subset_keys(x: np.ndarray, light: int) -> np.ndarray:
    """Keys of the subsets that a light set enumerates."""
    keys = []
    with np.errstate(over="ignore"):
        spread = mix(x * np.uint64(0xD6E8FEB86659FD93))
        total = np.add.reduce(spread)
        for c in wanted(len(x), light):
            salt = np.uint64(c * 0x2545F4914F6CDD1D % 2**64)
            for gone in combinations(range(len(x)), len(x) - c):
                keys.append(total - np.add.reduce(spread[list(gone)]) + salt if gone else total + salt)
    return mix(np.array(keys, dtype=np.uint64))


def emit_postings(frequent, buckets: int, light: int, naming: Names):
    """``frequent`` is a broadcast array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in row_chunks(batch, "text"):
                keys, names, sizes = [], [], []
                for x in shingle_sets(part.column("text")):
                    n = len(x)
                    if not n or (name := naming(x)) in seen:
                        continue
                    seen.add(name)
                    own = []
                    if n <= light:
                        own.append(subset_keys(x, light))
                    if 100 * n >= PERCENT * (light + 1):  # a partner may be heavy
                        own.append(head(x, frequent.value, buckets))
                    count = sum(map(len, own))
                    keys += own
                    names.append(np.full(count, name, dtype=np.int64))
                    sizes.append(np.full(count, min(n, CLIPPED), dtype=np.uint16))
                if keys:
                    keys = np.concatenate(keys)
                    # six bytes and the bucket tell keys apart; a clash would only add a candidate
                    short = np.ascontiguousarray((keys >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6])
                    rows = list(in_buckets(keys, buckets, short, np.concatenate(names), np.concatenate(sizes)))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.int32())] + [pa.array([r[k] for r in rows], type=pa.binary()) for k in (1, 2, 3)], names=["bucket", "keys", "sigs", "sizes"])

    return run


LISTS = "bucket int, key long, a long, na int, b long, nb int"


def scan_lists(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Pairs of the short lists of a bucket, and the members of its long ones (with a null ``b``)."""
    short, names, sizes = (np.concatenate([np.frombuffer(x.as_py(), dtype=t) for x in table.column(c)]) for c, t in (("keys", np.uint8), ("sigs", np.int64), ("sizes", np.uint16)))
    keys = np.zeros((len(names), 8), dtype=np.uint8)
    keys[:, :6] = short.reshape(-1, 6)
    keys = keys.view(np.uint64)[:, 0]
    order = np.lexsort((names, sizes, keys))
    keys, names, sizes = keys[order], names[order], sizes[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])
    keys, names, sizes = keys[new], names[new], sizes[new]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    length = np.diff(edge)
    first, second = [], []
    for n in range(2, SHORT_LIST + 1):
        at = edge[:-1][length == n]
        for i, j in combinations(range(n), 2):
            first.append(at + i)
            second.append(at + j)
    first, second = np.concatenate(first), np.concatenate(second)
    near = (100 * sizes[first].astype(np.int64) >= PERCENT * sizes[second].astype(np.int64)) | (sizes[second] == CLIPPED)
    first, second = first[near], second[near]
    pairs = np.unique(np.stack([names[first], sizes[first], names[second], sizes[second]]), axis=1) if len(first) else np.zeros((4, 0), dtype=np.int64)
    long = np.flatnonzero(np.repeat(length > SHORT_LIST, length))
    return pa.table(
        {
            "bucket": pa.array(np.full(pairs.shape[1] + len(long), key[0].as_py(), dtype=np.int32)),
            "key": pa.concat_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(keys[long].view(np.int64))]),
            "a": pa.array(np.concatenate([pairs[0], names[long]])),
            "na": pa.array(np.concatenate([pairs[1], sizes[long]]).astype(np.int32)),
            "b": pa.concat_arrays([pa.array(pairs[2]), pa.nulls(len(long), pa.int64())]),
            "nb": pa.concat_arrays([pa.array(pairs[3].astype(np.int32)), pa.nulls(len(long), pa.int32())]),
        }
    )


def differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many shingles sets differ at least, by their sketches (rows of 64-bit words)."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """``a, b, apart``: pairs that their sizes and sketches don't rule out, and how far apart these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            total = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            width, apart = np.array([min(len(v), len(w)) for v, w in zip(x, y, strict=True)]), np.empty(len(x), dtype=np.int64)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                apart[at] = differ(folded([x[k] for k in at], w), folded([y[k] for k in at], w))
            # sets that differ in d shingles share (total - d) / 2
            out = batch.select(["a", "b"]).append_column("apart", pa.array(apart / total))
            yield out.filter(pa.array(100 * (total - apart) >= PERCENT * (total + apart)))

    x = sketches.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    y = sketches.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    near = pairs.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    return near.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long, apart double")


def filter_words(names: DataFrame) -> np.ndarray:
    """A Bloom filter of the nodes, of bounded size, as 64-bit words."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (12 * names.count()).bit_length()))
    places = F.array(F.col("sig").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("sig", 32).bitwiseAND(F.lit(bits - 1)))
    set_bits = names.select(F.explode(places).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    out = np.zeros(bits // 64, dtype=np.uint64)
    rows = set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def sets_of(docs: DataFrame, names: DataFrame, naming: Names) -> DataFrame:
    """``sig, members`` of the named nodes, found again from the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_words(names))

    def asked(words: np.ndarray, name: int) -> bool:
        mask = len(words) * 64 - 1
        places = (name & mask, (name & 0xFFFFFFFFFFFFFFFF) >> 32 & mask)
        return all(int(words[p >> 6]) >> (p & 63) & 1 for p in places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        words = sent.value
        for batch in batches:
            for part in row_chunks(batch, "text"):
                found = []
                for x in shingle_sets(part.column("text")):
                    if len(x) and (name := naming(x)) not in seen and asked(words, name):
                        seen.add(name)
                        found.append((name, x.tobytes()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], type=pa.int64()), pa.array([x[1] for x in found], type=pa.binary())], names=["sig", "members"])

    return docs.mapInArrow(run, "sig long, members binary").join(names, "sig", "left_semi").dropDuplicates(["sig"])


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose sets link."""
    for batch in batches:
        yes = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            yes.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(yes, type=pa.bool_()))


def rounds(size: int | None, room: int) -> int:
    return max(1, -(-(size or 0) // room))


def of_round(k: int, n: int, *key: str) -> Column:
    return F.lit(True) if n == 1 else F.pmod(F.xxhash64(F.lit(11), *key), F.lit(n)) == k


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def links_of(pairs: DataFrame, sets: DataFrame, room: int) -> DataFrame:
    """The pairs that link, found on the full sets. A round sends the sets' own bytes, or ``room``, to its pairs."""
    x = sets.select(F.col("sig").alias("a"), F.col("members").alias("x"))
    y = sets.select(F.col("sig").alias("b"), F.col("members").alias("y"))
    own = sets.agg(F.sum("bytes")).first()[0] or 0
    n = rounds(pairs.join(sets.select(F.col("sig").alias("a"), "bytes"), "a").agg(F.sum("bytes")).first()[0], max(room, own))
    return union([keep(pairs.select("a", "b").where(of_round(k, n, "a", "b")).join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(linked, "a long, b long"), "links") for k in range(n)])


def labelled(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs between components, with the labels ``la, lb`` of their nodes."""
    if labels is None:
        return pairs.withColumns({"la": F.col("a"), "lb": F.col("b")})
    for node in ("a", "b"):
        named = labels.select(F.col("node").alias(node), F.col("label").alias("_label"))
        pairs = pairs.join(named, node, "left").withColumn(f"l{node}", F.coalesce("_label", node)).drop("_label")
    return pairs.where("la <> lb")


def verified_labels(pairs: DataFrame, sets: DataFrame, room: int, labels: DataFrame | None = None) -> DataFrame:
    """Components by the pairs that link, verifying no pair inside a component.

    In each of the first rounds every component verifies its nearest open
    pair only; what is still between components is verified after that.
    """
    tried = None
    for turn in range(NEAREST_ROUNDS + 1):
        left = labelled(pairs, labels)
        if tried is not None:
            left = left.join(tried, ["a", "b"], "left_anti")
        if turn < NEAREST_ROUNDS:
            ends = left.select("a", "b", F.explode(F.array("la", "lb")).alias("own"), "apart")
            left = ends.groupBy("own").agg(F.min(F.struct("apart", "a", "b")).alias("near")).select("near.a", "near.b").distinct()
        left = keep(left.select("a", "b"), "pairs")
        if labels is not None and left.isEmpty():
            break
        tried = left if tried is None else tried.unionByName(left)
        labels = components(links_of(left, sets, room), labels)
    return labels


def ordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def leader_pairs(members: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """Pairs of each member of a long list with the list's leader of this turn.

    The member of most long lists leads: it has the fewest shingles of its
    own, so among near copies it is the closest to all. Later it is one
    outside the list's largest component, and only members of other
    components than its own are compared.
    """
    rank = F.struct((-F.col("lists")).alias("rank"), F.xxhash64(F.lit(turn), "sig").alias("turn"), "sig", "n", "label")
    if labels is None:
        members = members.withColumn("label", F.col("sig"))
        leaders = members.groupBy("key").agg(F.min(rank).alias("lead"))
    else:
        members = members.join(labels, members.sig == labels.node, "left").select("key", "sig", "n", "lists", F.coalesce("label", "sig").alias("label"))
        parts = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"), F.min(rank).alias("lead"))
        largest = parts.groupBy("key").agg(F.max(F.struct("size", "label")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        leaders = parts.join(largest, "key").where(F.col("label") != F.col("top.label")).groupBy("key").agg(F.min("lead").alias("lead"))
    met = members.join(leaders, "key").where(F.col("sig") != F.col("lead.sig"))
    if labels is not None:
        met = met.where(F.col("label") != F.col("lead.label"))
    met = met.where(100 * F.least("n", "lead.n") >= PERCENT * F.greatest("n", "lead.n"))
    return ordered_pairs(met, "sig", "lead.sig")


class Sketches:
    """Sketches of a block's members, for each width that occurs: those of that width, and wider ones folded to it."""

    def __init__(self, sketches: list[bytes]):
        self.width = np.array([len(x) for x in sketches])
        self.levels = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width >= w)
            place = np.zeros(len(sketches), dtype=np.int64)
            place[at] = np.arange(len(at))
            self.levels[w] = place, folded([sketches[k] for k in at], w)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        width, out = np.minimum(self.width[x], self.width[y]), np.empty(len(x), dtype=np.int64)
        for w, (place, rows) in self.levels.items():
            at, step = np.flatnonzero(width == w), max(1, COMPARED_BYTES // w)
            for k in range(0, len(at), step):
                some = at[k : k + step]
                out[some] = differ(rows[place[x[some]]], rows[place[y[some]]])
        return out


def near_by_sketch(bits: Sketches, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of members those that sizes and sketches leave possible, and how far apart they are."""
    near = 100 * np.minimum(sizes[x], sizes[y]) >= PERCENT * np.maximum(sizes[x], sizes[y])
    x, y = x[near], y[near]
    total, apart = sizes[x] + sizes[y], bits.apart(x, y)
    near = np.flatnonzero(100 * (total - apart) >= PERCENT * (total + apart))
    return x[near], y[near], apart[near] / total[near]


def block_of(table: pa.Table, i: int, j: int) -> tuple:
    block, names, labels, sizes = (table.column(c).to_numpy().astype(np.int64) for c in ("block", "sig", "label", "n"))
    return names, labels, sizes, Sketches(table.column("sketch").to_pylist()), np.flatnonzero(block == i), np.flatnonzero(block == j)


def block_pairs(loose: int, many: int):
    """Pairs between components, from two blocks of a list, that sketches don't rule out; where these are many, the nodes that they are of, alone."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        where, i, j = (k.as_py() for k in key)
        names, labels, sizes, bits, left, right = block_of(table, i, j)
        a, b, gaps, n, met = [], [], [], 0, np.zeros(len(names), dtype=bool)
        most = max(loose * len(names), many)
        step = max(1, (1 << 16) // max(1, len(right)))
        for k in range(0, len(left), step):
            some = left[k : k + step]
            x, y = np.repeat(some, len(right)), np.tile(right, len(some))
            open_ = (labels[x] != labels[y]) & ((names[y] > names[x]) | (i != j))
            x, y, apart = near_by_sketch(bits, sizes, x[open_], y[open_])
            n += len(x)
            met[x] = met[y] = True
            if n <= most:
                a.append(names[x])
                b.append(names[y])
                gaps.append(apart)
        if n > most:
            alone = names[met]
            a, b, gaps = pa.array(alone), pa.nulls(len(alone), pa.int64()), pa.nulls(len(alone), pa.float64())
        else:
            a, b, gaps = (np.concatenate(v) if v else np.zeros(0) for v in (a, b, gaps))
            a, b, gaps = pa.array(np.minimum(a, b), type=pa.int64()), pa.array(np.maximum(a, b), type=pa.int64()), pa.array(gaps, type=pa.float64())
        same = {"bucket": (where["bucket"], pa.int32()), "key": (where["key"], pa.int64()), "i": (i, pa.int32()), "j": (j, pa.int32())}
        return pa.table({c: pa.array([v] * len(a), type=t) for c, (v, t) in same.items()} | {"a": a, "b": b, "apart": gaps})

    return run


def block_links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links that join components of two blocks of a list, verified on the full sets; none inside a component that others have joined."""
    _, i, j = (k.as_py() for k in key)
    names, labels, sizes, bits, left, right = block_of(table, i, j)
    sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("members")]
    found = []
    for x in left:
        other = right[labels[right] != labels[x]]
        _, other, apart = near_by_sketch(bits, sizes, np.full(len(other), x), other)
        for y in other[np.argsort(apart, kind="stable")]:
            if labels[x] == labels[y]:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= PERCENT * (len(sets[x]) + len(sets[y]) - both):
                found.append((names[x], names[y]))
                labels[labels == labels[y]] = labels[x]
    return pa.table({"a": pa.array([p[0] for p in found], type=pa.int64()), "b": pa.array([p[1] for p in found], type=pa.int64())})


def open_lists(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, sig, label, blocks``: members of the long lists that lie in more than one component. Lists of the same members open the same pairs: one of them stays."""
    members = members.join(labels, members.sig == labels.node, "left").select("key", "sig", F.coalesce("label", "sig").alias("label"))
    lists = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum(F.xxhash64("sig").cast("decimal(38,0)")).alias("who")).where("low <> high")
    lists = lists.groupBy("size", "who").agg(F.min("key").alias("key")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    return members.join(lists.select("key", "blocks"), "key")


def place(blocks: Column) -> Column:
    """A member's block; with a multiple of ``blocks``, a part of it."""
    return F.pmod(F.xxhash64(F.lit(7), "sig"), blocks).cast("int")


def in_pairs_of_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Each member once for each pair ``i <= j`` of blocks that its own is of."""
    spread = rows.withColumn("block", place(blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return spread.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})


def rest_pairs(members: DataFrame, labels: DataFrame, sketches: DataFrame, room: int) -> tuple[DataFrame, DataFrame]:
    """What leaders have left open in long lists, between components, in bounded blocks: ``a, b, apart``, and ``key, i, j, sig`` of the nodes in pairs of blocks that have more such pairs than are worth writing.

    A round sends about ``room`` bytes to the blocks.
    """
    left = keep(open_lists(members, labels), "open")
    rows = left.join(sketches, "sig")
    n = rounds(rows.agg(F.sum(F.col("blocks") * (F.octet_length("sketch") + F.lit(48)))).first()[0], room)
    spread = in_pairs_of_blocks(rows, F.col("blocks")).select("key", "i", "j", "block", "sig", "label", "n", "sketch")
    found = union([keep(spread.where(of_round(k, n, "key", "i", "j")).groupBy("key", "i", "j").applyInArrow(block_pairs(LOOSE, MANY_PAIRS), "bucket int, key long, i int, j int, a long, b long, apart double"), "blocks") for k in range(n)])
    return found.where("b is not null").select("a", "b", "apart").dropDuplicates(["a", "b"]), found.where("b is null").select(F.struct("bucket", "key").alias("key"), "i", "j", F.col("a").alias("sig"))


def dense_links(members: DataFrame, labels: DataFrame, sketches: DataFrame, dense: DataFrame, sets: DataFrame, room: int) -> DataFrame:
    """``a, b``: links between components in the pairs of blocks that are full of similar sets.

    The sets are sent to the blocks and verified there, so no pair is written
    that does not link, and of those that do no more than join the components.
    Blocks are cut further where their sets are large. A round sends about
    ``room`` bytes.
    """
    rows = open_lists(members, labels).join(dense.select("key", "sig").distinct(), ["key", "sig"], "left_semi").join(sketches, "sig")
    heavy = rows.groupBy("key", place(F.col("blocks")).alias("_block")).agg(F.sum(F.col("n") * F.lit(8)).alias("_bytes"))
    parts = heavy.groupBy("key").agg(F.ceil(F.max("_bytes") / BLOCK_BYTES).cast("int").alias("_parts"))
    rows = keep(rows.join(parts, "key"), "dense")
    spread = in_pairs_of_blocks(rows, F.col("blocks") * F.col("_parts"))
    # the blocks that the parts are of
    whole = spread.withColumns({"_i": F.least(F.col("i") % F.col("blocks"), F.col("j") % F.col("blocks")), "_j": F.greatest(F.col("i") % F.col("blocks"), F.col("j") % F.col("blocks"))})
    asked = dense.select("key", F.col("i").alias("_i"), F.col("j").alias("_j"), "sig")
    n = rounds(rows.agg(F.sum(F.col("blocks") * F.col("_parts") * (F.col("n").cast("long") * 8 + F.octet_length("sketch")))).first()[0], room)
    sent = [whole.where(of_round(k, n, "key", "i", "j")).join(asked, ["key", "_i", "_j", "sig"], "left_semi").join(sets, "sig") for k in range(n)]
    return union([keep(x.select("key", "i", "j", "block", "sig", "label", "n", "sketch", "members").groupBy("key", "i", "j").applyInArrow(block_links, "a long, b long"), "links") for x in sent])


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    ``component_id`` is the smallest id reachable by links, the row's own
    included. A text without words (or null) has an empty set and links with
    nothing. A row with a null id is reported with a null component and links
    with nothing. Repeated ids are separate rows. Other columns are not read;
    an empty table gives no rows.
    """
    with rows_a_batch(docs.sparkSession), freed_shuffles(docs.sparkSession):
        return _link(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))


def _link(docs: DataFrame) -> DataFrame:
    rows = keep(find_nodes(docs), "nodes")
    naming = Names(shared_halves(rows))
    rows = renamed(rows, naming.shared)
    nodes = rows.where("doc_id is not null and n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = keep(nodes, "nodes")
    total = rows.agg(F.sum(F.floor(F.col("n") / 5) + 1)).first()[0] or 0
    sizes = {r.n: r["count"] for r in nodes.where(f"n <= {LARGEST_LIGHT}").groupBy("n").count().collect()}
    buckets = max(1, min(1 << BUCKET_BITS, -(-total // POSTINGS_PER_BUCKET)))
    room = max(ROUND_BYTES, (nodes.agg(F.sum(F.col("n").cast("long") * 8)).first()[0] or 0) // ROUND_SHARE)
    known = docs.where("doc_id is not null")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(known, buckets, rows.where("doc_id is not null"), naming))
    light = light_boundary(sizes, pairs_a_posting(rows.where("doc_id is not null")))
    lists = known.mapInArrow(emit_postings(frequent, buckets, light, naming), "bucket int, keys binary, sigs binary, sizes binary")
    lists = keep(lists.groupBy("bucket").applyInArrow(scan_lists, LISTS), "lists")

    sketches = nodes.select("sig", "n", "sketch")
    members = lists.where("key is not null").select(F.struct("bucket", "key").alias("key"), F.col("a").alias("sig"), F.col("na").alias("n"))
    members = keep(members.join(members.groupBy("sig").agg(F.count(F.lit(1)).alias("lists")), "sig"), "members")
    # What sketches leave possible is settled first, so that one more pass over the texts finds the sets.
    pairs = keep(plausible(ordered_pairs(lists.where("key is null"), "a", "b").unionByName(leader_pairs(members, None, 0)).distinct(), sketches), "pairs")
    likely = components(pairs)
    for turn in range(1, LEADER_ROUNDS):
        more = keep(plausible(leader_pairs(members, likely, turn), sketches), "pairs")
        if more.isEmpty():
            break
        pairs = pairs.unionByName(more).dropDuplicates(["a", "b"])
        likely = components(more, likely)
    rest, dense = rest_pairs(members, likely, sketches, room)
    pairs = keep(pairs.unionByName(rest).dropDuplicates(["a", "b"]), "pairs")
    named = pairs.select(F.col("a").alias("sig")).union(pairs.select("b"))
    if not dense.isEmpty():
        named = named.union(dense.select("sig"))
    sets = keep(sets_of(known, named.distinct(), naming).withColumn("bytes", F.octet_length("members").cast("long")), "members")
    labels = verified_labels(pairs, sets, room)
    # Members of one list that only seemed to be in one component, and blocks full of similar sets; their sets are known.
    rest, dense = rest_pairs(members, labels, sketches, room)
    missed = keep(rest.join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not missed.isEmpty():
        labels = verified_labels(missed, sets, room, labels)
    if not dense.isEmpty():
        labels = components(dense_links(members, labels, sketches, dense, sets, room), labels)

    belongs = nodes.join(labels, nodes.sig == labels.node, "left").select("sig", "rep", F.coalesce("label", "sig").alias("label"))
    least = belongs.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = belongs.join(least, "label").select("sig", "component_id")
    inked = rows.where("doc_id is not null and n > 0").select("doc_id", "n", "sig").join(found, "sig").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    bare = rows.where("doc_id is null or n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return inked.unionByName(bare)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows with null ids stay; of rows that repeat a kept id all stay.
    """
    found = link(docs, id_col, text_col)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
