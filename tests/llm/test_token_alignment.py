import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pairloom.llm import registry
from pairloom.llm import token_alignment as A

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Whole texts, cut where both tokenizers' tokens end; no graph, no chunks."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def tokens(self, text):
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in self.b.encode(text)]
        return a, b

    def figures(self, text):
        if not text:
            return None
        a, b = self.tokens(text)
        raw = (" " + text).encode()
        if b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
            return None
        spans = []
        for side in (a, b):
            at, mine = 0, []
            for i, t in side:
                mine.append((i, at, at + len(t)))
                at += len(t)
            spans.append(mine)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, links, start, x, y = [], [], 0, 0, 0
        for end in ends:
            left, right = [], []
            while x < len(a) and spans[0][x][2] <= end:
                left.append(spans[0][x])
                x += 1
            while y < len(b) and spans[1][y][2] <= end:
                right.append(spans[1][y])
                y += 1
            groups.append(",".join(str(t[0]) for t in left) + "|" + ",".join(str(t[0]) for t in right))
            links += [(p[0], q[0]) for p in left for q in right if max(p[1], q[1]) < min(p[2], q[2])]
        return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def brute_force(texts):
    plain = Plain()
    found = [plain.figures(t) for t in texts]
    counts = Counter(pair for f in found if f for pair in f[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(f[0], f[1], f[2], len(f[3]), sum(counts[p] == best[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), f[4]) if f else (0, 0, 0, 0, 0, 0, "") for f in found]


def got(docs, **how):
    rows = A.align_documents(docs, *PATHS, **how).collect()
    return [((r.doc_id is not None, r.doc_id or 0), (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in rows]


def odd_texts():
    rng = random.Random(6)
    marks = ["a", "Bc", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "中文", "12", "!?", "\xa0", "　", "\x1f", "<|endoftext|>", "<s>", "<0x41>", ".\n", "x\ny", "▁", "\x00", "ﬁ", "😀", "\r\n", "zwölf", "Å"]
    return ["".join(rng.choice(marks) for _ in range(rng.randint(1, 25))) for _ in range(600)]


def test_chunks_align_as_whole_texts_do(spark):
    texts = [None, "", " ", "  ", "\n", " a", "a ", "a" * 3000, "word " * 3000, "▁", *odd_texts(), *odd_texts()[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(got(docs)) == [((True, i), f) for i, f in enumerate(brute_force(texts))]


def test_supplied_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    expected = sorted(((True, r.doc_id), f) for r, f in zip(rows, brute_force([r.text for r in rows]), strict=True))
    found = registry.op13_token_alignment(spark, sf_dir)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(got(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == expected
    assert sorted(((True, r.doc_id), tuple(r[1:])) for r in found.collect()) == expected


def test_rare_pairs_are_joined(spark):
    texts = odd_texts()[:150]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = [((True, i), f) for i, f in enumerate(brute_force(texts))]
    for heavy in (1, 40):
        assert sorted(got(docs, heavy_pairs=heavy)) == expected


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, "a b", 5), (None, None, 5)], "doc_id long, text string, n int").selectExpr("*", "1 as row", "2 as pairs", "3 as links")
    a_b, nothing = brute_force(["a b"] * 3 + [None])[2:]
    assert sorted(got(docs)) == [((False, 0), nothing), ((False, 0), a_b), ((True, 1), a_b), ((True, 1), a_b)]
    assert got(docs.limit(0)) == []


def test_components_are_the_cuts_at_common_ends():
    rng = random.Random(7)
    for _ in range(300):
        size = rng.randint(1, 40)

        def cut():
            ends = sorted({size, *(rng.randint(1, size) for _ in range(rng.randint(0, 12)))})
            return [e - s for s, e in zip([0, *ends], ends, strict=False)]

        a, b = np.cumsum(cut()), np.cumsum(cut())
        x, y = A.overlaps(a, b)
        groups = A.components(len(a) + len(b), x, len(a) + y)
        assert len(set(groups)) == len(set(a) & set(b))
        for side, ends in ((groups[: len(a)], a), (groups[len(a) :], b)):
            cuts = [e for e, now, then in zip(ends, side, side[1:], strict=False) if now != then]
            assert cuts == sorted(set(map(int, a)) & set(map(int, b)))[:-1]


def test_union_find_on_any_graph():
    rng = random.Random(8)
    for n in (1, 5, 60):
        for m in (0, 3, 40):
            x, y = ([rng.randrange(n) for _ in range(m)] for _ in range(2))
            label = list(range(n))
            for _ in range(n):
                for i, j in zip(x, y, strict=True):
                    label[i] = label[j] = min(label[i], label[j])
            assert A.components(n, np.array(x, dtype=int), np.array(y, dtype=int)).tolist() == label
    chain = np.arange(5000)
    assert set(A.components(5001, chain[::-1], chain[::-1] + 1)) == {0}


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(A, "CACHE_CHUNKS", 50)
    aligner = A.Aligner(*PATHS)
    first = aligner.rows(["some words " * 3, " ".join(map(str, range(500)))])
    assert len(aligner) == 50
    assert aligner.rows(["some words " * 3, " ".join(map(str, range(500)))])[1][:5] == first[1][:5]
