import random
import re

import numpy as np
import pytest

from pairloom.llm import jaccard as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> (set size, smallest id of its component), by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = {}
    for d, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(d)
    pairs = {(a, b) for v in having.values() for a in v for b in v if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def agrees(spark, rows):
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link(docs).collect()}
    assert got == brute(rows)


def test_sf_equals_brute_force(spark, sf_dir):
    agrees(spark, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()])


def test_light_sets(spark):
    rng = random.Random(5)
    rows, words = [], [f"w{i}" for i in range(400)]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 24))]
        for _ in range(4):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text.insert(rng.choice([0, len(text)]), rng.choice(words))
            rows.append((len(rows), " ".join(text[rng.randint(0, 1) :])))
    agrees(spark, rows)


@pytest.mark.parametrize("small", [False, True, "dense"])
def test_large_group_of_near_copies(spark, monkeypatch, small):
    """A chain of copies, far ones apart, and a passage that strangers share; also with blocks of a few nodes."""
    if small:
        monkeypatch.setattr(J, "BLOCK", 7)
        monkeypatch.setattr(J, "LEADER_ROUNDS", 1)
        monkeypatch.setattr(J, "FREQUENT", 3)
    if small == "dense":
        monkeypatch.setattr(J, "LOOSE", 0)
        monkeypatch.setattr(J, "MANY_PAIRS", 0)
        monkeypatch.setattr(J, "BLOCK_BYTES", 2000)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        if i % 3 == 0:
            base[rng.randrange(120)] = f"c{i}"
        text = list(base)
        text[rng.randrange(120)] = f"x{i}"
        rows.append((100 + i, " ".join(text)))
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(300 + i, passage + " " + " ".join(f"q{i}.{k}" for k in range(i % 40))) for i in range(50)]
    rows += [(500 + i, rows[5][1].upper()) for i in range(20)]
    agrees(spark, rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d e"), (8, "A B C D E"), (9, "É b c d e"), (10, "é b c d e"), (11, "x " * 5000)]
    agrees(spark, rows)
    assert J.link(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "a b c"), (3, "a b c"), (2, "z")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in J.link(docs).collect())
    assert got == [(0, 1, 0), (0, 1, 0), (2, 1, 2), (3, 1, 3), (3, 1, 3)]


def test_light_half_finds_links(spark, monkeypatch):
    """Many short texts with most shingles in common make lists dear, so that sets of more than five are light and link by subsets."""
    rng = random.Random(8)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(12)]
        for i in range(60):
            text = base[: rng.randint(9, 12)]
            text[-1 if i % 2 else 0] = f"u{g}.{i % 20}"
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert J.pairs_a_posting(J.find_nodes(docs)) > 5
    chosen = []
    boundary = J.light_boundary
    monkeypatch.setattr(J, "light_boundary", lambda *a: chosen.append(boundary(*a)) or chosen[-1])
    agrees(spark, rows)
    assert chosen[0] > 5


def test_nodes_that_share_half_a_name(spark, monkeypatch):
    rows = [(1, 10, 1), (2, 10, 2), (3, 11, 1), (4, 10, 1)]
    df = spark.createDataFrame([(*r, 6) for r in rows], "doc_id long, sig long, check long, n int")
    shared = J.shared_halves(df)
    assert shared == {10} and {r.doc_id: r.sig for r in J.renamed(df, shared).collect()} == {1: 1, 2: 2, 3: 11, 4: 1}
    x = np.arange(9, dtype=np.uint64)
    a, b = J.signature(x)
    assert a != b and J.Names()(x) == a and J.Names(frozenset({a}))(x) == b


def test_boundary_by_cost():
    assert J.light_boundary({n: 9 for n in range(20)}, 1.0) < J.light_boundary({n: 9 for n in range(20)}, 50.0)
    assert J.wanted(4, 16) == [4] and J.wanted(9, 16) == [8, 9]


def test_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "q", None), (None, "q", None)], "doc_id long, text string, lang string")
    assert sorted((r.doc_id or 0, r.lang or "") for r in J.drop_near_copies(docs).collect()) == [(0, ""), (1, "x"), (3, "")]


def templates(n, own, shared=52):
    """Documents of one template: 48 shingles that all have and some of their own."""
    return [(i, " ".join([f"s{k}" for k in range(shared)] + [f"o{i}.{k}" for k in range(own)])) for i in range(n)]


def test_documents_of_one_template_write_few_pairs(spark, monkeypatch):
    written, real = [], J.rest_pairs
    monkeypatch.setattr(J, "MANY_PAIRS", 1000)
    monkeypatch.setattr(J, "rest_pairs", lambda *a: written.append(real(*a)) or written[-1])
    for n in (400, 800):
        written.clear()
        rows = templates(n, 7)  # 48 of 62 shingles in common: no links
        rows += [(5000 + k, f"{rows[k][1]} o{k}.7") for k in range(30)]  # a shingle more: a link each
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in J.link(docs).collect()}
        assert all(got[i] == i for i in range(n)) and all(got[5000 + k] == k for k in range(30))
        assert sum(pairs.count() for pairs, _ in written) <= J.LOOSE * n
        assert any(not dense.isEmpty() for _, dense in written)


def test_sketches_tell_large_strangers_apart(spark):
    """Sets larger than the least sketch has bits: strangers are no candidates, linked sets stay so across widths."""
    rng = np.random.default_rng(4)
    draw = lambda n: np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    sets = [draw(6000) for _ in range(6)]
    sets += [np.unique(np.concatenate([sets[0][:5600], draw(300)])), draw(1020)]
    sets.append(np.unique(np.concatenate([sets[7], draw(100)])))  # twice as wide a sketch
    rows = spark.createDataFrame([(k, len(x), J.sketch(x)) for k, x in enumerate(sets)], "sig long, n int, sketch binary")
    pairs = spark.createDataFrame([(a, b) for b in range(9) for a in range(b)], "a long, b long")
    assert sorted((r.a, r.b) for r in J.plausible(pairs, rows).collect()) == [(0, 6), (7, 8)]
    bits, sizes = J.Sketches([J.sketch(x) for x in sets]), np.array([len(x) for x in sets])
    a, b = np.triu_indices(9, 1)
    x, y, apart = J.near_by_sketch(bits, sizes, a, b)
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == [(0, 6), (7, 8)]
    true = [len(np.setxor1d(sets[i], sets[j])) / (len(sets[i]) + len(sets[j])) for i, j in zip(x, y, strict=True)]
    assert all(0 < g <= t for g, t in zip(apart, true, strict=True))


@pytest.mark.parametrize("dense", [False, True])
def test_rounds_give_the_same(spark, monkeypatch, dense):
    """What goes to blocks and pairs in many rounds links as brute force does."""
    monkeypatch.setattr(J, "BLOCK", 15)
    monkeypatch.setattr(J, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(J, "ROUND_BYTES", 12_000)
    monkeypatch.setattr(J, "ROUND_SHARE", 1 << 40)
    if dense:
        monkeypatch.setattr(J, "LOOSE", 0)
        monkeypatch.setattr(J, "MANY_PAIRS", 0)
    asked, real = [], J.rounds
    monkeypatch.setattr(J, "rounds", lambda *a: asked.append(real(*a)) or asked[-1])
    rows = templates(40, 7)
    rows += [(5000 + k, f"{rows[k][1]} o{k}.7") for k in range(10)]
    agrees(spark, rows)
    assert max(asked) > 1


def test_shuffle_files_are_freed(spark):
    """No shuffle file of the queries behind a result is left when it is returned."""
    from glob import glob

    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    files = lambda: {x for d in folders for x in glob(f"{d}/*/shuffle_*.data")}
    docs = spark.createDataFrame(templates(60, 7), "doc_id long, text string")
    before = files()
    found = J.link(docs)
    assert not files() - before
    assert found.count() == 60
