import collections
import re

import pytest

from pairloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


TEXTS = [
    None,
    "",
    "one two",
    "a " * 30,
    "\n".join(["the same line here"] * 9),
    " ".join(f"word{i}" for i in range(50)),
    "Élan naïve 中文 ### \t tab\x0bvt\x0cff\rcr " * 3,
    "x" * 300_000 + " " + " ".join(f"w{i}" for i in range(40)),
    " ".join(f"WORD{chr(65 + i % 26)}{i}"[:6] for i in range(40)).replace("0", "O"),
    " ".join(f"ok{i}***" for i in range(50)),
    "\x85\xa0 no\xa0break " + " ".join(f"v{i}" for i in range(30)),
]


def test_measures_equal_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = {r.doc_id: r for r in Q.measure(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert tuple(got[i])[1:7] == brute(t), (i, t and t[:50])
    assert not got[9].kept and not got[9].base_failed  # symbols
    assert got[5].kept and got[10].kept


def test_sf_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:7] for r in Q.measure(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


@pytest.mark.parametrize("order", [list(Q.RULES), list(Q.RULES)[::-1]])
def test_order_never_changes_the_verdict(spark, sf_dir, order):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = sorted(r.doc_id for r in Q.keep_good(docs, order=order).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in Q.measure(docs).where("kept").collect())


def test_orders_by_rejections_per_cost():
    assert Q.order_rules([("dear", 9, 4, 4.0), ("cheap", 9, 2, 1.0), ("idle", 9, 0, 0.1)]) == ["cheap", "dear", "idle"]


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert Q.measure(docs).collect() == [] and Q.keep_good(docs).collect() == []
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c")], "doc_id long, text string")
    assert [r.n_words for r in Q.measure(docs).orderBy("n_words").collect()] == [1, 2, 2]


def kept_by_hand(text):
    """Every rule again, from the text itself."""
    n, chars, symbols, copies, _, failed = brute(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    letters = [c for c in text or "" if c.isascii() and c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    return not (failed or 10 * symbols > n or chars < 2 * n or chars > 15 * n or 10 * upper > 6 * len(letters) or 2 * copies > len(lines))


def test_kept_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.kept for r in Q.measure(docs).collect()}
    assert got == {r.doc_id: kept_by_hand(r.text) for r in docs.collect()} and len(set(got.values())) == 2
    base = [f"word{i} thing{i}" for i in range(15)]
    texts = [" ".join(base), " ".join(base).upper(), " ".join(base) + " #" * 3, " ".join(base) + " #" * 4, "\n".join(base + base[:14] * 2), " ".join("ab"[i % 2] for i in range(30)), " ".join("x" * 16 + str(i) for i in range(30)), " ".join(base[:10]), None]
    rows = {r.doc_id: r.kept for r in Q.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows == {i: kept_by_hand(t) for i, t in enumerate(texts)} and rows[0] and not any(rows[i] for i in (1, 3, 4, 5, 6))
