import datetime as dt

from pyspark.sql import functions as F

from pairloom.llm import chat_format as C
from pairloom.llm import line_dedup as L
from pairloom.llm import url_filter as U


def test_boilerplate_lines(spark):
    rows = [(i, "menu\nbody %d\n\n menu \nend" % i, "s") for i in range(10)] + [(20 + i, "menu\nother %d" % i, None) for i in range(3)]
    rows += [(30, None, "s"), (31, "", "s"), (None, "end\nx" * 3000, "t")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_lines int")
    got = {r.doc_id: r for r in L.drop_boilerplate(docs, ratio=0.5).collect()}
    assert len(got) == len(rows)
    assert got[4].text == "body 4\n" and (got[4].n_lines, got[4].n_dropped) == (5, 3)
    assert got[20].text == "menu\nother 0" and got[30].text is None and got[31].text == "" and got[None].n_dropped == 0
    assert L.drop_boilerplate(docs.limit(0)).collect() == []
    # a line is counted once a page, and the ratio must be exceeded
    docs = spark.createDataFrame([(i, "a\na" if i < 5 else "b%d" % i, "s") for i in range(10)], "doc_id long, text string, source string")
    assert all(r.n_dropped == 0 for r in L.drop_boilerplate(docs, ratio=0.5).collect())


def test_sites_by_host_and_clashing_names(spark):
    names = ["_site", "_lines", "_after", "_BEFORE", "a.b"]
    rows = [(i, f"http://h{i % 2}.com/{i}", "top\nx%d" % i, *[f"{c}{i}" for c in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "url", "text", *names])
    out = L.drop_boilerplate(docs, "text", U.host(F.col("url")), ratio=0.5)
    assert out.columns == ["doc_id", "url", *names, "text", "n_lines", "n_dropped"]
    for r in out.collect():
        assert r.text == f"x{r.doc_id}" and [r[c] for c in names] == [f"{c}{r.doc_id}" for c in names]


def test_hot_key_is_dealt_over_blocks_and_open_intervals_never_end(spark):
    far = dt.date(9999, 1, 1)
    entries = spark.createDataFrame([("l", "com", dt.date(2024, 1, 1), "add"), ("m", "b.com", dt.date(2024, 1, 1), "add")], "list string, key string, day date, action string")
    captures = spark.createDataFrame([(i, "http://%s.com/%s" % ("b" if i % 3 else "c", "p/" * (i % 50 * 40)), far) for i in range(200)], "page_id long, url string, fetched date")
    whole = sorted(map(tuple, U.filter_urls(captures, entries).collect()))
    assert sorted(map(tuple, U.filter_urls(captures, entries, block_rows=7).collect())) == whole
    assert all(r[4] == (2 if r[0] % 3 else 1) for r in whole)


def listed(log, url, day):
    """Replay of the log up to a day."""
    state = {}
    for name, key, when, action in sorted(log, key=lambda e: (e[2], e[3] != "add")):
        if when <= day:
            state[name, key] = action == "add"
    return state


def test_lists_as_of_the_fetch(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    log = [("l", "a.com", day(10), "add"), ("l", "a.com", day(20), "remove"), ("l", "a.com", day(20), "add"), ("l", "a.com", day(30), "add"), ("l", "b.com/x", day(0), "add"), ("m", "com", day(25), "add"), ("l", "z.com", day(5), "remove"), ("l", None, day(5), "add")]
    entries = spark.createDataFrame(log, "list string, key string, day date, action string")
    urls = ["http://a.com", "https://W.A.COM.:8/p?q#f", "http://u@b.com/x/y", "http://b.com/xy", "http://z.com/", "mailto:x", "", None, "http://nota.com"]
    rows = [(len(urls) * k + i, u, d) for i, u in enumerate(urls) for k, d in enumerate([day(5), day(10), day(19), day(20), day(29), day(31), None])]
    captures = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, fetched date, allowed int")
    got = {r.id: (r.allowed, r.n_matches, r.lists) for r in U.filter_urls(captures, entries).collect()}
    covers = {0: ["a.com", "com"], 1: ["a.com", "com"], 2: ["b.com/x", "com"], 3: ["com"], 4: ["z.com", "com"], 8: ["com"]}
    for n, u, d in rows:
        state = listed([e for e in log if e[1]], u, d) if d else {}
        hits = [name for (name, key), on in state.items() if on and key in covers.get(urls.index(u), [])]
        assert got[n] == (not hits, len(hits), ",".join(sorted(set(hits)))), (u, d)
    twice = U.filter_urls(captures.union(captures), entries)
    assert twice.count() == 2 * len(rows) and U.filter_urls(captures.limit(0), entries).collect() == []


def test_snapshots_collapse(spark):
    def chat(cid, *texts):
        return [(cid, i, "user" if i % 2 == 0 else "bot", t, 0) for i, t in enumerate(texts)]

    rows = chat(1, "a") + chat(2, "a", "b") + chat(3, "a", "b", "c") + chat(4, "a", "x") + chat(5, "a", "b", "c") + chat(6, None, "") + chat(7, "b") + chat(8, *map(str, range(700))) + chat(9, *map(str, range(699)))
    rows += chat(2, "a", "b")  # repeated rows
    df = spark.createDataFrame(rows + [(None, 0, None, "n", 0)], "conv_id long, turn long, role string, text string, part int")
    out = C.render(df).collect()
    by = {}
    for r in sorted(out, key=lambda r: r.part):
        by[r.conv_id] = by.get(r.conv_id, "") + r.text
    assert set(by) == {3, 4, 6, 7, 8, None}
    assert by[4] == "<|user|>\na\n<|bot|>\nx\n" and by[6] == "<|user|>\n\n<|bot|>\n\n" and by[None] == "<||>\nn\n"
    assert by[8] == "".join(f"<|{'user' if i % 2 == 0 else 'bot'}|>\n{i}\n" for i in range(700))
    assert max(r.part for r in out) == 2 and {r.n_turns for r in out if r.conv_id == 8} == {700}
    assert C.render(df.limit(0)).collect() == []


def test_turns_without_numbers_and_long_texts(spark):
    """Null turns go by role, hash and text, in chunks; a snapshot of them collapses like any other."""
    rows = [(1, None, "r%d" % (i % 3), f"t{i}") for i in range(900)] + [(2, 1, "user", "x" * 300_000), (3, 1, "user", "x" * 300_000), (3, 2, "bot", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    placed = C.turns(df).where("conv_id = 1").orderBy("place").collect()
    assert [r.place for r in placed] == list(range(1, 901)) and [r.role for r in placed] == sorted(r.role for r in placed)
    assert len({r.text for r in placed}) == 900
    out = {(r.conv_id, r.part): r for r in C.render(df).collect()}
    assert {k[0] for k in out} == {1, 3} and len(out[3, 0].text) > 300_000


def test_sums_beyond_a_long_and_ids_that_are_used_again(spark, monkeypatch):
    rows = [(None, i % 6, ("user", "bot")[i % 2], f"t{i}") for i in range(4000)] + [(1, i, "user", f"t{i}") for i in range(60)] + [(2, i, "user", f"t{i}") for i in range(59)] + [(3, None, "user", f"n{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    # two rows of 61 bits fit a long, the sum over the 30 chunks of conversation 1 does not
    monkeypatch.setattr(C, "CHUNK", 2)
    monkeypatch.setattr(C, "LANE_BITS", 61)
    one = df.where("conv_id in (1, 2)")
    assert {r.conv_id for r in C.render(one).collect()} == {1}
    rolled = C.turns(one).where("conv_id = 1").orderBy("place").collect()
    assert len({r.h1 for r in rolled}) == 60 and all(0 <= r.h1 < 1 << 61 for r in rolled)
    monkeypatch.undo()
    # the null id's rows are dealt over many chunks
    seen = []
    real = C.running
    monkeypatch.setattr(C, "running", lambda d, key, chunk, *a: seen.append(d) or real(d, key, chunk, *a))
    placed = C.turns(df, crowded=100).where("conv_id is null").orderBy("place").collect()
    sizes = [r["count"] for r in seen[0].where("conv_id is null").groupBy("_chunk").count().collect()]
    assert len(sizes) > 1000 and max(sizes) < 40
    assert [r.place for r in placed] == list(range(1, 4001))
    assert [(r.role, int(r.text[1:]) % 6) for r in placed] == sorted(((r.role, int(r.text[1:]) % 6) for r in placed), key=lambda x: x[1])
    known = lambda rows: sorted((str(r.conv_id), r.part, r.n_turns, r.text) for r in rows)
    assert known(C.render(df).collect()) == known(real_render(df, monkeypatch))


def real_render(df, monkeypatch):
    """Rendered with other chunks."""
    turns = C.turns
    monkeypatch.setattr(C, "turns", lambda chats: turns(chats, crowded=10))
    return C.render(df).collect()
