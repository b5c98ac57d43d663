import math
import random
import time

import pandas as pd
import pytest

from pairloom.llm import html_text as H


def shown(blocks, low=()):
    left = [b for b in blocks if not b[3]]
    best = max((b[2] for b in left), default=0)
    return "\n\n".join(b[1] for b in left if b[2] == best and b[0] not in low)


def text(page):
    return shown(H.parse(page)[0])


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b", "a\n\nb"),
        ("<p><b>open bold<br><p>next\n\t line</b></p>", "open bold\n\nnext line"),
        ("<article><h1>T</h1><p>x&nbsp;&#233; &lt;p&gt;</p></article><p>outside</p>", "T\n\nx é <p>"),
        ("<nav><ul><li>menu</ul></nav><main><p>m</p><aside>s</aside></main><footer>f</footer>", "m"),
        ('<body><div class="cookie-notice">ok?</div><p>t<span class="ad">buy</span>u</p><form>f<p>g</p></form>tail</body>', "tu\n\ntail"),
        ('<article><p>a</p><div id="comments"><p>c</p></div><div class="loads">ok</div></article>', "a\n\nok"),
        ('<p title="a > b">q</p><!-- <p>no</p> --><script>var t="</p><p>no</p>";</script><style>p{}</style><p>r', "q\n\nr"),
        ("<header>h</header><article><header><h1>T</h1></header><p>a</p></article>", "T\n\na"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>", "a\n\nb\n\n1\n\n2"),
        ("<p hidden>no</p><p style='display:none'>no</p><p>yes<!-- open", "yes"),
        ("</div></p>x<", "x<"),
        ("<p>a < b <3 <p", "a < b <3 <p"),
        ("<a <a <a <p>x", "x"),
        ('<p title=">" class=\'a"b\'>q</p><p data-x="1>2" hidden>no</p>', "q"),
        ('<p title="open>r</p><p>s', "r\n\ns"),
        ("<p>" + "word " * 50_000 + "</p>", ("word " * 50_000).strip()),
    ],
)
def test_parse(page, expected):
    assert text(page) == expected


def site(i, words):
    return f'<body><div class="x7"><p>Welcome to our site</p><p>Read on</p></div><div class="c"><p>{words}</p><p>more of {i}</p></div></body>'


def test_style_tree_cuts_what_a_site_repeats(spark):
    pages = [(i, f"http://a.example/{i}", site(i, f"story number {i}")) for i in range(12)]
    pages += [(100 + i, f"https://b.example:80/{i}", site(0, "copies of one page")) for i in range(12)]
    pages += [(200, "http://c.example/", site(9, "alone")), (300, None, None), (None, "", "<p>z</p>"), (None, "", "<p>z</p>")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    rows = H.extract(df).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: r.text for r in rows}
    assert got[3] == "story number 3\n\nmore of 3"
    assert got[100].startswith("Welcome") and got[200].startswith("Welcome")  # too few distinct pages to tell
    assert got[300] == "" and got[None] == "z"
    assert all(r.n_chars == len(r.text) for r in rows)
    assert H.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("broken", ["<a ", "<a", '<a "', "<a '>\"", "<div>", "<b>", "</x>", "<!", "<!--", "<p", "&", "<div class=\"", "<b></i>", "<td>", "<div></p>"])
def test_broken_pages_take_time_in_proportion(broken):
    began = time.perf_counter()
    H.parse(broken * 40_000)
    assert time.perf_counter() - began < 6


def test_near_copies_keep_their_text():
    """On a host of copies no branch stands out, so none is cut; nor is one with children that are rare."""
    columns = ["path", "pages", "styles", "style_entropy", "blocks", "block_entropy", "marked", "rare"]
    rows = [("#/b", 9, 1, 0.0, 0, None, False, False), ("#/b/p", 9, 1, 0.0, 3, 0.95, False, False)]
    assert H.low_branches(pd.DataFrame(rows, columns=columns)) == []
    rows += [("#/b/q", 9, 1, 0.0, 3, 0.1, False, False)]
    assert H.low_branches(pd.DataFrame(rows, columns=columns)) == ["#/b/p"]
    rows[1] = (*rows[1][:7], True)
    assert H.low_branches(pd.DataFrame(rows, columns=columns)) == []


def brute_tree(pages):
    """The tree of one host's pages by plain counting: path -> (pages, styles, style entropy, blocks, block entropy, marked)."""
    seen, marked = {}, {}
    for page in set(pages):
        blocks, styles = H.parse(page)
        for kind, path, feature, mark in {(0, p, f, m) for p, f, m in styles} | {(1, p, f, m) for p, f, _, m in blocks}:
            seen.setdefault(path, ({}, {}))[kind].setdefault(feature, set()).add(page)
            marked[path] = marked.get(path, False) or mark
    out = {}
    for path, kinds in seen.items():
        on = [set().union(*k.values()) for k in kinds]
        base = [math.log(max(2, len(x))) for x in on]
        shares = [len(v) / len(on[0]) for v in kinds[0].values()]
        met = [len(v) for v in kinds[1].values()]
        out[path] = (
            max(map(len, on)),
            len(kinds[0]),
            -sum(x * math.log(x) for x in shares) / base[0] if kinds[0] else None,
            len(met),
            sum(n * math.log(n) for n in met) / sum(met) / base[1] if met else None,
            marked[path],
        )
    return out


def brute_low(tree):
    """Paths with text whose branch is low throughout, by recursion from the top."""
    def below(path):
        return [p for p in tree if p.rpartition("/")[0] == path]

    def score(path):
        _, styles, entropy, blocks, block_entropy, _ = tree[path]
        parts = ([1 - block_entropy] if blocks else []) + [x for c in below(path) if tree[c][0] >= H.MIN_PAGES and (x := score(c)) is not None]
        if not parts:
            return None
        mixed, weight = sum(parts) / len(parts), H.GAMMA ** max(1, styles)
        return mixed if styles <= 1 else max(mixed, (1 - weight) * (1 if entropy is None else entropy) + weight * mixed)

    judged = [p for p in tree if tree[p][0] >= H.MIN_PAGES]
    best = max((x for p in judged if not tree[p][5] and (x := score(p)) is not None), default=0)

    def low(path):
        x = score(path)
        return tree[path][0] >= H.MIN_PAGES and (x is None or x < H.LOW * min(1, best)) and all(map(low, below(path)))

    return {p for p in judged if low(p) and tree[p][3]}


def test_tree_and_cuts_equal_brute_force(spark):
    """Sites of random templates whose menus, notices and bodies repeat to different degrees."""
    rng = random.Random(6)
    pages = []
    for h in range(4):
        for i in range(rng.choice([4, 9, 15])):
            parts = [f"<div class='m{h}'>" + "".join(f"<p>item {k}</p>" for k in range(3)) + "</div>", f"<section><h2>head {rng.randrange(3)}</h2><p>{'w' * rng.randint(1, 9)} {i}</p></section>", "<div class='ad'>buy %d</div>" % i, "<div class='box'><p>note</p></div>"]
            rng.shuffle(parts)
            pages.append((len(pages), f"http://h{h}.example/{i}", "<body>" + "".join(parts[: rng.randint(2, 4)]) + "</body>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    parsed = H.parsed(df)
    got = {(r.host, r.path): tuple(r)[2:] for r in H.style_tree(parsed).collect()}
    low = {r.host: set(r.low) for r in H.branches_to_cut(parsed).collect()}
    texts = {r.page_id: r.text for r in H.extract(df).collect()}
    cut = 0
    for h in range(4):
        name = f"h{h}.example"
        mine = [p for p in pages if name in p[1]]
        tree = brute_tree([p[2] for p in mine])
        assert {p for host, p in got if host == name} == set(tree)
        for path, row in tree.items():
            assert got[name, path] == pytest.approx(row)
        assert low.get(name, set()) == brute_low(tree)
        cut += len(low.get(name, set()))
        for i, _, page in mine:
            assert texts[i] == shown(H.parse(page)[0], low.get(name, set()))
    assert cut


def test_sf_equals_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    hosts = {}
    for r in pages:
        hosts.setdefault(H.host(r.url), []).append(r.html or "")
    low = {h: brute_low(brute_tree(p)) for h, p in hosts.items()}
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(pages)).collect()}
    assert got == {r.page_id: shown(H.parse(r.html or "")[0], low[H.host(r.url)]) for r in pages}
