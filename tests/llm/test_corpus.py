"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tempora.llm import chat, components, exact_dedup, html, language, mixing, near_dedup, packing, substring_dedup, tokens, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def prose(rng, n, words=("tal", "ren", "mio", "sa", "kel", "dor", "vi", "pan", "lu", "go")):
    return " ".join("".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    texts = [None, "", " \t\n", "a", "A", "é", "Ünï cödé — ☃ 漢字", "x" * 3000, "ab " * 700, *base]
    for t in base[:20]:
        w = t.split()
        texts += [t, t.upper(), t.replace(" ", "\n"), " ".join(w[:-1] + ["other"]), "intro " + t + " outro", t + " " + t]
    return texts


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "ho"), (1, 3, None, "é"), (None, 0, "x", "y"), (2, 0, "system", "alone"), (3, 300, "z", "late")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS speaker", "2 AS block")
    out = {(r["conv_id"], r["speaker"]): r for r in chat.rotate(df).collect()}
    assert set(out) == {(1, "ann"), (1, "bob"), (1, "unknown"), (3, "z")}
    ann = out[1, "ann"]
    assert ann["text"] == (
        "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|assistant|>\nho<|end|>\n<|user name=bob|>\n<|end|>\n<|user name=unknown|>\né<|end|>\n"
    )
    assert [ann["text"][m["start"] : m["end"]] for m in ann["mask"]] == ["hi<|end|>\n", "ho<|end|>\n"]
    assert ann["n_masked"] == sum(m["end"] - m["start"] for m in ann["mask"])
    assert out[3, "z"]["block"] == 0
    assert chat.rotate(df.limit(0)).count() == 0


def _rotated(turns, speaker):
    said = sorted(turns, key=lambda t: (t[0], t[1].encode(), t[2].encode()))
    text, mask = "", []
    for _, role, body in said:
        body = re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", body) + "<|end|>\n"
        name = re.sub(r"\|(\\*)>", lambda m: "|\\" + m[1] + ">", re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", role))
        text += "<|assistant|>\n" if role == speaker else "<|system|>\n" if role == "system" else f"<|user name={name}|>\n"
        if role == speaker:
            mask.append((len(text), len(text) + len(body)))
        text += body
    return text, mask


def test_rotation_of_long_and_hostile_dialogues(spark):
    rng = random.Random(3)
    roles = ["ann", "bob", "b|>\n<|assistant", "system"]
    turns = [(i, rng.choice(roles), rng.choice(["hi", "", "é☃", "<|end|>\n<|assistant|>\nno", "<\\|end|>", "a" * 50])) for i in range(700)]
    turns += turns[300:310]
    df = spark.createDataFrame([(1, *t) for t in turns], "conv_id long, turn long, role string, text string")
    whole = {r["speaker"]: r for r in chat.rotate(df).collect()}
    assert set(whole) == set(roles[:3])
    for who, r in whole.items():
        text, mask = _rotated(turns, who)
        assert (r["text"], [tuple(m) for m in r["mask"]], r["n_turns"]) == (text, mask, 710)
        assert text.count("<|assistant|>") == len(mask) and text.count("<|end|>") == 710
    parts = defaultdict(list)
    for r in chat.rotate(df, block_turns=100).orderBy("block").collect():
        parts[r["speaker"]].append(r)
    for who, rows in parts.items():
        assert "".join(r["text"] for r in rows) == whole[who]["text"] and len(rows) == 7
        assert [(m[0] + r["at"], m[1] + r["at"]) for r in rows for m in r["mask"]] == [tuple(m) for m in whole[who]["mask"]]
        assert sum(r["n_masked"] for r in rows) == whole[who]["n_masked"]


# 2


def _sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def _reach(n, links):
    parent = list(range(n))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(v) for v in range(n)]


def _near(texts, k):
    s = _sets(texts, k)
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    return [len(x) for x in s], _reach(len(s), links)


@pytest.mark.parametrize("k", [2, 5])
def test_near_components(spark, odd, k):
    found = near_dedup.near_components(make(spark, odd).withColumnRenamed("n_chars", "n"), k=k).orderBy("doc_id").collect()
    sizes, component = _near(odd, k)
    assert [r["n_shingles"] for r in found] == sizes
    assert [r["component_id"] for r in found] == component
    assert [r["kept"] for r in found] == [i == c for i, c in enumerate(component)]


def test_near_components_of_a_large_group_with_outliers(spark):
    rng = random.Random(8)
    base = prose(rng, 90).split()
    texts = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = prose(rng, 1) + str(rng.randrange(50))
        texts.append(" ".join(w))
    found = near_dedup.near_components(make(spark, texts), k=2).orderBy("doc_id").collect()
    assert [r["component_id"] for r in found] == _near(texts, 2)[1]


def test_near_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_components(df).collect()), key=str)
    assert found == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]
    assert near_dedup.near_components(empty(spark)).count() == 0
    assert sorted(near_dedup.near_dedup(df).select("doc_id").collect(), key=str) == [(1,), (1,), (None,)]


def test_repeated_ids_with_unlike_texts_in_any_order(spark):
    rng = random.Random(2)
    one, two, three = (prose(rng, 60) for _ in range(3))
    near = lambda t: t + " tail"
    rows = [(5, one), (5, two), (7, near(one)), (9, near(two)), (3, two), (11, three), (12, near(three)), (11, ""), (20, None)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + seed)
        found = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_components(df, k=2).collect()}
        assert found == {(5, 3), (7, 3), (9, 3), (3, 3), (11, 11), (12, 11), (20, 20)}


def test_bridge_to_a_group_that_grows_past_the_size_of_a_link(spark):
    h = np.random.default_rng(1).integers(0, 2**63, 1300).astype(np.uint64)
    sizes = [1000, 1253, 1252, 1251, 1249]
    regs = near_dedup.sketch(np.concatenate([h[:n] for n in sizes]), np.array(sizes))
    rows = [(7, i, min(i, 1), n, r.tobytes(), 5, i == 0) for i, (n, r) in enumerate(zip(sizes, regs))]
    df = spark.createDataFrame(rows, "key long, rep long, cluster long, n long, regs binary, size long, minor boolean").coalesce(1)
    assert [tuple(r) for r in near_dedup._bridges(df, 80).collect()] == [(0, 4)]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 1300).astype(np.uint64)
    a, b = h[:1000], h[300:]
    s = near_dedup.sketch(np.concatenate([a, b, h]), np.array([1000, 1000, 1300]))
    assert (near_dedup.merge(s[0], s[1]) == s[2]).all()
    j, keep = near_dedup.likely(s[:1], s[1:2], np.array([1000.0]), np.array([1000.0]), 50)
    assert abs(j[0] - 700 / 1300) < 0.15 and keep[0]


@pytest.mark.parametrize("links_a_task", [5, 100_000])
def test_components(spark, links_a_task, monkeypatch):
    monkeypatch.setattr(components, "LINKS_A_TASK", links_a_task)
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


# 3


def test_exact_groups(spark, odd):
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in odd]
    groups = defaultdict(list)
    for i, b in enumerate(bare):
        groups[b].append(i)
    for r in exact_dedup.exact_groups(make(spark, odd).withColumnRenamed("n_chars", "_n")).collect():
        g = groups[bare[r["doc_id"]]]
        keep = min(g, key=lambda i: (-len(odd[i] or ""), i))
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(g), keep == r["doc_id"])
        assert r["text_sha256"] == hashlib.sha256(bare[r["doc_id"]].encode()).hexdigest()
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


# 4


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    rows, centre = [], rng.standard_normal((12, 16))
    for i in range(300):
        v = centre[i % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.15, 0.4])
        rows.append((i, v.tolist(), int(i % 3)))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, rows[0][1], None), (404, rows[0][1], 0), (405, [], 0), (406, rows[0][1], 0), (407, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS n", "2 AS block")
    ok = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for i, v, a in ok:
        for j, w, b in ok:
            if i != j and a == b and v @ w >= 0.93:
                links[i].add(j)

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    assert found == {i: (len(links[i]), least(i), least(i) == i) for i, _, _ in rows}
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_recall_of_the_collision_count_and_of_the_keys():
    width, least = vectors.calibrate(0.93)
    rng = np.random.default_rng(0)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    d = rng.standard_normal((2000, 64))
    d -= (d * a).sum(1, keepdims=True) * a
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * d
    hits = (np.abs((a - b) @ vectors.directions(64, vectors.PROJECTIONS, 5)) <= width).sum(1)
    assert (hits >= least).mean() == 1.0
    for n in (1000, 50_000):
        cells, keys, cell = vectors.key_plan(n, 0.93, width)
        shift = rng.random(cells * keys)
        x, y = (np.floor(v @ vectors.directions(64, cells * keys, 7) / cell + shift).reshape(-1, keys, cells) for v in (a, b))
        assert (x == y).all(2).any(1).mean() == 1.0


@pytest.mark.parametrize("block", [4, 1024])
def test_near_vectors_of_dense_groups_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((3, 24))
    rows = [(i, (centre[i % 3] + 0.25 * rng.standard_normal(24)).tolist(), "x") for i in range(150)] + [(i, rng.standard_normal(24).tolist(), "x") for i in range(150, 500)]
    rows += [(7, rows[1][1], "x"), (600, rows[0][1], "x"), (600, rows[200][1], "x"), (601, rows[300][1], "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    lab = np.array([x for _, _, x in rows])
    hit = (unit @ unit.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(hit, False)
    ids = [i for i, _, _ in rows]
    component = _reach(700, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(hit))])
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect())
    assert found == sorted((i, int(hit[k].sum()), component[i], component[i] == i) for k, i in enumerate(ids))


# 5

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="nav-open"><header>Site</header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><article class="post"><header><h1>Caf&eacute; &amp; more</h1></header><p>One&nbsp; <b>two</b>
three<br>four</p><aside>Aside</aside><div class="advert">Buy</div><p>Five &lt;b&gt;</p><form><p>Sign up</p></form><section id="comments"><article><p>Reader says</p></article></section></article>
<div class="sidebar"><p>Links</p></div><footer>&copy; Site</footer></body></html>"""


def test_main_text(spark):
    plain = "<body><div><p>{}</p></div><p>this line of eight plain words stands everywhere</p></body>"
    pages = [(1, "https://a.b/x", PAGE), (2, None, None), (3, "https://c.d/1", plain.format("alpha beta")), (4, "https://c.d/2", plain.format("gamma delta")), (5, "https://e.f/2", plain.format("gamma delta")), (6, "u", ""), (7, "u", "<p>unclosed & <i>x"), (None, "https://c.d/3", plain.format("no id"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS at", "2 AS page")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.main_text(df).collect()}
    line = "this line of eight plain words stands everywhere"
    want = {1: "Café & more\nOne two three four\nFive <b>", 2: "", 3: "alpha beta", 4: "gamma delta", 5: "gamma delta\n" + line, 6: "", 7: "unclosed & x", None: "no id\n" + line}
    assert found == {k: (v, len(v)) for k, v in want.items()}
    assert html.main_text(df.limit(0)).count() == 0


def test_repeats_of_a_few_pages_copies_and_pages_without_a_host_stay(spark):
    rng = random.Random(12)
    line, quote, copy = "this line of eight plain words stands everywhere", prose(rng, 30), prose(rng, 90)
    own = [prose(rng, 40) for _ in range(8)]
    page = lambda *parts: "<body>" + "".join(f"<div>{x}</div>" for x in parts) + "</body>"
    rows = [(i, "https://a.b/", page(t, quote, line) if i < 2 else page(t, line), "\n".join([t, quote] if i < 2 else [t])) for i, t in enumerate(own[:6])]
    rows += [(i, "https://c.d/", page(copy + t), copy + t) for i, t in ((10, " first"), (11, " second"))]
    rows += [(i, None, page(t, line), t + "\n" + line) for i, t in ((20, own[6]), (21, own[7]))]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.main_text(df).collect()} == {r[0]: r[3] for r in rows}


@pytest.mark.parametrize("bad", ["<a ", "<a b=\"", "<a b='\"", "<", "<div><p", "</x", "<!-- ", "<svg", "<div class=ad><b>", "<nav></b>", "&#", "<p title=\"a>b", "<script>"])
def test_broken_markup_takes_linear_time(bad):
    page = bad * (1_000_000 // len(bad))
    begin = time.perf_counter()
    html.blocks(page)
    assert time.perf_counter() - begin < 8  # 0.1 to 2 s on a free core


def test_markup_that_does_not_end():
    text = lambda page: [t for _, _, t in html.blocks(page)]
    assert text('<p>a<p title="x>b<p>c') == ["a", "b", "c"]
    assert text("<p>a < b &amp; 1<2</p><p>c<a hre") == ["a < b & 1<2", "c"]
    assert text("<p title='a>b'>c</p><!-- d") == ["c"]


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 60, 300):
        text = rng.integers(0, 3, n).astype(np.uint64)
        ends = np.unique(np.r_[rng.integers(1, n + 1, 3), n])
        end = {i: int(ends[ends > i][0]) for i in range(n)}
        order, common = html.suffix_array(text, ends)
        tails = [text[i : end[i]].tolist() for i in order]
        assert tails == sorted(tails) and sorted(order.tolist()) == list(range(n))
        for k in range(1, n):
            x, y = tails[k - 1], tails[k]
            assert common[k] == next((m for m in range(min(len(x), len(y))) if x[m] != y[m]), min(len(x), len(y)))


def _unique_runs(pages, run=8):
    """Words that no run of 8 tokens (an element, then its words) on more than half of a host's pages covers."""
    out = {}
    for host in {h for _, h, _ in pages}:
        mine = {i: [t for tag, text in parts for t in ["<" + tag, *text.split()]] for i, h, parts in pages if h == host}
        seen = defaultdict(set)
        for i, t in mine.items():
            for k in range(len(t) - run + 1):
                seen[tuple(t[k : k + run])].add(i)
        for i, t in mine.items():
            gone = set()
            for k in range(len(t) - run + 1):
                if len(seen[tuple(t[k : k + run])]) * 2 > len(mine) and len(seen[tuple(t[k : k + run])]) > 1:
                    gone |= set(range(k, k + run))
            lines, at = [], 0
            for tag, text in next(p for j, _, p in pages if j == i):
                words = text.split()
                left = [w for k, w in enumerate(words, at + 1) if k not in gone]
                lines += [" ".join(left)] if left else []
                at += 1 + len(words)
            out[i] = "\n".join(lines)
    return out


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_index_against_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(html, "STREAM_TOKENS", size)
    rng = random.Random(21)
    lines = [prose(rng, n) for n in (6, 8, 12, 20, 9)]
    pages = []
    for i in range(60):
        host = f"h{i % 3}.org"
        parts = [("div", prose(rng, rng.randint(10, 40)))]
        for k, line in enumerate(lines):
            if rng.random() < (0.9, 0.8, 0.45, 0.6, 0.3)[k]:
                parts.insert(rng.randint(0, len(parts)), (rng.choice(["div", "p"]), line))
        pages.append((i, host, parts))
    rows = [(i, f"https://{h}/{i}", "<body>" + "".join(f"<{t}>{x}</{t}>" for t, x in parts) + "</body>") for i, h, parts in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.main_text(df).collect()} == _unique_runs(pages)


def test_prose_outside_an_article_stays_where_no_other_page_repeats_it(spark):
    rng = random.Random(14)
    article, lead, promo = [[prose(rng, 50) for _ in range(2)] for _ in range(3)]
    rows = []
    for i in range(2):
        rows.append((i, "https://a.b/", f"<nav>{promo[0]}</nav><div>{lead[i]}</div><article><p>{article[i]}</p></article><div>{promo[0]}</div><div>short</div>"))
    df = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string")
    found = sorted((r["page_id"], r["text"]) for r in html.main_text(df).collect())
    assert found == sorted((i, lead[i] + "\n" + article[i]) for i in (0, 0, 1))
    seen = {(r["kind"], r["covered"]): r["n"] for r in html.decisions(df).collect()}
    assert seen == {(html.ARTICLE, False): 3, (html.UNDECIDED, False): 3, (html.UNDECIDED, True): 3, (html.BOILERPLATE, True): 6}


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_articles_are_in_the_index(spark, size, monkeypatch):
    """Prose outside an article goes where it is a piece of another page's article, but not for copies of its own page."""
    monkeypatch.setattr(html, "STREAM_TOKENS", size)
    rng = random.Random(15)
    article, lead = [prose(rng, 90) for _ in range(6)], [prose(rng, 50) for _ in range(6)]
    page = lambda i, outside: f"<nav>Home</nav><article><p>{article[i]}</p></article><div>{outside}</div>"
    teaser = [" ".join(a.split()[5:55]) for a in article]
    rows = [(0, "https://a.b/", page(0, teaser[1]), article[0]), (1, "https://a.b/", page(1, lead[1]), article[1] + "\n" + lead[1])]
    rows += [(2, "https://a.b/", page(2, teaser[2]), article[2] + "\n" + teaser[2])]  # a quote of itself
    rows += [(i, "https://a.b/", page(3, lead[3]) + "<footer>x</footer>" * (i - 3), article[3] + "\n" + lead[3]) for i in (3, 4)]
    rows += [(5, "https://c.d/", page(4, teaser[1]), article[4] + "\n" + teaser[1])]  # another host
    rows += [(6, "https://a.b/", f"<div>{article[5]}</div><div>{teaser[0]}</div>", article[5] + "\n" + teaser[0])]  # two pages are not most of them
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.main_text(df).collect()} == {r[0]: r[3] for r in rows}


# 6 and 7


def _texts(rng):
    words = ["The", "don't", "we'll", "naïve", "<|endoftext|>", "x1y2", "3.14", "漢字", "á", "--", "''s", "İ", "\x1c", "½", "ﬁ", "ét́"]
    gaps = [" ", "  ", "\n", "\n\n", " \n ", "\t", " ", "", "\r\n"]
    return ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60))) for _ in range(150)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_and_splices_equal_the_library(name, odd):
    path = tokens.tokenizer_path(name)
    tok = tokens.load(path)
    texts = [t or "" for t in odd] + _texts(random.Random(4))
    enc = tokens.Encoder(path, packing.ids_bytes, lower=name[0] == "w", strip=name[0] == "w")
    small = tokens.Encoder(path, packing.ids_bytes, lower=name[0] == "w", strip=name[0] == "w", chunk=1500)
    want = [packing.ids_bytes(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [b"".join(v) for v in enc.batch(texts)] == want
    long = [t * 60 for t in texts]
    assert [b"".join(v) for v in small.batch(long)] == [packing.ids_bytes(tok.encode(t, add_special_tokens=False).ids) for t in long]


def test_token_counts(spark, odd):
    tok = tokens.load(tokens.tokenizer_path("byte_bpe_50k.json"))
    found = tokens.token_counts(make(spark, odd).withColumnRenamed("n_chars", "id"), tokens.tokenizer_path("byte_bpe_50k.json"), limit=100).orderBy("doc_id").collect()
    for r, t in zip(found, odd):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 100)
    assert tokens.token_counts(empty(spark), tokens.tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_packing(spark, odd):
    path, cap = tokens.tokenizer_path("word_bpe_49k.json"), 64
    tok = tokens.load(path)
    rows = packing.pack(make(spark, odd).withColumnRenamed("n_chars", "length"), path, capacity=cap).collect()
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, t in enumerate(odd):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        for r in by_doc[i]:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == r["piece"] * cap and r["length"] == len(part) and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in by_doc[i]) == len(ids)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= cap
    assert len(bins) <= 1.1 * total / cap + 2
    assert packing.pack(empty(spark), path).count() == 0


def test_plan_places_everything_once():
    rng = random.Random(1)
    for _ in range(30):
        cap = rng.choice([10, 64, 301])
        counts = {s: rng.randint(0, 40) for s in range(1, cap + 1) if rng.random() < 0.4}
        used, placed = defaultdict(set), defaultdict(int)
        for length, n, per, first, offset in packing.plan(counts, cap):
            placed[length] += n
            for j in range(n):
                span = range(offset + j % per * length, offset + (j % per + 1) * length)
                assert span.stop <= cap and not used[first + j // per].intersection(span)
                used[first + j // per].update(span)
        assert dict(placed) == {s: n for s, n in counts.items() if n}
        assert all(max(u) + 1 == len(u) for u in used.values())


# 8


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 40)), None if i % 9 == 0 else "big" if i % 3 else "small") for i in range(400)] + [(900, None, "big"), (901, " ", "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 AS total")
    out = mixing.temperature_mix(df, max_repeat=1.5, block_tokens=500).collect()
    total = sum(len((t or "").split()) for _, t, _ in rows)
    taken, have, weight = defaultdict(int), defaultdict(int), {}
    for _, t, s in rows:
        have[s] += len((t or "").split())
    for r in out:
        taken[r["source"]] += r["n_tokens"]
        weight[r["source"]] = r["weight"]
    assert abs(sum(weight.values()) - 1) < 1e-9
    for s, w in weight.items():
        assert 0 <= taken[s] - int(w * total) < 40
        assert w * total / have[s] <= 1.5 + 1e-6
    assert {r["doc_id"] for r in out} <= set(range(400))
    per = defaultdict(lambda: defaultdict(int))
    for r in out:
        per[r["block"]][r["source"]] += r["n_tokens"]
    for b, part in per.items():
        if b < max(per):
            assert all(abs(part[s] / sum(part.values()) - w) < 0.12 for s, w in weight.items())
    flat = mixing.temperature_mix(df, target_entropy=1.0986).select("source", "weight").distinct().collect()
    assert all(abs(r["weight"] - 1 / 3) < 0.02 for r in flat)
    assert mixing.temperature_mix(df.limit(0), max_repeat=2.0).count() == 0


# 9


def test_language(spark):
    rng = random.Random(6)
    kinds = {"aa": ("tal", "ren", "mio", "sa"), "bb": ("krz", "wol", "szc", "ny"), "cc": ("hua", "lei", "ola", "noa")}
    rows = []
    for i in range(300):
        lang = "aabbcc"[2 * (i % 3) : 2 * (i % 3) + 2]
        rows.append((i, prose(rng, rng.randint(3, 80), kinds[lang]), lang if i % 7 else None))
    both = " ".join(prose(rng, 60, kinds[k]) for k in ("aa", "bb", "aa"))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !?", "aa"), (1003, "é", None), (1004, both, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS n")
    found = {r["doc_id"]: r for r in language.identify(df).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [(r["lang_pred"], "aabbcc"[2 * (i % 3) : 2 * (i % 3) + 2]) for i, r in found.items() if r["held_out"] and i < 300]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert [found[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert found[1003]["lang_pred"] != "und"
    assert found[1004]["lang_pred"] == "aa" and 0.5 < found[1004]["score"] < 0.85
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify(df.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()} == {"und"}


# 10


def _cut(texts, width=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if w in seen:
                gone[s : s + width] = b"\1" * width
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), bytes(gone).count(b"\0\1") + (gone[:1] == b"\1"), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("many", [2, 64])
def test_repeated_passages(spark, odd, many, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MANY", many)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2000)
    rng = random.Random(9)
    passages = [prose(rng, n) for n in (12, 18, 25, 60)]
    texts = list(odd) + [" ".join([prose(rng, rng.randint(0, 30)), rng.choice(passages), prose(rng, rng.randint(0, 30)), rng.choice(passages)]) for _ in range(60)]
    df = make(spark, texts).withColumnRenamed("n_chars", "gram")
    found = substring_dedup.drop_repeats(df).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found] == _cut(texts)


def test_repeated_passages_of_a_text_over_8_mib_before_a_short_row(spark):
    long = np.random.default_rng(4).integers(97, 123, 9_000_000).astype(np.uint8).tobytes().decode()
    far = 1 << 23
    texts = [long[:500], long, long[far + 1000 : far + 1400], "short", long[far - 200 : far + 200], long[:300]]
    found = substring_dedup.drop_repeats(make(spark, texts).coalesce(1)).orderBy("doc_id").collect()
    assert [(r["n_removed"], r["n_spans"]) for r in found] == [(0, 0), (500, 1), (400, 1), (0, 0), (400, 1), (300, 1)]


def test_repeated_passages_ids(spark):
    t = "word " * 3 + "".join(chr(97 + i * i % 26) for i in range(300))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (7, t)], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["n_removed"]) for r in substring_dedup.drop_repeats(df).collect()), key=str)
    assert found[-1] == (None, 0) and found[2][1] == len(t) and found[0] == found[1]
    assert substring_dedup.drop_repeats(empty(spark)).count() == 0
