"""Minimum-slack packing, phrase mining and the filter audit against brute force; the pipeline on odd rows and names."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import corpus_pipeline
import numpy as np
import pytest

from tempora.llm import audit, exact_dedup, language, mixing, near_dedup, phrases, slack, tokens, vectors

from test_corpus import DOCS, empty, make, odd, prose  # noqa: F401

# 11


def _fits(counts, room):
    reach = {0}
    for s, n in counts.items():
        reach |= {v + s * k for v in reach for k in range(n + 1) if v + s * k <= room}
    return reach


@pytest.mark.parametrize("seed", range(40))
def test_closest_multiset(seed):
    rng = random.Random(seed)
    room = rng.randint(5, 60)
    counts = {rng.randint(1, 70): rng.randint(1, 4) for _ in range(rng.randint(1, 8))}
    best, used = slack.closest(counts, room)
    assert best == sum(s * n for s, n in used.items()) <= room and all(0 < n <= counts[s] for s, n in used.items())
    fitting = [s for s in counts if s <= room]
    if fitting:  # the longest that fits is in it, and no multiset with it comes closer
        a = max(fitting)
        rest = {s: n - (s == a) for s, n in counts.items()}
        assert used[a] and best == a + max(_fits(rest, room - a))
    else:
        assert (best, used) == (0, {})


@pytest.mark.parametrize("seed", range(60))
def test_plan_places_every_token_once_without_padding(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 16, 100, 4096])
    counts = {rng.randint(1, capacity): rng.randint(1, rng.choice([1, 3, 50])) for _ in range(rng.randint(1, 40))}
    length = np.array([s for s, n in counts.items() for _ in range(n)])
    rank = np.array([r for n in counts.values() for r in range(n)])
    windows, seen = defaultdict(list), np.zeros(len(length), int)
    for item, start, size, window, offset, cut in slack.Places(slack.plan(counts, capacity)).of(length, rank):
        assert (seen[item] == start).all()
        seen[item] += size
        assert (cut | (size == length[item])).all()
        for w, o, z in zip(window.tolist(), offset.tolist(), size.tolist()):
            windows[w].append((o, z))
    assert (seen == length).all()
    short = 0
    for parts in windows.values():
        at = 0
        for o, z in sorted(parts):
            assert o == at
            at += z
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
        short += at < capacity
    assert short <= capacity.bit_length()


def test_plan_of_many_equal_documents_is_short():
    assert len(slack.plan({3000: 10**9}, 4096)) < 100
    runs = slack.plan({s: 1000 for s in range(1, 4097)}, 4096)
    assert sum(r[2] for r in runs if r[6]) < 100  # where lengths are many, next to nothing is cut


@pytest.mark.parametrize("capacity", [64, 4096])
def test_windows_against_the_library(spark, odd, capacity):  # noqa: F811
    path = tokens.tokenizer_path("word_bpe_49k.json")
    df = make(spark, odd).selectExpr("*", "1 AS length", "2 AS ids", "3 AS _row")
    df = df.unionByName(df.filter("doc_id = 12")).unionByName(df.filter("doc_id = 13").withColumn("doc_id", df.doc_id * None))
    rows = slack.pack_windows(df, path, capacity).collect()
    tok = tokens.load(path)
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(odd)}
    want[None] = want[13]
    assert set(by) == set(want)
    for i, ids in want.items():
        covered = Counter()
        for r in by[i]:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
            covered.update(range(r["start"], r["start"] + r["length"]))
        assert covered == Counter({k: 2 if i == 12 else 1 for k in range(len(ids))})
    for parts in sequences.values():
        at = 0
        for o, z in sorted(parts):
            assert o == at
            at += z
        assert at == capacity or at & (at - 1) == 0
    assert slack.pack_windows(empty(spark), path).count() == 0


# 12


def _phrases(docs, max_n=3, least=10, inside=50, best=2000):
    f, words = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = set()
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            score, k = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            inside_one = any(
                len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= inside * a for q, b in candidates.items()
            )
            if not inside_one:
                rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:best], 1):
            out.add((lang, rank, p.decode(), -a, left, right, words[lang], -score))
    return out


def _mined(df, **more):
    return [(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in phrases.phrases(df, **more).collect()]


@pytest.mark.parametrize("more", [{}, {"max_n": 4, "least": 3}, {"max_n": 2, "least": 2, "best": 7}])
def test_phrases(spark, more):
    rng = random.Random(4)
    pool = "New york City the of is é über a\x0bb x\xa0y \x1c".split(" ")
    docs = [(None, "en"), ("", None), (" \t.\n", "en"), ("The, the", None), ("lone" * 2000, "de")]
    for i in range(300):
        text = "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "; "]) for _ in range(rng.randint(1, 60)))
        docs.append((text + "the big red dog " * rng.randint(0, 2), rng.choice(["en", "de", None, "und", "a\tb"])))
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, text string, lang string").selectExpr("*", "1 AS phrase", "2 AS n", "3 AS _k")
    found = _mined(df, **more)
    keys = {{"inside_percent": "inside"}.get(k, k): v for k, v in more.items()}
    assert len(found) == len(set(found)) and set(found) == _phrases(docs, **keys)
    assert phrases.phrases(df.limit(0)).count() == 0


@pytest.mark.parametrize("gaps", [" ", " ,", "\n"])
def test_phrases_of_one_very_long_text(spark, monkeypatch, gaps):
    rng = random.Random(6)
    text = "".join(rng.choice(["aa", "bb", "cc", "dd" * 40]) + rng.choice(gaps) for _ in range(4000))
    monkeypatch.setattr(phrases, "SLICE_BYTES", 1000)
    whole = spark.createDataFrame([(1, text, "en"), (2, "aa bb", "en")], "doc_id long, text string, lang string")
    # The limit is read where tasks are made, so windows are held against brute force there too.
    raw = np.frombuffer(text.encode(), np.uint8)
    words, count = [], 0
    for part, _, skip in phrases._windows(raw, np.array([0, len(raw)]), 3, 1000):
        found = re.findall(rb"[^ \t.,;:!?\n\x0b\x0c\r]+", part.tobytes())
        assert not words or found[:skip] == words[-skip:]
        words += found[skip:]
        count += 1
    assert count > 20 and words == re.findall(rb"[^ \t.,;:!?\n\x0b\x0c\r]+", raw.tobytes())
    assert set(_mined(whole)) == _phrases([(text, "en"), ("aa bb", "en")])


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 3 * 10**12
    made = [("a\ten", big), ("b\ten", 2 * big + 1), ("a b\ten", big - 7), ("\ten", 5 * big)]
    monkeypatch.setattr(phrases, "ngram_counts", lambda docs, orders, *_: spark.createDataFrame(made if 1 in orders else [], "phrase string, n long"))
    assert _mined(empty(spark)) == [("en", 1, "a b", big - 7, big, 2 * big + 1, 5 * big, 10**6 * (big - 7) ** 2 // (big * (2 * big + 1)))]


# 13


def _audit(rows, names, labels):
    """rows: (part, fails, labels) as sets."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = Counter()
        for order in permutations(names):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_by[f] += len(gone)
                lost = tuple(sum(label in r[2] for r in gone) for label in labels)
                fails = sum(f in r[1] for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(r[1] == {f} for r in own), *lost]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("held", [1, 10_000])
def test_audit_of_all_orders(spark, monkeypatch, held):
    monkeypatch.setattr(audit, "HELD_PARTS", held)
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", "", None, "é"]), *(rng.choice([True, False, False, None]) for _ in range(6))) for _ in range(500)]
    df = spark.createDataFrame(data, "part string, P boolean, Q boolean, R boolean, S boolean, good boolean, toxic boolean").selectExpr("*", "1 AS n", "2 AS subset")
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in audit.audit(df, list("PQRS"), ["good", "toxic"], "part").collect()}
    rows = [(p or "", {f for f, v in zip("PQRS", v) if v}, {f for f, v in zip(("good", "toxic"), v[4:]) if v}) for p, *v in data]
    assert found == _audit(rows, "PQRS", ["good", "toxic"])
    assert audit.audit(df.limit(0), list("PQRS"), ["good", "toxic"], "part").count() == 0
    with pytest.raises(ValueError):
        audit.audit(df, list("ABCDEFGHI"), [], "part")


def test_document_failures(spark, odd, monkeypatch):  # noqa: F811
    texts = [*odd, "tab\there " * 150, "A" * 5 + "b" * 95, "price $5", "same " * 300, odd[12], None]
    rows = [(i, t, "en" if i % 3 else None, "s", 0) for i, t in enumerate(texts)] + [(None, odd[12], "en", "s", 0), (3, odd[3], "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS _id", "2 AS part", "3 AS A", "true AS good")
    marks = spark.createDataFrame([(1, 1, 0), (1, None, 1), (2, 0, 0), (None, 1, 1), (12, None, None)], "doc_id long, quality int, toxic int")
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))

    def expect(i, t, lang):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t])
        return (lang, *fails, True if i == 1 else False if i in (2, 12) else None, True if i == 1 else False if i in (2, 12) else None)

    for limit in (50, 1 << 21):
        monkeypatch.setattr(audit, "CHUNK_BYTES", limit)
        found = audit.document_failures(df, marks).collect()
        assert Counter(map(tuple, found)) == Counter(expect(i, t, lang) for i, t, lang, *_ in rows)
    parts = list(audit.spaced(np.frombuffer(b"one two  three" * 9, np.uint8), np.array([0, 126]), 20))
    assert len(parts) > 3 and b"".join(z.tobytes() for z, _ in parts) == b"one two  three" * 9 and all(z[0] == 32 for z, _ in parts[1:])


# The pipeline and its operators on odd rows and names


CLASHES = "1 AS score, 2 AS lang_pred, 'x' AS _text, 3 AS _gone, 4 AS id, 5 AS n, 6 AS key, 7 AS rep, 8 AS weight, 9 AS block, 10 AS row, 11 AS sha, 12 AS _0, 13 AS held_out, 14 AS stays, 15 AS copy, 16 AS place, 17 AS n_tokens"


def test_pipeline_with_clashing_names_nulls_and_repeats(spark):
    rng = random.Random(8)
    texts = [prose(rng, 30) for _ in range(12)]
    rows = [(i, t, "aa", "s", 1) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1] + " ", "aa", "s", 1), (None, texts[1] + " ", "aa", "s", 1), (None, "only here once more", "aa", None, 1), (3, "other text of three", "aa", None, 1), (None, None, None, None, None), (7, "", "aa", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *CLASHES.split(", "))
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, "")
        if name != "packing":
            assert after.columns == docs.columns
            got = after.collect()
            assert all((r["score"], r["lang_pred"], r["_text"], r["weight"], r["n_tokens"]) == (1, 2, "x", 8, 17) for r in got)
        if name == "exact_dedup":
            bare = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in got]
            assert len(bare) == len(set(bare)) and set(bare) == {re.sub(r"\s", "", t) for t in [*texts, "only here once more", "other text of three"]}
            assert next(r for r in got if r["text"].startswith(texts[1]))["text"] == texts[1] + " "
        before = after
    assert before.count() > 0


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    rows = [(5, "a b"), (5, "a b"), (5, "ab"), (2, "c"), (None, "c"), (None, "c  "), (None, "d"), (None, "d"), (9, None), (8, " "), (9, "e"), (1, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = Counter((r["doc_id"], r["text"]) for r in exact_dedup.exact_dedup(df).collect())
    assert out == Counter([(5, "a b"), (None, "c  "), (None, "d"), (8, " "), (1, "e")])


def test_every_stage_on_an_empty_table(spark):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty(spark), "")
        assert out.count() == 0
        assert name == "packing" or out.columns == empty(spark).columns


def test_operators_with_clashing_names(spark):
    rows = [(1, "ein kurzer Text", "de", "s", 1), (2, "one short text", "en", "s", 1), (2, "one short text", "en", "s", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", *CLASHES.split(", "))
    assert language.identify(df).columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert near_dedup.near_components(df, k=2).count() == exact_dedup.exact_groups(df).count() == 4
    assert mixing.temperature_mix(df, max_repeat=2.0).count() >= 3
    assert tokens.token_counts(df, tokens.tokenizer_path("byte_bpe_50k.json")).count() == 4
    with pytest.raises(ValueError):
        near_dedup.near_components(df, percent=50)


def test_no_planted_link_of_near_vectors_is_lost(spark):
    rng = np.random.default_rng(12)
    pairs, dim = 20_000, 64
    a = rng.standard_normal((pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    d = rng.standard_normal((pairs, dim))
    d -= (d * a).sum(1, keepdims=True) * a
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    cosine = 0.9301
    b = cosine * a + np.sqrt(1 - cosine**2) * d
    rows = [(2 * i + k, v) for i, both in enumerate(zip(a.tolist(), b.tolist())) for k, v in enumerate(both)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS label").repartition(4)
    found = {r["vec_id"]: r["component_id"] for r in vectors.near_vectors(df, 0.93).collect()}
    assert sum(found[2 * i + 1] != found[2 * i] for i in range(pairs)) == 0
