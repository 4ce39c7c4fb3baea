"""The pipeline's stages, each against brute force on the rows that the one before it kept."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from tempora.llm import tokens

from test_corpus import DOCS, _near, prose


def test_stages(spark):
    rng = random.Random(11)
    base = [prose(rng, rng.randint(20, 60)) for _ in range(40)]
    texts = [None, "", "12 34", *base, *base[:6], *(t.replace(" ", "\n") + "\n" for t in base[6:10]), *(t + " more" for t in base[10:20])]
    docs = spark.createDataFrame([(i, t, "aa", f"s{min(i % 7, 3)}", len(t or "")) for i, t in enumerate(texts)], DOCS)
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, "")
        if name != "packing":
            assert after.columns == docs.columns
        rows, left = before.collect(), after.collect()
        if name == "language_id":
            assert {r["doc_id"] for r in left} == {r["doc_id"] for r in rows if any(map(str.isalpha, r["text"] or ""))}
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for r in rows:
                groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"])].append((-len(r["text"]), r["doc_id"]))
            assert sorted(r["doc_id"] for r in left) == sorted(min(g)[1] for g in groups.values())
        elif name == "near_dedup":
            rows.sort(key=lambda r: r["doc_id"])
            component = _near([r["text"] for r in rows], 5)[1]
            assert sorted(r["doc_id"] for r in left) == [r["doc_id"] for i, r in enumerate(rows) if component[i] == i]
            assert len(left) < len(rows)
        elif name == "mixing":
            words = lambda rs: Counter({s: sum(len(r["text"].split()) for r in rs if r["source"] == s) for s in {r["source"] for r in rs}})
            have, got = words(rows), words(left)
            assert all(got[s] / have[s] < 1.25 + 60 / have[s] for s in have)
            assert abs(sum(got.values()) - sum(have.values())) < 60 * len(have)
        else:
            tok = tokens.load(tokens.tokenizer_path("word_bpe_49k.json"))
            want = Counter()
            for r in rows:
                want[r["doc_id"]] += len(tok.encode(r["text"], add_special_tokens=False).ids) + 1
            got = Counter()
            for r in left:
                got[r["doc_id"]] += r["length"]
            assert got == want
        before = after


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert "sequence_id" in out.columns and out.count() > 0


def test_language_id_sends_each_text_once(spark):
    docs = spark.createDataFrame([(i, t, "aa", "s", 3) for i, t in enumerate(["one two three", "vier fünf", None, "12"])], DOCS)
    found = corpus_pipeline.language_id(spark, docs, "")
    assert "_text" not in found._jdf.queryExecution().analyzed().toString()
    assert sorted(r["doc_id"] for r in found.collect()) == [0, 1]
