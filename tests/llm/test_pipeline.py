"""The corpus pipeline's stages on their own inputs."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from axonframe.llm import common, mixing

STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def chain(spark, sf):
    docs, out, scratch = common.documents(spark, sf), {}, common.Scratch(spark)
    out["start"] = docs
    for name, stage in pipeline.STAGES:
        docs = out[name] = scratch.table(name, stage(spark, docs, sf))
    return out


def test_stages_are_in_order(chain):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "mixing", "packing"]
    for name in ("toxicity", "near_copies", "repeats", "mixing"):
        assert chain[name].dtypes == chain["start"].dtypes


def test_run_is_the_chain(spark, sf, chain):
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    assert rows(pipeline.run(spark, sf)) == rows(chain["packing"])


def test_toxic_rows_go(chain, spark, sf):
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    left = {r["doc_id"] for r in chain["toxicity"].collect()}
    clean = {r["doc_id"] for r in chain["start"].collect()} - toxic
    assert len(clean - left) <= 0.03 * len(clean)
    assert len(toxic & left) < len(toxic)


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def test_near_copies_go_and_others_stay(spark, sf):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows, groups = [], {}
    for g in range(40):
        words = [word() for _ in range(int(rng.integers(150, 500)))]
        for c in range(int(rng.integers(1, 6))):
            copy = list(words)
            for _ in range(c % 3 * len(words) // 150):
                copy[int(rng.integers(len(copy)))] = word()
            groups.setdefault(g, []).append(len(rows))
            rows.append((len(rows), " ".join(copy), "en", "s", 1))
    order = rng.permutation(len(rows))
    docs = spark.createDataFrame([rows[k] for k in order.tolist()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in STAGES["near_copies"](spark, docs, sf).collect()}
    assert all(kept & set(ids) for ids in groups.values())
    for ids in groups.values():
        first = shingles(rows[ids[0]][1])
        for i in ids[1:]:
            own = shingles(rows[i][1])
            if len(first & own) / len(first | own) >= 0.85:
                assert i not in kept


def test_repeats_are_cut_and_rows_stay(spark, sf):
    passage = "".join(chr(97 + k * k % 26) for k in range(230))
    docs = spark.createDataFrame([(1, "é" + passage + "ü one", "en", "a", 7), (2, "two " + passage, "en", "a", 7), (3, "clean", "en", "a", 5), (4, None, "en", "a", None), (5, passage, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in STAGES["repeats"](spark, docs, sf).collect()}
    assert got == {1: ("éü one", 6), 2: ("two ", 4), 3: ("clean", 5), 4: (None, None), 5: ("", 0)}


def test_mixing_takes_what_the_operator_says(spark, sf, chain):
    docs = chain["repeats"]
    want = {r["doc_id"]: r["takes"] for r in mixing.mix(mixing.measured(docs)).collect()}
    got = {}
    for r in chain["mixing"].collect():
        got.setdefault(r["doc_id"], []).append(len(re.findall(common.WORD, r["text"])))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(t for t in x if t) for i, x in want.items() if any(x)}


def test_a_part_taken_keeps_its_line_breaks(spark, sf):
    text = " one\n\ttwo  three\nfour\r\nfive six\n" * 30
    rows = [(k, text, "en", s, 1) for k, s in enumerate("aaaabbbbbbbbcccc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = STAGES["mixing"](spark, docs, sf).collect()
    cut = [r["text"] for r in got if r["text"] != text]
    assert cut and all(text.startswith(t) and not t[-1].isspace() and text[len(t)].isspace() for t in cut)
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] != text)


def test_packing_holds_every_row_of_its_input(chain):
    assert chain["packing"].where("start = 0").count() == chain["mixing"].count()


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows_pass_each_stage(spark, sf, odd, empty, name):
    out = STAGES[name](spark, odd, sf)
    if name != "packing":
        assert out.dtypes == odd.dtypes
    rows = out.collect()
    assert rows or name == "mixing"
    assert STAGES[name](spark, empty, sf).count() == 0
    if name == "near_copies":
        assert len([r for r in rows if r["doc_id"] in (7, 8)]) == 1
        assert sum(not (r["text"] or "").split() for r in rows) == 1
    if name == "repeats":
        assert len(rows) == odd.count()


def test_stages_are_pure(spark, sf, chain):
    again = STAGES["near_copies"](spark, chain["toxicity"], sf)
    digest = lambda df: sorted(hashlib.sha256(str(r).encode()).hexdigest() for r in df.collect())
    assert digest(again) == digest(chain["near_copies"])
    assert chain["mixing"].select(F.countDistinct("doc_id")).first()[0] > 0
