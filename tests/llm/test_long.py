"""Very long texts and messages through every operator, beside short ones and columns with clashing names."""

import hashlib
import zlib

import numpy as np
import pytest

from axonframe.llm import chat, fingerprints, licenses, matroska, mixing, packing, sharding, simhash, suffixes, toxicity

WORDS = 250_000


@pytest.fixture(scope="module")
def long_texts():
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 50_000, WORDS)]
    return ["short", " ".join(words), " ".join(words[:-3]) + " other words here", "\u00e9" * 1_000_000, None]


@pytest.fixture(scope="module")
def long(spark, long_texts):
    rows = [(k, t, "a", "7", "x", 3) for k, t in enumerate(long_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, fp string, shard int")


def raw(long_texts):
    return [(t or "").encode() for t in long_texts]


def test_fingerprints(long, long_texts):
    got = {r["doc_id"]: r for r in fingerprints.against_next(long).collect()}
    assert {k: r["n_chars"] for k, r in got.items()} == {k: len(t or "") for k, t in enumerate(long_texts)}
    assert got[2]["near_next"] > 0.99 and got[1]["near_edited"] > 0.1


def test_sizes_and_mixing(long, long_texts):
    got = {r["doc_id"]: r for r in mixing.mix(mixing.measured(long)).collect()}
    assert [got[k]["size"] for k in range(5)] == [1, WORDS, WORDS, 1, 0]
    assert sum(r["taken"] for r in got.values()) == 2 * WORDS + 2


def test_near_duplicates(long):
    found, named = simhash.near_duplicates(long)
    ids = {r["fp"]: r["component_id"] for r in named.collect()}
    group = {r["doc_id"]: ids[r["fp"]] for r in found.collect()}
    assert group[1] == group[2] == 1 and group[0] == 0 and group[3] == 3 and group[4] == 4
    assert {r["doc_id"] for r in simhash.kept_of_groups(long).collect()} == {0, 1, 3, 4}


def test_repeats(long, long_texts):
    got = {r["row"]["f0"]: r for r in suffixes.dedup(long).collect()}
    same = len(" ".join(long_texts[1].split()[:-3]).encode())
    assert got[1]["n_removed"] >= same and got[2]["n_removed"] >= same
    assert len(bytes(got[1]["kept"])) == got[1]["n_bytes"] - got[1]["n_removed"] < 200
    assert (got[3]["n_removed"], len(got[3]["spans"]), got[0]["n_removed"], got[4]["n_removed"]) == (2_000_000, 1, 0, 0)


def test_licences_and_scores(spark, long, long_texts):
    assert {r["doc_id"]: r["digest"] for r in licenses.scan(long).collect()} == {k: licenses.digest_of(t or "") for k, t in enumerate(long_texts)}
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(5)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(long, toxicity.train(long, labels)).collect())


def test_pieces(long, long_texts):
    rows = packing.packed(long).collect()
    want = {k: [*packing.token_ids(t or "", packing.vocabulary()), 0] for k, t in enumerate(long_texts)}
    covered = {}
    for r in rows:
        ids = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    assert covered == {k: len(v) for k, v in want.items()}


def test_shards_and_media(spark, long, long_texts):
    from axonframe.llm import common

    rows = long.selectExpr("doc_id", "cast(length(coalesce(text, '')) as long) AS n")
    got = sharding.shuffle_into_shards(rows, common.Scratch(spark), ["doc_id", "n"], 3).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1, 2, 3, 4] and {(r["shard"], r["slot"]) for r in got} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)}
    for r in matroska.digest(long).collect():
        payload = matroska.padded(raw(long_texts)[r["doc_id"]])
        assert (r["n_bytes"], r["payload_sha256"]) == (len(raw(long_texts)[r["doc_id"]]), hashlib.sha256(payload).hexdigest())


def test_conversations_with_long_messages_and_clashing_columns(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, msg string, seq string, opened string, turns string, loss string, formatted string, e string"
    extra = ("x",) * 7
    texts = ["#" * 2_000_000, "<\\" * 700_000, "", None, "plain"]
    rows = [(1, k, ("user", "assistant")[k % 2], t, *extra) for k, t in enumerate(texts)] + [(None, 0, None, "no id", *extra)]
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "conversations.parquet"))
        got = {r["conv_id"]: r for r in chat.query(spark, str(tmp_path / name)).collect()}
        assert got[-7]["n_turns"] == 2 and len(got) == (3 if data else 1)
    got = {r["conv_id"]: r for r in chat.query(spark, str(tmp_path / "some")).collect()}
    said = "".join(f"{('user', 'assistant')[k % 2]}\n{t or ''}\n" for k, t in enumerate(texts))
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256((texts[1] + "").encode()).hexdigest() and got[1]["loss_chars"] == 2_100_000


def test_ids_are_those_of_the_slower_reader():
    """Every code point, alone, doubled, and between letters, digits, marks and white space; special tokens; long runs."""
    from tokenizers import Tokenizer

    path = packing.vocabulary()
    slow = Tokenizer.from_file(path)
    special = [x.content for x in slow.get_added_tokens_decoder().values()]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    frames = ["a{0}b {0}{0} 1{0}2 \n{0} '{0}s. ", " {0}", "x {0}\t{0}y\u3000{0}"]
    texts = []
    for k in range(0, len(points), 997):
        frame = frames[k // 997 % len(frames)]
        texts.append("".join(frame.format(c) for c in points[k : k + 997]))
    texts += [s + "a" + s for s in special] + [" " * 5000 + "x", "ab" * 5000, "\n" * 3000, "7" * 4000, "don't WE'LL I'M 'tis''s"]
    want = slow.encode_batch(texts, add_special_tokens=False)
    for t, w in zip(texts, want, strict=True):
        assert packing.token_ids(t, path) == w.ids
