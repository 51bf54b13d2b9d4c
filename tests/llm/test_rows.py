"""Mixing, chat formatting, packing, sharding and media against brute force, and the pipeline's stages."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from axonframe.llm import chat, common, matroska, mixing, packing, registry, sharding
from tests.frames import same

# --- mixing --------------------------------------------------------------------------------------------------------


def shared_out(sizes, weights, most):
    """Targets by sharing the excess again and again."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[k] for k in capped)
        weight = sum(w for k, w in enumerate(weights) if k not in capped)
        target = [most * s if k in capped else rest * weights[k] / weight if weight else 0.0 for k, s in enumerate(sizes)]
        over = {k for k, s in enumerate(sizes) if k not in capped and target[k] > most * s + 1e-9}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [[100, 1, 50, 7], [5], [0, 0], [1000, 1, 1, 1, 1, 1, 1], [10, 20, 30, 40, 50, 60, 70]])
def test_targets_share_the_excess(spark, sizes):
    rows = [(k, f"0s{k:02}", n, "p") for k, n in enumerate(sizes)]
    got = mixing.source_targets(spark.createDataFrame(rows, "doc_id long, source_key string, size long, place string")).orderBy("source_key").collect()
    want = shared_out(sizes, [k % 3 + 1 for k in range(len(sizes))], 3) if sum(sizes) else [0.0] * len(sizes)
    assert [r["target"] for r in got] == pytest.approx(want)


def test_mixing_query_matches_sql(spark, sf, duck):
    same(registry.QUERIES["op2_mixing"](spark, sf), duck, registry.ORACLES["op2_mixing"])


def test_sources_come_to_their_targets(spark, sf):
    rows = [r.asDict() | {"source": s} for r, s in ((r, r["source_key"]) for r in mixing.mix(mixing.measured(common.documents(spark, sf))).collect())]
    assert all(r["taken"] <= 3 * r["size"] and sum(r["takes"]) == r["taken"] for r in rows)
    for key in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == key]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5
        at = [p for r in own for p, t in zip(r["positions"], r["takes"], strict=True) if t]
        assert all(0 <= p <= 1 for p in at)


def test_demand_is_inverted(spark):
    for tilt in (-0.5, 0.0, 0.5):
        df = spark.range(11).select((F.col("id") / 10).alias("x")).select("x", mixing.demand_inverse(F.col("x"), F.lit(tilt)).alias("t"))
        for r in df.collect():
            assert r["t"] + tilt * (r["t"] ** 2 - r["t"]) == pytest.approx(r["x"], abs=1e-12)


def test_order_is_by_position(spark, sf):
    got = registry.QUERIES["op2_mixing"](spark, sf).collect()
    at = [r["position"] if r["position"] is not None else 2.0 for r in got]
    assert at == sorted(at)


def test_mixing_of_odd_rows(odd, empty):
    got = mixing.mix(mixing.measured(odd)).collect()
    assert len(got) == odd.count()
    assert sum(r["taken"] for r in got if r["source_key"] == "1") <= 3 * 5
    assert mixing.training_order(mixing.mix(mixing.measured(empty))).count() == 0


# --- chat ----------------------------------------------------------------------------------------------------------


def test_chat_query_matches_sql(spark, sf, duck):
    same(registry.QUERIES["op5_chat"](spark, sf), duck, registry.ORACLES["op5_chat"])


def test_events_fold_to_final_messages(spark):
    log = [
        (1, 1, 1, "open", "user", None), (1, 2, 1, "delta", None, "Hel"), (1, 3, 1, "delta", None, "lo"),
        (1, 4, 2, "open", "assistant", None), (1, 5, 2, "delta", None, "bad"), (1, 6, 2, "regenerate", None, "ignored"), (1, 7, 2, "delta", None, "go"), (1, 8, 2, "delta", None, "od"),
        (1, 9, 1, "edit", None, "Hi"), (1, 10, 1, "delta", None, "!"), (1, 11, 3, "open", "user", "gone"), (1, 12, 3, "retract", None, None),
        (2, 1, 1, "open", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string")
    got = sorted((r["conv_id"], r["opened"], r["role"], r["text"]) for r in chat.fold(events.orderBy(F.rand(3))).collect())
    assert got == [(1, 1, "user", "Hi!"), (1, 4, "assistant", "good"), (2, 1, "", "")]


TRICKY = ["\\", "\\\\b", "#", "### Assistant: ", "<turn>### ", "</turn>\n", "\\h\\l\\b", ": ", "", "é\U0001f600", "\n\n", "</turn", "a" * 300]


def test_any_text_comes_back(spark):
    rng = np.random.default_rng(1)
    turns = []
    for conv in range(60):
        for turn in range(int(rng.integers(1, 6))):
            role = str(rng.choice(["user", "assistant", "Assistant", "a: b", "<x>", "#\\"]))
            turns.append((conv, turn, role, "".join(rng.choice(TRICKY, int(rng.integers(0, 6))))))
    turns += [(99, 0, "user", "x")] * 3 + [(99, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(chat.as_events(df)))).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r or "", x or "") for _, _, r, x in own]
        assert got[conv]["trained"] == "".join(x for _, _, r, x in own if (r or "").lower() == "assistant")
        assert got[conv]["formatted"].count("<turn>### ") == len(own)


def test_an_empty_log(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.render(chat.fold(chat.as_events(df)))).count() == 0


# --- packing -------------------------------------------------------------------------------------------------------


def best_fit(lengths, window):
    """Best-fit decreasing one piece at a time: the open capacities at the end, and how many windows."""
    room, n = [], 0
    for x in sorted(lengths, reverse=True):
        fit = [c for c in room if c >= x]
        if fit:
            room.remove(min(fit))
            c = min(fit)
        else:
            c, n = window, n + 1
        room.append(c - x)
    return sorted(room), n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    window = 32
    histogram = {x: lengths.count(x) for x in set(lengths)}
    used = {}
    for length, first, n, start, each, offset in packing.plan(histogram, window):
        assert offset + each * length <= window
        for r in range(n):
            used.setdefault(start + r // each, []).append((offset + r % each * length, length))
        assert 0 <= first <= histogram[length] - n
    want, windows = best_fit(lengths, window)
    assert len(used) == windows and sorted(used) == list(range(windows))
    for spans in used.values():
        end = 0
        for a, n in sorted(spans):
            assert a == end
            end = a + n
    assert sorted(window - sum(n for _, n in s) for s in used.values()) == want


def test_plan_is_bounded_by_the_window():
    rng = np.random.default_rng(1)
    small = {k: int(rng.integers(0, 100)) for k in range(1, 1025)}
    large = {k: int(rng.integers(0, 10**9)) for k in range(1, 1025)}
    assert len(packing.plan(large)) < 1024 * 64 and len(packing.plan(small)) < 1024 * 64
    pieces = sum(large.values())
    tokens = sum(k * n for k, n in large.items())
    windows = max(first + -(-n // each) for _, _, n, first, each, _ in packing.plan(large))
    assert pieces == sum(m[2] for m in packing.plan(large)) and windows < 1.01 * tokens / 1024


def test_ids_are_those_of_tokenizers(spark, sf):
    from tokenizers import Tokenizer

    path = packing.vocabulary()
    reader = Tokenizer.from_file(path)
    texts = [t[0] or "" for t in common.documents(spark, sf).select("text").collect()]
    texts += ["", " ", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "  x   y\n\n z\t\tq", "don't I'LL we've 3.14 １２", "é́ \x00\x7f\U0001f600" * 9, " " * 5000, "a" * 5000, "　  x y"]
    for text in texts:
        assert packing.token_ids(text, path) == reader.encode(text, add_special_tokens=False).ids


def test_packing_query_is_whole(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in common.documents(spark, sf).collect()}
    got = registry.QUERIES["op7_packing"](spark, sf).collect()
    path, by_doc, by_seq = packing.vocabulary(), {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    total = 0
    for i, rows in by_doc.items():
        ids = np.array([*packing.token_ids(docs[i], path), 0], "<u4")
        rows.sort(key=lambda r: r["start"])
        assert [r["start"] for r in rows] == np.cumsum([0, *(r["length"] for r in rows[:-1])]).tolist()
        assert sum(r["length"] for r in rows) == len(ids) == rows[0]["doc_tokens"]
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in rows)
        total += len(ids)
    for rows in by_seq.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == np.cumsum([0, *(r["length"] for r in rows[:-1])]).tolist()
        assert sum(r["length"] for r in rows) <= 1024
    assert len(by_seq) * 1024 < 1.05 * total + 1024


def test_packing_of_odd_rows(odd, empty):
    got = packing.packed(odd).collect()
    assert sum(r["start"] == 0 for r in got) == odd.count()
    assert packing.packed(empty).count() == 0


# --- sharding ------------------------------------------------------------------------------------------------------


def test_matrix_has_both_margins():
    rng = np.random.default_rng(5)
    for total in ([0] * 7, [1] * 30, rng.integers(0, 500, 100).tolist(), [10**10, 3, 0, 5 * 10**9]):
        m = sharding.communication_matrix(total, 24, 3)
        assert m.sum(1).tolist() == total and m.min() >= 0
        assert m.sum(0).max() - m.sum(0).min() <= 1


def test_matrix_follows_the_law():
    """Over many seeds one cell's mean and variance are those of the hypergeometric law."""
    cells = [int(sharding.communication_matrix([30, 50, 40], 4, s)[1, 2]) for s in range(3000)]
    n, good, draws = 120, 30, 50
    mean = draws * good / n
    var = mean * (1 - good / n) * (n - draws) / (n - 1)
    assert abs(np.mean(cells) - mean) < 4 * (var / 3000) ** 0.5
    assert abs(np.var(cells) / var - 1) < 0.15


def test_sharding_query_is_exact(spark, sf):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in common.documents(spark, sf).collect()}
    got = registry.QUERIES["op9_sharding"](spark, sf).collect()
    again = registry.QUERIES["op9_sharding"](spark, sf).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert {r["doc_id"] for r in got} == set(docs) and len(got) == len(docs)
    slots = {}
    for r in got:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(docs[r["doc_id"]]) + 8, zlib.crc32(docs[r["doc_id"]]), "rows", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def test_shuffle_is_uniform(spark):
    rows = spark.range(4800).select(F.col("id").alias("k"))
    got = sharding.shuffle_into_shards(rows, common.Scratch(spark), ["k"], shards=8, buckets=16).collect()
    quarter = np.zeros((8, 4))
    for r in got:
        quarter[r["shard"], r["k"] * 4 // 4800] += 1
    chi2 = ((quarter - 150) ** 2 / 150).sum()
    assert chi2 < 60  # 21 degrees of freedom
    slot = np.corrcoef([r["k"] for r in got], [r["slot"] for r in got])[0, 1]
    assert abs(slot) < 0.06


def test_sharding_of_odd_rows(spark, odd, empty):
    for df in (odd, empty):
        rows = common.pick(df, doc_id="doc_id", text="text").select("doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
        got = sharding.shuffle_into_shards(rows, common.Scratch(spark), ["doc_id", "text_crc32"]).collect()
        assert len(got) == df.count() and len({(r["shard"], r["slot"]) for r in got}) == len(got)


# --- Matroska ------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 200))
def test_payloads_come_back(part, times):
    payload = part * times
    samples, rows = matroska.demux(matroska.mux(payload))
    assert samples == payload
    assert all(r.cued for r in rows) and sum(r.size for r in rows) == len(payload)
    assert [r.timestamp_ns for r in rows] == sorted(r.timestamp_ns for r in rows)


def test_every_lacing_and_unknown_sizes_parse():
    frames = [b"a" * 300, b"b" * 5, b"c" * 70]
    head = b"\x82" + (40).to_bytes(2, "big")
    xiph = head + b"\x02" + bytes([2, 255, 45, 5]) + b"".join(frames)
    none = head + b"\x80" + b"single"
    fixed = head + b"\x84" + bytes([1]) + b"xxyy"
    e = matroska.element
    group = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, xiph) + matroska.number(matroska.REFERENCE, 1))
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska.number(matroska.TIMESTAMP, 1000) + group + e(matroska.SIMPLE_BLOCK, none)
    second = e(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, 2000) + e(matroska.SIMPLE_BLOCK, fixed))
    data = e(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + e(matroska.INFO, matroska.number(matroska.SCALE, 500_000)) + cluster + second
    got = matroska.packets(data)
    assert [data[p.offset : p.offset + p.size] for p in got] == [*frames, b"single", b"xx", b"yy"]
    assert [p.timestamp_ns // 500_000 for p in got] == [1040] * 4 + [2040] * 2
    assert [p.keyframe for p in got] == [False] * 3 + [True] * 3 and {p.track for p in got} == {2}
    assert len({p.cluster for p in got}) == 2


@given(st.integers(0, (1 << 56) - 2))
def test_sizes_of_any_length(n):
    assert matroska._vint(matroska.vint(n), 0, False) == (n, len(matroska.vint(n)))


def test_broken_files_are_reported(spark):
    whole = matroska.mux(b"payload " * 100)
    rows = [(1, whole), (2, whole[:-60]), (3, b"\x00\x01"), (4, None), (5, whole[:7])]
    got = matroska.packet_table(spark.createDataFrame(rows, "k long, d binary"), "k", "d").collect()
    assert {r["key"] for r in got if r["error"]} == {2, 3, 5}
    assert all(r["error"] is None for r in got if r["key"] == 1) and not [r for r in got if r["key"] == 4]


def test_media_query(spark, sf, odd, empty):
    for df in (common.documents(spark, sf), odd):
        texts = df.select("doc_id", "text").collect()
        got = matroska.digest(df).collect()
        want = []
        for r in texts:
            raw = (r["text"] or "").encode()
            payload = raw + bytes(-len(raw) % 64 if raw else 64)
            media = matroska.mux(payload)
            want.append((str(r["doc_id"]), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()))
        assert sorted((str(r["doc_id"]), *r[1:7]) for r in got) == sorted(want)
        assert all(r["payload_bytes"] % 64 == 0 < r["payload_bytes"] for r in got)
    assert matroska.digest(empty).count() == 0
