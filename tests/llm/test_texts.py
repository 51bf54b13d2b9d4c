"""Fingerprints, near-duplicates, repeats, licences and toxicity against brute force."""

import hashlib
import zlib
from itertools import combinations

import numpy as np
import pytest

from axonframe.llm import common, fingerprints, licenses, registry, simhash, suffixes, toxicity
from tests.frames import same


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# --- fingerprints --------------------------------------------------------------------------------------------------


def naive_entropy(window: bytes) -> int:
    total = sum(int(fingerprints._COUNTED[window.count(b)]) for b in set(window))
    return fingerprints.BINS - total * fingerprints.BINS // int(fingerprints._COUNTED[fingerprints.WIDTH])


def test_entropies_are_those_of_each_window():
    rng = np.random.default_rng(2)
    body = np.concatenate((rng.integers(97, 103, 200), np.full(60, 32), rng.integers(0, 256, 90))).astype(np.uint8)
    got = fingerprints.entropies(body)
    w = fingerprints.WIDTH
    assert got.tolist() == [naive_entropy(body[k : k + w].tobytes()) for k in range(len(body) - w + 1)]
    assert got.min() == 0 and got.max() <= fingerprints.BINS


def test_chains_do_not_depend_on_neighbours():
    rank = np.arange(fingerprints.BINS + 1) % 97
    parts = [bytes(np.random.default_rng(k).integers(97, 123, n, dtype=np.uint8)) for k, n in enumerate((5, 31, 32, 33, 63, 64, 500, 9000, 0, 1))]
    together = fingerprints.chains(parts, rank)
    alone = [fingerprints.chains([p], rank)[0] for p in parts]
    assert all(np.array_equal(a, b) for a, b in zip(together, alone, strict=True))
    assert len(together[8]) == 0 and all(len(c) for k, c in enumerate(together) if k != 8)


def test_likeness_is_symmetric_and_bounded():
    rank = np.arange(fingerprints.BINS + 1)
    rng = np.random.default_rng(3)
    a, b = (bytes(rng.integers(97, 123, 6000, dtype=np.uint8)) for _ in range(2))
    x, y, z, none = fingerprints.chains([a, b, a[:3000] + b[:3000], b""], rank)
    assert fingerprints.likeness(x, x) == 1 == fingerprints.likeness(none, none)
    assert fingerprints.likeness(x, none) == 0
    assert fingerprints.likeness(x, y) < 0.05 < 0.25 < fingerprints.likeness(x, z) < 0.8
    assert fingerprints.likeness(x, z) == fingerprints.likeness(z, x)


def next_texts(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] is not None, r[1] or ""))
    return [(a, b[1] or "") for a, b in zip(order, order[1:] + order[:1], strict=True)]


def test_each_document_meets_the_next(odd):
    got = fingerprints.against_next(odd, slice_rows=3).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    want = sorted((str(i), len(t or ""), hashlib.sha256(fingerprints.edit(t or "", n).encode()).hexdigest()) for (i, t), n in next_texts(rows))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == want
    same_text = {r["fingerprint"] for r in got if r["doc_id"] in (7, 8)}
    assert len(same_text) == 1
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))


def test_fingerprints_of_empty_and_single_tables(spark, empty):
    assert fingerprints.against_next(empty).count() == 0
    one = spark.createDataFrame([(5, "a single text " * 20)], "doc_id long, text string")
    row = fingerprints.against_next(one).first()
    assert row["near_next"] == 1


def test_the_query_links_edits_not_neighbours(spark, sf):
    got = registry.QUERIES["op1_fingerprints"](spark, sf).collect()
    long = [r for r in got if r["n_chars"] > 300]
    assert sum(r["near_edited"] > max(0.1, r["near_next"]) or r["near_next"] == 1 for r in long) > 0.97 * len(long)
    order = sorted(got, key=lambda r: -r["doc_id"])
    docs = dict(texts_of(common.documents(spark, sf)))
    for r, n in zip(order, order[1:] + order[:1], strict=True):
        assert r["edited_sha256"] == hashlib.sha256(fingerprints.edit(docs[r["doc_id"]], docs[n["doc_id"]]).encode()).hexdigest()
        assert (r["fingerprint"] == n["fingerprint"]) <= (r["near_next"] == 1)


# --- SimHash -------------------------------------------------------------------------------------------------------


def naive_simhash(text: str, words: int = 4) -> int:
    import re

    import xxhash

    parts = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    if not parts:
        return 0
    shingles = [b" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def naive_components(fps, bits=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(fps)), 2):
        if (int(fps[a]) ^ int(fps[b])).bit_count() <= bits:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def test_hash_is_that_of_spark(spark):
    import xxhash
    from pyspark.sql import functions as F

    text = "four words of text é"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_design_covers_every_four_positions():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in combinations(range(8), 4))


def test_simhash_query_matches_brute_force(spark, sf):
    got = sorted(registry.QUERIES["op3_simhash"](spark, sf).collect())
    docs = sorted(texts_of(common.documents(spark, sf)))
    fps = [naive_simhash(t) for _, t in docs]
    assert [r["fingerprint"] for r in got] == [f"{f:016x}" for f in fps]
    assert [r["component_id"] for r in got] == [docs[k][0] for k in naive_components(fps)]


@pytest.mark.parametrize("chunk", [5, 4096])
def test_links_join_what_is_linked(spark, chunk):
    """Dense balls, chains and lone points; with small chunks long lists are dealt out in pairs of chunks."""
    rng = np.random.default_rng(4)
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    fps = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    for base in list(fps)[:3]:
        fps |= {flip(base, int(rng.integers(1, 6))) for _ in range(60)}
        x = base
        for _ in range(15):
            x = flip(x, 4)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    scratch = common.Scratch(spark)
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links_between(nodes, scratch, chunk=chunk), scratch).collect()}
    want = naive_components(fps)
    groups = {}
    for s, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(s)
    for members in groups.values():
        assert {roots.get(s, s) for s in members} == {min(members)} if len(members) > 1 else roots.get(next(iter(members))) is None


def test_simhash_of_odd_rows(odd, empty):
    found, named = simhash.near_duplicates(odd)
    ids = {r["fp"]: r["component_id"] for r in named.collect()}
    rows = found.collect()
    assert len(rows) == odd.count()
    assert ids[0] == 2
    assert len({ids[r["fp"]] for r in rows if r["doc_id"] in (7, 8)}) == 1
    assert simhash.near_duplicates(empty)[0].count() == 0


@pytest.mark.parametrize("sides", [False, True])
def test_walked_postings_link_what_all_pairs_link(sides):
    """One key's list: bytes at the triple are equal, others are near or far."""
    rng = np.random.default_rng(8)
    for triple in (0, 7, 19):
        key = sum(int(rng.integers(256)) << 8 * p for p in simhash.TRIPLES[triple])
        free = [8 * p + b for p in range(8) if p not in simhash.TRIPLES[triple] for b in range(8)]
        fps = []
        for k in range(90):
            base = key if k % 9 == 0 else fps[k - 1]
            flips = rng.choice(free, 20 if k % 9 == 0 else int(rng.integers(1, 7)), replace=False)
            fps.append(base ^ sum(1 << int(b) for b in flips))
        fps = np.array(sorted(set(fps)), np.uint64)
        side = rng.integers(0, 2, len(fps)) == 1 if sides else None
        parent = list(range(len(fps)))

        def find(x, parent=parent):
            return x if parent[x] == x else find(parent[x])

        linked = lambda a, b: (int(fps[a]) ^ int(fps[b])).bit_count() <= 4 and (side is None or side[a] != side[b])  # noqa: E731, B023
        want = [p for p in combinations(range(len(fps)), 2) if linked(*p)]
        u, v = (x.view(np.uint64).tolist() for x in simhash.tree_links(fps, triple, side))
        at = {int(f): k for k, f in enumerate(fps)}
        for a, b in zip(u, v, strict=True):
            assert linked(at[a], at[b])
            assert find(at[a]) != find(at[b])
            parent[find(at[a])] = find(at[b])
        assert want and all(find(a) == find(b) for a, b in want)


# --- suffixes ------------------------------------------------------------------------------------------------------


def naive_removed(texts, length):
    seen = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        out.append(gone)
    return out


@pytest.mark.parametrize("letters", [1, 2, 5, 250])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for n in (*range(12), 64, 300):
        s = rng.integers(1, letters + 1, n)
        assert suffixes.suffix_array(s.astype(np.int64)).tolist() == sorted(range(n), key=lambda k: s[k:].tolist())


def planted(seed, n, length):
    """Texts with shared passages around the length, copies, periodic runs and near copies."""
    rng = np.random.default_rng(seed)
    word = lambda k: bytes(rng.integers(97, 123, k, dtype=np.uint8)).decode()
    shared = [word(k) for k in (length - 1, length, length + 1, 3 * length)]
    out = []
    for k in range(n):
        t = word(int(rng.integers(0, 3 * length)))
        for _ in range(int(rng.integers(0, 3))):
            t += shared[int(rng.integers(4))] + word(int(rng.integers(0, 30)))
        if k % 5 == 0:
            t += "ab" * int(rng.integers(0, length))
        out.append(t)
    out += [out[1], out[2], out[3][:-1] + "?", "é" * length, "x" + "é" * length, "z" * (length - 1), "z" * length, "q" * (length + 1), "", None]
    return out


def around_a_passage(length):
    """Many texts that share one passage a little shorter than the window, between parts that differ or repeat in part;
    texts of one letter, of two letters by turns, and of long repeated blocks."""
    rng = np.random.default_rng(11)
    word = lambda k: bytes(rng.integers(97, 123, k, dtype=np.uint8)).decode()
    passage, ends = word(length - 12), [word(40) for _ in range(6)]
    out = [word(30) + ends[int(rng.integers(6))][: int(rng.integers(41))] + passage + ends[int(rng.integers(6))][int(rng.integers(41)) :] + word(30) for _ in range(60)]
    block = word(3 * length)
    return [*out, "z" * 5000, "z" * 700, "ab" * 2500, "ab" * 300 + "a", block * 9, word(4000) + block + word(2000), word(6000)]


@pytest.mark.parametrize(("kind", "group", "block", "length"), [(0, None, None, 80), (0, 1, None, 80), (0, None, 256, 80), (0, None, None, 200), (1, 2000, None, 100), (1, 2000, 300, 100), (1, None, 1 << 10, 200)])
def test_repeats_match_brute_force(spark, monkeypatch, kind, group, block, length):
    if group:
        monkeypatch.setattr(suffixes, "GROUP_BYTES", group)
    if block:
        monkeypatch.setattr(suffixes, "BLOCK", block)
    texts = around_a_passage(length) if kind else planted(5, 40, length)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["row"]["f0"]: r for r in suffixes.dedup(df, length).collect()}
    raw = [(t or "").encode() for t in texts]
    assert len(got) == len(texts)
    for k, gone in enumerate(naive_removed(raw, length)):
        r, edges = got[k], np.flatnonzero(np.diff([0, *map(int, gone), 0]))
        assert r["n_bytes"] == len(raw[k]) and r["n_removed"] == sum(gone)
        assert [(s["start"], s["end"]) for s in r["spans"]] == list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        assert bytes(r["kept"]) == bytes(b for b, g in zip(raw[k], gone, strict=True) if not g)


def test_ranges_hold_the_starts_and_no_other():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 50, 400):
        group = np.sort(rng.integers(0, 5, n))
        start = np.concatenate([np.cumsum(rng.choice([1, 1, 1, 2, 7], int(m))) for m in np.bincount(group, minlength=5)]).astype(np.int64)
        got = {(g, f + k * s) for g, f, s, t in zip(*(x.tolist() for x in suffixes.ranges(group, start)), strict=True) for k in range(t)}
        assert got == set(zip(group.tolist(), start.tolist(), strict=True))
    assert [len(x) for x in suffixes.ranges(np.zeros(10_000, int), np.arange(10_000))] == [1] * 4


def test_a_long_text_of_one_letter(spark):
    rows = suffixes.dedup(spark.createDataFrame([(1, "m" * 6_000_000), (2, "n" * 150)], "doc_id long, text string")).collect()
    assert {(r["row"]["f0"], r["n_bytes"], r["n_removed"], len(r["spans"])) for r in rows} == {(1, 6_000_000, 6_000_000, 1), (2, 150, 0, 0)}


def test_repeats_query_matches_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in registry.QUERIES["op4_suffixes"](spark, sf).collect()}
    docs = texts_of(common.documents(spark, sf))
    raw = [t.encode() for _, t in docs]
    for (i, _), t, gone in zip(docs, raw, naive_removed(raw, 200), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(t), sum(gone), hashlib.sha256(kept).hexdigest())


def test_repeats_of_odd_rows(odd, empty):
    rows = suffixes.dedup(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["row"]["f0"] in (7, 8):
            assert r["n_removed"] == r["n_bytes"] == 640
    assert suffixes.dedup(empty).count() == 0


# --- licences ------------------------------------------------------------------------------------------------------


def test_licence_rules_in_python_and_spark_agree(spark, odd):
    from pyspark.sql import functions as F

    for text in [t for _, t in texts_of(odd)] + [t for _, t in licenses.TEXTS]:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(F.sha2(licenses.one_line(licenses.normalised(F.col("t"))), 256)).first()[0] == licenses.digest_of(text)


def test_licences_survive_what_does_not_matter(spark):
    mit = licenses.TEXTS[0][1]
    texts = [mit, mit.upper().replace("\n", "\r\n"), mit.replace("<year> <copyright holders>", "1999 Someone, all rights").replace(",", ";"), mit.replace("Licen", "Licen").replace("License", "Licence"), mit + " and more", "words\nReleased under the MIT  licence\nwords\n* Licensed under the Apache License, Version 2.0", None]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["license"] for r in got] == ["MIT"] * 4 + [None] * 3
    assert [r["line_licenses"] for r in got][5:] == ["Apache-2.0,MIT", ""]


def test_licence_query_matches_sql(spark, sf, duck):
    same(registry.QUERIES["op6_licenses"](spark, sf), duck, registry.ORACLES["op6_licenses"])


def test_licences_of_odd_rows(odd, empty):
    assert licenses.scan(odd).count() == odd.count()
    assert licenses.scan(empty).count() == 0


# --- toxicity ------------------------------------------------------------------------------------------------------


def test_grams_are_those_of_each_text_alone():
    texts = [b"One two, three one", b"", b"word", b"three two one two", "é\tü".encode()]
    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    text, gram = toxicity.hashed_grams(np.frombuffer(b"".join(texts), np.uint8), ends)
    for k, t in enumerate(texts):
        alone = toxicity.hashed_grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1]
        assert sorted(gram[text == k]) == sorted(alone)
    assert len(toxicity.hashed_grams(np.frombuffer(texts[3], np.uint8), np.array([0, 16]))[1]) >= 4 + 3 + 2


def test_held_out_rows_are_scored_well(spark):
    """Large enough to learn from: sf0.1's labels, whose held-out fifth the model never sees."""
    from tests.conftest import DATA

    sf = str(DATA / "sf0.1")
    got = {r["doc_id"]: r for r in registry.QUERIES["op8_toxicity"](spark, sf).collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(got[i]["score"], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97
    assert sum(s >= 0.5 for s in good) > 0.75 * len(good)
    assert sum(s >= 0.5 for s in bad) < 0.02 * len(bad)


def test_scores_ignore_held_out_labels(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = common.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.bias == b.bias and np.array_equal(a.index, b.index) and np.array_equal(a.weight, b.weight)


def test_toxicity_of_odd_rows(spark, odd, empty):
    none = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(odd, none).collect()} == {0.0}
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (7, None), (None, 1), (10, 0), (6, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.accepted(odd, model).columns == odd.columns
    assert toxicity.score(empty, model).count() == 0 and toxicity.accepted(empty, model).count() == 0
