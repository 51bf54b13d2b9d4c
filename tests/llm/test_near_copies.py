"""Near copies by the Jaccard similarity of their shingles, against all pairs."""

from itertools import combinations

import numpy as np
import pytest

from axonframe.llm import simhash


def shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def kept_by_force(texts, least=0.8):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(k):
        return k if root[k] == k else top(root[k])

    near = 0
    for a, b in combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            near += 1
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {k for k in range(len(texts)) if root[k] == k}, near


def edited_texts():
    """Groups around and far above the threshold, with chains: each text is an edit of one before it."""
    rng, texts = np.random.default_rng(3), []
    for g in range(25):
        size = int(rng.integers(6, 400))
        group = [[f"w{x}" for x in rng.integers(0, 50_000, size)]]
        for _ in range(6):
            copy = list(group[int(rng.integers(len(group)))])
            for _ in range(int(rng.integers(0, 2 + size // 20))):
                copy[int(rng.integers(size))] = f"w{int(rng.integers(50_000))}"
            group.append(copy)
        texts += [" ".join(x) for x in group]
    return texts


@pytest.mark.parametrize("chunk", [simhash.SHINGLES, 300])
def test_kept_rows_are_those_of_all_pairs(spark, chunk):
    texts = edited_texts()
    want, near = kept_by_force(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.kept_of_groups(docs, chunk=chunk).collect()}
    assert near > 50 and len(want) > 50
    assert got == want


@pytest.mark.parametrize(("chunk", "rounds"), [(4000, 8), (4000, 1), (1500, 3)])
def test_large_groups_are_taken_apart(spark, monkeypatch, chunk, rounds):
    """Two templates with many copies each, some at the edge of the threshold, and texts between the two."""
    monkeypatch.setattr(simhash, "STARS", rounds)
    rng = np.random.default_rng(9)
    first = [f"w{x}" for x in rng.integers(0, 1 << 30, 120)]
    second = first[:80] + [f"v{x}" for x in rng.integers(0, 1 << 30, 40)]
    texts = []
    for template, n in ((first, 90), (second, 60)):
        for _ in range(n):
            copy = list(template)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = f"x{int(rng.integers(1 << 30))}"
            texts.append(" ".join(copy))
    for cut in range(70, 120, 4):
        texts.append(" ".join(first[:cut] + second[cut:]))
    texts = [texts[k] for k in rng.permutation(len(texts)).tolist()]
    want, near = kept_by_force(texts)
    assert near > 1000 and 1 < len(want) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.kept_of_groups(docs, chunk=chunk).collect()} == want


def test_texts_below_the_threshold_stay(spark):
    """Simhashes of these agree in over 0.8 of their bits, their shingles don't: 0.68 of them are shared."""
    rng = np.random.default_rng(0)
    words = [f"w{x}" for x in rng.integers(0, 1 << 30, 600)]
    rows = [" ".join(words)]
    for k in range(30):
        copy = list(words)
        for p in range(k % 20, 600, 26):
            copy[p] = f"x{k}x{p}"
        rows.append(" ".join(copy))
    first = shingles(rows[0])
    assert max(len(first & shingles(t)) / len(first | shingles(t)) for t in rows[1:]) < 0.8
    want, _ = kept_by_force(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.kept_of_groups(docs).collect()} == want


def test_fingerprints_link_in_the_pipeline(spark, sf):
    """A template with tails of its own each: few shingles in common as sets, fingerprints within 4 bits; chains of
    fingerprints and of shingles join. The groups are those of all pairs by either rule."""
    import corpus_pipeline

    rng = np.random.default_rng(12)
    template = [f"w{x}" for x in rng.integers(0, 1 << 30, 11)]
    texts = [" ".join(template * 60 + [f"t{k}x{j}" for j in range(12)]) for k in range(5)]
    long = [f"v{x}" for x in rng.integers(0, 1 << 30, 300)]
    texts += [" ".join(long), " ".join([*long[:150], "x", *long[151:]]), " ".join(f"y{x}" for x in rng.integers(0, 1 << 30, 80)), "", "  "]
    prints = simhash.fingerprints_of([t.encode() for t in texts]).tolist()
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    only = 0
    for a, b in combinations(range(len(texts)), 2):
        near, like = (prints[a] ^ prints[b]).bit_count() <= 4, len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        only += near and not like
        if near or like:
            group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    assert only >= 10 and 3 <= len(set(group)) < len(kept_by_force(texts)[0])
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()} == set(group)
