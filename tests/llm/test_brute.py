"""Whole queries against plain second versions: loops over Python numbers that share only the parameters."""

import base64
import hashlib
import math
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.llm import common, fingerprints, matroska, registry, sharding, toxicity

WORD64 = (1 << 64) - 1


@pytest.fixture(scope="module")
def small(spark, sf, odd):
    """(doc_id, text) of some documents of the test data and of the odd rows."""
    docs = [tuple(r) for r in common.documents(spark, sf).orderBy("doc_id").limit(40).select("doc_id", "text").collect()]
    return docs + [(r["doc_id"] and r["doc_id"] + 1_000_000, r["text"]) for r in odd.collect() if len(r["text"] or "") < 5000]


@pytest.fixture(scope="module")
def small_table(spark, small):
    return spark.createDataFrame(small, "doc_id long, text string")


# --- fingerprints --------------------------------------------------------------------------------------------------


def naive_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & WORD64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & WORD64
    return x ^ x >> 31


def naive_hash(window):
    h = 0x9E3779B97F4A7C15
    for k in range(0, len(window), 8):
        h = naive_mix(h ^ int.from_bytes(window[k : k + 8], "little")) + k // 8 & WORD64
    return naive_mix(h)


def naive_bins(text):
    w = fingerprints.WIDTH
    part = lambda n: round(n * math.log2(n) * (1 << 20))
    return [fingerprints.BINS - sum(part(c) for c in Counter(text[k : k + w]).values()) * fingerprints.BINS // part(w) for k in range(len(text) - w + 1)]


def naive_chain(text, rank):
    w, wins = fingerprints.WIDTH, Counter()
    if not text:
        return []
    if len(text) < w:
        features = [naive_hash(text.ljust(w, b"\0") + bytes([len(text)]) + bytes(7))]
    else:
        ranks = [rank[b] for b in naive_bins(text)]
        for k in range(max(1, len(ranks) - w + 1)):
            wins[min(range(k, min(k + w, len(ranks))), key=lambda j: (ranks[j], j))] += 1
        fit = {k for k in wins if ranks[k] < fingerprints.BINS} or set(wins)
        least = min(fingerprints.WINS, max(wins[k] for k in fit))
        features = list(dict.fromkeys(naive_hash(text[k : k + w]) for k in sorted(fit) if wins[k] >= least))
    out = []
    for k, h in enumerate(features):
        if k % fingerprints.CAPACITY == 0:
            out.append(set())
        out[-1] |= {(h >> 11 * p) % fingerprints.FILTER_BITS for p in range(fingerprints.PROBES)}
    return out


def naive_bytes(chain):
    return b"".join(sum(1 << fingerprints.FILTER_BITS - 1 - b for b in f).to_bytes(fingerprints.FILTER_BITS // 8, "big") for f in chain)


def naive_likeness(x, y):
    if not x or not y:
        return float(len(x) == len(y))
    if x == y:
        return 1.0
    if (sum(map(len, y)), naive_bytes(y)) < (sum(map(len, x)), naive_bytes(x)):
        x, y = y, x
    total = 0.0
    for f in x:
        best = 0.0
        for g in y:
            most, chance = min(len(f), len(g)), len(f) * len(g) / fingerprints.FILTER_BITS
            floor = chance + fingerprints.MARGIN * (most - chance)
            best = max(best, (len(f & g) - floor) / max(most - floor, 1e-9))
        total += min(1.0, best) * len(f)
    return total / sum(map(len, x))


def test_fingerprints_of_a_whole_table(small, small_table):
    counts = Counter(b for _, t in small for b in naive_bins((t or "").encode()))
    rank = dict.fromkeys(range(fingerprints.BINS + 1), fingerprints.BINS)
    for k, b in enumerate(sorted(range(fingerprints.LEAST, fingerprints.BINS + 1), key=lambda b: (counts[b], b))):
        rank[b] = min(k, fingerprints.BINS - 1)
    order = sorted(small, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] is not None, r[1] or ""))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = (naive_chain(x.encode(), rank) for x in (t, edited, n))
        text = lambda x: f"sif1:{len(x)}:" + base64.b64encode(naive_bytes(x)).decode()
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), round(naive_likeness(a, b), 9), round(naive_likeness(a, c), 9)))
    got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprints.against_next(small_table).collect()]
    assert sorted(got) == sorted(want)


# --- toxicity ------------------------------------------------------------------------------------------------------


def tox_mix(x):
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & WORD64
    return x ^ x >> 32


def naive_features(text):
    words, now = [], b""
    for b in text + b" ":
        if b >= 128 or chr(b).isalnum():
            now += bytes([b + 32 if 65 <= b <= 90 else b])
        elif now:
            words.append(now)
            now = b""
    poly = lambda w: tox_mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(w)) & WORD64)
    hashes, out = [poly(w) for w in words], set()
    for k, (w, h) in enumerate(zip(words, hashes, strict=True)):
        out.add(tox_mix(h + 1 & WORD64))
        out |= {tox_mix(poly(w[:n]) + n + 16 & WORD64) for n in toxicity.STEMS if len(w) > n}
        out |= {tox_mix(h * 3 + hashes[k + gap] * (2 * gap + 3) + gap & WORD64) for gap in (1, 2) if k + gap < len(words)}
    return {h >> 64 - toxicity.BITS for h in out}


def naive_fit(examples):
    z, n = Counter(), Counter()

    def weight(f):
        l1 = 0.0 if f == "bias" else toxicity.L1
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for features, label in examples:
            at = [*features, "bias"]
            w = {f: weight(f) for f in at}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - label
            for f in at:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w[f]
                n[f] += g * g
    return {f: weight(f) for f in z if weight(f)}


def test_scores_of_a_whole_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in common.documents(spark, sf).collect()]
    toxic = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r["doc_id"] is not None and r["toxic"] is not None:
            toxic[r["doc_id"]] = max(r["toxic"], toxic.get(r["doc_id"], 0))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    ids = sorted((i for i in toxic if not held(i)), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    text = dict(docs)
    weights = naive_fit([(naive_features((text[i] or "").encode()), int(toxic[i] > 0)) for i in ids if i in text])
    assert any(toxic[i] for i in ids) and len(weights) > 10
    got = {r["doc_id"]: r for r in registry.QUERIES["op8_toxicity"](spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        total = weights.get("bias", 0.0) + sum(weights.get(f, 0.0) for f in naive_features((t or "").encode()))
        want = 1 / (1 + math.exp(-max(-35.0, min(35.0, total))))
        assert abs(got[i]["score"] - want) < 1e-9 and got[i]["held_out"] == held(i) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)


# --- sharding ------------------------------------------------------------------------------------------------------


def test_shards_of_a_whole_table(spark, sf):
    """The matrix's counts dealt out by sorting in plain Python; only the hash is Spark's."""
    docs = common.documents(spark, sf).select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    key, seed = ["doc_id", "size", "text_crc32"], sharding.SEED
    rows = [r.asDict() for r in docs.select("*", *(F.xxhash64(*key, F.lit(seed + k)).alias(f"h{k}") for k in range(3))).collect()]
    buckets = {}
    for r in rows:
        buckets.setdefault(r["h0"] % sharding.BUCKETS, []).append(r)
    matrix = sharding.communication_matrix([len(buckets.get(b, [])) for b in range(sharding.BUCKETS)], sharding.SHARDS, seed)
    for b, members in buckets.items():
        dealt = [s for s in range(sharding.SHARDS) for _ in range(matrix[b, s])]
        for r, s in zip(sorted(members, key=lambda r: (r["h1"], r["doc_id"], r["size"], r["text_crc32"])), dealt, strict=True):
            r["shard"] = s
    want = set()
    for s in range(sharding.SHARDS):
        mine = sorted((r for r in rows if r["shard"] == s), key=lambda r: ((r["h2"] & WORD64) >> 64 - sharding.SLICES_BITS, r["h2"], r["doc_id"], r["size"], r["text_crc32"]))
        want |= {(r["doc_id"], r["size"], r["text_crc32"], s, k) for k, r in enumerate(mine)}
    got = registry.QUERIES["op9_sharding"](spark, sf).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got} == want and len(got) == len(rows)


def test_matrices_have_the_law_of_a_uniform_permutation():
    """Every way of dealing 8 rows of 3 buckets to 3 shards, counted, against many draws."""
    rows_in, n = [3, 1, 4], 4000
    bucket = [b for b, k in enumerate(rows_in) for _ in range(k)]
    shard = [0, 0, 0, 1, 1, 1, 2, 2]
    law = Counter()
    for p in permutations(range(8)):
        law[tuple(Counter((bucket[k], shard[p[k]]) for k in range(8)).get((b, s), 0) for b in range(3) for s in range(3))] += 1
    total = sum(law.values())
    drawn = Counter(tuple(sharding.communication_matrix(rows_in, 3, seed).reshape(-1).tolist()) for seed in range(n))
    assert set(drawn) <= set(law)
    chi = sum((drawn[m] - n * c / total) ** 2 / (n * c / total) for m, c in law.items())
    free = len(law) - 1
    assert abs(chi - free) < 5 * math.sqrt(2 * free)


def test_large_draws_have_the_exact_law():
    """Small margins by enumeration, through the sampler of large ones; large ones by their moments."""
    rng = np.random.Generator(np.random.PCG64(5))
    good, bad, left, n = 30, 50, 20, 20_000
    law = [math.comb(good, x) * math.comb(bad, left - x) / math.comb(good + bad, left) for x in range(left + 1)]
    drawn = Counter(sharding.large_draw(rng, good, bad, left) for _ in range(n))
    cells = [x for x in range(left + 1) if n * law[x] > 5]
    chi = sum((drawn[x] - n * law[x]) ** 2 / (n * law[x]) for x in cells)
    assert chi < len(cells) + 5 * math.sqrt(2 * len(cells))
    for good, bad, left in ((2 * 10**9, 46 * 10**9, 4 * 10**7), (10**10, 3 * 10**9, 10**6), (5 * 10**9, 10**9, 6 * 10**9 - 500_000)):
        x = np.array([sharding.large_draw(rng, good, bad, left) for _ in range(400)], float)
        p = good / (good + bad)
        mean, var = left * p, left * p * (1 - p) * (good + bad - left) / (good + bad - 1)
        assert abs(x.mean() - mean) < 5 * math.sqrt(var / len(x)) and abs(x.var() / var - 1) < 0.4
    matrix = sharding.communication_matrix([4 * 10**8] * 25, 24, 7)
    assert matrix.sum(1).tolist() == [4 * 10**8] * 25 and np.ptp(matrix.sum(0)) <= 1 and (matrix >= 0).all()


# --- Matroska ------------------------------------------------------------------------------------------------------


def read_vint(data, at):
    width = next(k for k in range(8) if data[at] & 0x80 >> k) + 1
    return int.from_bytes(data[at : at + width], "big"), width


def naive_tree(data, at, end, parents):
    """(id, offset, body or children) of each element, by the letter of the format."""
    out = []
    while at < end:
        start = at
        ident, width = read_vint(data, at)
        at += width
        size, width = read_vint(data, at)
        size -= 1 << 7 * width
        at += width
        out.append((ident, start, naive_tree(data, at, at + size, parents) if ident in parents else data[at : at + size]))
        at += size
    assert at == end
    return out


def naive_frames(block):
    """The frames of a SimpleBlock of track 1."""
    assert block[0] == 0x81
    lacing, body = block[3] >> 1 & 3, block[4:]
    if lacing == 0:
        return [body]
    count, body = body[0] + 1, body[1:]
    if lacing == 2:
        assert len(body) % count == 0
        return [body[k * len(body) // count : (k + 1) * len(body) // count] for k in range(count)]
    assert lacing == 3
    sizes, at = [], 0
    for k in range(count - 1):
        n, width = read_vint(body, at)
        n -= 1 << 7 * width
        sizes.append(n if k == 0 else sizes[-1] + n - ((1 << 7 * width - 1) - 1))
        at += width
    frames = []
    for n in sizes:
        frames.append(body[at : at + n])
        at += n
    return [*frames, body[at:]]


def naive_media(payload):
    """What a file must hold, read by a second parser, and the features of what is read."""
    data = matroska.mux(payload)
    parents = {0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0x1C53BB6B, 0xBB, 0xB7}
    (head, _, header), (segment, at, body) = naive_tree(data, 0, len(data), parents)
    assert (head, segment) == (0x1A45DFA3, 0x18538067) and dict((i, b) for i, _, b in header)[0x4282] == b"matroska"
    first = body[0][1]  # cue positions count from the segment's body
    kinds = [i for i, _, _ in body]
    assert kinds[:2] == [0x1549A966, 0x1654AE6B] and set(kinds[2:]) <= {0x1F43B675, 0x1C53BB6B}
    track = dict((i, b) for i, _, b in dict((i, b) for i, _, b in dict((i, b) for i, _, b in body)[0x1654AE6B])[0xAE])
    assert track[0x86] == b"A_PCM/INT/LIT" and dict((i, b) for i, _, b in track[0xE1])[0x6264] == b"\x08"
    clusters = [(at, b) for i, at, b in body if i == 0x1F43B675]
    cues = [dict((i, b) for i, _, b in point) for i, _, b in body if i == 0x1C53BB6B for _, _, point in b]
    cued = {int.from_bytes(dict((i, b) for i, _, b in c[0xB7])[0xF1], "big") + first for c in cues}
    samples, frames, done = b"", 0, 0
    for at, parts in clusters:
        base = int.from_bytes(parts[0][2], "big")
        assert parts[0][0] == 0xE7 and base == done * 1000 // matroska.HERTZ
        for ident, _, block in parts[1:]:
            assert ident == 0xA3 and base + int.from_bytes(block[1:3], "big", signed=True) == done * 1000 // matroska.HERTZ
            found = naive_frames(block)
            frames += len(found)
            samples += b"".join(found)
            done = len(samples)
    n, count = len(samples), Counter(samples)
    mean = sum(b * c for b, c in count.items()) * 1000 // max(1, n)
    rms = round(math.sqrt(sum((b - 128) ** 2 * c for b, c in count.items()) / max(1, n)) * 1000)
    crossings = sum((a >= 128) != (b >= 128) for a, b in zip(samples, samples[1:], strict=False))
    entropy = round(-sum(c / n * math.log2(c / n) for c in count.values()) * 1000)
    feature = f"packets={frames};clusters={len(clusters)};cued={len(cued & {at for at, _ in clusters})};ms={n * 1000 // matroska.HERTZ};mean={mean};rms={rms};crossings={crossings};entropy={entropy}"
    return data, samples, feature


def test_media_of_a_whole_table(spark, small, small_table):
    long = [(5_000_001, "a long one, ünd so on; " * 20_000), (5_000_002, "x" * 63), (5_000_003, "x" * 64), (5_000_004, "y" * 64_000)]
    rows = small + long
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        data, samples, feature = naive_media(payload)
        assert samples == payload
        want.append((str(i), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
    got = [tuple(str(v) if k == 0 else v for k, v in enumerate(r)) for r in matroska.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want)
