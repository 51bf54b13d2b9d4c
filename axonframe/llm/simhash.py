"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits have at least 4 of 8 bytes equal at their positions. Single
bytes are too common to meet by, so the index is dealt out by 3 positions and their bytes, in a design in which any 4
positions hold one of these triples: a pair with 4 shared bytes meets where 3 of them are shared. There, each of the
other positions has postings by byte; a fingerprint's postings are walked and tallied, only those with a tally of one
or more, 4 shared bytes with the key's 3, are kept, and their bits are compared. Links become components by
alternating large-star and small-star steps.

Defined cases: null, empty and wordless texts have the fingerprint 0 and link like any other; texts under n words are
one shingle; equal fingerprints, so equal texts and repeated rows, are one node; a null doc_id is never the smallest, a
group of them has a null id; an empty table has no rows; texts are read whole, however long, in blocks of hashes; other
columns aren't read, whatever their names (kept_of_groups carries them all).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WORDS, SEED, BITS = 4, 42, 4
#: Bytes that two fingerprints within BITS share at least.
SHARED = 8 - BITS
#: Postings of one key that one task compares at once; longer lists are dealt out as pairs of chunks.
CHUNK = 4096
BLOCK = 1 << 18
#: Postings in a list up to which all pairs are tallied at once.
FEW = 16
#: Near copies: keys of a text, min-hashes of a key, shingles of one task's chunk, and rounds that take a large group apart.
BANDS, ROWS, SHINGLES, STARS = 32, 4, 1 << 21, 8
MIXERS = np.random.default_rng(SEED).integers(0, 1 << 64, (BANDS, ROWS, 2), np.uint64) | np.array([0, 1], np.uint64)


def _design() -> list[tuple[int, int, int]]:
    """20 position triples; any 4 of the 8 positions contain one: positions in groups of 3, 3, 2 (a, b, c), triples in
    a group, or two in a group and one in the next."""
    groups = (0, 1, 2), (3, 4, 5), (6, 7)
    where = {p: g for g, ps in enumerate(groups) for p in ps}

    def taken(t: tuple[int, ...]) -> bool:
        g = sorted(where[p] for p in t)
        return len(set(g)) == 1 or (g[0] == g[1] and g[2] == (g[0] + 1) % 3) or (g[1] == g[2] and g[0] == (g[1] + 1) % 3)

    return [t for t in combinations(range(8), 3) if taken(t)]


TRIPLES = _design()


def shingle_hashes(text: bytes, words: int = WORDS) -> list[int]:
    parts = text.lower().split()  # of bytes: A-Z only, and the six white spaces of the word rule
    if not parts:
        return []
    joined, ends, at = b" ".join(parts), [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0, *(e + 1 for e in ends[: len(parts) - words])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)]


def fingerprints_of(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """uint64 fingerprints; a bit is set if it is in more than half of a text's shingle hashes."""
    out, hashes, counts, seen = np.zeros(len(texts), np.uint64), [], [], {}
    first = [seen.setdefault(t, k) for k, t in enumerate(texts)]
    distinct = [k for k, f in enumerate(first) if f == k]

    def flush(upto: list[int]) -> None:
        n = np.array(counts, np.int64)
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.zeros((len(n), 64), np.int64)
        some = np.flatnonzero(n)
        if len(some):
            sums[some] = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int64)
        out[upto] = np.packbits(2 * sums > n[:, None], axis=1).view(">u8")[:, 0]

    waiting: list[int] = []
    for k in distinct:
        h = shingle_hashes(texts[k], words)
        hashes += h
        counts.append(len(h))
        waiting.append(k)
        if len(hashes) > BLOCK // 8:
            flush(waiting)
            hashes, counts, waiting = [], [], []
    if waiting:
        flush(waiting)
    return out[first]


def fingerprinted(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long)."""
    rows = common.pick(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, ends = common.utf8(batch["text"])
            raw, ends = body.tobytes(), ends.tolist()
            fp = fingerprints_of([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], words)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def posted(nodes: DataFrame) -> DataFrame:
    """Postings (key, fp) of distinct fingerprints, one for each position triple, whose number is in the key's upper bits."""
    keys = []
    for k, (a, b, c) in enumerate(TRIPLES):
        byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long")) for p in (a, b, c)]
        keys.append(F.lit(k << 24).cast("long") + byte[0] * 65536 + byte[1] * 256 + byte[2])
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def tallied(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs share SHARED bytes by position and, verified, differ in at most BITS bits."""
    differ = x ^ y
    shared = (differ[:, None].view(np.uint8) == 0).sum(1)
    out = shared >= SHARED
    out[out] = np.bitwise_count(differ[out]) <= BITS
    return out


def tree_links(fp: np.ndarray, triple: int, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest that joins what is linked in one key's list; with `side`, only what is linked across sides.

    The list's fingerprints share the triple's bytes. Each one, once reached, walks the postings of its other bytes
    among those not reached yet; what is met there at all has the least tally and is verified.
    """
    n, byte = len(fp), np.ascontiguousarray(fp)[:, None].view(np.uint8)
    others = [p for p in range(8) if p not in TRIPLES[triple]]
    open_, links, left, built = np.ones(n, bool), [], n, 0
    lists: list[tuple[np.ndarray, np.ndarray]] = []
    for seed in range(n):
        if not open_[seed]:
            continue
        open_[seed], left, stack = False, left - 1, [seed]
        while stack and left:
            if not lists or 2 * left < built:  # postings of what is still open
                rest = np.flatnonzero(open_)
                lists, built = [], left
                for p in others:
                    order = rest[np.argsort(byte[rest, p], kind="stable")]
                    lists.append((order, np.searchsorted(byte[order, p], np.arange(257))))
            k = stack.pop()
            own = byte[k].tolist()
            met = np.concatenate([post[at[own[p]] : at[own[p] + 1]] for p, (post, at) in zip(others, lists, strict=True)])
            tally = np.bincount(met, minlength=n)
            near = np.flatnonzero((tally >= SHARED - len(TRIPLES[triple])) & open_)
            if side is not None:
                near = near[side[near] != side[k]]
            near = near[np.bitwise_count(fp[near] ^ fp[k]) <= BITS]
            open_[near] = False
            left -= len(near)
            links += [(k, j) for j in near.tolist()]
            stack += near.tolist()
    found = np.array(links, np.int64).reshape(-1, 2)
    return fp[found[:, 0]].view(np.int64), fp[found[:, 1]].view(np.int64)


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    pair = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v))), axis=1) if len(u) else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x, np.int64)) for x in pair], names=["u", "v"])


def _groups(batches: Iterator[pa.RecordBatch], by: list[str], rest: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups of the sorted rows, as many groups at once as a batch completes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch[c].to_numpy() for c in by + rest])
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        open_ = np.ones(len(cols[0]), bool)
        for c in cols[: len(by)]:
            open_ &= c == c[-1]
        cut = len(open_) if not open_.any() else int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0
        held = [[c[cut:] for c in cols]]
        if cut:
            yield [c[:cut] for c in cols]
    if held and len(held[0][0]):
        yield held[0]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by key to links. All pairs of short lists are tallied by their distance in the list."""
    for key, fp in _groups(batches, ["key"], ["fp"]):
        fp = fp.view(np.uint64)
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(new, len(key)))
        few = sizes <= FEW
        in_few, u, v = np.repeat(few, sizes), [], []
        for d in range(1, min(FEW, len(key))):
            k = np.flatnonzero(in_few[d:] & (key[d:] == key[:-d]))
            k = k[tallied(fp[k], fp[k + d])]
            u.append(fp[k].view(np.int64))
            v.append(fp[k + d].view(np.int64))
        for a, n in zip(new[~few], sizes[~few], strict=True):
            x, y = tree_links(fp[a : a + n], int(key[a] >> 24), None)
            u.append(x)
            v.append(y)
        yield _pairs(np.concatenate(u) if u else np.zeros(0, np.int64), np.concatenate(v) if v else np.zeros(0, np.int64))


def _linked_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Like _linked for long lists: rows sorted by (key, i, j), the pair of chunks i, j of a key together."""
    for key, i, j, chunk, fp in _groups(batches, ["key", "i", "j"], ["chunk", "fp"]):
        fp = fp.view(np.uint64)
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        for a, b in zip(new, np.append(new[1:], len(key)), strict=True):
            yield _pairs(*tree_links(fp[a:b], int(key[a] >> 24), None if i[a] == j[a] else chunk[a:b] == i[a]))


def links_between(nodes: DataFrame, scratch: common.Scratch, chunk: int = CHUNK) -> DataFrame:
    """(u, v) links among distinct fingerprints (fp), enough to join all that are linked."""
    posts, kind = posted(nodes), "u long, v long"
    long = scratch.table("long", posts.groupBy("key").count().where(F.col("count") > chunk))
    if not long.head(1):
        return posts.repartition("key").sortWithinPartitions("key").mapInArrow(_linked, kind)
    posts = posts.join(long, "key", "left")
    short = posts.where(F.col("count").isNull()).select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_linked, kind)
    dealt = posts.where(F.col("count").isNotNull()).withColumn("parts", F.ceil(F.col("count") / chunk)).withColumn("chunk", F.pmod(F.xxhash64("fp"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "fp")
    return short.unionByName(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_linked_chunks, kind))


def components(links: DataFrame, scratch: common.Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each component, for nodes that have a link.

    Large-star and small-star steps by turns until no link changes; each step's links are a table of their own. A
    star's centre may hold many links, so neighbours are never gathered: minima are aggregated and joined back.
    """
    def star(pairs: DataFrame, large: bool, name: str) -> DataFrame:
        both = pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(pairs.select(F.col("v").alias("a"), F.col("u").alias("b")))
        if not large:
            both = both.where(F.col("b") < F.col("a"))
        least = scratch.table(f"{name}-least", both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        rows = both.join(least, "a")  # two plain exchanges, so a centre's links can be split over tasks
        moved = rows.where(F.col("b") > F.col("a") if large else F.col("b") != F.col("m")).select(F.col("m").alias("u"), F.col("b").alias("v"))
        if not large:
            moved = moved.unionByName(least.select(F.col("m").alias("u"), F.col("a").alias("v")))
        return scratch.table(name, moved.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    def sign(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, was = scratch.table("links0", links.where(F.col("u") != F.col("v")).distinct()), None
    for k in range(most_rounds):
        if not now.head(1):
            break
        now = star(star(now, True, f"large{k}"), False, f"links{k + 1}")
        for old in (f"links{k}", f"large{k}", f"large{k}-least", f"links{k + 1}-least"):
            scratch.drop(old)
        if was == (was := sign(now)):
            break
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents with fp, (fp, component_id)): component_id is the smallest doc_id among the linked."""
    scratch = common.Scratch(docs.sparkSession)
    found = scratch.table("fingerprints", fingerprinted(docs, words))
    nodes = scratch.table("nodes", found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = links_between(nodes.select("fp"), scratch)
    roots = scratch.table("roots", components(links, scratch))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least_of = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return found, scratch.table("named", named.join(least_of, "root").select("fp", "component_id"))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; equal texts share one array."""
    seen: dict[bytes, np.ndarray] = {}
    for t in texts:
        if t not in seen:
            seen[t] = np.unique(np.array(shingle_hashes(t, words), np.uint64))
    return [seen[t] for t in texts]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) keys, each of ROWS min-hashes; for sets that aren't empty."""
    out, at = np.zeros((len(sets), BANDS), np.uint64), 0
    while at < len(sets):
        upto, total = at, 0
        while upto < len(sets) and (upto == at or total + len(sets[upto]) <= BLOCK // 8):
            total += len(sets[upto])
            upto += 1
        h = np.concatenate(sets[at:upto])
        starts = np.cumsum([0, *(len(s) for s in sets[at : upto - 1])])
        for k in range(BANDS):
            key = np.full(upto - at, k + 1, np.uint64)
            for r in range(ROWS):
                least = np.minimum.reduceat((h ^ MIXERS[k, r, 0]) * MIXERS[k, r, 1], starts)
                key = (key ^ least) * np.uint64(0xE7037ED1A0B428DB)
                key ^= key >> np.uint64(32)
            out[at:upto, k] = key
        at = upto
    return out


def jaccard_links(sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Links, by place in the list, of a forest that joins the sets of a Jaccard similarity of at least so much; with
    `side`, only of those across sides. Each set, once reached, is counted against those not reached yet."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    order = np.argsort(ids, kind="stable")
    term, post = ids[order], np.repeat(np.arange(n), sizes)[order]
    terms = np.arange(ids.max(initial=-1) + 2)
    first, built, left = np.searchsorted(term, terms), n, n
    open_, links = np.ones(n, bool), []
    for seed in range(n):
        if not open_[seed]:
            continue
        open_[seed], left, stack = False, left - 1, [seed]
        while stack and left:
            if 2 * left < built:
                kept = open_[post]
                term, post = term[kept], post[kept]
                first, built = np.searchsorted(term, terms), left
            k = stack.pop()
            own = ids[begin[k] : begin[k + 1]]
            runs = first[own + 1] - first[own]
            met = post[np.repeat(first[own] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())]
            both = np.bincount(met, minlength=n)
            near = open_ & (both > 0) & (both >= similarity * (sizes + sizes[k] - both) - 1e-9)
            if side is not None:
                near &= side != side[k]
            near = np.flatnonzero(near)
            open_[near] = False
            left -= len(near)
            links += [(k, j) for j in near.tolist()]
            stack += near.tolist()
    return links


def _verified(words: int, similarity: float):
    """Texts sorted by (root, i, j), the pair of chunks i, j of a candidate group together, to links."""
    def links_of(held: dict[int, tuple[int, np.ndarray]], across: bool) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        nodes, chunks = list(held), np.array([c for c, _ in held.values()])
        return [(nodes[a], nodes[b]) for a, b in jaccard_links([s for _, s in held.values()], chunks if across else None, similarity)]

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        found = np.array(links, np.int64).reshape(-1, 2)
        return _pairs(found[:, 0], found[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            body, ends = common.utf8(batch["text"])
            raw, ends, links = body.tobytes(), ends.tolist(), []
            keys = zip(*(batch[c].to_pylist() for c in ("root", "i", "j")), strict=True)
            for k, (key, node, chunk) in enumerate(zip(keys, batch["node"].to_pylist(), batch["chunk"].to_pylist(), strict=True)):
                if key != now:
                    links += links_of(held, bool(now) and now[1] != now[2])
                    now, held = key, {}
                if node not in held:
                    held[node] = chunk, shingle_sets([raw[ends[k] : ends[k + 1]]], words)[0]
            yield batch_of(links)
        yield batch_of(links_of(held, bool(now) and now[1] != now[2]))

    return run


def _star(words: int):
    """Texts sorted by (root, part), the part's copy of the head first, to each other text's similarity to the head."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, np.zeros(0, np.uint64)
        for batch in batches:
            body, ends = common.utf8(batch["text"])
            raw, ends = body.tobytes(), ends.tolist()
            out: dict[int, tuple[int, float]] = {}
            for k, (root, part, node, leads) in enumerate(zip(*(batch[c].to_pylist() for c in ("root", "part", "node", "leads")), strict=True)):
                own = shingle_sets([raw[ends[k] : ends[k + 1]]], words)[0]
                if leads:
                    now, head = (root, part), own
                elif now == (root, part):
                    both = len(np.intersect1d(own, head, assume_unique=True))
                    out[node] = root, both / (len(own) + len(head) - both)
            roots, likes = zip(*out.values(), strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(roots, pa.int64()), pa.array(list(out), pa.int64()), pa.array(likes, pa.float64())], names=["root", "node", "like"])

    return run


def _dealt(rows: DataFrame, parts: str = "parts") -> Column:
    return F.pmod(F.xxhash64("node"), F.col(parts))


def starred(members: DataFrame, with_text, scratch: common.Scratch, words: int, similarity: float, chunk: int, rounds: int = STARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, members with label, pairs of labels to compare) of candidate groups too large for a task.

    Round by round the least text without a label is held against all others without one; those alike take the round's
    number as label. That is linear in a group, and ends when what has no label (label 0) fits a task. Texts of one label
    are joined already. Of two labels the Jaccard distance of the heads, less both radii, bounds that of their texts, so
    labels that lie too far apart aren't compared.
    """
    open_, labels, links, likes = members, [], [], []
    for k in range(1, rounds + 1):
        sizes = open_.groupBy("root").agg(F.sum("size").alias("total"), F.min("node").alias("head")).where(F.col("total") > chunk)
        large = scratch.table(f"star{k}", sizes.withColumn("parts", F.ceil(F.col("total") / chunk)))
        if not large.head(1):
            break
        now = open_.join(large, "root")
        heads = now.where(F.col("node") == F.col("head"))
        spread = heads.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("leads", F.lit(True))
        others = now.where(F.col("node") != F.col("head")).withColumn("part", _dealt(now)).withColumn("leads", F.lit(False))
        texts = with_text(spread.unionByName(others).select("root", "part", "node", "leads", "least"))
        found = texts.repartition("root", "part").sortWithinPartitions("root", "part", F.desc("leads")).mapInArrow(_star(words), "root long, node long, like double")
        found = scratch.table(f"likes{k}", found.unionByName(heads.select("root", "node", F.lit(1.0).alias("like"))))
        near = found.where(F.col("like") >= similarity - 1e-9)
        links.append(near.join(large, "root").where(F.col("node") != F.col("head")).select(F.col("head").alias("u"), F.col("node").alias("v")))
        labels.append(near.withColumn("label", F.lit(k)))
        likes.append(found.where(F.col("like") < similarity - 1e-9).withColumn("x", F.lit(k)))
        open_ = scratch.table(f"open{k}", open_.join(near.select("node"), "node", "left_anti"))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    labelled = scratch.table("labels", union(labels))
    members = scratch.table("labelled", members.join(labelled.select("node", "label", "like"), "node", "left").withColumn("label", F.coalesce("label", F.lit(0))))
    catalogue = members.groupBy("root", "label").agg(F.ceil(F.sum("size") / chunk).alias("parts"), (1 - F.min("like")).alias("radius"), F.min(F.when(F.col("like") == 1, F.col("node"))).alias("head"))
    catalogue = scratch.table("catalogue", catalogue)  # a row for each round of a group that doesn't fit a task
    x, y = (catalogue.select("root", *(F.col(c).alias(f"{c}_{n}") for c in ("label", "parts", "radius", "head"))) for n in "xy")
    apart = union(likes).select(F.col("root"), F.col("x").alias("label_x"), F.col("node").alias("head_y"), (1 - F.col("like")).alias("apart"))
    pairs = x.join(y, "root").where((F.col("label_x") < F.col("label_y")) | ((F.col("label_x") == 0) & (F.col("label_y") == 0))).join(apart, ["root", "label_x", "head_y"], "left")
    far = F.coalesce(F.col("apart") - F.col("radius_x") - F.col("radius_y") > 1 - similarity + 1e-9, F.lit(False))
    return union(links), members, pairs.where(~((F.col("label_x") > 0) & far)).select("root", "label_x", "parts_x", "label_y", "parts_y")


def chunk_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(root, i, j, chunk, node, least): members once for each pair of chunks i, j that they are to be compared in. Chunks
    are parts of a label."""
    name = lambda label, part: F.shiftleft(label.cast("long"), 40) + part
    sides = []
    for own, other in ("xy", "yx"):
        rows = members.join(pairs.withColumnRenamed(f"label_{own}", "label"), ["root", "label"])
        if own == "y":  # a label against itself is dealt out once
            rows = rows.where(F.col("label") != F.col("label_x"))
            mine, theirs = F.col("label"), F.col("label_x")
        else:
            mine, theirs = F.col("label"), F.col("label_y")
        rows = rows.withColumn("chunk", name(mine, _dealt(rows, f"parts_{own}")))
        rows = rows.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"parts_{other}") - 1))).withColumn("other", name(theirs, F.col("_q")))
        sides.append(rows.select("root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "least"))
    return sides[0].unionByName(sides[1])


def print_links(signs: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(u, v): nodes joined by their fingerprints (node, fp), those found by the inverted index at BITS differing bits or
    fewer. Each component of fingerprints is a star around its least node."""
    pairs = scratch.table("prints", signs.select("node", "fp").distinct())
    roots = scratch.table("roots", components(links_between(pairs.select("fp").distinct(), scratch), scratch).withColumnRenamed("node", "at"))
    named = scratch.table("named", pairs.join(roots, F.col("fp") == F.col("at"), "left").select("node", F.coalesce("root", "fp").alias("root")))
    heads = named.groupBy("root").agg(F.min("node").alias("u"))
    return named.join(heads, "root").where(F.col("u") != F.col("node")).select("u", F.col("node").alias("v"))


def kept_of_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, chunk: int = SHINGLES, prints: bool = False) -> DataFrame:
    """docs without near copies: of each group the row with the smallest id stays (then the smallest text hash).

    Two texts are near copies if their sets of `words`-word shingles have a Jaccard similarity of `similarity` or more,
    counted over the whole sets. What is counted are the texts of a candidate group: those joined by a common key of
    min-hashes. Two texts of similarity s have none in common with probability (1 - s**ROWS)**BANDS: at 0.8, 5e-8.
    Candidate groups of over `chunk` shingles are taken apart by `starred` first; what is left to compare is dealt out
    as pairs of chunks. Texts without words form one group; a row without an id is the last of its group. With `prints`,
    texts whose fingerprints the inverted index links (`near_duplicates`) are near copies too.
    """
    scratch, names = common.Scratch(docs.sparkSession), docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    rows = plain.withColumn("th", F.xxhash64(text))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, ends = common.utf8(batch["text"])
            raw, ends = body.tobytes(), ends.tolist()
            sets = shingle_sets([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], words)
            sizes = np.array([len(s) for s in sets], np.int64)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
            keys = band_keys([s for s in sets if len(s)])
            at = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0))))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            fp = fingerprints_of([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]) if prints else np.zeros(len(sets), np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(node.view(np.int64)), pa.array(sizes), lists, pa.array(fp.view(np.int64))], names=["doc_id", "th", "node", "size", "keys", "fp"])

    def with_text(found: DataFrame) -> DataFrame:
        """found with the text of its column `least`."""
        keyed = found.select("*", F.col("least.doc_id").alias("at_id"), F.col("least.th").alias("at_th")).drop("least")
        return rows.select(doc_id.alias("doc_id"), "th", text.alias("text")).join(keyed, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("th") == F.col("at_th"))).drop("doc_id", "th", "at_id", "at_th")

    signs = rows.select(doc_id.alias("doc_id"), "th", text.alias("text")).mapInArrow(run, f"doc_id {kind}, th long, node long, size long, keys array<long>, fp long")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    signs = scratch.table("signs", signs)
    nodes = scratch.table("nodes", signs.groupBy("node").agg(F.first("keys").alias("keys"), F.first("size").alias("size"), F.min(order).alias("least")))
    posts = nodes.select("node", F.explode("keys").alias("key"))
    heads = scratch.table("heads", posts.groupBy("key").agg(F.min("node").alias("u"), F.count("*").alias("n")).where(F.col("n") > 1).select("key", "u"))
    groups = scratch.table("groups", components(posts.join(heads, "key").select("u", F.col("node").alias("v")), scratch))
    # a component's least node is its root and has no row of its own
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root")).distinct()
    members = scratch.table("members", nodes.select("node", "size", "least").join(groups, "node"))
    large = scratch.table("large", members.groupBy("root").agg(F.sum("size").alias("total")).where(F.col("total") > chunk).select("root"))
    zero, links = F.lit(0).cast("long"), []
    dealt = members.select("root", zero.alias("i"), zero.alias("j"), zero.alias("chunk"), "node", "least")
    if large.head(1):
        found, labelled, pairs = starred(members.join(large, "root", "left_semi"), with_text, scratch, words, similarity, chunk)
        links.append(found)
        dealt = dealt.join(large, "root", "left_anti").unionByName(chunk_pairs(labelled, pairs))
    compared = with_text(dealt).select("root", "i", "j", "chunk", "node", "text")
    links.append(compared.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_verified(words, similarity), "u long, v long"))
    if prints:
        links.append(print_links(signs, common.Scratch(docs.sparkSession)))
    exact = common.Scratch(docs.sparkSession)
    roots = exact.table("roots", components(reduce(DataFrame.unionByName, links), exact))
    named = nodes.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    kept = scratch.table("kept", named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("kept_id"), F.col("least.th").alias("kept_th")))
    out = rows.join(kept, doc_id.eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th")), "left_semi")
    first = F.row_number().over(W.partitionBy(doc_id, "th").orderBy(F.lit(0)))
    return out.withColumn("nth", first).where(F.col("nth") == 1).select(*plain.columns).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    found, named = near_duplicates(common.documents(spark, sf_dir))
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
