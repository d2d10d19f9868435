"""N-gram Jaccard self-join with set-relation skipping (operator 2).

Two texts link when the Jaccard similarity of their sets of word shingles is at
least ``percent`` / 100, exactly. The join follows prefix filtering under a
global order of shingles (rare ones first), and skips work by relations between
sets:

* index level: the list of a shingle is arranged in blocks by set size, and an
  entry has its position; a set meets only the blocks and entries whose size and
  position allow the needed overlap, and lists that lie within one component are
  skipped as a whole;
* answer level: a set that is highly similar to a leader is answered through it.
  Jaccard distance is a metric, so once the distance of two leaders is known,
  pairs of their followers whose distances rule a link out are never looked at.

Components are found first; a pair that is neither skipped by such a bound nor
within one component is verified on the whole texts. All links lie within
components, and are counted there: each set is kept as what it lacks and what it
adds against one set of its component, overlaps follow from those differences
alone, and two sets that are both near enough to that set link without a look.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, forget, slices, written

#: Bytes of text whose words are hashed at once.
STEP = 1 << 18
#: Share of the shingle space whose document frequencies are counted.
SHARE = 0.33
#: Ids up to which the set of documents to verify is broadcast (8 bytes each); beyond, the join shuffles.
MOST_BROADCAST = 1_000_000

_space = re.compile(rb"[\x20\x09-\x0D]").search
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_BASE = 0xD6E8FEB86659FD93
_FLIP = np.uint64(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class _Powers:
    """Powers of an odd base modulo 2^64 and their inverses, as far as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, STEP + (1 << 14))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up, cls.down


def _segments(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(text number, part): long texts are cut at white space."""
    for k, t in enumerate(texts):
        if len(t) <= STEP:
            yield k, t
            continue
        at = 0
        while at < len(t):
            m = _space(t, at + STEP)
            end = m.start() if m else len(t)
            yield k, t[at:end]
            at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order (A-Z as a-z), and the number of words of each text."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    group: list[tuple[int, bytes]] = []

    def flush() -> None:
        a = np.frombuffer(b" ".join(t for _, t in group) + b" ", np.uint8)
        space = _IS_SPACE[a]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        start, end = edge[::2], edge[1::2]
        up, down = _Powers.get(len(a))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_LOWER[a] * up[: len(a)], out=sums[1:])
        hashes.append(_mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
        first = np.cumsum([0] + [len(t) + 1 for _, t in group[:-1]])
        of = np.array([k for k, _ in group])[np.searchsorted(first, start, side="right") - 1]
        np.add.at(counts, of, 1)

    size = 0
    for k, t in _segments(texts):
        if group and size + len(t) > STEP:
            flush()
            group, size = [], 0
        group.append((k, t))
        size += len(t) + 1
    if group:
        flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles.

    A text with fewer words is one shingle as a whole; without words, the set is
    empty. Shingles are told apart by 64-bit hashes: two different ones of the
    same pair of texts are alike with a chance below 1e-12 for texts of a few
    thousand words.
    """
    words, counts = word_hashes(texts)
    n = len(words) - width + 1
    run = words[: max(n, 0)].copy()
    for j in range(1, width):
        run = _mix(run * np.uint64(0x9E3779B97F4A7C15) + words[j : j + max(n, 0)])
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(run[at : at + c - width + 1]))
        elif c:
            h = np.full(1, 0xA5A5A5A5 + c, np.uint64)
            for w in words[at : at + c]:
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _cut(share: float) -> int:
    return min(int(share * 2**64), 2**64 - 1)


def profiles(df: DataFrame, width: int, share: float) -> DataFrame:
    """doc_id, n (set size), k (shingles in the counted share), s1, s2 (signature of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = np.uint64(_cut(share))
        for batch in slices(batches, 1):
            sets = shingle_sets(_texts(batch.column(1)), width)
            n = [len(s) for s in sets]
            k = [int(np.searchsorted(s, cut)) for s in sets]
            s1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            s2 = np.array([_mix(s ^ _FLIP).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(k, pa.int32()), pa.array(s1), pa.array(s2)], names=["doc_id", "n", "k", "s1", "s2"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n int, k int, s1 long, s2 long")


def needed(n: int, percent: int) -> int:
    """Length of the prefix: links share a shingle within it, whatever the global order."""
    return n - (percent * n + 99) // 100 + 1


def postings(df: DataFrame, width: int, share: float, percent: int) -> DataFrame:
    """token, doc, more: the shingles that can be in a prefix, with the texts that have them.

    Of each text its shingles in the counted share, and where those are fewer
    than the prefix, the next ones by hash. Equal sets of a slice of a batch give
    rows for the smallest id only. A token's texts within a slice make one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = np.uint64(_cut(share))
        for batch in slices(batches, 1):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            best: dict[bytes, int] = {}
            sets = shingle_sets(_texts(batch.column(1)), width)
            for k, s in enumerate(sets):
                if len(s):
                    key = s.tobytes() if len(s) < 3 else np.array([len(s), s[0], s[-1], s.sum(dtype=np.uint64)], np.uint64).tobytes()
                    if key not in best or ids[k] < ids[best[key]]:
                        best[key] = k
            chosen = sorted(best.values())
            if not chosen:
                continue
            parts = [sets[k][: max(needed(len(sets[k]), percent), int(np.searchsorted(sets[k], cut)))] for k in chosen]
            token = np.concatenate(parts)
            doc = np.repeat(ids[chosen], [len(p) for p in parts])
            del sets, parts
            order = np.argsort(token, kind="stable")
            token, doc = (token[order] ^ _FLIP).view(np.int64), doc[order].astype(np.int64)
            first = np.flatnonzero(np.diff(token, prepend=token[0] - 1 if token[0] > -(2**63) else token[0] + 1))
            size = np.diff(first, append=len(token))
            more = np.maximum(size - 1, 0)
            rest = np.ones(len(token), bool)
            rest[first] = False
            offsets = np.concatenate([[0], np.cumsum(more)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(doc[rest]), mask=pa.array(more == 0))
            token, doc = token[first], doc[first]
            for at in range(0, len(token), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(token[at : at + 100_000]), pa.array(doc[at : at + 100_000]), lists[at : at + 100_000]], names=["token", "doc", "more"])

    return df.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(run, "token long, doc long, more array<long>")


def entries(df: DataFrame, classes: DataFrame, width: int, share: float, percent: int) -> DataFrame:
    """token, doc, n, pos: the prefixes of all different sets, without shingles that one set alone has.

    Order: counted shingles by document frequency, then hash; then the others by
    hash. ``pos`` is a shingle's place in the order, or a lower bound of it.
    """
    rows = postings(df, width, share, percent)
    # how many rows of texts have the token; one window, one shuffle
    freq = F.sum(1 + F.coalesce(F.size("more"), F.lit(0))).over(Window.partitionBy("token"))
    shared = rows.withColumn("freq", freq).where("freq > 1")
    shared = shared.select("token", "freq", F.explode(F.concat(F.array("doc"), F.coalesce("more", F.array().cast("array<long>")))).alias("doc"))
    shared = shared.join(classes.select(F.col("rep").alias("doc"), "n", "k"), "doc")
    cut = int(np.array([_cut(share)], np.uint64)[0] ^ _FLIP) - (1 << 64) if _cut(share) < 2**63 else int(np.uint64(_cut(share)) ^ _FLIP)
    counted = F.col("token") < F.lit(cut)
    item = F.struct(F.when(counted, 0).otherwise(1).alias("late"), F.when(counted, F.col("freq")).otherwise(F.lit(0)).alias("freq"), F.col("token").alias("token"))
    lists = shared.groupBy("doc", "n", "k").agg(F.array_sort(F.collect_set(item)).alias("list"))
    early = F.size(F.filter("list", lambda x: x["late"] == 0))
    lists = lists.withColumn("alone", F.col("k") - early)
    rows = lists.select("doc", "n", "alone", F.posexplode("list").alias("rank", "x"))
    pos = F.col("alone") + F.col("rank")
    prefix = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    return rows.select(F.col("x.token").alias("token"), "doc", "n", pos.cast("int").alias("pos")).where((pos < prefix) | (F.col("x.late") == 1))


def enough(na: Column, nb: Column, ra: Column, rb: Column, percent: int) -> Column:
    """Size and position bounds: ``ra``, ``rb`` shingles are left from a shared one on."""
    sizes = (100 * na >= percent * nb) & (100 * nb >= percent * na)
    return sizes & (F.least(ra, rb) * (100 + percent) >= percent * (na + nb))


def beside(pairs: DataFrame, df: DataFrame, width: int, unique: bool, answer, names: str) -> DataFrame:
    """``answer(a, b, set of a, set of b)``, a tuple for the columns ``names``, of each pair (a, b), from the whole texts.

    Pairs are dealt by b, in as many parts as its number of pairs asks for, and
    each task streams its texts past the set of the b at hand, some megabytes of
    text at a time.
    """
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    parts = pairs.groupBy("b").agg((1 + F.floor(F.count("*") / 256)).alias("parts"))
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    ids = written(ids, "pair-ids")
    some = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    texts = df.select(F.col("doc_id").cast("long"), "text").join(some, "doc_id", "left_semi")
    if not unique:
        texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"), F.lit(1).alias("role"))
    hubs = parts.select(F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    roles = written(dealt.unionByName(hubs), "pair-roles")
    rows = roles.join(texts.withColumnRenamed("doc_id", "a"), "a").select("b", "part", "role", "a", "text")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "b", "part").sortWithinPartitions("b", "part", "role")
    made = [x.split()[0] for x in names.split(", ")]
    types = [pa.binary() if x.endswith("binary") else pa.int64() for x in names.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, at = np.zeros(0, np.uint64), None
        for batch in slices(batches, 4):
            sets = shingle_sets(_texts(batch.column(4)), width)
            b, role, a = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out: list[tuple] = []
            for k, s in enumerate(sets):
                if role[k] == 0:
                    hub, at = s, b[k]
                elif at == b[k] and len(hub) and len(s):
                    out.append(answer(a[k], b[k], s, hub))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=made)

    done = written(rows.mapInArrow(run, names), "verified")
    forget(pairs, ids, roles)
    return done


def _held(s: np.ndarray, hub: np.ndarray) -> np.ndarray:
    """Which values of ``s`` the sorted array ``hub`` (not empty) has."""
    j = np.searchsorted(hub, s)
    j[j == len(hub)] = 0
    return hub[j] == s


def verify(pairs: DataFrame, df: DataFrame, width: int, unique: bool) -> DataFrame:
    """a, b, na, nb, overlap of each pair, from the whole texts."""
    return beside(pairs, df, width, unique, lambda a, b, s, hub: (a, b, len(s), len(hub), int(_held(s, hub).sum())), "a long, b long, na long, nb long, overlap long")


#: Sets, and bytes of their differences, that a block of a component holds about.
BLOCK_SETS, BLOCK_BYTES = 1024, 4 << 20


def block_links(n: tuple, lost: tuple, diffs: tuple, weight: tuple, hub: int, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each set of the first block the weight of the sets of the second that link with it, and the other way round.

    Every argument is a pair, first and second block. A set is ``hub`` shingles,
    less ``lost`` of them, with others added; ``diffs`` has both kinds. So two
    sets share hub - lost - lost + (values that both differences hold).
    ``same``: the blocks are one, whose sets don't link with themselves.
    """
    na, nb = (np.asarray(x, np.int64) for x in n)
    la, lb = (np.asarray(x, np.int64) for x in lost)
    wa, wb = (np.asarray(x, np.int64) for x in weight)
    token = np.concatenate([*diffs[1], np.zeros(0, np.uint64)])
    of = np.repeat(np.arange(len(nb)), [len(d) for d in diffs[1]])
    order = np.argsort(token, kind="stable")
    token, of = token[order], of[order]
    found_a, found_b = np.zeros(len(na), np.int64), np.zeros(len(nb), np.int64)
    rows = max(1, min(len(na), (1 << 20) // max(1, len(nb))))
    for at in range(0, len(na), rows):
        m = min(rows, len(na) - at)
        shared = np.zeros(m * len(nb), np.int64)
        mine = np.concatenate([*diffs[0][at : at + m], np.zeros(0, np.uint64)])
        row = np.repeat(np.arange(m), [len(d) for d in diffs[0][at : at + m]])
        low, high = np.searchsorted(token, mine, "left"), np.searchsorted(token, mine, "right")
        hits = high - low
        ends = np.cumsum(hits)
        start = 0
        while start < len(mine):  # a few million hits at a time
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 21), "right")))
            h = hits[start:stop]
            flat = np.arange(int(h.sum())) - np.repeat(np.cumsum(h) - h, h) + np.repeat(low[start:stop], h)
            np.add(shared, np.bincount(np.repeat(row[start:stop], h) * len(nb) + of[flat], minlength=m * len(nb)), out=shared)
            start = stop
        overlap = shared.reshape(m, len(nb)) + (hub - la[at : at + m, None] - lb[None, :])
        link = overlap * (100 + percent) >= percent * (na[at : at + m, None] + nb[None, :])
        if same:
            link[np.arange(m), at + np.arange(m)] = False
        found_a[at : at + m] = link @ wb
        found_b += wa[at : at + m] @ link
    return found_a, found_b


def link_counts(df: DataFrame, members: DataFrame, width: int, percent: int, unique: bool) -> DataFrame:
    """rep, others: documents whose different set links with the set of ``rep``, for each set of a component of several.

    ``members``: rep, comp, weight (documents with the set). Sets whose distance
    to the component's first set is at most half of that of a link are its core;
    any two of them link, by the triangle inequality, and are counted by their
    weights alone. The others, blocks of about ``BLOCK_SETS`` sets or
    ``BLOCK_BYTES`` bytes of differences, meet each other and the blocks of the
    core in tasks of their own. No row is made for a pair of sets.
    """

    def answer(a: int, b: int, s: np.ndarray, hub: np.ndarray) -> tuple:
        held = _held(s, hub)
        gone = hub[~_held(hub, s)]
        return a, b, len(s), len(hub), len(gone), np.concatenate([gone, s[~held]]).tobytes()

    far = beside(members.where("rep <> comp").select(F.col("rep").alias("a"), F.col("comp").alias("b")), df, width, unique, answer, "a long, b long, n long, hub long, lost long, diff binary")
    rows = far.join(members.select(F.col("rep").alias("a"), "weight"), "a").select(F.col("a").alias("rep"), F.col("b").alias("comp"), "weight", "n", "hub", "lost", "diff")
    hubs = far.groupBy(F.col("b").alias("comp")).agg(F.first("hub").alias("hub"))
    hubs = members.where("rep = comp").join(hubs, "comp").select("rep", "comp", "weight", F.col("hub").alias("n"), "hub", F.lit(0).cast("long").alias("lost"), F.lit(b"").alias("diff"))
    overlap = F.col("hub") - F.col("lost")
    rows = rows.unionByName(hubs).withColumn("core", 200 * overlap >= (100 + percent) * (F.col("n") + F.col("hub") - overlap))
    rows = written(rows, "differences")
    kind = lambda c: F.when(F.col("core") == c, 1)
    blocks = lambda c: F.ceil(F.greatest(F.sum(kind(c)) / BLOCK_SETS, F.sum(kind(c) * F.octet_length("diff")) / BLOCK_BYTES))
    sizes = rows.groupBy("comp").agg(F.sum(kind(True) * F.col("weight")).alias("near"), F.coalesce(blocks(True), F.lit(0)).alias("p"), F.coalesce(blocks(False), F.lit(0)).alias("q"))
    sizes = sizes.withColumns({"p": F.when(F.col("p") == 0, F.col("p")).otherwise(F.greatest("p", F.lit(1))), "q": F.when(F.col("q") == 0, F.col("q")).otherwise(F.greatest("q", F.lit(1)))})
    sized = written(rows.join(sizes, "comp"), "differences-sized")
    inside = sized.where("core").select("rep", (F.col("near") - F.col("weight")).alias("others"))
    # blocks: those of the core are 0 to p - 1, the others p to p + q - 1; the core does not meet the core
    own = F.when(F.col("core"), F.pmod(F.xxhash64("rep"), F.greatest("p", F.lit(1)))).otherwise(F.col("p") + F.pmod(F.xxhash64("rep"), F.greatest("q", F.lit(1))))
    partners = F.when(F.col("core"), F.sequence("p", F.col("p") + F.col("q") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("p") + F.col("q") - 1))
    dealt = sized.where("q > 0").withColumn("own", own).withColumn("other", F.explode(partners))
    dealt = dealt.select("comp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "weight", "n", "hub", "lost", "diff")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "comp", "x", "y").sortWithinPartitions("comp", "x", "y", "own", "rep")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            sides = [[r for r in held if r[0] == k] for k in key[1:]]
            cols = [([r[2] for r in side], [r[3] for r in side], [r[5] for r in side], [np.frombuffer(r[6], np.uint64) for r in side], [r[1] for r in side]) for side in sides]
            (wa, na, la, da, ra), (wb, nb, lb, db, rb) = cols
            x, y = block_links((na, nb), (la, lb), (da, db), (wa, wb), held[0][4], percent, key[1] == key[2])
            reps, found = (ra, x) if key[1] == key[2] else (ra + rb, np.concatenate([x, y]))
            return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(found, pa.int64())], names=["rep", "others"])

        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[:3] != key:
                    if held:
                        yield done()
                    key, held = r[:3], []
                held.append(r[3:])
        if held:
            yield done()

    counted = inside.unionByName(dealt.mapInArrow(count, "rep long, others long")).groupBy("rep").agg(F.sum("others").alias("others"))
    counted = written(counted, "link-counts")
    forget(far, rows, sized)
    return counted


def linked(percent: int) -> Column:
    return F.col("overlap") * (100 + percent) >= percent * (F.col("na") + F.col("nb"))


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of every node of the links (a, b).

    Alternating large-star and small-star steps, each on a written edge table;
    each only groups and joins by node. Every stage takes some megabytes of the
    driver's memory while it is submitted, so a plan here has few of them.
    """
    turned = lambda *pairs: F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])).alias("e")
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    last = None
    while True:
        both = edges.select(turned(("a", "b"), ("b", "a"))).select("e.*")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "edges-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(turned(("b", "m"), ("a", "m"))).select("e.*").where("a <> b").distinct()
        new = written(small, "edges")
        forget(edges, large)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    done = written(edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()), "components")
    forget(edges)
    return done


def join_components(df: DataFrame, width: int = 5, percent: int = 80, share: float = SHARE, counts: bool = True) -> tuple[DataFrame, DataFrame]:
    """Classes of the Jaccard self-join on (doc_id, text), and the links that span them.

    First: a row for each row of ``df``: doc_id, n_shingles, component_id (the
    smallest doc_id that links reach, itself included), and with ``counts``
    n_links, the number of other documents that link with it, each of those with
    an equal set among them. Second: verified links (a, b, na, nb, overlap)
    between representatives of different sets; together with equality of sets
    they span every class.

    A null or blank text has no shingles and is a class of its own, without
    links. A null doc_id takes no part and has a null component_id and n_links.
    Rows that share a doc_id but not the set are one document, with the smallest
    of their texts; rows that repeat a document each give its row. A very long
    text is hashed in steps and has all its shingles. A similarity of just
    ``percent`` / 100 links. Other columns are not read, whatever their names. An
    empty table gives empty results.
    """
    docs, made = df.select(F.col("doc_id").cast("long"), "text"), []
    prof = written(profiles(docs, width, share), "profiles")
    ids = prof.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("s1", "s2", "n")).alias("lo"), F.max(F.struct("s1", "s2", "n")).alias("hi"), F.count("*").alias("rows"))
    torn, repeated = ids.agg(F.max((F.col("lo") != F.col("hi")).cast("int")), F.max("rows")).first()
    if torn:
        made.append(prof)
        one = written(docs.join(ids.where("lo <> hi").select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("__one"), F.lit(True).alias("__torn")), "torn")
        docs = docs.join(one, "doc_id", "left").select("doc_id", F.when(F.col("__torn"), F.col("__one")).otherwise(F.col("text")).alias("text"))
        made.append(one)
        prof = written(profiles(docs, width, share), "profiles")
    unique = (repeated or 0) <= 1
    each = prof.where("doc_id is not null and n > 0").select("doc_id", "s1", "s2", "n", "k")
    each = each if unique else each.distinct()
    classes = written(each.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("k").alias("k"), F.count("*").alias("weight")), "classes")
    entry = written(entries(docs, classes, width, share, percent), "entries")

    # the smallest id of each block of a list stands for the block
    size_block = F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int")  # sets that link are in one block or in two that touch
    block = entry.withColumn("block", size_block).withColumn("rest", F.col("n") - F.col("pos"))
    hubs = block.groupBy("token", "block").agg(F.min(F.struct("doc", "n", "rest")).alias("h"), F.count("*").alias("c")).where("c > 1")
    near = block.join(hubs, ["token", "block"]).where((F.col("doc") != F.col("h.doc")) & enough(F.col("n"), F.col("h.n"), F.col("rest"), F.col("h.rest"), percent))
    # of its block heads a set first meets the one it shares most of its prefix with; the others come with the leaders
    near = near.groupBy(F.col("doc").alias("a"), F.col("h.doc").alias("b")).agg(F.count("*").alias("c")).groupBy("a").agg(F.min_by("b", F.struct(-F.col("c"), "b")).alias("b"))
    seen = verify(near, docs, width, unique)
    links = first = seen.where(linked(percent))
    comp = components(links)

    # leaders: the linked block head that is nearest, or the set itself
    gap = 1 - F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))
    lead = written(links.groupBy("a").agg(F.min(F.struct(gap.alias("gap"), F.col("b").alias("b"))).alias("l")).select(F.col("a").alias("doc"), F.col("l.b").alias("leader"), F.col("l.gap").alias("gap")), "leaders")

    def open_entries(rows: DataFrame, name: str) -> DataFrame:
        """Entries with a block of another component near that size and position allow; three blocks at most for each."""
        rows = rows.withColumn("rest", F.col("n") - F.col("pos")).join(comp.withColumnRenamed("node", "doc"), "doc", "left").join(lead, "doc", "left")
        rows = rows.select("token", "doc", "n", "rest", F.coalesce("comp", "doc").alias("comp"), F.coalesce("leader", "doc").alias("leader"), F.coalesce("gap", F.lit(0.0)).alias("gap"))
        rows = written(rows.withColumn("block", size_block), name)
        made.append(rows)
        heads = rows.groupBy("token", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("far"))
        near = rows.withColumn("block", F.explode(F.array(*[F.col("block") + k for k in (-1, 0, 1)]))).join(heads, ["token", "block"])
        sizes = (100 * F.col("n") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("n"))
        room = F.least("rest", "far") * (100 + percent) >= percent * (F.col("n") + F.col("low"))
        near = near.where(((F.col("lo") != F.col("comp")) | (F.col("hi") != F.col("comp"))) & sizes & room)
        return near.select("token", "doc", "n", "rest", "comp", "leader", "gap").distinct()

    # only sets with such entries can link to another component; among them all shingles are
    # counted, so that the positions tell how many shingles a set shares with none of the others
    left = written(open_entries(entry, "placed").select(F.col("doc").alias("doc_id")).distinct(), "open")
    some = F.broadcast(left) if left.count() <= MOST_BROADCAST else left
    placed = written(open_entries(entries(docs.join(some, "doc_id", "left_semi"), classes.withColumn("k", F.col("n")), width, 1.0, percent), "open-placed"), "open-lists")
    heads = placed.withColumn("block", size_block).groupBy("token", "block", "leader").agg(F.min("comp").alias("comp"), F.max("gap").alias("far"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))
    x, y = heads.withColumn("block", F.explode(F.array(*[F.col("block") + k for k in (-1, 0, 1)]))).alias("x"), heads.alias("y")
    sizes = (100 * F.col("x.high") >= percent * F.col("y.low")) & (100 * F.col("y.high") >= percent * F.col("x.low"))
    room = F.least("x.rest", "y.rest") * (100 + percent) >= percent * (F.col("x.low") + F.col("y.low"))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.leader") < F.col("y.leader")) & (F.col("x.comp") != F.col("y.comp")) & sizes & room)
    met = written(met.groupBy(F.col("y.leader").alias("a"), F.col("x.leader").alias("b")).agg(F.max("y.far").alias("fa"), F.max("x.far").alias("fb")), "leader-pairs")
    if not met.isEmpty():
        known = seen.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(True).alias("known")).distinct()
        fresh = verify(met.join(known, ["a", "b"], "left_anti"), docs, width, unique)
        made += [fresh, links, comp]
        links = written(links.unionByName(fresh.where(linked(percent))), "links")
        comp = components(links)
        answers = seen.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), gap.alias("gap")).unionByName(fresh.select("a", "b", gap.alias("gap"))).distinct()
        within = (100 - percent) / 100 + 1e-9
        maybe = met.join(answers, ["a", "b"], "left").where((F.col("fa") + F.col("fb") > 0) & (F.coalesce("gap", F.lit(0.0)) <= within + F.col("fa") + F.col("fb")))
        maybe = written(maybe.select(F.col("a").alias("la"), F.col("b").alias("lb"), F.coalesce("gap", F.lit(0.0)).alias("apart")), "follower-pairs")
        made.append(maybe)
        if not maybe.isEmpty():
            at = comp.withColumnRenamed("node", "doc").withColumnRenamed("comp", "now")
            place = placed.join(at, "doc", "left").withColumn("now", F.coalesce("now", "doc"))
            x = place.join(maybe, F.col("leader") == F.col("la")).select("token", "lb", (F.col("apart") - F.col("gap") - within).alias("xg"), F.col("doc").alias("xd"), F.col("n").alias("xn"), F.col("rest").alias("xr"), F.col("now").alias("xc"))
            y = place.select("token", F.col("leader").alias("lb"), F.col("gap").alias("yg"), F.col("doc").alias("yd"), F.col("n").alias("yn"), F.col("rest").alias("yr"), F.col("now").alias("yc"))
            pairs = x.join(y, ["token", "lb"]).where((F.col("xc") != F.col("yc")) & (F.col("xg") <= F.col("yg")) & enough(F.col("xn"), F.col("yn"), F.col("xr"), F.col("yr"), percent))
            pairs = pairs.select(F.greatest("xd", "yd").alias("a"), F.least("xd", "yd").alias("b")).distinct()
            last = verify(pairs, docs, width, unique)
            made += [last, links, comp]
            links = written(links.unionByName(last.where(linked(percent))), "links")
            comp = components(links)
    rows = prof.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "s1", "s2", "n")
    rows = rows.join(classes.select("s1", "s2", "n", "rep", "weight"), ["s1", "s2", "n"], "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    named = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("comp", "rep", "doc_id")).alias("component_id"), "rep", "weight")
    if counts:
        members = classes.select("rep", "weight").join(comp.withColumnRenamed("node", "rep"), "rep")
        found = link_counts(docs, members, width, percent, unique)
        made.append(found)
        n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("weight") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)))
        named = named.join(found, "rep", "left").withColumn("n_links", n_links)
    named = written(named.select("doc_id", "n_shingles", "component_id", *["n_links"] * counts), "named")
    if links is first:
        links = written(links, "links")
    forget(prof, classes, entry, seen, comp, lead, left, placed, met, *made)
    return named, links


def keep_one(df: DataFrame, **options: int) -> DataFrame:
    """The rows of ``df`` that stay when one document of each class does: the one with the smallest id.

    Rows with a null doc_id, and documents without words, stay. Of rows that
    repeat the smallest doc_id one stays, with the smallest text. Very long texts
    are compared as a whole; an empty table gives an empty one. Columns stay as
    they are, whatever their names.
    """
    found, links = join_components(df, counts=False, **options)
    forget(links)
    going = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "going")
    if going.count() <= MOST_BROADCAST:
        going = F.broadcast(going)
    rest = df.join(going, "doc_id", "left_anti").select(*df.columns)
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return rest
    order = Window.partitionBy("doc_id").orderBy("text", *[F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])])
    ranked = rest.join(twice, "doc_id", "left_semi").withColumn("__rank", F.row_number().over(order)).where("__rank = 1").select(*df.columns)
    return rest.join(twice, "doc_id", "left_anti").select(*df.columns).unionByName(ranked)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(documents(spark, sf_dir))[0]


OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{SPACE}]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), t AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.h = b.h AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY 1, 2, a.n, b.n HAVING 180 * COUNT(*) >= 80 * (a.n + b.n)
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT o.b, r.c FROM r JOIN o ON o.a = r.doc_id AND r.c < o.b
)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, MIN(r.c) AS component_id, CAST(COALESCE(ANY_VALUE(l.n), 0) AS BIGINT) AS n_links
FROM s JOIN r USING (doc_id) LEFT JOIN (SELECT a AS doc_id, COUNT(*) AS n FROM o GROUP BY 1) l USING (doc_id) GROUP BY s.doc_id, s
"""
