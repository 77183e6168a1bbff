"""Near-duplicates with an LSH forest over MinHash signatures.

1. Every text gives its set of distinct shingles of ``words`` words (A-Z lower-cased), hashed to 64 bits, and a
   signature of TREES * DEPTH minima. Texts with equal sets form a class; one of each goes on.
2. Each tree sorts the classes by its DEPTH minima; the orders are dealt out by range, so that a dense place of one
   is many tasks' work. Those that share the first LEAST minima form a region. Neighbours by longest common
   prefix are candidates: for each class up to WIDTH on each side, from the deepest common prefix upward, LEAST deep
   at the least. So depth adapts to the region: in one of few classes all meet, however short their common prefix;
   in a dense one only those with the longest prefixes do. Of each region's candidates a maximum spanning
   forest by estimated similarity is proposed, so candidates are linear in the classes.
3. Proposed pairs are confirmed on full sets; confirmed links make components (alternating stars).
4. Closing: in regions that still hold several components, classes outside the region's largest component (open
   ones) are compared with all others: pairs that the signatures don't exclude (estimate at least FLOOR) are confirmed
   or refuted on full sets, each in the first tree where it shares a region. So each pair that shares a region is
   linked, refuted or inside one component. A region is dealt out in blocks of about BLOCK classes; its open
   classes visit all of its blocks, in parties of about BLOCK, so no task gets more than two blocks at a time, and no
   pairs are made.
5. Regions that would take more than DENSE such visits (many classes that are alike but not linked) are not visited. Their
   classes' sets are joined exactly by prefixes instead: shingles are ordered by how many of these classes have them, the
   rarest first, after those that no open class has. Of two sets that are similar enough the smaller, x, shows one of its first |x| - ceil(2t / (1 + t) * |x|) + 1
   shingles among the first |y| - ceil(t * |y|) + 1 of the other; and what is left of both behind it must suffice. Shingles of one
   class alone, or of no open one, take the first places but make no rows, so alike texts whose own parts differ meet nowhere: work grows with the sets, not with
   their pairs. Only pairs of two components, one of them open, are confirmed.

Two sets of similarity 0.75 share a region unless all trees miss: (1 - 0.75**3)**20 = 1.7e-5; FLOOR is 4.8
standard deviations below 0.75.

Nulls: a null text has no shingles and is linked with nothing, as are empty texts. A null id counts as above
all others: such a row is in its component, but only names it where all ids are null (component null). Repeated
rows and rows with the same id are documents of their own. Ties: classes with equal minima are ordered by their
hash. Very long texts: a task holds one text, some 30 bytes a byte (measured: 0.6 GB for 20 MB). An empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.frames import NO_ID, attached, keyed, packed, partitions, saved, scoped, unpacked
from noticeflow.llm.textkit import Rolling, Slice, column, ids, mix, slices, text_buffers, tidy, valid_windows

WORDS, PERCENT = 5, 75
TREES, DEPTH, LEAST = 20, 6, 3
WIDTH = 4
BLOCK = 256
DENSE = 64  # visits of a party to a block that a region may take
PROPOSE, FLOOR = 0.68, 0.56

_rng = np.random.Generator(np.random.PCG64(77))
MULTIPLIERS = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = "_id long, _th long, n_shingles long, c long, minima binary"


def shingle_sets(s: Slice, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and each document's first (n + 1 values)."""
    first = s.words()[2]
    counts = np.diff(first)
    w = s.word_hashes(lower=True)
    rolling = Rolling(w, 1)
    at = valid_windows(first, words)
    doc = s.doc_of_word()
    short = np.flatnonzero((counts > 0) & (counts < words))
    values = np.r_[rolling.windows(words)[at] if len(at) else np.zeros(0, np.uint64), mix(rolling.ranges(first[short], first[short + 1]) + counts[short].astype(np.uint64))]
    owner = np.r_[doc[at], short]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(s.n + 1))


def region_keys(minima: np.ndarray) -> np.ndarray:
    """For each row of minima the region it is in, tree by tree."""
    trees = minima.reshape(len(minima), TREES, DEPTH)
    head = np.zeros((len(minima), TREES), np.uint64)
    for k in range(LEAST):
        head = (head << np.uint64(16)) | trees[:, :, k].astype(np.uint64)
    return mix(head ^ mix(np.arange(TREES, dtype=np.uint64) + np.uint64(1))).view(np.int64)


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Step 1: set size, class c and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            doc_ids, ths = column(batch, "_id"), column(batch, "_th")
            for s in slices(data, offsets):
                values, first = shingle_sets(s, words)
                n = np.diff(first)
                full = np.flatnonzero(n > 0)
                starts = first[:-1][full]
                c = np.zeros(s.n, np.int64)
                minima = np.zeros((s.n, TREES * DEPTH), np.uint16)
                if len(full):
                    one, two = np.add.reduceat(mix(values), starts), np.bitwise_xor.reduceat(mix(values * np.uint64(0x2545F4914F6CDD1D)), starts)
                    c[full] = mix(one ^ mix(two + n[full].astype(np.uint64))).view(np.int64)
                    for k, a in enumerate(MULTIPLIERS):
                        minima[full, k] = (mix(np.minimum.reduceat(values * a, starts)) & np.uint64(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(s.i, s.n), ths.slice(s.i, s.n), pa.array(n.astype(np.int64)), pa.array(c), pa.array([r.tobytes() for r in minima], pa.binary())], ["_id", "_th", "n_shingles", "c", "minima"])

    return docs.select("_id", "_th", "text").mapInArrow(tidy(run), SIGNED)


def signatures_of(batch: pa.RecordBatch) -> np.ndarray:
    minima, offs = text_buffers(column(batch, "minima"))
    return minima[offs[0] : offs[-1]].view(np.uint16).reshape(batch.num_rows, TREES * DEPTH)


def orders(classes: DataFrame) -> DataFrame:
    """Step 2: a row for each class and tree: the region (key) and the minima below it (tail, 16 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = signatures_of(batch)
            tail = np.zeros((len(m), TREES), np.uint64)
            for k in range(LEAST, DEPTH):
                tail = (tail << np.uint64(16)) | m.reshape(-1, TREES, DEPTH)[:, :, k].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(column(batch, "c").to_numpy(), TREES)), pa.array(region_keys(m).ravel()), pa.array(tail.ravel().view(np.int64))], ["c", "key", "tail"])

    return classes.select("c", "minima").mapInArrow(tidy(run), "c long, key long, tail long")


def common_prefix(key: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """How many minima each row of a tree's order shares with the one before; 0 where the region is another."""
    if not len(key):
        return np.zeros(0, np.int64)
    same = key[1:] == key[:-1]
    differ = tail[1:] ^ tail[:-1]
    below = sum(((differ >> np.int64(16 * k)) == 0).astype(np.int64) for k in range(DEPTH - LEAST))
    return np.r_[0, np.where(same, LEAST + below, 0)]


def candidates(key: np.ndarray, tail: np.ndarray, m: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i before j) of a tree's order that are among each other's WIDTH nearest by common prefix and are
    estimated to be similar enough, and that estimate."""
    lcp = common_prefix(key, tail)
    shared = lcp.copy()  # with the row ``back`` places before
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for back in range(1, WIDTH + 1):
        j = np.arange(back, len(key))
        if back > 1:
            shared = np.r_[0, np.minimum(shared[:-1], lcp[1:])] if len(lcp) else lcp  # the least step on the way back
        j = j[shared[j] >= LEAST]
        alike = (m[j] == m[j - back]).mean(1)
        ok = alike >= least
        out.append((j[ok] - back, j[ok], alike[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Forest:
    """Union-find over whatever can be hashed."""

    def __init__(self):
        self.up: dict = {}

    def top(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a, b) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[a] = b
        return a != b


def _emit(pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        a, b = np.array(sorted({(min(p), max(p)) for p in pairs}), np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: spanning pairs of the candidates of each region, from rows in a tree's order."""
    held: tuple | None = None  # the last WIDTH rows
    forest, region = Forest(), None
    for batch in batches:
        key, tail, c, m = (*(column(batch, x).to_numpy() for x in ("key", "tail", "c")), signatures_of(batch))
        old = 0
        if held is not None:
            old = len(held[0])
            key, tail, c, m = (np.concatenate(x) for x in zip(held, (key, tail, c, m), strict=True))
        i, j, alike = candidates(key, tail, m, PROPOSE)
        new = j >= old
        i, j, alike = i[new], j[new], alike[new]
        order = np.lexsort((-alike, key[j]))
        out = []
        for k, a, b in zip(key[j][order].tolist(), c[i][order].tolist(), c[j][order].tolist(), strict=True):
            if k != region:
                forest, region = Forest(), k
            if forest.join(a, b):
                out.append((a, b))
        yield from _emit(out)
        held = tuple(x[-WIDTH:].copy() for x in (key, tail, c, m))
        if region is not None and region != int(key[-1]):
            forest, region = Forest(), None


def first_here(m: np.ndarray, i: int, others: np.ndarray, key: int) -> np.ndarray:
    """Of the others those that share no earlier region with i than that of this key."""
    mine, theirs = m[i].reshape(TREES, DEPTH)[:, :LEAST], m[others].reshape(len(others), TREES, DEPTH)[:, :, :LEAST]
    first = np.argmax((theirs == mine).all(2), axis=1)
    return region_keys(m[i : i + 1])[0][first] == key


def open_pairs(m: np.ndarray, c: np.ndarray, comp: np.ndarray, visitor: np.ndarray, is_open: np.ndarray, key: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a block's rows each visitor i with the residents j whose pair is to be looked at here: other component, not
    excluded, not seen in an earlier tree. A pair of open classes is looked at where the one with the larger c lives."""
    home = np.flatnonzero(~visitor)
    for i in np.flatnonzero(visitor):
        near = home[(comp[home] != comp[i]) & (~is_open[home] | (c[home] > c[i]))]
        near = near[(m[near] == m[i]).mean(1) >= FLOOR]
        if len(near):
            near = near[first_here(m, i, near, key)]
        if len(near):
            yield i, near


def _blocks(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """key, c, comp, visitor, open, minima and a further column of consecutive rows of one block of a region."""
    held: list[tuple] = []

    def block():
        key, _, _, c, comp, visitor, is_open, minima, *more = zip(*held, strict=True)
        m = np.frombuffer(b"".join(minima), np.uint16).reshape(len(c), -1)
        return key[0], np.array(c), np.array(comp), np.array(visitor), np.array(is_open), m, more[0] if more else []

    for batch in batches:
        for row in zip(*(column(batch, x).to_pylist() for x in ("key", "block", "party", "c", "comp", "visitor", "open", "minima", *names)), strict=True):
            if held and row[:3] != held[0][:3]:
                yield block()
                held = []
            held.append(row)
    if held:
        yield block()


def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: the rows (key, c) that have a pair to look at."""
    for key, c, comp, visitor, is_open, m, _ in _blocks(batches):
        need = np.zeros(len(c), bool)
        for i, near in open_pairs(m, c, comp, visitor, is_open, key):
            need[i] = True
            need[near] = True
        if need.any():
            found = np.unique(c[need])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key)), pa.array(found)], ["key", "c"])


def settle(percent: int):
    """Step 4: links between components, from the rows of a block with their sets."""

    def links(key, c, comp, visitor, is_open, m, sets) -> list[tuple[int, int]]:
        sizes = np.array([len(x) // 8 for x in sets])
        _, token = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
        starts = np.r_[0, np.cumsum(sizes)]
        flag = np.zeros(int(token.max()) + 1, np.int64)
        forest = Forest()
        out = []
        for i, near in open_pairs(m, c, comp, visitor, is_open, key):
            near = near[[forest.top(comp[j]) != forest.top(comp[i]) for j in near]]
            if not len(near):
                continue
            own = token[starts[i] : starts[i + 1]]
            flag[own] = 1
            shared = np.array([flag[token[starts[j] : starts[j + 1]]].sum() for j in near])
            flag[own] = 0
            for j in near[100 * shared >= percent * (sizes[i] + sizes[near] - shared)]:
                if forest.join(comp[i], comp[j]):
                    out.append((int(c[i]), int(c[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, "shingles"):
            yield from _emit(links(*block))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xo), (y, yo) = text_buffers(column(batch, "x")), text_buffers(column(batch, "y"))
            ok = np.zeros(len(xo) - 1, bool)
            for i in range(len(ok)):
                u, v = x[xo[i] : xo[i + 1]].view(np.uint64), y[yo[i] : yo[i + 1]].view(np.uint64)
                both = np.sort(np.concatenate([u, v]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * shared >= percent * (len(u) + len(v) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    one, two = sets.select(F.col("c").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("c").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one.hint("shuffle_merge"), "a").join(two.hint("shuffle_merge"), "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def alike(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Step 5: the pairs (a, b) of classes (c, comp, open) whose sets can be similar enough, of two components, one open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(column(batch, "shingles"))
            n = np.diff(offs) // 8
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(column(batch, "c").to_numpy(), n)), pa.array(np.repeat(n, n)), pa.array(data[offs[0] : offs[-1]].view(np.int64))], ["c", "n", "token"])

    open_ = saved(classes.where("open").select("c", "open"))
    tokens = attached(sets.select("c", "shingles").mapInArrow(tidy(run), "c long, n long, token long"), open_, F.lit(1), "left", ("c",))
    stats = saved(tokens.groupBy("token").agg(F.count("*").alias("df"), F.count("open").alias("k")).where("df > 1 and k > 0").select("token", "df"))
    met = attached(tokens.select("c", "n", "token"), stats, F.lit(0), "inner", ("token",))
    own = Window.partitionBy("c")
    at = met.withColumn("pos", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token")))
    least = lambda part, whole: F.col("n") - F.expr(f"({part} * n + {whole - 1}) div {whole}") + 1
    prefix = at.where(F.col("pos") <= least(percent, 100)).withColumn("first", F.col("pos") <= least(2 * percent, 100 + percent))
    prefix = saved(prefix.select("c", "n", "token", "pos", "first").join(classes, "c"))
    x, y = (prefix.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("c", "n", "pos", "comp", "open", "first"))) for s in "xy")
    smaller = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("c_x") < F.col("c_y")))
    needed = F.expr(f"({percent} * (n_x + n_y) + {100 + percent - 1}) div {100 + percent}")
    enough = (100 * F.col("n_x") >= percent * F.col("n_y")) & (1 + F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= needed)
    pairs = x.where("first_x").join(y, "token").where(smaller & enough & (F.col("comp_x") != F.col("comp_y")) & (F.col("open_x") | F.col("open_y")))
    return saved(pairs.select(F.col("c_x").alias("a"), F.col("c_y").alias("b")).distinct())


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """c and the sorted shingle hashes of its representative's text. wanted: c, _id, _th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            for s in slices(data, offsets):
                values, first = shingle_sets(s, words)
                yield pa.RecordBatch.from_arrays([column(batch, "c").slice(s.i, s.n), pa.array([values[first[d] : first[d + 1]].tobytes() for d in range(s.n)], pa.binary())], ["c", "shingles"])

    return attached(docs, wanted, F.lit(16), "inner").select("c", "text").mapInArrow(tidy(run), "c long, shingles binary").dropDuplicates(["c"])


@scoped
def components(links: DataFrame) -> DataFrame:
    """v, comp: the least vertex that each vertex reaches, by alternating large and small stars.

    links: a, b. The least neighbour of a vertex is a minimum that is combined before it is shuffled, and comes back by a
    join whose large partitions can be split, so a star's centre is not one task's work. Rounds grow with the
    logarithm of the longest chain.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = saved(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("c"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("c"), F.col("v").alias("comp")).distinct())


@scoped
def clustered(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable, its own included), n_links (confirmed links of
    its class, of a spanning set), kept (doc_id = component_id; null ids count as equal), comp (what tells components
    apart, as ids may be null or occur in several; null for texts without words)."""
    docs = keyed(docs)
    n = partitions(docs)
    sig = saved(signed(docs, words))
    classes = saved(sig.where("n_shingles > 0").groupBy("c").agg(F.min(F.struct("_id", "_th")).alias("rep"), F.min("minima").alias("minima")))
    trees = orders(classes)
    shared = saved(trees.join(trees.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").select("c", "key", "tail", "n"))
    signatures = saved(classes.select("c", "minima").join(shared.select("c").distinct(), "c", "left_semi"))

    def proposed() -> DataFrame:
        rows = saved(shared.select("key", "tail", "c").join(signatures, "c"))
        return rows.repartitionByRange(n, "key", "tail", "c").sortWithinPartitions("key", "tail", "c").mapInArrow(tidy(propose), "a long, b long").distinct()

    def with_component(rows: DataFrame, comp: DataFrame) -> DataFrame:
        return rows.join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))

    def regions_of(rows: DataFrame) -> DataFrame:
        """Regions of several components of rows (key, c, comp): blocks, parties of open classes, the largest component."""
        by_comp = rows.groupBy("key", "comp").agg(F.count("*").alias("k"))
        regions = by_comp.groupBy("key").agg(F.sum("k").alias("size"), F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("most")).where("comps > 1")
        count = lambda x: F.ceil(x / BLOCK).cast("int")
        return saved(regions.select("key", count(F.col("size")).alias("blocks"), count(F.col("size") - F.col("most.k")).alias("parties"), F.col("most.comp").alias("largest")))

    def in_blocks(rows: DataFrame) -> DataFrame:
        """Rows (key, c, comp) of regions of several components, each in its block, open ones as visitors in all blocks."""
        regions = regions_of(rows)
        dealt = attached(rows, regions, F.lit(24), "inner", ("key",)).withColumn("open", F.col("comp") != F.col("largest"))
        one_of = lambda x, salt: F.pmod(F.xxhash64("c", F.lit(salt)), F.col(x)).cast("int")
        each = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
        at_home = dealt.select("key", one_of("blocks", 1).alias("block"), each("parties").alias("party"), "c", "comp", F.lit(False).alias("visitor"), "open")
        visits = dealt.where("open").select("key", each("blocks").alias("block"), one_of("parties", 2).alias("party"), "c", "comp", F.lit(True).alias("visitor"), "open")
        return at_home.unionByName(visits)

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "key", "block", "party").sortWithinPartitions("key", "block", "party", "c", "visitor")

    def sets_of(c: DataFrame) -> DataFrame:
        wanted = c.distinct().join(classes, "c").select("c", F.col("rep._id").alias("_id"), F.col("rep._th").alias("_th"))
        return saved(full_sets(docs, saved(wanted), words))

    pairs = saved(proposed())
    links = saved(confirmed(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("c"))), percent))
    comp = components(links)
    placed = saved(with_component(shared.select("key", "c"), comp))
    dense = saved(regions_of(placed).where(F.col("blocks") * F.col("parties") > DENSE).select("key", "largest"))
    if not dense.isEmpty():
        own = attached(placed, dense, F.lit(16), "inner", ("key",)).groupBy("c").agg(F.first("comp").alias("comp"), F.max(F.col("comp") != F.col("largest")).alias("open"))
        own = saved(own)
        sets = sets_of(own.select("c"))
        more = saved(confirmed(alike(own, sets, percent), sets, percent))
        if not more.isEmpty():
            links = saved(links.unionByName(more))
            comp = components(links)
        placed = saved(with_component(attached(placed.drop("comp"), dense, F.lit(16), "left_anti", ("key",)), comp))
    looked_at = in_blocks(placed).join(signatures, "c")
    columns = ("key", "block", "party", "c", "comp", "visitor", "open", "minima")
    left = saved(together(looked_at.select(*columns)).mapInArrow(tidy(open_rows), "key long, c long").distinct())
    if not left.isEmpty():
        rows = in_blocks(saved(with_component(left, comp))).join(signatures, "c").join(sets_of(left.select("c")), "c")
        more = saved(together(rows.select(*columns, "shingles")).mapInArrow(tidy(settle(percent)), "a long, b long").distinct())
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("n_links"))
    ends = classes.select("c", F.col("rep._id").alias("least")).join(comp, "c", "left").join(degree, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    named = ends.groupBy("comp").agg(F.min("least").alias("component")).join(ends, "comp").select("c", "comp", "component", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = sig.select("_id", "_th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("c")).alias("c")).join(named, "c", "left")
    component = F.coalesce("component", "_id")
    null = lambda c: F.when(c != NO_ID, c)
    return rows.select(null(F.col("_id")).alias("doc_id"), "n_shingles", null(component).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("_id") == component).alias("kept"), "comp", "_th")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, of which one stays of each component; texts without words all stay."""
    found = clustered(docs, words, percent)
    stay = found.where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "_th", "comp", "n_shingles")
    winners = stay.where("n_shingles > 0").groupBy("comp").agg(F.min(F.struct("_id", "_th")).alias("w")).select("w.*")
    winners = saved(winners.unionByName(stay.where("n_shingles = 0").select("_id", "_th").distinct()))
    rows = packed(docs)
    out = attached(rows, winners, F.lit(0), "left_semi")
    twice = found.where("n_shingles > 0").groupBy("doc_id", "_th").count().where("count > 1")
    if not twice.isEmpty():  # rows that agree in id and text: one stays
        again = saved(twice.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "_th").withColumn("again", F.lit(True)))
        marked = attached(out, again, F.lit(1), "left")
        out = marked.where("again is null").drop("again").unionByName(marked.where("again").drop("again").dropDuplicates(["_id", "_th"]))
    return unpacked(out, docs.columns)
