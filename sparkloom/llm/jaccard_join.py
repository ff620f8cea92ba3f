"""Exact Jaccard join on word shingles by T-occurrence search with divided inverted lists.

Documents are sets of hashed five-word shingles. Two sets link when their intersection is at least `percent` of their
union, so a set of n shingles needs T = ceil(percent * n) of them in common with any partner: among its n - T + 1
rarest at least one. The work is divided as DivideSkip divides it, over the cluster:

* the short lists: every set emits its n - T + 1 rarest shingles (rarest by the counts of their buckets over all
  documents, then by hash; any one order of all shingles keeps the join exact), and shingles that only one set emits vanish;
* sets that meet on a short list stay together only if their counts of shingles by class differ by no more than linked
  sets' can; per list a spanning forest of such meetings is kept, never all pairs, and the forest's connected
  components hold all links. A list of more than list_rows sets is dealt to several tasks; each keeps, besides its
  forest, the sets from which it found the others, and those of all its tasks are joined where, by the triangle
  inequality, sets found from them can link;
* in each component the exact search runs set by set: short lists are merged, long ones probed by binary search, and
  partners that reach the overlap join the component; what has joined is searched for no more.

Copies collapse before all this to the smallest doc_id of equal sets (128-bit sums of hashes), in each task first.
Components of more than max_group_shingles are searched in blocks; one set of each group found there meets those of the
other blocks, and only sets that are then outside the component's largest group meet all blocks.

Lists and components come to a task sorted, so it holds one at a time. Very long texts are sets like others; a task
holds the words of one of them at a time.

Null, empty and wordless texts have the empty set and link with nothing; texts of fewer words than a shingle are one
shingle; ties don't arise. Rows that repeat a doc_id give as many rows. Rows without a doc_id link with nothing: they
give their n_shingles and a null component_id. Other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import RollingHash, Scratch, WordHashes, mix, shuffle_partitions, small_batches, sorted_groups, text_blocks
from sparkloom.llm.components import Stars, connected_components, contracted

#: Classes of shingles that are counted for each set: more for larger sets, so that chance can't make two look alike.
LEAST_CLASSES, MOST_CLASSES = 64, 1024
DOC, SHORT = 0, 1
EDGE, FOUND_FROM = 0, 1
#: Shingles are counted in so many buckets (a power of two), whose counts are added up in so many parts.
BUCKETS, BUCKET_PARTS = 1 << 21, 256
#: Sets that so many others of a list were found from are compared pair by pair; more are joined as they are.
MOST_PAIRED = 5_000
I64, I32 = pa.int64(), pa.int32()


class Shingler:
    """Sets of shingle hashes of a block of texts, laid end to end."""

    def __init__(self, k: int):
        self.k, self.hashes, self.rolling = k, WordHashes(), RollingHash(0x9E3779B97F4A7C15)

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text index, hash) of the distinct shingles, by text and hash."""
        split = [t.encode("utf-8").lower().split() if t else [] for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        words = self.hashes.of([w for ws in split for w in ws])
        shingles = np.where(n >= self.k, n - self.k + 1, np.minimum(n, 1))
        text = np.repeat(np.arange(len(texts)), shingles)
        within = np.arange(len(text)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
        start = (np.cumsum(n) - n)[text] + within
        h = self.rolling.runs(self.rolling.prefix(words), start, np.minimum(n, self.k)[text]) if len(text) else np.zeros(0, np.uint64)
        order = np.argsort(h)
        owner = text[order]  # sorting by it in 16 bits is several times faster than np.lexsort
        order = order[np.argsort(owner.astype(np.uint16) if len(texts) <= 1 << 16 else owner, kind="stable")]
        text, h = text[order], h[order]
        keep = np.r_[True, (np.diff(text) != 0) | (h[1:] != h[:-1])][: len(h)]
        return text[keep], h[keep]


def needed(n, percent: int):
    """Shingles that a set of n shares with any partner, at least."""
    return -(-percent * n // 100)


def bucket_of(h: np.ndarray) -> np.ndarray:
    """Where each shingle is counted: by its upper bits, as classes go by the lower ones."""
    return (h >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def shingle_counts(docs: DataFrame, k: int) -> np.ndarray:
    """For each bucket of shingles, how many of all documents hold them, less the mean of the buckets (what the other
    shingles of a bucket add to its count), 0 at least. Its size does not grow with the documents."""
    size = BUCKETS // BUCKET_PARTS

    def count(batches):
        shingler, counts = Shingler(k), np.zeros(BUCKETS, np.int32)
        for _, texts in text_blocks(batches, "doc_id", "text"):
            np.add.at(counts, bucket_of(shingler.sets(texts)[1]), np.int32(1))  # of one type, or it is slow
        parts = np.flatnonzero(counts.reshape(-1, size).any(axis=1))
        pack = zstandard.ZstdCompressor(level=1).compress
        packed = [pack(counts[p * size : (p + 1) * size].tobytes()) for p in parts.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(parts, I64), pa.array(packed, pa.binary())], ["part", "counts"])

    def add(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(*(c.to_pylist() for c in batch.columns)):
                total[part] = total.get(part, 0) + np.frombuffer(unpack(packed), np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), I64), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["part", "counts"])

    schema = "part long, counts binary"
    counted = docs.select("doc_id", "text").mapInArrow(count, schema).repartition(shuffle_partitions(docs.sparkSession), "part").mapInArrow(add, schema).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    for part, own in zip(*(c.to_pylist() for c in counted.columns)):
        counts[part * size : (part + 1) * size] = np.frombuffer(own, np.int64)
    return np.clip(counts - int(counts.mean()), 0, np.iinfo(np.int32).max).astype(np.int32)


def short_lists(docs: DataFrame, k: int, percent: int, counts: np.ndarray, list_rows: int) -> DataFrame:
    """Rows of kind DOC (doc_id, n, digest x and y, class counts) and, for one of a task's equal sets, SHORT (doc_id,
    x: shingle, n: which part of the list, as lists that the counts show to be long are dealt to several tasks)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = "kind int, doc_id long, n int, x long, y long, classes binary"
    names, types = zip(*(f.split() for f in schema.split(", ")))
    arrow = [pa.int32(), I64, pa.int32(), I64, I64, pa.binary()]

    def run(batches):
        counts = shared.value
        shingler = Shingler(k)
        met: set[tuple[int, int]] = set()
        for ids, texts in text_blocks(batches, "doc_id", "text"):
            text, h = shingler.sets(texts)
            m = len(texts)
            n = np.bincount(text, minlength=m)
            first = np.cumsum(n) - n

            def total(v):
                sums = np.r_[np.uint64(0), np.cumsum(v)]
                return (sums[first + n] - sums[first]).view(np.int64)

            x, y = total(mix(h ^ np.uint64(0x5851F42D4C957F2D))), total(mix(h ^ np.uint64(0x14057B7EF767814F)))
            k_of = n_classes(n)
            ends = np.cumsum(k_of)
            cell = (ends - k_of)[text] + (h & (k_of[text] - 1).astype(np.uint64)).astype(np.int64)
            counted = np.minimum(np.bincount(cell, minlength=int(k_of.sum())), 255).astype(np.uint8).tobytes()
            classes = [counted[b - a : b] for a, b in zip(k_of.tolist(), ends.tolist())]
            rows = [pa.array(np.zeros(m, np.int32)), pa.array(ids, I64), pa.array(n.astype(np.int32)), pa.array(x), pa.array(y), pa.array(classes, pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, list(names))
            new = np.zeros(m, bool)
            if len(met) > 200_000:
                met.clear()
            for i, key in enumerate(zip(x.tolist(), y.tolist())):
                if n[i] and key not in met:
                    met.add(key)
                    new[i] = True
            text, h = text[new[text]], h[new[text]]
            df = counts[bucket_of(h)]
            order = np.argsort((text << 32) | df, kind="stable")  # sorted by text and h already
            text, h, df = text[order], h[order], df[order]
            kept = n * new
            place = np.arange(len(text)) - (np.cumsum(kept) - kept)[text]
            short = place < (n - needed(n, percent) + 1)[text]
            text, h, df = text[short], h[short], df[short]
            owner = np.asarray(ids, np.int64)[text] if len(text) else np.zeros(0, np.int64)
            parts = np.ceil(df / list_rows).astype(np.int64)
            part = np.where(parts > 1, dealt(owner, np.maximum(parts, 1)), -1)
            none = [pa.nulls(len(h), t) for t in arrow]
            none[:4] = pa.array(np.full(len(h), SHORT, np.int32)), pa.array(owner), pa.array(part.astype(np.int32)), pa.array(h.view(np.int64))
            yield pa.RecordBatch.from_arrays(none, list(names))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def counts_only(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and n_shingles of each row."""

    def run(batches):
        shingler = Shingler(k)
        for ids, texts in text_blocks(batches, "doc_id", "text"):
            n = np.bincount(shingler.sets(texts)[0], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, I64), pa.array(n.astype(np.int64))], ["doc_id", "n_shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long")


def dealt(doc: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return (mix(doc.view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)) % parts.astype(np.uint64)).astype(np.int64)


def n_classes(n: np.ndarray) -> np.ndarray:
    """A power of two, about a tenth of the set's size."""
    doublings = np.ceil(np.log2(np.maximum(n, 1) / (10 * LEAST_CLASSES)))
    return (LEAST_CLASSES * 2 ** np.maximum(doublings, 0)).clip(max=MOST_CLASSES).astype(np.int64)


def _shared_only(list_rows: int):
    """Short lists of two sets or more, dealt anew where they are long; of a task's lists with the same sets one is enough."""

    def run(batches):
        met: set[tuple[int, int]] = set()
        for cols in sorted_groups(batches, keys=2):
            x, first_part, doc = (cols[c].to_numpy() for c in ("x", "part", "doc_id"))
            start = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (first_part[1:] != first_part[:-1])])
            size = np.diff(np.r_[start, len(x)])
            members = np.add.reduceat(mix(doc.view(np.uint64)), start)
            whole = (first_part[start] < 0) & (size <= list_rows)
            chosen = ~whole
            if len(met) > 300_000:
                met.clear()
            for i in np.flatnonzero(whole & (size > 1)).tolist():
                key = int(members[i]), int(size[i])
                if key not in met:
                    met.add(key)
                    chosen[i] = True
            keep = np.repeat(chosen, size)
            again = dealt(doc ^ 1, np.repeat(-(-size // list_rows), size))
            part = np.where(np.repeat(whole, size), -1, (np.maximum(first_part, 0).astype(np.int64) << 32) + again)
            yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (x, part, doc)], ["x", "part", "doc_id"])

    return run


class ClassCounts:
    """Counts of shingles by class, of sets that may have different numbers of classes."""

    def __init__(self, counts: list[bytes]):
        self.k = np.fromiter(map(len, counts), np.int64, len(counts))
        self.at = np.cumsum(self.k) - self.k
        self.flat = np.frombuffer(b"".join(counts), np.uint8)

    def folded(self, rows: np.ndarray, k: int) -> np.ndarray:
        """Counts of these sets by k classes; 255 stands for more, as it does in each set."""
        out = np.empty((len(rows), k), np.int32)
        own = self.k[rows]
        for own_k in np.unique(own):
            which = np.flatnonzero(own == own_k)
            cells = self.flat[self.at[rows[which]][:, None] + np.arange(own_k)]
            out[which] = np.minimum(cells.reshape(-1, own_k // k, k).sum(axis=1, dtype=np.int32), 255)
        return out

    def differ(self, i: np.ndarray, j: np.ndarray, coarser: int = 1) -> np.ndarray:
        """How many shingles the sets i and j differ in, at least."""
        gap, least = np.zeros(len(i), np.int64), np.minimum(self.k[i], self.k[j]) // coarser
        for k in np.unique(least):
            which = np.flatnonzero(least == k)
            for s in range(0, len(which), 1_000_000 // int(k)):
                part = which[s : s + 1_000_000 // int(k)]
                gap[part] = np.abs(self.folded(i[part], int(k)) - self.folded(j[part], int(k))).sum(axis=1)
        return gap


def compatible(n, m, difference, percent: int):
    """Whether sets of n and m shingles that differ in so many, at least, can link."""
    return difference * (100 + percent) <= (n + m) * (100 - percent)


def near_enough(n, m, difference, percent: int):
    """Whether sets that can link with one of n and one of m shingles can link with each other: from end to end the
    difference is at most that of three links between sets whose sizes differ by 100 / percent at most."""
    return difference * (100 + percent) * percent <= (n + m) * (100 - percent) * (percent + 200)


FOREST = "kind int, a long, b long, n int, classes binary"


def _forest(percent: int):
    """Edges that join the sets of each short list that can link and, of lists that several tasks share, the sets that
    others were found from (a: shingle, b: set)."""

    def run(batches):
        stars = Stars()

        def edges() -> pa.RecordBatch:
            out = stars.batch()
            m = out.num_rows
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, EDGE, np.int32)), *out.columns, pa.nulls(m, I32), pa.nulls(m, pa.binary())], ["kind", "a", "b", "n", "classes"])

        for cols in sorted_groups(batches, keys=2, most=20_000):
            x, part, doc, n = (cols[c].to_numpy() for c in ("x", "part", "rep", "n"))
            keep = np.flatnonzero(np.r_[True, (np.diff(x) != 0) | (np.diff(part) != 0) | (np.diff(doc) != 0)])
            x, part, doc, n, classes = x[keep], part[keep], doc[keep], n[keep].astype(np.int64), cols["classes"].take(pa.array(keep))
            counts = ClassCounts(classes.to_pylist())

            def fit(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                ok = compatible(n[i], n[j], np.abs(n[i] - n[j]), percent)
                ok[ok] = compatible(n[i[ok]], n[j[ok]], counts.differ(i[ok], j[ok]), percent)
                return ok

            cuts = np.r_[np.flatnonzero(np.r_[True, (np.diff(x) != 0) | (np.diff(part) != 0)]), len(x)]
            size, shared = np.diff(cuts), part[cuts[:-1]] >= 0
            two = cuts[:-1][(size == 2) & ~shared]
            two = two[fit(two, two + 1)]
            stars.add(doc[two].tolist(), doc[two + 1].tolist())
            found_from: list[int] = []
            for s, m, several in zip(*(v[(size > 2) | shared].tolist() for v in (cuts[:-1], size, shared))):
                left = np.arange(s, s + m)
                while len(left):
                    todo, left = [left[0]], left[1:]
                    sources = {int(todo[0])}
                    while todo and len(left):
                        q = todo.pop()
                        fits = fit(np.full(len(left), q), left)
                        found, left = left[fits], left[~fits]
                        if len(found):
                            sources.add(int(q))
                            todo += found.tolist()
                            stars.add([int(doc[q])] * len(found), doc[found].tolist())
                    if several:
                        found_from += sources
            if found_from:
                at = pa.array(found_from, I64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), FOUND_FROM, np.int32)), pa.array(x).take(at), pa.array(doc).take(at), pa.array(n.astype(np.int32)).take(at), classes.take(at)], ["kind", "a", "b", "n", "classes"])
            if len(stars.parent) > 200_000:
                yield edges()
        yield edges()

    return run


def _join_parts(percent: int):
    """Edges between the sets that the tasks of a list found others from."""

    def run(batches):
        def edges():
            for cols in sorted_groups(batches, most=20_000):
                x, doc, n = (cols[c].to_numpy() for c in ("a", "b", "n"))
                n, counts = n.astype(np.int64), ClassCounts(cols["classes"].to_pylist())
                cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(x) != 0]), len(x)]
                for s, e in zip(cuts, cuts[1:]):
                    if e - s > MOST_PAIRED:
                        yield np.full(e - s, doc[s]), doc[s:e]
                        continue
                    for i in range(s, e - 1):
                        j = np.arange(i + 1, e)
                        own = np.full(len(j), i)
                        j = j[near_enough(n[own], n[j], counts.differ(own, j, coarser=2), percent)]
                        yield np.full(len(j), doc[i]), doc[j]

        yield from contracted(edges())

    return run


class Lists:
    """Inverted lists of some sets."""

    def __init__(self, sets: list[np.ndarray], of: np.ndarray):
        flat = np.concatenate([sets[i] for i in of])
        owner = np.repeat(of, [len(sets[i]) for i in of])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner, self.built_of = flat[order], owner[order], len(of)

    def of(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each shingle's list starts and ends; lists are in order of owner."""
        return np.searchsorted(self.flat, shingles, "left"), np.searchsorted(self.flat, shingles, "right")


def partners(query: np.ndarray, lists: Lists, open_: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Open sets that link with the query, by DivideSkip."""
    least = int(needed(len(query), percent))
    low, high = lists.of(query)
    order = np.argsort(high - low)
    low, high = low[order], high[order]
    n_long = min(least - 1, max(0, int(least / (0.01 * np.log2(max(2, int((high - low).max(initial=1)))) + 1))))
    n_short = len(query) - n_long
    merged = np.concatenate([lists.owner[i:j] for i, j in zip(low[:n_short], high[:n_short])] or [np.zeros(0, np.int64)])
    found, count = np.unique(merged[open_[merged]], return_counts=True)
    keep = count >= least - n_long
    found, count = found[keep], count[keep]
    for k, (i, j) in enumerate(zip(low[n_short:], high[n_short:])):
        if not len(found):
            break
        own = lists.owner[i:j]
        at = np.minimum(np.searchsorted(own, found), max(0, len(own) - 1))
        count = count + (own[at] == found if len(own) else 0)
        keep = count >= least - (n_long - k - 1)
        found, count = found[keep], count[keep]
    return found[100 * count >= percent * (len(query) + sizes[found] - count)]


def search(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the index of the first one of its component of linked sets."""
    m = len(sets)
    label = [-1] * m
    sizes = np.fromiter(map(len, sets), np.int64, m)
    open_ = np.ones(m, bool)
    lists = Lists(sets, np.arange(m))
    for first in range(m):
        if not open_[first]:
            continue
        open_[first] = False
        label[first], todo, left = first, deque([first]), int(open_.sum())
        while todo and left:
            found = partners(sets[todo.popleft()], lists, open_, sizes, percent)
            open_[found] = False
            left -= len(found)
            for i in found.tolist():
                label[i] = first
                todo.append(i)
            if left and left < lists.built_of // 2:
                lists = Lists(sets, np.flatnonzero(open_))
    return label


def _search_groups(k: int, percent: int):
    """Star edges of the linked sets of each group of texts."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        shingler = Shingler(k)
        for cols in sorted_groups(batches, most=5_000):
            group, doc, packed = cols["g"].to_numpy(), cols["doc_id"].to_numpy(), cols["z"]
            cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(group) != 0]), len(group)]
            a, b = [], []
            for s, e in zip(cuts, cuts[1:]):
                sets: list[np.ndarray] = []
                for at in range(s, e, 200):
                    texts = [unpack(z).decode("utf-8") for z in packed.slice(at, min(e, at + 200) - at).to_pylist()]
                    text, h = shingler.sets(texts)
                    ends = np.searchsorted(text, np.arange(len(texts) + 1))
                    sets += [h[i:j] for i, j in zip(ends, ends[1:])]
                own = doc[s:e]
                a.append(own)
                b.append(own[search(sets, percent)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _packed_texts(batches):
    """Texts compressed: they are shuffled twice."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pack(t.encode("utf-8")) for t in texts], pa.binary())], ["doc_id", "z"])


def in_blocks(members: DataFrame, most: int) -> DataFrame:
    """doc_id, n, component, blocks and block of the sets of components with more than `most` shingles."""
    blocks = members.groupBy("component").agg(F.ceil(2 * F.sum("n") / most).cast("int").alias("blocks")).filter("blocks > 2")
    return members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))


def every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def pairs_of_blocks(blocked: DataFrame) -> DataFrame:
    """Groups in which every two sets of a component meet."""
    groups = blocked.select("*", every(F.col("blocks")).alias("other"))
    return groups.select(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("g"), "doc_id").distinct()


def search_large(large: DataFrame, search_in, most: int) -> DataFrame:
    """Edges that join the linked sets of large components. Each block is searched by itself, then one set of each group
    of linked sets that it has, all blocks together: copies of one text are a single group after that. Only the sets
    that are still outside their component's largest group meet all blocks."""
    own = Scratch(search_in(large.select(F.xxhash64("component", "block").alias("g"), "doc_id"))).read()
    firsts = own.select(F.col("b").alias("doc_id")).distinct().join(large.select("doc_id", "n", "component"), "doc_id")
    split = in_blocks(firsts, most)
    together = firsts.join(split.select("component").distinct(), "component", "left_anti").select(F.xxhash64("component").alias("g"), "doc_id")
    between = Scratch(search_in(together.union(pairs_of_blocks(split)))).read()
    edges = own.union(between)
    label = connected_components(edges).withColumnRenamed("component", "label").withColumnRenamed("node", "doc_id")
    labelled = large.join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    sizes = labelled.groupBy("component", "label").agg(F.sum("n").alias("all_n"))
    main = sizes.groupBy("component").agg(F.max_by("label", F.struct("all_n", "label")).alias("main"))
    rest = Scratch(labelled.join(main, "component").filter("label <> main").select("doc_id", "n", "component", "blocks", "block")).read()
    parts = rest.groupBy("component").agg(F.ceil(2 * F.sum("n") / most).cast("int").alias("parts"))  # at least one
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts")).cast("int").alias("part")
    outside = rest.join(parts, "component").select("doc_id", "component", part, every(F.col("blocks")).alias("block"))
    inside = large.join(parts, "component").select("doc_id", "component", every(F.col("parts")).alias("part"), "block")
    met = outside.unionByName(inside).select(F.xxhash64("component", "block", "part").alias("g"), "doc_id").distinct()
    return edges.union(search_in(met))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, max_group_shingles: int = 2_000_000, list_rows: int = 4_000, sample_docs: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of each row of docs (doc_id, text).
    sample_docs is not read: shingles are counted over all documents, whatever a caller says here."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    apart = counts_only(docs.filter(F.col("doc_id").isNull()), k).withColumn("component_id", F.lit(None).cast("long"))
    docs = docs.filter(F.col("doc_id").isNotNull())
    first = Scratch(short_lists(docs, k, percent, shingle_counts(docs, k), list_rows))
    own = first.read().filter(F.col("kind") == DOC).select("doc_id", "n", "x", "y", "classes")
    rep = own.filter("n > 0").groupBy("x", "y", "n").agg(F.min("doc_id").alias("rep"))
    classed = Scratch(own.join(rep, ["x", "y", "n"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), "classes"))

    lists = first.read().filter(F.col("kind") == SHORT).select("x", F.col("n").alias("part"), "doc_id").repartition(parts, "x", "part").sortWithinPartitions("x", "part")
    shared = lists.mapInArrow(_shared_only(list_rows), "x long, part long, doc_id long")
    met = shared.join(classed.read(), "doc_id").select("x", "part", "rep", "n", "classes").repartition(parts, "x", "part").sortWithinPartitions("x", "part", "rep")
    forest = Scratch(met.mapInArrow(_forest(percent), FOREST))
    between = forest.read().filter(F.col("kind") == FOUND_FROM).select("a", "b", "n", "classes").repartition(parts, "a").sortWithinPartitions("a").mapInArrow(_join_parts(percent), "a long, b long")
    near = connected_components(forest.read().filter(F.col("kind") == EDGE).select("a", "b").union(between), stars_already=True)
    forest.drop()

    members = classed.read().filter("doc_id = rep").select("doc_id", "n").dropDuplicates(["doc_id"]).join(near.withColumnRenamed("node", "doc_id"), "doc_id")
    packed = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).mapInArrow(_packed_texts, "doc_id long, z binary")

    def search_in(groups: DataFrame) -> DataFrame:
        """Star edges (a, b) of the linked sets of each group (g, doc_id)."""
        grouped = packed.join(groups.select("g", "doc_id"), "doc_id")
        return grouped.repartition(parts, "g").sortWithinPartitions("g", "doc_id").mapInArrow(_search_groups(k, percent), "a long, b long")

    large = in_blocks(members, max_group_shingles)
    if large.isEmpty():
        found = search_in(members.withColumnRenamed("component", "g")).toDF("node", "component")
    else:
        large = Scratch(large).read()
        whole = members.join(large.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("g"), "doc_id")
        found = connected_components(search_in(whole).union(search_large(large, search_in, max_group_shingles)))
    first.drop()  # what was read of it has been written
    label = found.groupBy("node").agg(F.min("component").alias("component"))
    linked = (
        classed.read()
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), "rep")
        .join(label.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    )
    return linked.unionByName(apart)
