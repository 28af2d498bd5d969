"""Near duplicates by Order MinHash, verified by banded alignment.

A text is its lower-cased words.  Its shingles of five words are labelled with
their occurrence, so a repeated one counts as often as it stands there.  Each
sketch draws the two shingles that are least under its own hash and keeps them
in text order, and further sketches do so with shingles of three words, of which
scattered edits leave more; texts that agree in a sketch, or for strictness in two at once,
meet in a bucket.  Each member of a bucket is aligned with the bucket's first
member: links grow with the members, not with their square.  A link
stands when the words' edit similarity, ``1 - distance / longer length``, is 0.8 or more;
classes are the connected components of the links.  The first member may be like
neither of two that are like each other, so where a bucket's members are in
several classes then, all members of different classes are compared, in blocks
that are spread like any rows: by the bags of their words first, which never tell
alike texts apart, then by alignment, of two blocks each member's closest pair
before all others, in rounds as long as these are many and a good part of them links: a large group
of alike texts is few classes before all pairs of different classes are.  So no two texts that share a sketch and are similar stay in two classes.

Texts of equal words are one node from the start.  Sketches, links and
components stay in tables; no bucket is gathered in one place.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, narrow, remove_rows, row_hash, texts
from ledgerline.operators.positions import with_row_positions

#: Words in a shingle.
SHINGLE = 5
SHORT = 3
#: Sketches of a text, those of its short shingles, and shingles in a sketch.
SKETCHES = 12
SHORT_SKETCHES = 24
DRAWN = 2
#: Least edit similarity of a link.
SIMILARITY = 0.8
#: Members of a bucket in a block, and bins of a bag of words.
BLOCK = 128
BINS = 512
#: From this many pairs on, of which one in so many is a link, another round of closest pairs comes before all that are left.
MANY = 2000
LINKED = 8
#: Words whose hashes a task keeps.
MAX_WORDS = 500_000

_SEEDS = np.array([xxhash.xxh3_64_intdigest(b"sketch", seed=i) for i in range(SKETCHES + SHORT_SKETCHES)], "u8")
_SKETCHED = "doc_id long, text_hash long, node binary, n_words int, keys array<long>"


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode())
        return h


def word_hashes(text: str, known: _Words) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), "u8", len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash for each run of ``size`` words; of all words where they are fewer."""
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, "u8")
    for i in range(size):
        out = out * np.uint64(0x100000001B3) + _mix(words[i:i + n] + np.uint64(i))
    return _mix(out)


def _occurrences(h: np.ndarray) -> np.ndarray:
    """How often each value stood before in ``h``."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    place = np.arange(len(h))
    out = np.empty(len(h), "u8")
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out


def sketch(words: np.ndarray) -> np.ndarray:
    """The sketches of a text, each hashed with its number; a text without words has the same as another."""
    if not len(words):
        return _mix(_SEEDS)
    return np.concatenate([_drawn(shingles(words), _SEEDS[:SKETCHES]),
                           _drawn(shingles(words, SHORT), _SEEDS[SKETCHES:])])


def _drawn(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    if len(h) <= DRAWN:
        own = np.tile(h, (len(seeds), 1))
    else:
        labelled = _mix(h + np.uint64(0x9E3779B97F4A7C15) * _occurrences(h))
        parts = [seeds] if len(h) < 50_000 else np.split(seeds, len(seeds))
        drawn = [np.argpartition(_mix(labelled ^ s[:, None]), DRAWN - 1, axis=1)[:, :DRAWN] for s in parts]
        own = h[np.sort(np.concatenate(drawn), axis=1)]
    out = seeds.copy()
    for i in range(own.shape[1]):
        out = _mix(out * np.uint64(31) + own[:, i])
    return out


def bucket_keys(sketches: np.ndarray) -> np.ndarray:
    """A key for each sketch, even, and for each of long shingles with the next, odd: buckets of these lie within those of the even."""
    long = sketches[:SKETCHES]
    both = _mix(long * np.uint64(3) + np.roll(long, 1))
    return np.concatenate([sketches & ~np.uint64(1), both | np.uint64(1)]).astype("i8")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()  # gone with the task: workers live on and have later stages' tables to hold
    for part, values in texts(batches):
        words = [word_hashes(t, known) for t in values]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_hash"),
             pa.array([xxhash.xxh3_128_digest(w.tobytes()) for w in words], pa.binary()),
             pa.array([len(w) for w in words], pa.int32()),
             pa.array([bucket_keys(sketch(w)) for w in words], pa.list_(pa.int64()))],
            names=["doc_id", "text_hash", "node", "n_words", "keys"])


def edit_distance(a: Sequence, b: Sequence, limit: int) -> int | None:
    """Edit distance of two sequences if it is at most ``limit``.

    A banded alignment, column by column: the cells within ``limit`` of the
    diagonal are two bit vectors, of the places where a column goes up and
    down by one (Myers; the band that moves along the diagonal is Hyyrö's).
    """
    if len(a) < len(b):
        a, b = b, a
    head, n, m = 0, len(a), len(b)
    while head < m and a[head] == b[head]:
        head += 1
    while m > head and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b, n, m = a[head:n], b[head:m], n - head, m - head
    limit = min(limit, n)
    if n - m > limit:
        return None
    if not m:
        return n
    # what the shorter lacks must each be edited
    spare = Counter(a)
    spare.subtract(Counter(b))
    if sum(c for c in spare.values() if c > 0) > limit:
        return None

    places: dict = defaultdict(int)
    for i, x in enumerate(a):
        places[x] |= 1 << i
    width = 2 * limit + 2
    full = (1 << width) - 1
    up, down, distance, at = full << (width - limit - 1) & full, 0, limit, limit + 1 - width
    diagonal, row = 1 << (width - 1), 1 << (width - 2)
    most = 2 * limit + m - n  # beyond this the end can't be reached within the limit
    for j, x in enumerate(b):
        here = places.get(x, 0)
        here = (here >> at if at > 0 else here << -at) & full
        at += 1
        same = (((here & up) + up) ^ up) | here | down
        right_up, right_down = (down | ~(same | up)) & full, same & up
        if j < n - limit:
            distance += not same & diagonal
        else:
            distance += bool(right_up & row) - bool(right_down & row)
            row >>= 1
        if distance > most:
            return None
        same = (same & full) >> 1
        up, down = (right_down | ~(same | right_up)) & full, same & right_up
    return distance if distance <= limit else None


def similar(a: Sequence, b: Sequence, least: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    return edit_distance(a, b, int((1 - least) * longer + 1e-9)) is not None


def _aligned(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                pairs = zip(*(part.column(c).to_pylist() for c in ("a", "b", "a_text", "b_text")))
                good = [(a, b) for a, b, s, t in pairs if similar(s.lower().split(), t.lower().split(), least)]
                if good:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*good)], names=["a", "b"])

    return run


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of ``edges`` (u, v; v less than u) is either a root or has one edge to one: no star changes them then."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return (ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
            .where(F.col("up") + F.col("down") > 1).agg(F.count("*")).first()[0] == 0)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): the least node of its connected component.

    Alternates large and small stars (each node's neighbours move to the least
    of them) over written tables until every node has one edge, to its root.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct(), "links")
    while True:
        if _are_stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = materialize(large, "large_star")
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(roots, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(roots.select("u", F.col("m").alias("v"))))
        edges = materialize(small.distinct(), "small_star")


def _alike_in_length(a: str, b: str, least: float) -> Column:
    return F.least(a, b) >= F.lit(least - 1e-9) * F.greatest(a, b)


def _align(pairs: DataFrame, text: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    told = (pairs.join(text.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
            .join(text.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b"))
    return materialize(told.mapInArrow(_aligned(least), "a binary, b binary"), "aligned")


def _tied(links: DataFrame, roots: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and components with ``more`` links."""
    tied = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return links.unionByName(more), materialize(components(tied), "components")


def bag(words: np.ndarray) -> np.ndarray:
    """How many words fall in each bin, up to 255."""
    return np.minimum(np.bincount((words % np.uint64(BINS)).astype("i8"), minlength=BINS), 255).astype("u1")


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for part, values in texts(batches):
        bags = [bag(word_hashes(t, known)) for t in values]
        yield pa.RecordBatch.from_arrays(
            [part.column("node"), pa.array([b.tobytes() for b in bags], pa.binary()),
             pa.array([int(b.sum(dtype="i8")) for b in bags], pa.int64())], names=["node", "bag", "total"])


def _lets(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u1").reshape(-1, BINS) for c in ("bag", "b_bag"))
            lacks = np.empty(len(a), "i8")
            for i in range(0, len(a), 4096):
                lacks[i:i + 4096] = (np.maximum(a[i:i + 4096], b[i:i + 4096]) - b[i:i + 4096]).sum(axis=1, dtype="i8")
            totals, n = ([batch.column(c).to_numpy() for c in names] for names in (("total", "b_total"), ("n", "b_n")))
            # what either has beyond the other must each be edited
            lacks = np.maximum(lacks, lacks + totals[1] - totals[0])
            near = lacks <= ((1 - least) * np.maximum(*n) + 1e-9).astype("i8")
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near))

    return run


def _let(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, n, b_n) that their bags of words let be similar, before any text is carried to them."""
    told = (pairs.join(bags.withColumnRenamed("node", "a"), "a")
            .join(bags.select(F.col("node").alias("b"), F.col("bag").alias("b_bag"), F.col("total").alias("b_total")), "b"))
    return materialize(told.mapInArrow(_lets(least), "a binary, b binary"), "let")


def _classed(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _mixed(classed: DataFrame, *more: Column) -> DataFrame:
    """The keys of buckets whose members are of several classes."""
    return classed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *more).where("lo <> hi")


def _collected(members: DataFrame) -> DataFrame:
    return materialize(members.groupBy("key", "block").agg(
        F.min("n_words").alias("lo"), F.max("n_words").alias("hi"),
        F.collect_list(F.struct("node", "root", "n_words", "bag", "keys")).alias("x")), "blocks")  # at most BLOCK


def _blocks(met: DataFrame, roots: DataFrame, bags: DataFrame) -> DataFrame | None:
    """The members of buckets of several classes by number of words, ``BLOCK`` of them in a row.

    A bucket of two has been aligned with its first member, and buckets of two
    sketches lie within those of one.  Of buckets with the same members, one is
    taken: texts that share a passage often meet in many.
    """
    classed = _classed(met.where(F.col("key").bitwiseAND(F.lit(1)) == 0), roots).select("key", "node", "n_words", "root")
    same = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"same{i}") for i in range(2)]  # 128 bits of the set of members
    mixed = _mixed(classed, F.count("*").alias("n"), *same).where("n > 2")
    mixed = materialize(mixed.groupBy("n", "same0", "same1").agg(F.min("key").alias("key")).select("key"), "mixed")
    if mixed.isEmpty():
        return None
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = materialize(classed.join(mixed, "key", "left_semi"), "in_mixed")  # the sort reads its input twice
    placed = materialize(with_row_positions(members, ["key", "n_words", "node"], out="place", buckets=parts), "placed")
    own = members.groupBy("node").agg(F.collect_set("key").alias("keys"))  # at most one for each sketch
    told = bags.select("node", "bag").join(own, "node")
    return _collected(placed.withColumn("block", F.floor(F.col("place") / BLOCK)).join(told, "node"))


def _still_mixed(blocks: DataFrame, roots: DataFrame) -> DataFrame | None:
    """``blocks`` after classes were joined: buckets that are one class now go, the others' members get their new class.

    Members stay where they are, and classes only grow, so no bucket comes anew."""
    members = blocks.select("key", F.explode("x.node").alias("node"))
    mixed = materialize(_mixed(_classed(members, roots)).select("key"), "mixed")
    if mixed.isEmpty():
        return None
    left = blocks.join(mixed, "key", "left_semi").select("key", "block", F.explode("x").alias("m"))
    return _collected(_classed(left.select("key", "block", "m.node", "m.n_words", "m.bag", "m.keys"), roots))


def _members(column: pa.ListArray, i: int):
    node, root, n, bags, keys = column.slice(i, 1).flatten().flatten()
    bags = np.frombuffer(b"".join(bags.to_pylist()), "u1").reshape(-1, BINS)
    return node.to_pylist(), root.to_pylist(), n.to_numpy(), bags, bags.sum(axis=1, dtype="i8"), [*map(set, keys.to_pylist())]


def _compared(least: float, closest: bool):
    def pairs(key, x, y) -> Iterator[tuple[bytes, bytes]]:
        number: dict = {}
        x_class, y_class = (np.array([number.setdefault(r, len(number)) for r in m[1]]) for m in (x, y))
        best: dict = {}
        for p, (n, own, total) in enumerate(zip(*x[2:5])):
            longer = np.maximum(n, y[2])
            maybe = (y_class != x_class[p]) & (np.minimum(n, y[2]) >= (least - 1e-9) * longer)
            if x is y:
                maybe[:p + 1] = False
            at = np.flatnonzero(maybe)
            if not len(at):
                continue
            # what either has beyond the other must each be edited
            other = y[3][at]
            lacks = (np.maximum(own, other) - other).sum(axis=1, dtype="i8")
            lacks = np.maximum(lacks, lacks + y[4][at] - total)
            near = lacks <= ((1 - least) * longer[at] + 1e-9).astype("i8")
            for q, d in zip(at[near], lacks[near]):
                if min(x[5][p] & y[5][q]) != key:
                    continue  # they meet in several buckets: the pair is made in the least of them alone
                a, b = x[0][p], y[0][q]
                found = d, max(a, b), min(a, b)
                if closest:
                    best[a], best[b] = min(best.get(a, found), found), min(best.get(b, found), found)
                else:
                    yield found[1:]
        yield from {found[1:] for found in best.values()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            for i in range(batch.num_rows):
                one = _members(x, i)
                found = list(pairs(batch.column("key")[i].as_py(), one, _members(y, i) if y[i].is_valid else one))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], names=["a", "b"])

    return run


def _between(blocks: DataFrame, least: float, closest: bool) -> DataFrame:
    """The pairs of members of different classes that their lengths and bags of words let be similar, each once.

    With ``closest``, of two blocks only each member's pair whose bags differ least: at most as many as members.
    """
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = blocks.select("key", "block", "lo", "hi")
    two = materialize(
        ends.select("key", F.col("block").alias("i"), "hi")
        .join(ends.select("key", F.col("block").alias("j"), F.col("lo").alias("next_lo")), "key")
        .where((F.col("i") < F.col("j")) & (F.col("hi") >= F.lit(least - 1e-9) * F.col("next_lo")))
        .select("key", "i", "j"), "block_pairs")
    x = blocks.select("key", F.col("block").alias("i"), "x")
    y = blocks.select("key", F.col("block").alias("j"), F.col("x").alias("y"))
    apart = two.repartition(parts, "key", "i", "j").join(x, ["key", "i"]).join(y, ["key", "j"]).select("key", "x", "y")
    within = blocks.select("key", "x", F.lit(None).cast(blocks.schema["x"].dataType).alias("y"))
    found = [d.mapInArrow(_compared(least, closest), "a binary, b binary") for d in (within, apart)]
    return materialize(found[0].unionByName(found[1]), "between")  # a pair is in one block, or two, of its least key alone


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, class_id, class_size, n_links, kept.

    ``class_id`` is the least doc_id of the class, ``n_links`` the links of the
    text's node that were found while classes were joined (not all its similar
    texts: members of one class are not compared further), ``kept`` true for the rows that have the class_id and, of
    those, the least ``text_hash``.  A null text is empty, and texts without
    words are one class.  Null ids come last; a class of null ids only has a
    null class_id.  An empty table gives no rows.
    """
    rows = narrow(docs, id_col, text_col, row_hash(text_col).alias("text_hash"))
    sketched = materialize(rows.mapInArrow(_sketched, _SKETCHED), "sketches")
    last = F.coalesce("doc_id", F.lit(2 ** 63 - 1))
    nodes = materialize(sketched.groupBy("node").agg(
        F.min(F.struct(last.alias("id"), "text_hash")).alias("first"), F.first("n_words").alias("n_words"),
        F.first("keys").alias("keys")), "nodes")

    member = nodes.select(F.explode("keys").alias("key"), "node", "n_words")
    # keys alone are counted first: most stand alone, and their members are then not carried further
    shared = materialize(member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    met = materialize(member.join(shared, "key"), "members")
    buckets = met.groupBy("key").agg(F.min(F.struct("node", "n_words")).alias("head")).select(
        "key", F.col("head.node").alias("b"), F.col("head.n_words").alias("b_words"))
    buckets = materialize(buckets, "buckets")  # so that both sides of the join are plain exchanges, and skew can be split
    pairs = materialize(met.join(buckets, "key").where("node <> b").where(_alike_in_length("n_words", "b_words", least))
                        .select(F.col("node").alias("a"), "b", F.col("n_words").alias("n"), F.col("b_words").alias("b_n"))
                        .distinct(), "pairs")

    places = nodes.join(met.select("node").distinct(), "node").select("node", "first.*")
    text = materialize(
        rows.withColumn("id", last).join(places, ["id", "text_hash"])
        .groupBy("id", "text_hash", "node").agg(F.first("text").alias("text")).select("node", "text"),  # where the join left it
        "texts") if not met.isEmpty() else None
    if text is None:
        roots = nodes.select("node", F.col("node").alias("root")).limit(0)
        degree = nodes.select("node", F.lit(0).cast("long").alias("n_links")).limit(0)
    else:
        bags = materialize(text.mapInArrow(_bagged, "node binary, bag binary, total long"), "bags")
        links = _align(_let(pairs, bags, least), text, least)
        roots = materialize(components(links), "components")
        tried, blocks = pairs.select("a", "b"), _blocks(met, roots, bags)
        closest = True
        while blocks is not None:
            found = _between(blocks, least, closest)
            many = found.count()
            if not many:
                break
            more = _align(found.join(tried, ["a", "b"], "left_anti"), text, least)
            joined = more.count()
            if joined:
                links, roots = _tied(links, roots, more)
                blocks = _still_mixed(blocks, roots) if closest else None
            if not closest:
                break
            closest = joined * LINKED >= many >= MANY  # the last time whatever is left: mostly pairs that are no links
            tried = tried.unionByName(found)
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
        degree = ends.groupBy("node").agg(F.count("*").alias("n_links"))
    known = (nodes.join(roots, "node", "left").join(degree, "node", "left")
             .select("node", "first", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    copies = sketched.groupBy("node").agg(F.count("*").alias("copies"))
    classes = (known.join(copies, "node").groupBy("root")
               .agg(F.min("first").alias("head"), F.sum("copies").alias("class_size")))
    classes = materialize(classes, "classes")
    named = known.join(classes, "root").select("node", "n_links", "head", "class_size")
    return (sketched.select("doc_id", "text_hash", "node").join(named, "node")
            .select("doc_id", "text_hash",
                    F.when(F.col("head.id") != 2 ** 63 - 1, F.col("head.id")).alias("class_id"), "class_size", "n_links",
                    ((last == F.col("head.id")) & (F.col("text_hash") == F.col("head.text_hash"))).alias("kept")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    found = near_duplicates(docs, id_col, text_col, least)
    return remove_rows(docs, found.where(~F.col("kept")).select("doc_id", "text_hash").distinct(), id_col, text_col)
