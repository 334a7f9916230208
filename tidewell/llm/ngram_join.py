"""N-gram Jaccard self-join by prefix trees.

Each text becomes the set of its shingles, as 64-bit hashes. Texts of equal sets form a class and are joined as one.
Candidates come from prefixes in one global order: hashes below a cut that few sets list, then those beyond it, then
those below it that many list, each step by how many sets list them. Two sets that meet the threshold must share one of
their first n - need + 1 shingles. Beyond the cut only sets are listed whose prefix reaches that far, so most shingles
are never counted; which pairs are found doesn't depend on it.

Groups of copies would make pairs with the square of their size, so links are found in two steps that together lose
no connection. First every set is held against the smallest id of the prefix lists it shares most with, and what links
is contracted. Then only lists that still hold sets of different components give pairs, and those across components.

Pairs are decided by a prefix tree: the partners of a set are stored in a trie of their ordered shingles, chains
pressed together; the set runs through it, partial overlaps are shared by all below a node, and a subtree is left when
the overlap so far and what remains on either side can't reach what its smallest set needs. Partners are dealt in
blocks, so a hub's partners are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import beside, connected_components, discard, release, salts, table
from .common import materialize as _materialize

WORDS_PER_SHINGLE, PERCENT = 5, 80
BLOCK = 64
#: Sets that list a hash up to which it is light. Decides where it stands in the order, not whether it counts.
HEAVY = 64
#: Ids up to which the doubles travel to every task (24 bytes each).
BROADCAST_ROWS = 200_000
#: Bytes of text that are hashed in one go; a longer word is hashed whole.
WINDOW = 1 << 19
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP, _BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table written; then the driver gives back what it held of its plan and tasks. A join writes some twenty tables,
    and a driver of a gigabyte would else fill with them before it collects its garbage by itself."""
    out = _materialize(df, name)
    release(df.sparkSession)
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A number for each byte, the same for A-Z and a-z, 0 for what separates words."""
    values = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
    values[65:91] = values[97:123]
    values[_SPACE] = 0
    return values


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base % 2**64, np.uint64)])


_BYTE, _LOW, _HIGH = _byte_values(), _powers(_BASE, 1 << 16), _powers(pow(_BASE, 1 << 16, 2**64), 1 << 12)


def _window(data: np.ndarray, bounds: np.ndarray, low: int) -> int:
    """Where the stretch from low ends, at most WINDOW on: after white space or at the start of a text."""
    high = min(low + WINDOW, len(data))
    if high == len(data):
        return high
    spaces = np.flatnonzero(_SPACE[data[low:high]])
    cut = max(low + int(spaces[-1]) + 1 if len(spaces) else 0, int(bounds[np.searchsorted(bounds, high, side="right") - 1]))
    if cut > low:
        return cut
    end = int(bounds[np.searchsorted(bounds, high, side="right")])
    for at in range(high, end, WINDOW):  # one word fills the window
        spaces = np.flatnonzero(_SPACE[data[at : min(at + WINDOW, end)]])
        if len(spaces):
            return at + int(spaces[0]) + 1
    return end


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word `[^\\x20\\x09-\\x0D]+` of UTF-8 texts end to end, and before which word each text begins.

    bounds: where each text begins, and the end. A word's hash is a polynomial in its bytes, A-Z as a-z.
    """
    hashes, places, low = [], [], 0
    while low < len(data):
        high = _window(data, bounds, low)
        part = data[low:high]
        word = ~_SPACE[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inside = bounds[np.searchsorted(bounds, low, side="right") : np.searchsorted(bounds, high)] - low
        first[inside] = word[inside]
        starts = np.flatnonzero(first)
        if len(starts):
            lengths = np.diff(np.append(starts, len(part)))
            at = np.arange(starts[0], len(part)) - np.repeat(starts, lengths)
            power = _LOW[at & 0xFFFF]
            if lengths.max() > 1 << 16:
                power = power * _HIGH[(at >> 16) & 0xFFF]
            hashes.append(np.add.reduceat(_BYTE[part[starts[0] :]] * power, starts - starts[0]))
            places.append(starts + low)
        low = high
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), bounds)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-word shingles; of the whole sequence where it is shorter; none
    without words. A null text counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    each, of = word_hashes(data, bounds - bounds[0])
    runs = {}
    for k in range(1, n + 1):
        counts = np.diff(of)
        at = np.flatnonzero(counts == k) if k < n else np.flatnonzero(counts >= n)
        if len(at):
            starts = of[at] if k < n else np.arange(len(each) - n + 1)
            total = np.full(len(starts), k, np.uint64)
            for j in range(k):
                total = _mix(total * _STEP + each[starts + j])
            runs[k] = dict(zip(at.tolist(), total)) if k < n else total
    none = np.zeros(0, np.uint64)
    for i, (low, high) in enumerate(zip(of[:-1].tolist(), of[1:].tolist())):
        words = high - low
        if not words:
            yield none
        elif words < n:
            yield runs[words][i].reshape(1)
        else:
            s = np.sort(runs[n][low : high - n + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), n))


def need(size: int, percent: int) -> int:
    """Shingles that a set of this size must share with any set it links with."""
    return -(-percent * size // 100)


def _rows(ids: list, arrays: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, schema[0].type), *(pa.array(a, f.type) for a, f in zip(arrays, list(schema)[1:]))], schema=schema)


def last_low(cut: float) -> np.uint64:
    return np.uint64(int(cut * 2**64) - 1) if cut < 1 else np.uint64(2**64 - 1)


def late_hashes(docs: DataFrame, n: int, cut: float) -> DataFrame:
    """token, doc: the hashes beyond the cut of these texts."""
    schema = pa.schema([("doc", pa.int64()), ("late", pa.list_(pa.int64()))])
    below = last_low(cut)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sets = list(shingle_sets(part.column(1), n))
                yield _rows(part.column(0).to_pylist(), [[s[int(np.searchsorted(s, below, side="right")) :].view(np.int64) for s in sets]], schema)

    listed = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc long, late array<long>")
    return listed.select(F.explode("late").alias("token"), "doc")


def list_sets(docs: DataFrame, n: int, cut: float) -> DataFrame:
    """doc_id, size, digest and the hashes below the cut."""
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("low", pa.list_(pa.int64()))])
    below = last_low(cut)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                out = [[], [], [], []]
                for s in shingle_sets(part.column(1), n):
                    digest = xxhash.xxh128_digest(s.tobytes())
                    lows = int(np.searchsorted(s, below, side="right"))
                    for column, value in zip(out, (len(s), int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), s[:lows].view(np.int64))):
                        column.append(value)
                yield _rows(part.column(0).to_pylist(), out, schema)

    ddl = "doc_id long, size int, d1 long, d2 long, low array<long>"
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ddl)


# ---- the prefix tree


class Trie:
    """Ordered sets with shared beginnings; a node holds a run of shingles that all sets below it have."""

    def __init__(self, sets: list[tuple[int, np.ndarray]]):
        self.sets = sorted(sets, key=lambda s: s[1].astype(">u8").tobytes())
        self.runs, self.children, self.ends, self.smallest, self.longest_rest = [], [], [], [], []
        self.roots = [self._build(*g) for g in self._groups(0, len(self.sets), 0)]

    def _groups(self, low: int, high: int, depth: int):
        """(low, high, depth) of the stretches whose next shingle agrees; sets that end at depth are left out."""
        start = low
        while start < high and len(self.sets[start][1]) == depth:
            start += 1
        while start < high:
            first = self.sets[start][1][depth]
            end = start + 1
            while end < high and self.sets[end][1][depth] == first:
                end += 1
            yield start, end, depth
            start = end

    def _build(self, low: int, high: int, depth: int) -> int:
        a, b = self.sets[low][1], self.sets[high - 1][1]
        m = min(len(a), len(b))
        apart = np.flatnonzero(a[depth:m] != b[depth:m])
        reach = depth + int(apart[0]) if len(apart) else m
        node = len(self.runs)
        self.runs.append(a[depth:reach])
        self.ends.append([i for i in range(low, high) if len(self.sets[i][1]) == reach])
        sizes = [len(self.sets[i][1]) for i in range(low, high)]
        self.smallest.append(min(sizes))
        self.longest_rest.append(max(sizes) - reach)
        self.children.append([])
        self.children[node] = [self._build(*g) for g in self._groups(low, high, reach)]
        return node

    def linked(self, probe: np.ndarray, percent: int):
        """Ids of the sets with Jaccard >= percent / 100."""
        n, stack = len(probe), [(root, 0) for root in self.roots]
        while stack:
            node, overlap = stack.pop()
            run = self.runs[node]
            at = np.searchsorted(probe, run)
            overlap += int((probe[np.minimum(at, n - 1)] == run).sum())
            left = n - int(np.searchsorted(probe, run[-1], side="right"))
            least = -(-percent * (n + self.smallest[node]) // (100 + percent))
            if overlap + min(left, self.longest_rest[node]) < least:
                continue
            for i in self.ends[node]:
                doc, s = self.sets[i]
                if 100 * overlap >= percent * (n + len(s) - overlap):
                    yield doc
            stack += [(child, overlap) for child in self.children[node]]


def verify(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The (anchor, member) pairs whose sets link, written. Members come in blocks of about BLOCK beside their anchor's
    set. Each step reads a table, so that plans, and what the driver keeps of them, stay small."""
    spark = docs.sparkSession
    pairs, pairs_path = materialize(pairs.select("anchor", "member").distinct(), "asked")
    sized = beside(pairs, "anchor", "member", F.count("*").alias("n"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    members = sized.select("anchor", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block"), "member", F.lit(1).alias("role"))
    sizes = pairs.groupBy("anchor").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    anchors = sizes.select("anchor", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("anchor").alias("member"), F.lit(0).alias("role"))
    wanted, wanted_path = materialize(members.unionByName(anchors), "dealt")
    discard(spark, pairs_path)
    involved = wanted.select(F.col("member").alias("doc_id")).distinct()
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(involved, "doc_id", "left_semi")
    schema = pa.schema([("member", pa.int64()), ("hashes", pa.binary())])

    def sets(batches):
        for batch in batches:
            for part in slices(batch, 1):
                yield _rows(part.column(0).to_pylist(), [[s.tobytes() for s in shingle_sets(part.column(1), n)]], schema)

    hashed = texts.mapInArrow(sets, "member long, hashes binary")
    dealt = wanted.join(hashed, "member").select("anchor", "block", "role", "member", "hashes")
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(count, "anchor", "block").sortWithinPartitions("anchor", "block", "role", "member")
    found = pa.schema([("anchor", pa.int64()), ("member", pa.int64())])

    def decide(batches):
        def close(anchor, probes, group):
            if not probes or not group:
                return [], []
            trie = Trie(group)
            got = sorted({m for probe in probes for m in trie.linked(probe, percent)})
            return [anchor] * len(got), got

        key, probes, group = None, [], []
        for batch in batches:
            left, right = [], []
            for anchor, block, role, member, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (anchor, block) != key:
                    if key:
                        a, b = close(key[0], probes, group)
                        left += a
                        right += b
                    key, probes, group = (anchor, block), [], []
                s = np.frombuffer(data, np.uint64)
                if not role:
                    probes.append(s)
                elif len(s):
                    group.append((member, s))
            if left:
                yield _rows(left, [right], found)
        if key:
            a, b = close(key[0], probes, group)
            yield _rows(a, [b], found)

    linked, _ = materialize(dealt.mapInArrow(decide, "anchor long, member long"), "links")
    discard(spark, wanted_path)
    release(spark)
    return linked


def _shared(tokens: DataFrame) -> DataFrame:
    """token, doc, df of the hashes that two sets or more list."""
    return tokens.join(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token")


def components(docs: DataFrame, n: int = WORDS_PER_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    A text without words has the empty set, links with nothing and is its own component; so do null texts. Rows that
    share an id are one node with all their texts. Rows without an id get the smallest id they reach, if any. An empty
    table gives none; of other columns none is read, so their names don't matter; very long texts are hashed whole.
    Words and shingles stand as 64-bit hashes: two that differ are taken for one with a chance of 2**-64 a pair.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    cut = min(1.0, 2 * (100 - percent) / 100)
    # The salt is drawn once and written: a class of equal sets meets its smallest id through parts, so that no task
    # gets a whole class, be it a third of all rows. Empty sets take no part.
    wide, wide_path = materialize(list_sets(docs, n, cut).withColumn("salt", F.floor(F.rand(11) * salts(spark)).cast("int")), "shingles")
    listed, _ = materialize(wide.select("doc_id", "size", "d1", "d2", "salt"), "digests")
    parts = listed.where("size > 0").groupBy("d1", "d2", "salt").agg(F.min("doc_id").alias("rep"))
    classes, _ = materialize(parts.drop("rep").join(parts.groupBy("d1", "d2").agg(F.min("rep").alias("rep")), ["d1", "d2"]), "classes")
    # Sets so small that only equal ones link need no candidates: need(size + 1) > size.
    linkable = wide.where(F.expr(f"100 * size >= {percent} * (size + 1)"))
    doubles, doubles_path = materialize(listed.where("size > 0").drop("size").join(classes, ["d1", "d2", "salt"]).where("doc_id > rep").select("doc_id", "d1", "d2").distinct(), "doubles")
    # Few doubles travel to the lists of hashes; many are joined by a shuffle of the lists.
    chosen = linkable.join(F.broadcast(doubles) if doubles.count() <= BROADCAST_ROWS else doubles, ["doc_id", "d1", "d2"], "left_anti").where("doc_id is not null")
    # One row an id; an id with several texts keeps all its hashes and skips the filters by size and place.
    sizes = chosen.groupBy(F.col("doc_id").alias("doc")).agg(F.max("size").alias("size"), F.sum(F.size("low")).alias("lows"), (F.count("*") > 1).alias("loose"))
    sizes, sizes_path = materialize(sizes.withColumn("prefix", F.expr(f"size - ceil({percent} * size / 100D) + 1")), "sizes")
    low = _shared(chosen.select(F.explode("low").alias("token"), F.col("doc_id").alias("doc")))
    kept, kept_path = materialize(low.join(sizes, "doc"), "low")
    discard(spark, wide_path)
    discard(spark, doubles_path)
    # Sets whose light hashes below the cut don't fill the prefix go on with those beyond it; the others never need them.
    heavy = kept.groupBy("doc").agg(F.count_if(F.col("df") > HEAVY).alias("heavy"))
    short, short_path = materialize(sizes.join(heavy, "doc", "left").where("loose or prefix > lows - coalesce(heavy, 0)").select(F.col("doc").alias("doc_id")), "short")
    # Written, as one plan of all that leads to the prefixes would fill the driver's memory.
    late, late_path = materialize(_shared(late_hashes(docs.join(short, "doc_id", "left_semi"), n, cut)), "late")
    more = late.join(sizes, "doc")
    step = F.when(F.col("late"), 1).when(F.col("df") <= HEAVY, 0).otherwise(2)
    both = kept.withColumn("late", F.lit(False)).unionByName(more.withColumn("late", F.lit(True))).withColumn("step", step)
    per_doc = Window.partitionBy("doc")
    count = lambda condition: F.sum(F.when(condition, 1).otherwise(0)).over(per_doc)
    light = F.col("lows") - count(F.col("step") == 2)
    # Hashes that no other set has come first in their step; they take places and need no rows.
    ahead = F.when(F.col("step") == 0, F.col("lows") - count(~F.col("late"))).when(F.col("step") == 1, light + F.col("size") - F.col("lows") - count(F.col("late"))).otherwise(light + F.col("size") - F.col("lows"))
    ordered = (
        both.withColumn("place", ahead + F.row_number().over(Window.partitionBy("doc", "step").orderBy("df", "token")))
        .where("loose or place <= prefix").select("token", "doc", "size", "place", "loose")
    )
    prefixes, prefixes_path = materialize(ordered, "prefixes")
    for path in (kept_path, sizes_path, short_path, late_path):
        discard(spark, path)

    firsts = prefixes.groupBy("token").agg(F.min("doc").alias("anchor"), F.max("doc").alias("last")).where("anchor < last")
    votes = prefixes.join(firsts, "token").where("doc <> anchor").groupBy("doc", "anchor").agg(F.count("*").alias("votes"))
    ranked = votes.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("votes"), "anchor")))
    near = ranked.where("rank <= 2").select("anchor", F.col("doc").alias("member"))
    # An id that stands at several texts is one node: it links their classes.
    texts_of = listed.where("size > 0 and doc_id is not null").drop("size").distinct()
    several = texts_of.groupBy("doc_id").agg(F.countDistinct("d1", "d2").alias("texts")).where("texts > 1").select("doc_id")
    same_id = texts_of.join(several, "doc_id", "left_semi").join(classes, ["d1", "d2", "salt"]).select(F.col("doc_id").alias("anchor"), F.col("rep").alias("member")).where("anchor <> member").distinct()
    same, _ = materialize(same_id, "same")
    first_edges = verify(near, docs, n, percent).unionByName(same)
    release(spark)
    first = connected_components(first_edges)

    placed = prefixes.join(first.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("token")
    # Both sides are joined as one table under two names; a hot list is split by the skew handling of the join.
    here, here_path = materialize(placed.join(mixed, "token", "left_semi"), "mixed")
    one = here.select("token", *[F.col(c).alias(f"x_{c}") for c in ("doc", "size", "place", "loose", "component")])
    two = here.select("token", *[F.col(c).alias(f"y_{c}") for c in ("doc", "size", "place", "loose", "component")])
    least = f"ceil({percent} * (x_size + y_size) / {100 + percent}D)"
    across = (
        one.join(two, "token")
        .where("x_doc < y_doc and x_component <> y_component")
        .where(f"x_loose or y_loose or 100 * least(x_size, y_size) >= {percent} * greatest(x_size, y_size) and x_place <= x_size - {least} + 1 and y_place <= y_size - {least} + 1")
        .select(F.col("x_doc").alias("anchor"), F.col("y_doc").alias("member"))
    )
    pairs, pairs_path = materialize(across.distinct(), "pairs")
    discard(spark, here_path)
    if not pairs.isEmpty():
        # What was linked before comes as stars, so that only the new links are left to settle.
        stars = first.select(F.col("component").alias("anchor"), F.col("node").alias("member"))
        first = connected_components(stars.unionByName(verify(pairs, docs, n, percent)))
    discard(spark, prefixes_path)
    discard(spark, pairs_path)
    labels = classes.join(first.select(F.col("node").alias("rep"), "component"), "rep", "left").select("d1", "d2", "salt", F.coalesce("component", "rep").alias("component_id"))
    count = F.col("size").cast("long").alias("n_shingles")
    held = listed.where("size > 0").join(labels, ["d1", "d2", "salt"]).select("doc_id", count, "component_id")
    return held.unionByName(listed.where("size = 0").select("doc_id", count, F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = WORDS_PER_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The row with the smallest id of each group of linked texts. All columns stay.

    Where ids are repeated or missing, each row gets a key of its own in the order of the ids, those without an id last,
    and goes or stays by its own text. Of rows with the same id and text one stays, even if they have no words.
    """
    doubtful = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("doc_id is null or rows > 1")
    if doubtful.isEmpty():
        found = components(docs, n, percent).where("doc_id <> component_id").select("doc_id")
        return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").alias("id"), "text")
    # Rows that are alike in id and text are told apart by their other columns, so that the keys don't depend on the run.
    ordered = rows.orderBy(F.asc_nulls_last("id"), "text", F.xxhash64(F.to_json("row"))).withColumn("key", F.monotonically_increasing_id())
    keyed, _ = materialize(ordered, "keyed")
    copies = components(keyed.select(F.col("key").alias("doc_id"), "text"), n, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("key"))
    same = Window.partitionBy("id", F.sha2("text", 256)).orderBy("key")
    again = keyed.where("id is not null").select("key", F.row_number().over(same).alias("nth")).where("nth > 1").select("key")
    return keyed.join(copies.unionByName(again), "key", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in columns])


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of the documents that link at 85 % over 4-word shingles; see components for awkward rows."""
    return components(table(spark, sf_dir, "documents"), n=4, percent=85)
