"""N-gram Jaccard join by a token-group matrix.

Texts become sets of word shingles.  Equal sets collapse into classes.  Classes are
partitioned into groups of similar texts (equal min-hash, cut into blocks of bounded size),
and the matrix holds, per shingle, the groups whose union has it.  A text with n shingles can
miss at most n - ceil(t n) of them in any partner, so one of its first n - ceil(t n) + 1
shingles in a fixed global order must be in the partner's group, and among that group's own
first shingles: only those entries of the matrix are stored and joined.  The order puts
frequent shingles last, so shared passages open no groups.  A second, dense matrix has per group
and hash range the most shingles of any member there; its smaller entries, added up, bound the
overlap of any two members of two groups.  Only groups that can reach the threshold are opened;
there the union of one bounds each query of the other, and what passes is compared exactly.
Each group is first compared with three others by a few central members; groups that then
hang together are not compared again, so a large family costs links, not pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Forest, Scratch, as_bytes, by_group, connected_components
from llm.words import shingle_hashes, words_of

#: Slots of the fixed-size filters that go to every task (1 MiB each, at any input size).
SLOTS = 1 << 20
#: Members of a group that are compared first, to find out what hangs together anyway.
PILOTS = 4
#: Texts sent to one copy of a group.
QUERIES = 1024
#: Columns of the matrix of counts: shingles are counted by so many hash ranges.
COLUMNS = 256
#: Counts end here; a text or group that reaches it anywhere is bounded by nothing and compared exactly.
FULL = 127


def slot_filter(slots: DataFrame) -> np.ndarray:
    """A boolean per slot from a one-column frame of slots; at most SLOTS rows reach the driver."""
    found = np.zeros(SLOTS, bool)
    rows = slots.distinct().toArrow().column(0).to_numpy()
    found[rows.astype(np.int64)] = True
    return found


def slots_of(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(SLOTS - 1)).astype(np.int64)


def prefix_size(n: int, percent: int) -> int:
    """So many first shingles in a common order hold one of any partner's."""
    return n - math.ceil(percent * n / 100) + 1 if n else 0


def frequent_shingles(texts: DataFrame, n: int, percent: int, least: int) -> np.ndarray:
    """Slots of the shingles that stand among the first of ``least`` texts or more.

    Half as many again as a prefix are counted, as dropping frequent ones lets others move up;
    so are shingles that three texts of a batch share.  The counts only order the shingles: the
    result of the join does not depend on them.
    """
    def first(batches):
        for batch in batches:
            sets = [shingle_hashes(words_of(t), n) for t in as_bytes(batch.column(1))]
            tokens = np.concatenate([s[:3 * prefix_size(len(s), percent) // 2] for s in sets] or [np.empty(0, np.uint64)])
            shared, times = np.unique(np.concatenate(sets or [np.empty(0, np.uint64)]), return_counts=True)
            tokens = np.concatenate([tokens, shared[times >= 3]])
            times = np.concatenate([np.ones(len(tokens) - int((times >= 3).sum()), np.int64), times[times >= 3]])
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(times, pa.int64())], names=["token", "times"])

    often = texts.mapInArrow(first, "token long, times long").groupBy("token").agg(F.sum("times").alias("n")).where(
        F.col("n") >= least)
    return slot_filter(often.select(F.col("token").bitwiseAND(SLOTS - 1)))


def signature(packed: bytes) -> tuple[int, int]:
    """Two signed 64-bit halves that name a set."""
    sign = xxhash.xxh3_128_intdigest(packed)
    return (sign >> 64) - (1 << 63), (sign & (1 << 64) - 1) - (1 << 63)


def _profiles(texts: DataFrame, n: int, percent: int, frequent: np.ndarray, full: int) -> DataFrame:
    """Per text: set size, 128-bit set signature, min-hash and prefix in the global order."""
    held = texts.sparkSession.sparkContext.broadcast(frequent)

    def profile(batches):
        for batch in batches:
            rows = [[], [], [], [], [], []]
            for t in as_bytes(batch.column(1)):
                s = shingle_hashes(words_of(t), n)
                late = held.value[slots_of(s)]
                first = prefix_size(len(s), percent)
                prefix = s[~late][:first]
                if len(prefix) < first:
                    prefix = np.concatenate([prefix, s[late][:first - len(prefix)]])
                for row, value in zip(rows, (len(s), *signature(s.tobytes()), s[:1].view(np.int64)[0] if len(s) else 0, prefix.view(np.int64),
                                             np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=COLUMNS), full)),
                                      strict=True):
                    row.append(value)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.int8())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))],
                names=["id", "n", "s1", "s2", "low", "prefix", "counts"])

    return texts.mapInArrow(profile, "id long, n long, s1 long, s2 long, low long, prefix array<long>, counts array<byte>")


def _refined(blocks: DataFrame, percent: int, most_count: int) -> DataFrame:
    """Cuts blocks of equal min-hash into groups whose members may link, by their counts per column."""
    names = blocks.columns

    def refine(batches):
        for group in by_group(batches, ["gid"]):
            group = group.combine_chunks()
            counts = group.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, COLUMNS)
            n, gid = group.column("n").to_numpy(), group.column("gid")[0].as_py()
            forest = Forest(len(n))
            central, full = np.zeros(len(n)), counts.max(1) == most_count
            for k in range(len(n)):
                bound = np.minimum(counts[k], counts).sum(1, dtype=np.int64) / np.maximum(n[k], n)
                bound[full | full[k]] = 1
                near = 100 * bound >= percent - 1e-9
                central[k] = bound[near].sum()
                for j in np.flatnonzero(near[:k]).tolist():
                    forest.join(j, k)
            roots = np.array([forest.root(k) for k in range(len(n))])
            order = np.lexsort((-central, roots))  # the most central members of a group are its pilots
            first = np.searchsorted(roots[order], roots[order])
            pilot = np.zeros(len(n), bool)
            pilot[order] = np.arange(len(n)) - first < PILOTS
            new = [xxhash.xxh3_64_intdigest(f"{gid} {r}".encode()) - (1 << 63) for r in roots.tolist()]
            columns = {c: group.column(c).combine_chunks() for c in names}
            columns |= {"gid": pa.array(new, pa.int64()), "members": pa.array(np.bincount(roots)[roots], pa.int64()),
                        "pilot": pa.array(pilot)}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return blocks.repartition("gid").sortWithinPartitions("gid", "rep").mapInArrow(refine, blocks.schema)


def _most(rows: DataFrame) -> DataFrame:
    """(gid, lo, members, counts) of groups of several: smallest size, number, and the largest count per column."""
    def most(batches):
        for group in by_group(batches, ["gid"]):
            counts = group.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, COLUMNS).max(0)
            yield pa.RecordBatch.from_arrays(
                [group.column("gid").combine_chunks().slice(0, 1), pa.array([min(group.column("n").to_pylist())], pa.int64()),
                 pa.array([group.num_rows], pa.int64()), pa.array([counts], pa.list_(pa.int8()))],
                names=["gid", "lo", "members", "counts"])

    return rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(
        most, "gid long, lo long, members long, counts array<byte>")


def _sets(texts: DataFrame, n: int, wanted: np.ndarray) -> DataFrame:
    """(id, s1, set) of the texts whose id may be wanted."""
    held = texts.sparkSession.sparkContext.broadcast(wanted)

    def sets(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = pa.array(held.value[ids & (SLOTS - 1)] & batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            batch = batch.filter(keep)
            found = [shingle_hashes(words_of(t), n).tobytes() for t in as_bytes(batch.column(1))]
            signs = [signature(x)[0] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs, pa.int64()), pa.array(found, pa.binary())],
                                             names=["id", "s1", "set"])

    return texts.mapInArrow(sets, "id long, s1 long, set binary")


def links_between(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Positions (i, j) of pairs that reach the threshold; ``right`` None: pairs within ``left``."""
    group = left if right is None else right
    union, where = np.unique(np.concatenate(group), return_inverse=True)
    sizes = np.array([len(s) for s in group])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    found = []
    for i, s in enumerate(left):
        at = np.searchsorted(union, s)
        at[at == len(union)] = 0
        has = np.zeros(len(union), bool)
        has[at[union[at] == s]] = True
        if 100 * np.count_nonzero(has) < percent * max(len(s), sizes.min()):
            continue  # no member of the group can reach the threshold
        both = np.add.reduceat(has[where], starts, dtype=np.int64)
        ok = 100 * both >= percent * (len(s) + sizes - both)
        if right is None:
            ok[:i + 1] = False
        found += [(i, int(j)) for j in np.flatnonzero(ok)]
    return found


def _verified(laid: DataFrame, percent: int) -> DataFrame:
    """(a, b) links of rows (target, chunk, side, id, set): members (side 0) among themselves if there
    are no queries (side 1), else queries with members; a forest per task's group, not all pairs."""
    def verify(batches):
        for group in by_group(batches, ["target", "chunk"]):
            ids = group.column("id").to_pylist()
            side = np.asarray(group.column("side").to_pylist())
            sets = [np.frombuffer(b, np.uint64) for b in group.column("set").to_pylist()]
            cut = int((side == 0).sum())
            if cut == len(ids):
                found = links_between(sets, None, percent) if cut > 1 else []
            else:
                found = [(cut + i, j) for i, j in links_between(sets[cut:], sets[:cut], percent)] if cut else []
            forest = Forest(len(ids))
            for i, j in found:
                forest.join(i, j)
            linked = sorted({k for pair in found for k in pair})
            ends = [(ids[k], ids[forest.root(k)]) for k in linked if forest.root(k) != k]
            if ends:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*ends, strict=True)], names=["a", "b"])

    return laid.mapInArrow(verify, "a long, b long")


def _laid(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "target", "chunk").sortWithinPartitions("target", "chunk", "side", "id")


def _links_within(groups: DataFrame, members: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links inside the groups (gid)."""
    rows = members.join(groups, "gid", "left_semi").select(
        F.col("gid").alias("target"), F.lit(0).cast("long").alias("chunk"), F.lit(0).alias("side"), "id", "set")
    return _verified(_laid(rows, parts), percent)


def _links(pairs: DataFrame, members: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links between the groups of pairs (g1, g2, m1, m2): the texts of the smaller one are sent to the larger.

    A group is stored once per QUERIES texts sent to it, so a hot group is shared by several tasks.
    """
    larger = F.struct("m1", F.col("g1").alias("g")) >= F.struct("m2", F.col("g2").alias("g"))
    sent = pairs.select(F.when(larger, F.col("g1")).otherwise(F.col("g2")).alias("target"),
                        F.when(larger, F.col("g2")).otherwise(F.col("g1")).alias("gid"), F.least("m1", "m2").alias("m"))
    chunks = sent.groupBy("target").agg(F.ceil(F.sum("m") / QUERIES).alias("chunks"))
    queries = sent.join(chunks, "target").join(members, "gid").select(
        "target", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), F.lit(1).alias("side"), "id", "set")
    stored = members.join(chunks, F.col("gid") == F.col("target")).select(
        "target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "id", "set")
    return _verified(_laid(stored.union(queries), parts), percent)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3,
                       percent: int = 90, group_rows: int = 128, frequent_from: int = 20, full: int = FULL) -> DataFrame:
    """One row per input row: id, n_shingles, class_id (smallest id with an equal set), component_id.

    Two texts link when 100 * |A n B| >= percent * |A u B|.  Null and blank texts have an empty
    set: n_shingles 0, linked with nothing, their own class and component.  Rows that repeat an id
    are rows like others.  A row without id belongs to the class of its set, if that class has
    any id.  Other columns are never read.  An empty table gives an empty table.  Counts per hash range
    stop at ``full``, 127 at most; what reaches it is compared exactly.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    with Scratch(spark) as scratch:
        frequent = frequent_shingles(texts, words, percent, frequent_from)
        profiles = scratch.keep(_profiles(texts, words, percent, frequent, full), "profiles")
        classes = scratch.keep(profiles.where("n > 0 and id is not null").groupBy("s1", "s2").agg(
            F.min("id").alias("rep"), F.min("n").alias("n"), F.min("low").alias("low")), "classes")
        per_low = classes.groupBy("low").agg(F.count(F.lit(1)).alias("members"))
        placed = classes.join(per_low, "low").select(
            "rep", "n", "s1", "s2", "members", F.lit(True).alias("pilot"),
            F.xxhash64("low", F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / group_rows))).alias("gid"))
        held = profiles.where("n > 0").select(F.col("id").alias("rep"), "s1", "s2", "prefix", "counts")
        repeats = not profiles.where("n > 0").groupBy("id", "s1").agg(F.count(F.lit(1)).alias("k")).where(
            "k > 1 and id is not null").isEmpty()
        if repeats:  # rows of one id and text: one is enough
            held = held.dropDuplicates(["rep", "s1", "s2"])
        placed = scratch.keep(placed.join(held, ["rep", "s1", "s2"]), "placed")
        grouped = scratch.keep(placed.where("members = 1").union(
            _refined(placed.where("members > 1"), percent, full)), "groups")
        scratch.drop(placed)
        # From here on only names and sizes of all texts are needed; the wide table is the largest of all.
        named = scratch.keep(profiles.select("id", "n", "s1", "s2"), "named")
        scratch.drop(profiles)

        entries = grouped.select("gid", "n", "members", F.explode("prefix").alias("token"))
        alone = entries.where("members = 1").select("token", "gid", F.col("n").alias("lo"), F.col("n").alias("hi"))
        unions = entries.where("members > 1").groupBy("token", "gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
        matrix = alone.union(unions)
        other = matrix.toDF("token", "gid2", "lo2", "hi2")
        met = matrix.join(other, "token").where(
            f"gid < gid2 and 100 * hi >= {percent} * lo2 and 100 * hi2 >= {percent} * lo").select(
            F.col("gid").alias("g1"), F.col("gid2").alias("g2")).distinct()
        met = scratch.keep(met, "met")
        bounds = scratch.keep(grouped.where("members = 1").select("gid", F.col("n").alias("lo"), "members", "counts").union(
            _most(grouped.where("members > 1").select("gid", "n", "counts"))), "bounds")
        overlap = F.aggregate(F.zip_with("k1", "k2", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
        unbounded = (F.array_max("k1") >= full) | (F.array_max("k2") >= full)
        pairs = scratch.keep(met.join(bounds.toDF("g1", "lo1", "m1", "k1"), "g1").join(
            bounds.toDF("g2", "lo2", "m2", "k2"), "g2").where(
            unbounded | (100 * overlap >= percent * F.greatest("lo1", "lo2"))).select(
            "g1", "g2", "m1", "m2"), "near-pairs")
        # of each group, its pairs with the largest other group and with two more: compared early, by pilots
        ends = pairs.select(F.col("g1").alias("g"), F.col("g2").alias("o"), F.col("m2").alias("m")).union(
            pairs.select("g2", "g1", "m1"))
        best = ends.groupBy("g").agg(F.max(F.struct("m", "o"))["o"].alias("x"), F.min("o").alias("y"),
                                     F.max("o").alias("z")).select("g", F.explode(F.array("x", "y", "z")).alias("o"))
        early = best.select(F.least("g", "o").alias("g1"), F.greatest("g", "o").alias("g2")).distinct().join(
            pairs, ["g1", "g2"])

        several = grouped.where("members > 1").select("gid")
        involved = pairs.select(F.col("g1").alias("gid")).union(pairs.select("g2")).union(several).distinct()
        wanted = scratch.keep(grouped.select("gid", F.col("rep").alias("id"), "s1", "pilot").join(involved, "gid", "left_semi"), "wanted")
        chosen = slot_filter(wanted.select(F.col("id").bitwiseAND(SLOTS - 1)))
        sets = _sets(texts, words, chosen)
        if repeats:
            sets = sets.dropDuplicates(["id", "s1"])
        members = scratch.keep(wanted.join(sets, ["id", "s1"]).select("gid", F.col("s1").alias("id"), "pilot", "set"), "members")

        known = scratch.keep(_links_within(several.distinct(), members, percent, parts).union(
            _links(early, members.where("pilot"), percent, parts)), "links")
        so_far = scratch.keep(connected_components(scratch, known), "so-far")
        state = scratch.keep(members.select("gid", "id").join(so_far, "id", "left").groupBy("gid").agg(
            F.min(F.coalesce("component", "id")).alias("c"), F.max(F.coalesce("component", "id")).alias("d")), "state")
        left = pairs.join(state.toDF("g1", "c1", "d1"), "g1").join(state.toDF("g2", "c2", "d2"), "g2") \
            .where("not (c1 = d1 and c2 = d2 and c1 = c2)").select("g1", "g2", "m1", "m2")
        links = known.union(_links(left, members, percent, parts))
        nodes = classes.select("s1", "s2", "rep").join(
            connected_components(scratch, links).withColumnRenamed("id", "s1"), "s1", "left")
        nodes = scratch.keep(nodes.withColumn("component", F.coalesce("component", "s1")), "nodes")
        smallest = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
        out = named.join(
            nodes.join(smallest, "component").drop("component"), ["s1", "s2"], "left")
        return scratch.result(out.select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
            F.coalesce("rep", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id")))
