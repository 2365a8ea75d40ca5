"""SimHash near-duplicate search with BK-trees.

Fingerprints are indexed in shards (a shard holds the fingerprints that agree in
one table of bit positions), every shard gets a BK-tree, and a search follows only
child edges within the radius. Exact tables keep all but ``radius`` of some disjoint
runs of bits, in every combination: two fingerprints within the radius differ in at
most ``radius`` runs, so they agree in one table. The more rows, the more runs and the
longer keys, so that shards stay small. A shard that outgrows one task is dealt over
block pairs, so every pair still meets.

A tree task returns a spanning star for each group it finds, not its pairs; stars
of all shards are joined by ``connected_components``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import Forest, merge
from .common import HOT, aside, crowded, discard, lookup, salted, save
from .components import connected_components, thinned

#: Members of a shard that one tree takes; larger shards are dealt over pairs of blocks.
SHARD = 4096
#: Rows that a tree task reads, as a mean.
TASK_ROWS = 250_000
#: Tables whose shards are searched at once.
WAVE = 16


def shingles(data: bytes, k: int) -> list[bytes]:
    """Word shingles of UTF-8 text with A-Z lower-cased; words are split at ASCII white space.

    Fewer than k words: the whole sequence is one shingle; none: no shingle.
    """
    words = data.lower().split()
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)))))


def fingerprint(parts: list[bytes], seeds: tuple[int, ...]) -> np.ndarray:
    """A 64-bit word for each seed: a bit is set if it is set in over half of the hashes."""
    out = np.zeros(len(seeds), np.uint64)
    if parts:
        for w, seed in enumerate(seeds):
            h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in parts), np.uint64, len(parts))
            ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[w] = np.packbits(2 * ones > len(parts), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, text: str, keep: list[str], k: int, seeds: tuple[int, ...], distinct: bool = False) -> DataFrame:
    """``keep`` plus fp0, fp1, ... (long, the bits of the unsigned word) for each row; null text has no words.

    distinct: a shingle counts once, however often the text repeats it; adds their number, n_shingles.
    """
    names = [f"fp{i}" for i in range(len(seeds))] + ["n_shingles"] * distinct

    def run(batches):
        for b in batches:
            made = np.zeros((b.num_rows, len(names)), np.uint64)
            for i, t in enumerate(b.column(b.num_columns - 1)):
                data = t.as_py()
                if data:
                    parts = shingles(data, k)
                    parts = list(set(parts)) if distinct else parts
                    made[i, : len(seeds)] = fingerprint(parts, seeds)
                    if distinct:
                        made[i, -1] = len(parts)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(made[:, w].view(np.int64)) for w in range(len(names)))], names=[*keep, *names])

    given = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    schema = ", ".join([f"`{c}` {given.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} long" for n in names])
    return given.mapInArrow(run, schema)


def exact_tables(bits: int, radius: int, rows: int = 0) -> list[np.ndarray]:
    """Sets of bit positions of which any two fingerprints within the radius agree in at least one.

    All combinations of runs but ``radius`` of them, for the number of runs that ships
    the fewest copies of ``rows`` rows: a table ships each row once, and once more for
    every SHARD members that its key gathers.
    """

    def made(runs: int) -> list[np.ndarray]:
        parts = np.array_split(np.arange(bits), runs)
        return [np.concatenate(c) for c in itertools.combinations(parts, runs - radius)]

    def copies(runs: int) -> float:
        return math.comb(runs, radius) * max(1.0, rows / 2.0 ** (bits * (runs - radius) / runs) / SHARD)

    return made(min(range(radius + 1, radius + 5), key=copies))


def sampled_tables(bits: int, width: int, count: int, seed: int = 7) -> list[np.ndarray]:
    """``count`` random sets of ``width`` positions: finds a pair that differs in a share p of its bits with 1 - (1 - (1-p)^width)^count."""
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice(bits, width, replace=False)) for _ in range(count)]


def near(nodes: DataFrame, words: int, radius: int, tables: list[np.ndarray], tree: type = Forest) -> DataFrame:
    """Stars (src, dst) that span the groups of ``nodes`` (node long, fp0, fp1, ...) linked within the radius.

    Nodes must be distinct. Rows with a null node are ignored. WAVE tables are searched at once; if there are more, the stars of
    each wave are written, so that the shuffled rows of one wave alone lie on disk.
    """
    fps = [f"fp{i}" for i in range(words)]
    nodes = nodes.where("node is not null").select("node", *fps)
    n = nodes.count()
    waves = [_searched(nodes, n, fps, radius, tables[i : i + WAVE], tree) for i in range(0, len(tables), WAVE)]
    links = None
    for wave in waves:
        found = wave() if len(waves) == 1 else save(thinned(wave()), "near-wave")
        links = found if links is None else links.union(found)
    return links


def _searched(nodes: DataFrame, n: int, fps: list[str], radius: int, tables: list[np.ndarray], tree: type) -> Callable[[], DataFrame]:
    """What finds the stars of some tables. A row is shipped to a shard as its node and fingerprint; the key is hashed from these on either side."""
    words = len(fps)
    masks = np.zeros((len(tables), words * 64), np.uint8)
    for t, at in enumerate(tables):
        masks[t, at] = 1
    masks = np.packbits(masks, axis=1, bitorder="little").view(np.uint64).reshape(len(tables), words)
    held = [F.element_at(F.array(*[F.lit(int(m)) for m in masks[:, w].view(np.int64)]), F.col("t") + 1) for w in range(words)]
    key = F.xxhash64("t", *[F.col(c).bitwiseAND(m) for c, m in zip(fps, held)])

    def search(batches):
        got = [[np.asarray(c) for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        cols = [np.concatenate(x) for x in zip(*got)]
        del got
        table, pair, node = cols[:3]
        fp = np.stack(cols[3:], axis=1).view(np.uint64)
        unit = pair.view(np.uint64) * np.uint64(len(tables)) + table.astype(np.uint64)
        for w in range(words):
            unit = (unit ^ (fp[:, w] & masks[table, w])) * np.uint64(0x9E3779B97F4A7C15)
            unit ^= unit >> np.uint64(29)
        order = np.argsort(unit, kind="stable")
        unit = unit[order]
        alone = np.ones(len(unit), bool)
        alone[1:] &= unit[1:] != unit[:-1]
        alone[:-1] &= unit[1:] != unit[:-1]
        order, unit = order[~alone], unit[~alone]
        if not len(order):
            return
        fp = fp[order]
        node = node[order]
        forest = tree(fp, unit)
        label = np.arange(len(node))
        for a, b in forest.neighbours(radius):
            merge(label, a, b)
        # the hub is the smallest node, so that the stars of one group in many tables mostly share their hubs
        hub = node.copy()
        np.minimum.at(hub, label, node)
        hub = hub[label]
        linked = np.flatnonzero(hub != node)
        yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(hub[linked])], names=["src", "dst"])

    def run() -> DataFrame:
        banded = nodes.select(F.explode(F.array(*[F.lit(t) for t in range(len(tables))])).alias("t"), F.lit(-1).cast("long").alias("pair"), "node", *fps)
        # Shards that need dealing out are told from an eighth of the nodes; which shards these are changes the cost alone, never the result.
        seen = banded.where("pmod(xxhash64(node), 8) = 0").select(key.alias("key"))
        hot = save(seen.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD // 8).select("key", F.ceil(F.col("n") * 8 / SHARD).cast("int").alias("blocks")), "hot")
        units = banded
        if hot.limit(1).count():
            mine = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("long")
            other = F.explode(F.expr("transform(filter(sequence(0, blocks - 1), x -> x <> mine), x -> least(x, mine) * 4294967296 + greatest(x, mine))"))
            dealt = banded.withColumn("key", key).join(lookup(hot, 200_000), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            many = dealt.where("blocks > 1").withColumn("mine", mine).withColumn("pair", other)
            units = dealt.where("blocks = 1").select("t", "pair", "node", *fps).union(many.select("t", "pair", "node", *fps))
        parts = max(12, n * len(tables) // TASK_ROWS)
        return units.repartition(parts, key, "pair").mapInArrow(search, "src long, dst long")

    return run


def simhash_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """Rows of ``docs`` with fingerprint (16 hex digits) and component_id: the smallest id reachable by links.

    Documents link if their 64-bit fingerprints differ in at most ``radius`` bits;
    complete for every group size. Returns (doc, fingerprint, component_id), one row
    for each input row. Null or wordless text: fingerprint zero, linked like any other.
    Equal texts share a fingerprint, so they share a component. A null id keeps its
    row and never becomes a component_id unless its component has no other id.
    Repeated ids keep all their rows. Empty table: no rows. Further columns are ignored.
    """
    each = save(fingerprints(docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_in")), "_in", ["_doc"], k, (42,)).withColumn("_row", F.monotonically_increasing_id()), "fp")
    unique = save(each.groupBy("fp0").agg(F.min("_doc").alias("least")), "fp-unique")
    linked = save(connected_components(near(unique.select(F.col("fp0").alias("node"), "fp0"), 1, radius, exact_tables(64, radius, unique.count()))), "fp-linked")
    held = save(linked.join(unique.withColumnRenamed("fp0", "node"), "node").select("node", "component", "least"), "fp-held")
    least = save(held.groupBy("component").agg(F.min("least").alias("smallest")), "fp-least")
    named = save(held.join(least, "component").select(F.col("node").alias("fp0"), "smallest"), "fp-named")
    final = save(unique.join(named, "fp0", "left").select("fp0", F.coalesce("smallest", "least").alias("component_id")), "fp-final")
    discard(unique, linked, held, least, named)
    out = salted(each, final, "fp0", crowded(each, "fp0", HOT), F.col("_row"))
    return out.select(F.col("_doc").alias(doc), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near duplicates by exact similarity, on SimHash candidates -------------------------------------------------

#: Documents, and bytes of shingle hashes, of a candidate cluster that one verification takes.
BLOCK, BLOCK_BYTES = 64, 16 << 20
#: The same where blocks are compared pair by pair.
PAIRED = 512
#: Rounds in which the heads of blocks that are still apart are dealt anew.
DEALS = 8


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """(node, component, set): the distinct shingle hashes of (node, component, _text), sorted, as packed 64-bit words."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # a set at a time: texts may be long
                parts = shingles(b.column(2)[i].as_py() or b"", k)
                made = np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in parts), np.uint64, len(parts)))
                one = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array([made.tobytes()], pa.binary())], names=["node", "component", "set"])

    return rows.select("node", "component", "_text").mapInArrow(run, "node long, component long, set binary")


def _verify(similarity: float) -> Callable:
    """Exact Jaccard of shingle sets within each unit of (unit, node, given, set), as stars (src, dst).

    Documents with one ``given`` are known to be linked already; only pairs that are not are compared.
    """

    def stars(node: np.ndarray, given: np.ndarray, sets: list[np.ndarray]):
        m = len(sets)
        size = np.array([len(s) for s in sets])
        _, first, group = np.unique(given, return_index=True, return_inverse=True)
        label = first[group]
        flat = np.concatenate(sets)
        _, token = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(m), size)
        order = np.argsort(token, kind="stable")
        posting = owner[order]
        start = np.searchsorted(token[order], np.arange(token.max() + 2 if len(token) else 1))
        at = np.concatenate([[0], np.cumsum(size)])
        for i in range(m):
            apart = label[label] != label[i]
            if not size[i] or not apart.any():
                continue
            mine = token[at[i] : at[i + 1]]
            width = start[mine + 1] - start[mine]
            step = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
            shared = np.bincount(posting[np.repeat(start[mine], width) + step], minlength=m)
            alike = np.flatnonzero(apart & (shared >= similarity * (size + size[i] - shared) - 1e-9))
            if len(alike):
                merge(label, np.full(len(alike), i), alike)
        bound = np.flatnonzero(label != np.arange(m))
        return node[bound], node[label[bound]]

    def run(batches):
        # rows come sorted by unit, so one unit is held at a time
        now, ids, given, sets = None, [], [], []
        for b in batches:
            for u, n, g, t in zip(*(c.to_pylist() for c in b.columns)):
                if u != now and len(ids) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(np.array(ids, np.int64), np.array(given, np.int64), sets)], names=["src", "dst"])
                if u != now:
                    now, ids, given, sets = u, [], [], []
                ids.append(n)
                given.append(g)
                sets.append(np.frombuffer(t, np.uint64))
        if len(ids) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(np.array(ids, np.int64), np.array(given, np.int64), sets)], names=["src", "dst"])

    return run


def _class(text: str):
    """Equal texts have equal classes; texts without words have class 0."""
    return F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text)).otherwise(F.lit(0))


def _verified(docs: DataFrame, doc: str, text: str, member: DataFrame, similarity: float, k: int) -> DataFrame:
    """Stars (src, dst) that span the linked documents of each candidate cluster; member: (node, component, _doc).

    Shingle sets are made once. A cluster is compared in blocks of up to BLOCK documents
    and BLOCK_BYTES of sets; then the smallest documents of what was found, of all blocks,
    are dealt into blocks anew, as long as that brings them down. Only clusters that are
    still in several parts are compared over all pairs of blocks, without the pairs that
    are joined already.
    """
    member = save(member.select("node", "component", "_doc"), "nd-member")
    asked = lookup(member.withColumnRenamed("node", "_class"), 500_000)
    one = docs.select(F.col(doc).alias("_doc"), _class(text).alias("_class"), F.col(text).cast("binary").alias("_text"))
    one = one.join(asked, one["_doc"].eqNullSafe(asked["_doc"]) & (one["_class"] == asked["_class"])).select(one["_class"].alias("node"), "component", "_text")
    one = save(_sets(one, k), "nd-sets")
    sizes = save(one.select("node", "component", F.length("set").alias("bytes")), "nd-sizes")

    def compared(rows: DataFrame) -> DataFrame:
        """Stars of (unit, node, given, set)."""
        parts = max(12, rows.count() // 1000)
        return save(rows.select("unit", "node", "given", "set").repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(_verify(similarity), "src long, dst long"), "nd-link")

    def blocks(rows: DataFrame, many: int) -> DataFrame:
        """(node, component, blocks) of rows: blocks of ``many`` documents or BLOCK_BYTES of sets."""
        held = rows.join(sizes, ["node", "component"])
        need = F.greatest(F.ceil(F.count(F.lit(1)) / many), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
        large = save(held.groupBy("component").agg(need.alias("blocks")).where("blocks > 1"), "nd-size")
        return rows.join(lookup(large, 200_000), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))

    def part_of(turn: int):
        return F.pmod(F.xxhash64("node", F.lit(turn)), F.col("blocks")).cast("int")

    everyone = member.select("node", "component")
    dealt = save(blocks(everyone, BLOCK), "nd-dealt")
    found = compared(one.join(dealt.select("node", F.xxhash64("component", part_of(0)).alias("unit")), "node").withColumn("given", F.col("node")))
    large = dealt.where("blocks > 1").select("node", "component")
    if not large.limit(1).count():
        discard(member, one, sizes, dealt)
        return found

    def parts(links: DataFrame) -> DataFrame:
        """(node, component, given) of large clusters that ``links`` leave in several parts."""
        label = connected_components(links).withColumnRenamed("component", "given")
        now = save(large.join(label, "node", "left").withColumn("given", F.coalesce("given", "node")), "nd-parts")
        several = now.groupBy("component").agg(F.min("given").alias("a"), F.max("given").alias("b")).where("a <> b").select("component")
        several = save(several, "nd-several")
        apart = save(now.join(lookup(several, 200_000), "component", "left_semi"), "nd-parts")
        discard(now, several)
        return apart

    before = None
    for turn in range(1, DEALS + 1):
        heads = save(blocks(parts(found).where("node = given").select("node", "component"), BLOCK), "nd-heads")
        left = heads.count()
        if not left or before is not None and left > 0.9 * before:
            break
        before = left
        found = found.union(compared(one.join(heads.select("node", F.xxhash64("component", F.lit("heads"), part_of(turn)).alias("unit")), "node").withColumn("given", F.col("node"))))
        if not heads.where("blocks > 1").limit(1).count():
            break  # every cluster's heads met in one block
    rest = parts(found)
    rest = blocks(rest, PAIRED).withColumn("mine", part_of(0))
    pairs = F.expr("if(blocks = 1, array(array(0, 0)), transform(filter(sequence(0, blocks - 1), x -> x <> mine), x -> array(least(x, mine), greatest(x, mine))))")
    rest = save(rest.withColumn("pair", F.explode(pairs)).select("node", "given", F.xxhash64("component", "pair").alias("unit")), "nd-rest")
    if rest.limit(1).count():
        found = found.union(compared(one.join(rest, "node")))
    discard(member, one, sizes, dealt, rest)
    return found


#: Bits of a fingerprint.
BITS = 128
#: Cost of shipping a row to a shard, in distances computed there; twice its time, as disk is scarcer.
SHIP = 60.0


def _differing(a: int, b: int, both: int) -> float:
    """Chance that a bit differs between fingerprints of sets of ``a`` and ``b`` shingles that share ``both``."""
    chance = lambda n: [math.comb(n, i) / 2.0**n for i in range(n + 1)]
    above = lambda n, least: sum(p for i, p in enumerate(chance(n)) if i >= least)
    out = 0.0
    for ones, p in enumerate(chance(both)):
        x, y = above(a - both, a // 2 + 1 - ones), above(b - both, b // 2 + 1 - ones)
        out += p * (x * (1 - y) + y * (1 - x))
    return out


#: Up to so many distinct shingles texts are searched once more among themselves, as their fingerprints tie most.
FEW, SMALL = 5, 24


def farthest(similarity: float, few: bool = False) -> float:
    """The largest share of differing bits that a pair of this Jaccard similarity or more expects, over the sizes of its sets.

    few: both sets have FEW shingles at most; else one has more. Large sets of equal size
    have the cosine 2J / (1 + J) and differ with probability angle / pi; sets of up to
    SMALL shingles are counted out.
    """
    out = 0.0 if few else float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    for b in range(2, FEW + 1) if few else range(FEW + 1, SMALL + 1):
        for a in range(1, b + 1):
            both = math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
            out = max([out, *(_differing(a, b, c) for c in range(both, min(a, b - (a == b)) + 1))])
    return out


def _search_plan(similarity: float, recall: float, rows: int, few: bool = False) -> tuple[int, int, int]:
    """Radius, bits of a table and number of tables that find a pair of this similarity with probability ``recall``, whatever the size of its sets.

    The distance of a pair is binomial; the mean over it counts. Of all widths the one
    that costs least: short keys gather large shards, long keys need many tables.
    """
    share = max(farthest(similarity, few), 1 / BITS)
    radius = int(np.ceil(BITS * share + 3.3 * np.sqrt(BITS * share * (1 - share))))
    d = np.arange(radius + 1)
    chance = np.array([math.comb(BITS, int(x)) for x in d], float) * share**d * (1 - share) ** (BITS - d)
    best = None
    for width in range(6, 41):
        hit = (1 - d / BITS) ** width
        found = lambda t: (chance * (1 - (1 - hit) ** t)).sum()  # noqa: E731, B023
        if found(1 << 14) < recall:
            break
        low, high = 1, 1 << 14
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if found(mid) >= recall else (mid + 1, high)
        members = rows / 2.0**width
        cost = low * (SHIP * max(1.0, members / SHARD) + members / 2)
        if best is None or cost < best[0]:
            best = (cost, width, low)
    return radius, best[1], best[2]


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """Documents that a smaller document of their group makes redundant: (doc, _class), one row for each row to drop.

    A group is a component of links between equal texts and between texts whose
    ``k``-word shingle sets have Jaccard similarity of at least ``similarity``. The
    smallest id of a group stays. Candidates come from BK-trees over 128-bit SimHash
    fingerprints of these sets; the tables follow from ``recall``, the chance to find a
    pair just at the threshold (closer pairs: more likely), and from the number of
    rows. Every link is verified on the shingle sets. Null and wordless texts form one
    group. A null id counts as larger than any other. Repeated ids keep their rows
    apart by their texts; further columns are ignored. Empty table: no rows.
    """
    narrow = docs.select(F.col(doc).alias("_doc"), _class(text).alias("_class"), F.col(text).alias("_in"))
    each = save(fingerprints(narrow, "_in", ["_doc", "_class"], k, (42, 43), distinct=True).withColumn("_row", F.monotonically_increasing_id()), "nd-fp")
    unique = save(each.groupBy("_class").agg(F.min("_doc").alias("least"), F.min("fp0").alias("fp0"), F.min("fp1").alias("fp1"), F.min("n_shingles").alias("n_shingles")), "nd-unique")
    nodes = unique.where("n_shingles > 0").select(F.col("_class").alias("node"), "fp0", "fp1", "n_shingles")
    links = None
    for few, some in ((False, nodes), (True, nodes.where(F.col("n_shingles") <= FEW))):
        radius, width, count = _search_plan(similarity, recall, some.count(), few)
        found = near(some, 2, radius, sampled_tables(BITS, width, count))
        links = found if links is None else links.union(found)
    links = save(links, "nd-near")
    cluster = save(connected_components(thinned(links)), "nd-cluster")
    discard(links)
    link = _verified(docs, doc, text, cluster.join(unique.select(F.col("_class").alias("node"), F.col("least").alias("_doc")), "node"), similarity, k)
    joined = save(connected_components(link), "nd-linked")
    held = save(joined.join(unique.select(F.col("_class").alias("node"), "least"), "node"), "nd-held")
    least = save(held.groupBy("component").agg(F.min("least").alias("smallest")), "nd-least")
    named = save(held.join(least, "component").select(F.col("node").alias("_class"), "smallest"), "nd-named")
    stays = save(unique.join(named, "_class", "left").select("_class", F.coalesce("smallest", "least").alias("_stays")), "nd-stays")
    out = save(salted(each.select("_doc", "_class", "_row"), stays, "_class", crowded(each, "_class", HOT), F.col("_row")).where("not (_doc <=> _stays)").select(F.col("_doc").alias(doc), "_class"), "nd-drop")
    discard(unique, cluster, link, joined, held, least, named, stays, each)
    return out


def deduplicated(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row for each group of ``near_duplicates``, all columns kept, whatever their names.

    Rows that repeat an id with the same text count once. Null and wordless texts are
    one group. Whole texts are read, however long. Empty table: no rows.
    """
    drop = near_duplicates(docs, doc, text, k, similarity)
    gone = lookup(drop.distinct().toDF("gone_doc", "gone_class"), 1_000_000)
    plain, named = aside(docs)
    mine, body = f"c{docs.columns.index(doc)}", f"c{docs.columns.index(text)}"
    marked = plain.withColumn("label", _class(body))
    left = marked.join(gone, marked[mine].eqNullSafe(gone["gone_doc"]) & (marked["label"] == gone["gone_class"]), "left_anti")
    if docs.groupBy(doc).count().where("count > 1").limit(1).count():
        left = left.dropDuplicates([mine, "label"])
    return named(left)
