"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item is a sequence of word shingles. Shingles are ordered by their
number of occurrences in the whole corpus, rarest first. A text that contains a window
contains all its shingles, so a prefix of one shingle, the rarest, is the necessary
prefix: only texts with that shingle are candidates. Its offset in the window gives
the one place where the window can start; places that start before the text or end
after it are cut by the positional and length bounds, and the words of the rest are
compared one by one.

A small set of items is looked up in an index that every task holds. A larger one is
joined in Spark: texts ship a row for each shingle that a sketch of the items' shingles
lets through, with the words around it, and meet the windows on the shingle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, crowded, discard, lookup, salted, save, scored

#: Bytes of item text whose index every task may hold (about 20 times that in memory); larger sets of items are joined.
INDEX_BYTES = 1_000_000
#: Bits of the sketch of the items' shingles, a multiple of 32768: its size is fixed, however many items there are.
SKETCH = 1 << 26
#: Rows of one shingle or window that one task joins.
HOT = 200_000
#: Words of documents that a worker compares at once.
CHUNK_WORDS = 1 << 20
SHINGLE = 3
#: ASCII other than letters and digits separates words; A-Z are lower-cased.
_CUT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(data: bytes | None) -> list[bytes]:
    return data.translate(_CUT).split() if data else []


@dataclass
class Index:
    """Windows of the items. Widths k are 1 to SHINGLE; a window of fewer words than SHINGLE is one shingle."""

    vocab: dict[bytes, int]
    windows: dict[int, np.ndarray]  # length -> (windows, length) word ids, no two rows equal
    items: dict[int, list[list[str]]]  # length -> item ids of each window
    rare: dict[int, np.ndarray] = field(default_factory=dict)  # length -> occurrences of each window's shingles in the corpus
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # length -> sorted codes, offsets, windows

    def codes(self, ids: np.ndarray, k: int) -> np.ndarray:
        """A number for each run of k ids along the last axis; -1 if one of them is no item's word."""
        n, m = ids.shape[-1] - k + 1, len(self.vocab) + 1
        out, known = np.zeros((*ids.shape[:-1], n), np.int64), np.ones((*ids.shape[:-1], n), bool)
        for i in range(k):
            part = ids[..., i : i + n]
            out = out * m + part
            known &= part >= 0
        return np.where(known, out, -1)

    def shingle_codes(self) -> dict[int, np.ndarray]:
        """For each k, the distinct codes of the windows' shingles."""
        got: dict[int, list] = {}
        for n, w in self.windows.items():
            got.setdefault(min(SHINGLE, n), []).append(self.codes(w, min(SHINGLE, n)).ravel())
        return {k: np.unique(np.concatenate(v)) for k, v in got.items()}

    def choose(self, counts: dict[int, dict[int, int]]) -> None:
        """Keep each window's rarest shingle (the leftmost of equals) as its prefix."""
        for n, w in self.windows.items():
            k = min(SHINGLE, n)
            code = self.codes(w, k)
            seen = counts.get(k, {})
            often = np.array([[seen.get(c, 0) for c in row] for row in code.tolist()])
            at = often.argmin(axis=1)
            first = code[np.arange(len(w)), at]
            order = np.argsort(first, kind="stable")
            self.prefix[n] = (first[order], at[order], order)


def build(items: list[tuple[str, bytes]], window: int) -> Index:
    vocab: dict[bytes, int] = {}
    found: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        ids = [vocab.setdefault(w, len(vocab)) for w in words(text)]
        n = min(window, len(ids))
        for i in range(len(ids) - n + 1) if n else ():
            found.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set()).add(item)
    return Index(vocab, {n: np.array(list(w), np.int64).reshape(-1, n) for n, w in found.items()}, {n: [sorted(s) for s in w.values()] for n, w in found.items()})


def _chunks(texts: pa.Array):
    """(word counts, words) of the rows, about CHUNK_WORDS at a time."""
    held, sizes = [], []
    for t in texts:
        w = words(t.as_py())
        held += w
        sizes.append(len(w))
        if len(held) >= CHUNK_WORDS:
            yield sizes, held
            held, sizes = [], []
    if sizes:
        yield sizes, held


def _ids(index: Index, held: list[bytes]) -> np.ndarray:
    return np.fromiter(map(index.vocab.get, held, repeat(-1)), np.int64, len(held))


def _within(n: int, k: int, ends: np.ndarray) -> np.ndarray:
    """Whether the k words from each position lie in one document."""
    owner = np.searchsorted(ends, np.arange(n - k + 1), "right")
    return np.arange(n - k + 1) + k <= ends[owner]


def count_shingles(docs: DataFrame, text: str, index: Index) -> dict[int, dict[int, int]]:
    """Occurrences in all documents of every shingle of the items: k -> code -> count."""
    wanted = index.shingle_codes()

    def run(batches):
        ix = index
        total = {k: np.zeros(len(c), np.int64) for k, c in wanted.items()}
        for sizes, held in (x for b in batches for x in _chunks(b.column(0))):
            ids, ends = _ids(ix, held), np.cumsum(sizes)
            for k, codes in wanted.items():
                if len(ids) >= k and len(codes):
                    c = ix.codes(ids, k)
                    c = c[(c >= 0) & _within(len(ids), k, ends)]
                    at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
                    total[k] += np.bincount(at[codes[at] == c], minlength=len(codes))
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(wanted[k][some]), pa.array(n[some])], names=["k", "code", "n"])

    got = docs.select(F.col(text).cast("binary").alias("_text")).mapInArrow(run, "k int, code long, n long").groupBy("k", "code").agg(F.sum("n").alias("n")).collect()
    out: dict[int, dict[int, int]] = {}
    for k, code, n in got:  # at most as many rows as the items have shingles
        out.setdefault(k, {})[code] = n
    return out


def _matches(ix: Index, ids: np.ndarray, ends: np.ndarray):
    """Yield (window length, starts, windows) of verified occurrences."""
    begins = np.concatenate([[0], ends[:-1]])
    for n, (codes, offsets, which) in ix.prefix.items():
        k = min(SHINGLE, n)
        if len(ids) < n:
            continue
        c = ix.codes(ids, k)
        low, high = np.searchsorted(codes, c, "left"), np.searchsorted(codes, c, "right")
        at = np.flatnonzero((high > low) & (c >= 0))
        # candidates a bounded number at a time
        width = np.cumsum((high - low)[at])
        begin = 0
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(width, (width[begin - 1] if begin else 0) + CHUNK_WORDS // 4, "right")))
            here = at[begin:stop]
            w = (high - low)[here]
            pick = np.repeat(low[here], w) + np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            start, window = np.repeat(here, w) - offsets[pick], which[pick]
            doc = np.searchsorted(ends, np.repeat(here, w), "right")
            ok = (start >= begins[doc]) & (start + n <= ends[doc])
            start, window = start[ok], window[ok]
            if len(start):
                same = (np.lib.stride_tricks.sliding_window_view(ids, n)[start] == ix.windows[n][window]).all(axis=1)
                yield n, start[same], window[same]
            begin = stop


def _block(docs: DataFrame, text: str, keep: list[str], ix: Index) -> DataFrame:
    span = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))

    def score(texts: pa.Array) -> pa.Array:
        counts, spans, names = [], [], []
        for sizes, held in _chunks(texts):
            ids, ends = _ids(ix, held), np.cumsum(sizes)
            begins = ends - sizes
            change = np.zeros(len(ids) + 1, np.int64)
            items: dict[int, set] = {}
            for n, start, window in _matches(ix, ids, ends):
                np.add.at(change, start, 1)
                np.add.at(change, start + n, -1)
                for d, w in set(zip(np.searchsorted(ends, start, "right").tolist(), window.tolist())):
                    items.setdefault(d, set()).update(ix.items[n][w])
            hit = np.cumsum(change[:-1]) > 0
            for d in range(len(sizes)):
                found = []
                if d in items:
                    h = np.diff(np.concatenate([[0], hit[begins[d] : ends[d]].view(np.int8), [0]]))
                    found = [{"first": int(a), "past": int(z)} for a, z in zip(np.flatnonzero(h == 1), np.flatnonzero(h == -1))]
                spans.append(found)
                names.append(sorted(items.get(d, ())))
            counts += sizes
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(names, pa.list_(pa.string()))], names=["n_words", "hits", "items"])

    return scored(docs, keep, F.col(text).cast("binary"), score, "n_words long, hits array<struct<first:long,past:long>>, items array<string>")


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(win, n, w, item): the windows of items (i, t), as words between blanks; win is a hash of w."""

    def run(batches):
        for b in batches:
            for item, t in zip(b.column(0).to_pylist(), b.column(1)):
                w = words(t.as_py())
                n = min(window, len(w))
                made = [b" ".join(w[i : i + n]).decode("utf-8", "replace") for i in range(len(w) - n + 1)] if n else []
                for i in range(0, len(made), 4096):
                    part = made[i : i + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(part), pa.int32()), pa.array(part), pa.array([item] * len(part))], names=["n", "w", "item"])

    return items.mapInArrow(run, "n int, w string, item string").select(F.xxhash64("w").alias("win"), "n", "w", "item").distinct()


def _code(shingle: bytes) -> int:
    h = xxhash.xxh64_intdigest(shingle)
    return h - (1 << 64) if h >> 63 else h


def _sketch(codes: DataFrame) -> np.ndarray:
    """A bit for each slot, set where a code of (code) falls; SKETCH bits reach the driver, whatever the input."""
    slot = F.pmod(F.col("code"), F.lit(SKETCH)) + 1
    got = codes.select(F.bitmap_bucket_number(slot).alias("at"), F.bitmap_bit_position(slot).alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(SKETCH // 8, np.uint8)
    for at, bits in got:
        part = np.frombuffer(bytes(bits), np.uint8)
        out[(at - 1) * 4096 : (at - 1) * 4096 + len(part)] = part
    return out


def _joined(docs: DataFrame, text: str, items: DataFrame, window: int) -> DataFrame:
    """(t1, t2, hits, items) of the texts that hold a window of items (i, t); t1 and t2 are two hashes of the text."""
    spark = docs.sparkSession
    found = save(_windows(items, window), "dc-windows")
    wins = save(found.groupBy("win", "w").agg(F.first("n").alias("n")), "dc-wins")
    lengths = sorted({min(SHINGLE, r[0]) for r in wins.select("n").distinct().collect()})  # at most as many as words of a window

    def cut(batches):
        for b in batches:
            got = []
            for win, n, w in zip(*(b.column(c).to_pylist() for c in range(3))):
                parts, k = w.encode().split(b" "), min(SHINGLE, n)
                got += [(win, _code(b" ".join(parts[i : i + k])), i) for i in range(n - k + 1)]
            cols = list(zip(*got)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["win", "code", "off"])

    parts = save(wins.select("win", "n", "w").mapInArrow(cut, "win long, code long, off int"), "dc-shingles")
    given = docs.select(F.col(text).cast("binary").alias("t"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")).where("t is not null")

    def passing(sketch, data: bytes):
        """(words, codes, places) of the shingles that the sketch lets through, for each length."""
        w = words(data)
        for k in lengths:
            if len(w) >= k:
                shingles = w if k == 1 else list(map(b" ".join, zip(*(w[i:] for i in range(k)))))
                code = np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles))
                slot = (code % np.uint64(SKETCH)).astype(np.int64)
                at = np.flatnonzero(sketch.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                yield w, k, code.view(np.int64)[at], at

    wide = spark.sparkContext.broadcast(_sketch(parts.select("code")))

    def count(batches):
        for b in batches:
            got = [c for t in b.column(0) for _, _, c, _ in passing(wide, t.as_py())]
            code, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    often = save(given.select("t").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("seen")), "dc-often")
    # a shingle that no text holds rules its window out; of the others the rarest, leftmost one is the prefix
    rated = parts.join(often, "code", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "off", "code")).alias("p"))
    prefix = save(rated.where("p.seen > 0").select("win", "p.code", "p.off").join(wins, "win"), "dc-prefix")
    narrow = spark.sparkContext.broadcast(_sketch(prefix.select("code")))
    schema = "t1 long, t2 long, code long, at int, left int, around array<string>"

    def meet(batches):
        for b in batches:
            for t, t1, t2 in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for w, k, code, at in passing(narrow, t.as_py()):
                    for i in range(0, len(at), 4096):
                        here = at[i : i + 4096].tolist()
                        around = [[x.decode("utf-8", "replace") for x in w[max(0, p - window + k) : p + window]] for p in here]
                        yield pa.RecordBatch.from_arrays([pa.array([t1] * len(here), pa.int64()), pa.array([t2] * len(here), pa.int64()), pa.array(code[i : i + 4096]), pa.array(here, pa.int32()), pa.array([min(p, window - k) for p in here], pa.int32()), pa.array(around, pa.list_(pa.string()))], names=["t1", "t2", "code", "at", "left", "around"])

    # equal texts ship their shingles once a task
    places = save(given.mapInArrow(meet, schema).distinct(), "dc-places")
    both = salted(places, prefix, "code", crowded(places, "code", HOT), F.struct("t1", "at")).where((F.col("off") <= F.col("left")) & (F.size("around") - F.col("left") + F.col("off") >= F.col("n")))
    same = F.array_join(F.slice("around", F.col("left") - F.col("off") + 1, F.col("n")), " ") == F.col("w")
    first = F.col("at") - F.col("off")
    hits = save(both.where(same).select("t1", "t2", "win", "w", first.cast("long").alias("first"), (first + F.col("n")).cast("long").alias("past")).distinct(), "dc-hits")

    def runs(batches):
        for b in batches:
            out = []
            for spans in b.column(2).to_pylist():  # by first word; the windows of a text are at most as many as its words and lengths
                merged: list[dict] = []
                for x in spans:
                    if merged and x["first"] <= merged[-1]["past"]:
                        merged[-1]["past"] = max(merged[-1]["past"], x["past"])
                    else:
                        merged.append(dict(x))
                out.append(merged)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, b.schema.field(2).type)], names=["t1", "t2", "hits"])

    spans = hits.groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("first", "past"))).alias("hits")).mapInArrow(runs, "t1 long, t2 long, hits array<struct<first:long,past:long>>")
    held = hits.select("t1", "t2", "win", "w").distinct()
    named = salted(held, found.select("win", F.col("w").alias("same"), "item"), "win", crowded(held, "win", HOT), F.col("t1")).where("w = same").select("t1", "t2", "item").distinct()
    named = named.groupBy("t1", "t2").agg(F.sort_array(F.collect_list("item")).alias("items"))
    united = save(spans.join(named, ["t1", "t2"]), "contamination")
    discard(found, wins, parts, often, prefix, places, hits)
    wide.unpersist()
    narrow.unpersist()
    return united


def _n_words(text: str):
    return F.size(F.filter(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda x: x != "")).cast("long")


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None, item: str = "item_id", item_text: str = "text", window: int = 13, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``keep`` (default: all columns) plus n_words, hits and items for each document.

    hits: the runs (first, past) of words inside any occurrence of a window, in word
    numbers; items: the ids, as sorted strings, of the items with such windows. A
    window is ``window`` consecutive words of an item; an item of fewer words, but not
    none, is one window. Null and wordless texts have no words. Items with a null id
    or no words match nothing; items that repeat an id count as one. Whole texts are
    read, however long; repeated rows have equal results. Columns of the input named
    like an output are replaced. Empty documents: no rows; no items: no hits.

    The items are looked up in an index if their text is within ``index_bytes``; beyond
    that they are joined, and texts are read twice in narrow form.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "hits", "items")]
    known = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t"))
    total = known.agg(F.sum(F.length("t"))).first()[0] or 0
    if total <= index_bytes:
        index = build(sorted((r[0], bytes(r[1])) for r in known.collect()), window)
        index.choose(count_shingles(docs, text, index))
        return _block(docs, text, keep, index)
    united = lookup(_joined(docs, text, known, window), 200_000)
    out = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(_n_words(text), F.lit(0)).alias("n_words"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")).join(united, ["t1", "t2"], "left")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", F.coalesce("hits", F.expr("cast(array() as array<struct<first:long,past:long>>)")).alias("hits"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def n_hit():
    return F.expr("aggregate(hits, 0L, (a, x) -> a + x.past - x.first)")


def is_contaminated():
    """At least one word, and at least a twentieth of all, inside an occurrence."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def contamination_report(docs: DataFrame, items: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each document.

    Nulls, empty texts, repeated rows, ties and empty tables as in ``contamination``; further columns are ignored.
    """
    found = contamination(docs.select("doc_id", "text"), items, keep=["doc_id"], index_bytes=index_bytes)
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows; all columns kept, whatever their names. Null and wordless texts stay; empty table: no rows."""
    plain, named = aside(docs)
    found = contamination(plain, items, text=f"c{docs.columns.index('text')}", keep=plain.columns)
    return named(found.where(~is_contaminated()))


SQL = r"""
with d as (
  select doc_id, row_number() over () as rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null),
win as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
lens as (select distinct n from win),
dw as (
  select rid, i, n, array_to_string(w[i : i + n - 1], ' ') as s
  from (select rid, w, n, unnest(range(1, cast(len(w) - n + 2 as bigint))) as i from d, lens where len(w) >= n)),
occ as (select dw.rid, dw.i, dw.n, win.item_id from dw join win on dw.n = win.n and dw.s = win.s),
hit as (select rid, count(distinct j) as n_hit from (select rid, unnest(range(i, i + n)) as j from occ) group by rid),
it as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct rid, item_id from occ) group by rid)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join hit on d.rid = hit.rid left join it on d.rid = it.rid
"""
