"""Token counts through a cache of digests.

A text's content digest and the tokenizer's version digest are joined to stored counts.
Of what is missing, each distinct content is encoded once and appended to the cache, a
Parquet folder per tokenizer version that later runs read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, salted, save, scored, scratch

#: Characters encoded at once; longer texts are cut there where that changes no token.
CHARACTERS = 1 << 18
#: Largest tokenizer file, which goes to every task.
FILE_BYTES = 64 << 20
#: Rows of one content that a task joins; more are dealt over several tasks.
COPIES = 1_000
#: Where a byte-level pattern always ends one word and starts the next: a single space between two characters that are not white space.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: Words whose counts a worker holds, and the characters of the longest of them.
WORDS, WORD = 1 << 19, 64


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer file: ``.json`` of the library tokenizers, ``.model`` of sentencepiece. The file's bytes go to the tasks, so executors need no copy of it."""

    kind: str
    blob: bytes

    @classmethod
    def read(cls, path: str) -> Tokenizer:
        kind = os.path.splitext(path)[1]
        if kind not in (".json", ".model"):
            raise ValueError(f"neither .json nor .model: {path}")
        if os.path.getsize(path) > FILE_BYTES:
            raise ValueError(f"a tokenizer of over {FILE_BYTES} bytes: {path}")
        with open(path, "rb") as f:
            return cls(kind, f.read())

    @property
    def version(self) -> str:
        """Digest of the file, the library and its version."""
        if self.kind == ".json":
            import tokenizers as library
        else:
            import sentencepiece as library
        return hashlib.sha256(f"{self.kind} {library.__version__} ".encode() + self.blob).hexdigest()

    @property
    def normalises(self) -> bool:
        """Whether different texts can have the same content."""
        return self.kind == ".model" or json.loads(self.blob)["normalizer"] is not None

    def counter(self) -> Callable[[list[str]], list[int]]:
        """Numbers of tokens of texts: no begin, end or added special token, nothing truncated or padded."""
        return _counter(self)

    def content(self) -> Callable[[str], bytes]:
        """What of a text its tokens follow from: its normal form; for texts with a special token, which are split before that, the text itself."""
        if self.kind == ".model":
            processor = _loaded(self)
            return lambda text: processor.normalize(text).encode()
        tokenizer = _loaded(self)
        special = [t["content"] for t in json.loads(self.blob)["added_tokens"]]
        return lambda text: b"text " + text.encode() if any(s in text for s in special) else b"form " + tokenizer.normalizer.normalize_str(text).encode()


@lru_cache(maxsize=4)
def _loaded(which: Tokenizer):
    if which.kind == ".model":
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=which.blob)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
    import tokenizers

    out = tokenizers.Tokenizer.from_str(which.blob.decode())
    out.no_truncation()
    out.no_padding()
    return out


def pieces(text: str, size: int) -> Iterator[str]:
    """``text`` cut at a CUT after every ``size`` characters; whole if it has none there."""
    at = 0
    while len(text) - at > size and (cut := CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _cuttable(definition: dict) -> bool:
    """Whether the tokens of a text are those of its pieces one after the other."""
    split = definition["pre_tokenizer"] or {}
    plain = definition["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    return plain and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in definition["added_tokens"])


@lru_cache(maxsize=4)
def _counter(which: Tokenizer) -> Callable[[list[str]], list[int]]:
    loaded = _loaded(which)
    if which.kind == ".model":

        def encode(texts: list[str]) -> list[int]:
            return [len(ids) for ids in loaded.encode(texts, num_threads=1)]
    else:

        def encode(texts: list[str]) -> list[int]:
            return [len(e) for e in loaded.encode_batch_fast(texts, add_special_tokens=False)]

    cut = which.kind == ".json" and _cuttable(json.loads(which.blob))
    known: dict[str, int] = {}

    def by_words(texts: list[str]) -> list[int]:
        """Texts word by word: the library gets each word that is not held yet once."""
        split = [CUT.split(t) for t in texts]
        new = list({w for words in split for w in words} - known.keys())
        known.update(zip(new, encode(new)))
        out = [sum(map(known.__getitem__, words)) for words in split]
        if len(known) > WORDS:
            known.clear()
        for w in new:
            if len(w) > WORD:
                known.pop(w, None)
        return out

    def count(texts: list[str]) -> list[int]:
        total, now, owner, size = [0] * len(texts), [], [], 0

        def flush() -> None:
            for i, n in zip(owner, by_words(now) if cut else encode(now)):
                total[i] += n
            now.clear()
            owner.clear()

        for i, text in enumerate(texts):
            for piece in pieces(text, CHARACTERS) if cut else (text,):
                if now and size + len(piece) > CHARACTERS:
                    flush()
                    size = 0
                now.append(piece)
                owner.append(i)
                size += len(piece)
        flush()
        return total

    return count


def digested(docs: DataFrame, text: str, tokenizer: Tokenizer, keep: list[str], name: str = "digest") -> DataFrame:
    """The columns ``keep`` and the digest of the content (null: empty). Without a normal form of its own a text is its content, and no Python runs."""
    whole = F.coalesce(F.col(text), F.lit(""))
    if not tokenizer.normalises:
        return docs.select(*keep, F.unhex(F.sha2(whole.cast("binary"), 256)).alias(name))

    def digest(texts: pa.Array) -> pa.Array:
        content = tokenizer.content()
        return pa.StructArray.from_arrays([pa.array([hashlib.sha256(content(t)).digest() for t in texts.to_pylist()], pa.binary())], [name])

    return scored(docs, keep, whole, digest, f"{name} binary")


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of the cache; a digest that two runs appended counts once. No rows where nothing is stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={version}")
    kind = "digest binary, n_tokens long"
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(path.toString()).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encoded(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(digest, n_tokens) of rows (digest, text): one per digest."""

    def count(batch: pa.Array) -> pa.Array:
        once = batch.dictionary_encode()
        n = pa.array(tokenizer.counter()(once.dictionary.to_pylist()), pa.int64())
        return pa.StructArray.from_arrays([n.take(once.indices)], ["n_tokens"])

    return scored(texts, ["digest"], F.col("text"), count, "n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: Tokenizer, cache: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: key, n_bytes (UTF-8) and n_tokens.

    ``cache`` is a folder that executors share; it gets the counts of all contents it lacked for
    this version of the tokenizer and library. Whole texts; null is empty, and an empty text has no
    tokens. Equal contents are encoded once, whatever their keys; null and repeated keys keep their
    rows. Further columns are ignored. Empty table: no rows, and nothing is appended.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    rows = save(digested(given, "text", tokenizer, ["key", "n_bytes"]).withColumn("salt", F.monotonically_increasing_id()), "tok-rows")
    kinds = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    kinds = save(kinds.join(stored(spark, cache, tokenizer.version), "digest", "left"), "tok-kinds")
    misses = kinds.where("n_tokens is null").select("digest", F.col("key").alias("_key"))
    fresh = None
    if misses.limit(1).count():
        # the row of the least key stands for its content: rows meet by both, so a content of many rows is no hot key
        whole = digested(given.withColumn("text", F.coalesce("text", F.lit(""))), "text", tokenizer, ["key", "text"])
        chosen = whole.join(misses, (whole["digest"] == misses["digest"]) & whole["key"].eqNullSafe(misses["_key"]), "left_semi")
        fresh = save(encoded(chosen.select("digest", "text"), tokenizer), "tok-fresh")
        fresh.write.mode("append").parquet(f"{cache}/tokenizer={tokenizer.version}")
    known = kinds.where("n_tokens is not null").select("digest", "n_tokens")
    found = save(known.union(fresh) if fresh is not None else known, "tok-found")
    crowd = kinds.where(F.col("n") > COPIES).select("digest", F.ceil(F.col("n") / COPIES).cast("int").alias("_parts"))
    crowd = save(crowd, "tok-crowd")
    out = salted(rows, found, "digest", crowd if crowd.limit(1).count() else None, F.col("salt"))
    discard(kinds, fresh)
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens")


def limit_report(docs: DataFrame, tokenizer: Tokenizer, cache: str | None = None, limit: int = 512) -> DataFrame:
    """``token_counts`` with over_limit (n_tokens > ``limit``). Without ``cache`` the counts are stored in a new folder, so every distinct content is encoded."""
    counts = token_counts(docs, tokenizer, cache or scratch(docs.sparkSession, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
