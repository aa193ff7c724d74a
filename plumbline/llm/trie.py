"""Prefix trie of conversations by a splitter skeleton.

A conversation is a path: 16 bytes per turn, the MD5 of its role and text. In the order
of paths the members of a trie node are neighbours, and the trie is the walk along that
order. Splitters taken from a sample cut it into shards of about equal size. The
prefixes of the splitters are the skeleton, a small trie that every task gets: only its
nodes can have members in several shards. Each shard is sorted and walked with a stack
as deep as one conversation; nodes off the skeleton are finished there, nodes on it
leave partial sums, which are added up per node and then from the bottom of the
skeleton to its root.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import _arrow, _ddl, _emit, _runs, arrow_batches, map_batches, need, written
from plumbline.llm.mixing import word_count
from plumbline.plans.workers import ship

ship(__name__)
TURN = 16
FAMILY, MOST_HEAD = 20, 3
# The skeleton has at most MAX_SPLITTERS * (SPLITTER_TURNS + 1) nodes, whatever the table.
MAX_SPLITTERS, SPLITTER_TURNS = 16384, 32
SHARD_PATHS = 50_000
PIECE_IDS = 65536
PATHS = "conv_id bigint, path binary, words binary"
NODES = ("skeleton int, above int, key string, depth bigint, conv_id bigint, parent_conv_id bigint, "
         "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint")
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
           "ends_sha256")


def prefix_trie(turns: DataFrame, family: int = FAMILY, shard_paths: int = SHARD_PATHS,
                max_splitters: int = MAX_SPLITTERS) -> DataFrame:
    """One row per trie node of the rebuilt conversations; see COLUMNS.

    Turns come in the order of ``turn``, null first, equal ones by the MD5 of role and
    text; null role or text is empty, rows without conv_id take no part, repeated rows
    are repeated turns. A conversation gets the first crc32(id) % 4 turns of the first of
    its ``family``, then its own after as many. One without any turn left ends at the
    root. An empty table has no nodes, and other columns take no part. A conversation is
    one row of 24 bytes per turn, which bounds it to about 80 million turns.
    """
    spark = arrow_batches(turns.sparkSession)
    paths = written(rebuilt(turns, family), "paths")
    distinct = written(paths.groupBy("path", "words").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "distinct_paths")
    count = distinct.count()
    shards = min(max_splitters + 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // shard_paths))
    cuts = splitters(distinct, shards)
    tree = skeleton(cuts)
    rows = written(_shards(distinct, spark.sparkContext.broadcast((cuts, {p: i for p, i, *_ in tree})),
                           len(cuts) + 1), "trie_nodes")
    top = written(_reduced(spark, rows.where("skeleton is not null"), tree), "trie_skeleton")
    above = top.select(F.col("skeleton").alias("above"), F.col("conv_id").alias("above_conv"))
    rest = rows.where("skeleton is null").join(F.broadcast(above), "above", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "above_conv"))
    nodes = rest.select("key", *COLUMNS[:-1]).unionByName(top.select("key", *COLUMNS[:-1]))
    ends = nodes.join(_ends(paths), "key", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return ends.select(*COLUMNS)


def rebuilt(turns: DataFrame, family: int = FAMILY) -> DataFrame:
    """(conv_id, path, words): every conversation behind the head of its family's first."""
    role, text = (F.coalesce(n, F.lit("")) for n in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    base = F.col("conv_id") - F.col("conv_id") % family
    narrow = need(turns, "conv_id", "turn", "role", "text").where("conv_id is not null").select(
        base.alias("base"), (F.col("conv_id") != base).alias("later"), "conv_id", "turn",
        F.unhex(F.md5(told)).alias("digest"), word_count("text").alias("words"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)).alias("head"))
    out = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in _ddl(PATHS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first of a family comes before the others; of it only the head is held."""
        family_, head, at, path, words = None, (b"", b""), None, bytearray(), bytearray()

        def done() -> dict:
            nonlocal head
            if not at[1]:
                head = bytes(path[:MOST_HEAD * TURN]), bytes(words[:MOST_HEAD * 8])
            n = at[3]
            return {"conv_id": [at[2]], "path": [head[0][:n * TURN] + path[n * TURN:]],
                    "words": [head[1][:n * 8] + words[n * 8:]]}

        for b in batches:
            if not b.num_rows:
                continue
            names = ("base", "later", "conv_id", "head")
            keys = [b.column(b.schema.get_field_index(n)) for n in names]
            ready = []
            for lo, hi in _runs([keys[2]], b.num_rows):
                key = tuple(k[lo].as_py() for k in keys)
                if key != at:
                    if at is not None:
                        ready.append(done())
                    if key[0] != family_:
                        family_, head = key[0], (b"", b"")
                    at, path, words = key, bytearray(), bytearray()
                path += b"".join(b.column("digest").slice(lo, hi - lo).to_pylist())
                words += b.column("words").slice(lo, hi - lo).to_numpy().tobytes()
            if ready:
                yield from _emit([{n: [v for r in ready for v in r[n]] for n in out.names}], out)
        if at is not None:
            yield from _emit([done()], out)

    order = ["base", "later", "conv_id", F.col("turn").asc_nulls_first(), "digest"]
    return narrow.repartition("base").sortWithinPartitions(*order).mapInArrow(run, PATHS)


def splitters(distinct: DataFrame, shards: int) -> list[bytes]:
    """At most ``shards`` - 1 increasing paths, cut to SPLITTER_TURNS, at even steps of a
    sample of four per shard. They decide how even the shards are, no result."""
    sample = distinct.select(F.substring("path", 1, TURN * SPLITTER_TURNS).alias("p"), F.xxhash64("path").alias("h"))
    held = sorted({bytes(r.p) for r in sample.orderBy("h").limit(4 * shards).collect()})
    return [held[i * len(held) // shards] for i in range(1, shards) if i * len(held) // shards > (i - 1) * len(held) // shards]


def skeleton(cuts: list[bytes]) -> list[tuple[bytes, int, int | None, list[int]]]:
    """(prefix, id, parent's id, ids up to the root) of all prefixes of the splitters."""
    known: dict[bytes, tuple] = {b"": (b"", 0, None, [0])}
    for c in cuts:
        for d in range(1, len(c) // TURN + 1):
            if (p := c[:d * TURN]) not in known:
                up = known[p[:-TURN]]
                known[p] = (p, len(known), up[1], [len(known), *up[3]])
    return list(known.values())


def _shards(distinct: DataFrame, shared: Broadcast, shards: int) -> DataFrame:
    def place(batch: pa.RecordBatch) -> dict:
        cuts = shared.value[0]
        return {"shard": [bisect_right(cuts, p) for p in batch.column("path").to_pylist()],
                **{n: batch.column(n) for n in ("path", "words", "n", "conv_id")}}

    schema = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in _ddl(NODES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, walk = None, None
        for b in batches:
            for lo, hi in _runs([b.column("shard")], b.num_rows) if b.num_rows else ():
                shard = b.column("shard")[lo].as_py()
                if shard != at:
                    if walk:
                        yield from _emit([walk.close()], schema)
                    at, walk = shard, Walk(shared.value[1], f"{shard}-")
                part = b.slice(lo, hi - lo).to_pydict()
                for p, w, n, c in zip(*(part[k] for k in ("path", "words", "n", "conv_id")), strict=True):
                    walk.add(p, memoryview(w).cast("q"), n, c)
                yield from _emit([walk.take()], schema)
        if walk:
            yield from _emit([walk.close()], schema)

    placed = map_batches(distinct, place, "shard int, path binary, words binary, n bigint, conv_id bigint")
    return (placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path")
            .mapInArrow(run, NODES))


class Walk:
    """The trie of paths that come in order; holds the path from the root and, below nodes
    off the skeleton, the children that wait for their parent's smallest member."""

    def __init__(self, on_skeleton: dict[bytes, int], name: str):
        self.known, self.name, self.seq = on_skeleton, name, 0
        self.path, self.stack, self.out = b"", [], []

    def add(self, path: bytes, words: memoryview, n: int, conv: int) -> None:
        if not self.stack:
            self._push(0, self.known[b""])
        same = 0
        for same in range(0, min(len(path), len(self.path)) + 1, TURN):
            if path[same:same + TURN] != self.path[same:same + TURN]:
                break
        while len(self.stack) > same // TURN + 1:
            self._pop()
        for d in range(len(self.stack), len(path) // TURN + 1):
            up = self.stack[-1]["skeleton"]
            self._push(words[d - 1], None if up is None else self.known.get(path[:d * TURN]))
        top = self.stack[-1]
        top["n"] += n
        top["conv"] = conv if top["conv"] is None else min(top["conv"], conv)
        top["key"] = hashlib.md5(path).hexdigest()
        self.path = path

    def _push(self, words: int, skeleton: int | None) -> None:
        self.stack.append({"words": words, "skeleton": skeleton, "n": 0, "conv": None, "children": 0,
                           "leaves": 0, "saved": 0, "key": None, "waiting": []})

    def _pop(self) -> None:
        v = self.stack.pop()
        depth, up = len(self.stack), self.stack[-1] if self.stack else None
        off = v["skeleton"] is None
        if off:
            v["leaves"] = v["leaves"] or 1
            v["saved"] += (v["n"] - 1) * v["words"]
        self.seq += 1
        key = v["key"] or (f"{self.name}{self.seq}" if off
                           else hashlib.md5(self.path[:depth * TURN]).hexdigest())
        row = [v["skeleton"], None, key, depth, v["conv"], None, v["n"], v["children"], v["leaves"],
               v["saved"], v["words"]]
        for w in v["waiting"]:
            w[5] = v["conv"]
        self.out += v["waiting"]
        if off and up["skeleton"] is None:
            up["waiting"].append(row)
        else:
            row[1] = up["skeleton"] if off else None
            self.out.append(row)
        if up:
            up["n"] += v["n"]
            up["conv"] = v["conv"] if up["conv"] is None else min(up["conv"], v["conv"])
            up["children"] += off
            up["leaves"] += v["leaves"]
            up["saved"] += v["saved"]

    def take(self) -> dict:
        rows, self.out = self.out, []
        names = [f.split()[0] for f in NODES.split(", ")]
        return dict(zip(names, zip(*rows, strict=True) if rows else [()] * len(names), strict=True))

    def close(self) -> dict:
        while self.stack:
            self._pop()
        return self.take()


def _reduced(spark: SparkSession, partial: DataFrame, tree: list[tuple]) -> DataFrame:
    """Skeleton nodes that have members, with the sums of all shards and of the skeleton
    below them; everything here is as small as the skeleton."""
    known = spark.createDataFrame([t[1:] for t in tree], "skeleton int, up int, line array<int>")
    part = partial.groupBy("skeleton").agg(
        F.min("key").alias("key"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.max("words").alias("words"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    part = written(part.join(F.broadcast(known), "skeleton"), "skeleton_parts")
    below = part.groupBy(F.col("up").alias("skeleton")).agg(F.count("*").alias("more")).where("skeleton is not null")
    own = part.join(F.broadcast(below), "skeleton", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    sums = own.select(F.explode("line").alias("skeleton"), (F.col("n_children") == 0).cast("bigint").alias("leaf"),
                      ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sums = sums.groupBy("skeleton").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    parents = part.select(F.col("skeleton").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    return (own.join(F.broadcast(sums), "skeleton").join(F.broadcast(parents), "up", "left")
            .withColumns({"n_leaves": F.col("n_leaves") + F.col("leaf"),
                          "saved_tokens": F.col("saved_tokens") + F.col("saved")})
            .select("skeleton", "key", *COLUMNS[:-1]))


def _ends(paths: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of the ids of all conversations with one path.

    Ranges of (path, id) are joined to pieces of PIECE_IDS ids each by many tasks; one
    task then streams the pieces of a path, which only it can do in order.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("first", pa.int64()), ("piece", pa.string())])
        at, ids, out = None, [], []
        for b in batches:
            for lo, hi in _runs([b.column("key")], b.num_rows) if b.num_rows else ():
                key = b.column("key")[lo].as_py()
                if ids and (key != at or len(ids) >= PIECE_IDS):
                    out.append((at, ids[0], ",".join(map(str, ids))))
                    ids = []
                at = key
                ids += b.column("conv_id").slice(lo, hi - lo).to_pylist()
            if len(out) > 1000:
                yield from _emit([dict(zip(schema.names, zip(*out, strict=True), strict=True))], schema)
                out = []
        if ids:
            out.append((at, ids[0], ",".join(map(str, ids))))
            yield from _emit([dict(zip(schema.names, zip(*out, strict=True), strict=True))], schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("ends_sha256", pa.string())])
        at, state = None, None
        for b in batches:
            out = []
            for key, piece in zip(b.column("key").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if key != at:
                    if state:
                        out.append((at, state.hexdigest()))
                    at, state = key, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if out:
                yield from _emit([dict(zip(schema.names, zip(*out, strict=True), strict=True))], schema)
        if state:
            yield from _emit([{"key": [at], "ends_sha256": [state.hexdigest()]}], schema)

    ids = paths.select(F.md5("path").alias("key"), "conv_id")
    cut = ids.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(
        pieces, "key string, first bigint, piece string")
    return cut.repartition("key").sortWithinPartitions("key", "first").mapInArrow(
        digests, "key string, ends_sha256 string")
