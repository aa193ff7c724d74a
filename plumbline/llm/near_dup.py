"""Near duplicates by an inverted join over signature coordinates.

Documents with equal shingle sets form one class. Every class has K minimum
hashes and is posted under each (coordinate, value). Two sets of similarity s
agree on about K * s coordinates, so a linked pair collides at least T times but
for a chance below 1e-5. Coordinates are ordered by how many classes share their
value: a pair with T collisions meets in the postings of all but the T - 1 most
frequent ones (the prefix), and values of one class need no posting at all. The
members of a posting compare the whole signature (the skipped rest) and give a
spanning forest of pairs with T collisions, not the pairs. The components of
those forests are candidate groups; inside them exact similarities of full sets
decide, in pairs of blocks, again leaving only a spanning forest of the links.

Postings and candidate groups of any size are cut into blocks, and each pair of
blocks is a group of its own, so a task holds two blocks whatever the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import (
    arrow_batches, components, hot_join, map_batches, map_groups, need, written,
)
from plumbline.llm.text import min_hashes, set_key, sets, words
from plumbline.plans.lookup import maybe_in
from plumbline.plans.workers import ship

ship(__name__)
COORDINATES = 48
MATCHES = 26
POSTING_BLOCK = 2048
SET_BLOCK = 192


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80,
                    coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document.

    Texts are linked when 100 * intersection >= ``percent`` * union of their distinct
    shingles. Null and empty texts have no shingles and are linked with nothing.
    Equal rows are one class; rows of one doc_id with different texts are linked
    only by their texts. Rows without doc_id link others like any row; such a row has
    component_id null and is kept only where no row of its component has an id.
    ``matches`` suits ``percent`` of at least 80; lower it with ``percent``. An empty
    table has no rows; columns other than doc_id and text take no part.
    """
    arrow_batches(docs.sparkSession)
    docs = need(docs, "doc_id", "text")
    profiles = written(map_batches(
        docs, lambda b: _profile(b, shingle_words, coordinates),
        "doc_id bigint, n_shingles bigint, node binary, signature binary"), "profiles")
    classes = written(
        profiles.where("n_shingles > 0").groupBy("node", "signature")
        .agg(F.min("doc_id").alias("smallest"), F.count("*").alias("copies")), "classes")
    groups = written(components(_candidates(classes, coordinates, matches)), "groups")
    links = written(_links(docs, classes, groups, shingle_words, percent), "exact_links")
    labels = components(links)
    named = classes.select("node", "smallest", "copies").join(labels, "node", "left")
    named = written(named.withColumn("label", F.coalesce("label", "node")), "named")
    least = written(named.groupBy("label").agg(F.min("smallest").alias("component_id"), F.count("*").alias("size")),
                    "components")
    table = written(hot_join(named, least, "label", "size").select("node", "copies", "component_id"), "table")
    out = hot_join(profiles.select("doc_id", "n_shingles",
                                   F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")),
                   table, "node", "copies")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _profile(batch: pa.RecordBatch, k: int, coordinates: int) -> dict:
    n, node, signature = [], [], []
    for w in words(batch.column("text")):
        parts = sets(w, k)
        n += [len(p) for p in parts]
        node += [set_key(p) for p in parts]
        signature += [row.tobytes() for row in min_hashes(parts, coordinates)]
    return {"doc_id": batch.column("doc_id"), "n_shingles": n, "node": node, "signature": signature}


def _candidates(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(a, b): spanning pairs of classes that agree on ``matches`` coordinates."""
    value = F.conv(F.hex(F.substring("signature", F.expr("4 * j + 1"), F.lit(4))), 16, 10)
    posts = classes.select("node", F.explode(F.sequence(F.lit(0), F.lit(coordinates - 1))).alias("j"),
                           "signature")
    posts = posts.select("node", (F.shiftleft(F.col("j").cast("bigint"), 32)
                                  + value.cast("bigint")).alias("post"))
    shared = posts.groupBy("post").agg(F.count("*").alias("size")).where("size > 1")
    own = (posts.join(shared, "post").groupBy("node")
           .agg(F.sort_array(F.collect_list(F.struct("size", "post"))).alias("own"))
           .where(F.size("own") >= matches))
    prefix = own.select("node", F.expr(f"slice(own, 1, size(own) - {matches - 1})").alias("prefix"))
    rows = (prefix.join(classes.select("node", "signature"), "node")
            .select("node", "signature", F.explode("prefix").alias("p"))
            .select("node", "signature", "p.post", F.expr(f"ceil(p.size / {POSTING_BLOCK})").alias("blocks")))
    return map_groups(_block_pairs(rows), ["post", "i", "j"], ["node"],
                      lambda key, t: _collisions(key, t, matches), "a binary, b binary").distinct()


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks that its own block is part of."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}
                            ).drop("other", "blocks")


def _collisions(key: tuple, rows: pa.Table, matches: int) -> Iterator[dict]:
    if rows.num_rows < 2:
        return
    node = rows.column("node").to_pylist()
    sig = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype=np.uint32)
    sig = sig.reshape(len(node), -1)
    block = rows.column("block").to_numpy()
    a, b = _forest(len(node), lambda x, rest: np.flatnonzero(
        ((sig[rest] == sig[x]).sum(axis=1) >= matches)
        & ((block[rest] != block[x]) | (key[1] == key[2]))))
    if a:
        yield {"a": [node[x] for x in a], "b": [node[x] for x in b]}


def _forest(n: int, near) -> tuple[list, list]:
    """Edges of a spanning forest; ``near(x, rest)`` gives places in ``rest`` near ``x``."""
    a, b, rest = [], [], np.arange(n)
    while len(rest):
        open_, rest = [int(rest[0])], rest[1:]
        while open_ and len(rest):
            x = open_.pop()
            hit = near(x, rest)
            if len(hit):
                found = rest[hit]
                a += [x] * len(found)
                b += found.tolist()
                open_ += found.tolist()
                rest = np.delete(rest, hit)
    return a, b


def _links(docs: DataFrame, classes: DataFrame, groups: DataFrame, k: int, percent: int) -> DataFrame:
    sizes = groups.groupBy("label").agg(F.count("*").alias("size"))
    members = written(hot_join(groups, written(sizes, "sizes"), "label", "size")
                      .join(classes.select("node", "smallest"), "node")
                      .select("node", "label", "smallest",
                              F.expr(f"ceil(size / {SET_BLOCK})").alias("blocks")), "members")
    # One row of a class is enough, that of its smallest id; rows without an id are all read,
    # since a class may have no others, and are combined before they are shuffled.
    ids = written(members.select(F.col("smallest").alias("doc_id")).where("doc_id is not null").distinct(), "member_ids")
    texts = maybe_in(docs, ids, "doc_id")[0].join(ids, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    full = map_batches(texts, lambda b: _full_sets(b, k), "node binary, shingles binary").dropDuplicates(["node"])
    rows = full.join(members.drop("smallest"), "node")
    return map_groups(
        _block_pairs(rows), ["label", "i", "j"], ["node"],
        lambda key, t: _exact(key, t, percent), "a binary, b binary").distinct()


def _full_sets(batch: pa.RecordBatch, k: int) -> dict:
    parts = [p for w in words(batch.column("text")) for p in sets(w, k)]
    return {"node": [set_key(p) for p in parts], "shingles": [p.tobytes() for p in parts]}


def _exact(key: tuple, rows: pa.Table, percent: int) -> Iterator[dict]:
    n = rows.num_rows
    if n < 2:
        return
    node = rows.column("node").to_pylist()
    parts = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in rows.column("shingles")]
    block = rows.column("block").to_numpy()
    size = np.array([len(p) for p in parts])
    common = _shared_counts(parts, n)

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        both = common[x, rest]
        ok = 100 * both >= percent * (size[x] + size[rest] - both)
        return np.flatnonzero(ok & ((block[rest] != block[x]) | (key[1] == key[2])))

    a, b = _forest(n, near)
    if a:
        yield {"a": [node[x] for x in a], "b": [node[x] for x in b]}


def _shared_counts(parts: list[np.ndarray], n: int, width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of slices of the incidence matrix."""
    flat = np.concatenate(parts)
    owner = np.repeat(np.arange(n), [len(p) for p in parts])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    code = np.cumsum(new) - 1
    keep = np.bincount(code)[code] > 1
    owner = owner[keep]
    code = np.unique(code[keep], return_inverse=True)[1]
    out = np.zeros((n, n), dtype=np.int64)
    lo = 0
    while lo < len(code):
        hi = int(np.searchsorted(code, code[lo] + width, "left"))
        slab = np.zeros((n, width), dtype=np.float32)
        slab[owner[lo:hi], code[lo:hi] - code[lo]] = 1
        out += (slab @ slab.T).astype(np.int64)
        lo = hi
    return out
