"""Near duplicates by fast similarity sketching.

A document's set of word shingles is sketched in rounds: each round throws
every shingle into a bin by a new hash, with a value that later rounds cannot
undercut, and a set leaves once all its bins hold a least value. After as many
rounds as bins, each further round fills one bin by itself, so every coordinate
of every set fills. Two sets agree in a coordinate with the chance of their
similarity, and in how many of them concentrates as for independent ones.

Coordinates are cut into bands; sets that share a band meet. With 32 bands of 4
coordinates a pair at the threshold of 85 percent misses all bands with a chance
of 6e-11, one of 50 percent meets with 87 percent. What meets is confirmed on
whole texts. Not all pairs are needed, only what links connect: a first round
takes each set with the first one of its band key, a second a few partners per
set, the last every pair that meets and is not connected yet. A band key of many
sets is cut into blocks by hash and every block meets every other, so no task
holds more than two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import broadcast_if, cut, exchange_width
from ._words import U, batches, claim, lists, longs, mix, shingle_sets
from .jaccard import MEETING, PARTNERS, Bitmaps, _cross, bitmap, components, dealt, verified

WORDS, PERCENT = 3, 85
SIZE, ROWS = 128, 4  # coordinates of a sketch, and of a band
KNOWN = 1 << 20  # sets of which a task remembers that it has sent their bands
ROWS_A_TASK = 1 << 17  # rows of band keys that a task crosses


def sketches(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """A row of `size` coordinates for each set of 64-bit hashes; of an empty set, all ones. `size` is a power of two up to 128."""
    counts = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.empty(0, U)])
    owner = np.repeat(np.arange(len(sets)), counts)
    out = np.full(len(sets) * size, ~U(0))
    for turn in range(2 * size):
        if not len(flat):
            break
        thrown = mix(flat ^ mix(np.array([turn + 1], U))[0])
        value = U(turn << 56) | thrown >> U(8)
        if turn < size:
            at = owner * size + (thrown & U(size - 1)).astype(np.int64)
        else:  # bins that are full already hold less
            at = owner * size + (turn - size)
        np.minimum.at(out, at, value)
        full = (out.reshape(-1, size) != ~U(0)).all(axis=1)
        if full.any():
            stays = ~full[owner]
            flat, owner = flat[stays], owner[stays]
    return out.reshape(-1, size)


def band_keys(found: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band of `rows` coordinates of each sketch."""
    bands = found.reshape(len(found), -1, rows)
    keys = np.broadcast_to(mix(np.arange(bands.shape[1], dtype=U) + U(1)), bands.shape[:2])
    for k in range(rows):
        keys = mix(keys * U(0xD6E8FEB86659FD93) + bands[:, :, k])
    return keys


def _sign(n: int, size: int, rows: int):
    """Per row the number of its shingles, two hashes of its set, and, once per set and task, its bitmap and band keys."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sketching")
        known: set[tuple[int, int]] = set()
        for batch in parts:
            for part, texts in batches(batch):
                sets = list(shingle_sets(texts, n))
                first = [int(np.sum(mix(s ^ U(0xA3B195354A39B70D)), dtype=U)) for s in sets]
                second = [int(np.sum(mix(s ^ U(0x1B03738712FAD5C9)), dtype=U)) for s in sets]
                if len(known) > KNOWN:
                    known.clear()
                new = [len(s) > 0 and not (k in known or known.add(k)) for s, k in zip(sets, zip(first, second, strict=True), strict=True)]
                shown = [s for s, go in zip(sets, new, strict=True) if go]
                keys = iter(band_keys(sketches(shown, size), rows)) if shown else iter(())
                part = part.drop_columns(["text"])
                columns = {
                    "n": pa.array([len(s) for s in sets], pa.int32()),
                    "set_a": pa.array(longs(np.array(first, U))),
                    "set_b": pa.array(longs(np.array(second, U))),
                    "bits": pa.array([bitmap(s) if go else None for s, go in zip(sets, new, strict=True)], pa.binary()),
                    "bands": lists([next(keys) if go else np.empty(0, U) for go in new]),
                }
                for name, values in columns.items():
                    part = part.append_column(name, values)
                yield part

    return run


def _may_link(percent: int):
    """Those of the pairs (a, b, n_a, n_b, bits_a, bits_b) that sizes and bitmaps do not rule out."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sketching")
        for batch in parts:
            a, b, n, m = (batch.column(k).to_numpy() for k in range(4))
            k = len(a)
            sizes = np.concatenate([n, m]).astype(np.int64)
            i, j = np.where(n <= m, np.arange(k), np.arange(k) + k), np.where(n <= m, np.arange(k) + k, np.arange(k))
            keep = percent * sizes[j] <= 100 * sizes[i]
            bits = Bitmaps(batch.column(4).to_pylist() + batch.column(5).to_pylist())
            keep[keep] = bits.near(sizes, i[keep], j[keep], percent)
            yield pa.record_batch({"a": pa.array(a[keep]), "b": pa.array(b[keep])})

    return run


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) once links (a, b) of nodes unite components."""
    over = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("comp_a")), "a").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("comp_b")), "b")
    merged = components(over.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
    found = labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left")
    return cut(found.select("node", F.coalesce("top", "comp").alias("comp")), "sketch-labels")


def sketch_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, size: int = SIZE, rows: int = ROWS, block: int = MEETING) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a set holds the distinct
    runs of `n` words, of a shorter text the whole sequence as one. Documents
    link when 100 * intersection >= percent * union; component_id is the least
    doc_id that links reach, kept whether it is the row's own. Equal sets are
    told by two 64-bit hashes, links between different ones by their words.
    Null or empty text, or white space alone, has no shingles and links with
    nothing: component_id is its own id. Rows with one doc_id but different
    texts are one document with several sets. Rows without an id link by text,
    but give components no name: null if no other does, and kept then. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = cut(keyed.mapInArrow(_sign(n, size, rows), "doc_id long, text_hash long, n int, set_a long, set_b long, bits binary, bands array<long>"), "sketch-signed")

    node_of = F.xxhash64("n", "set_a", "set_b")
    rep = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    classes = signed.where("n > 0").groupBy("n", "set_a", "set_b").agg(rep.alias("rep"), F.min("bits").alias("bits"), F.max("bands").alias("bands"))
    classes = cut(classes.select("n", "set_a", "set_b", "bits", "bands", F.col("rep.doc_id").alias("rep_doc"), F.col("rep.text_hash").alias("rep_text"), node_of.alias("node")), "sketch-classes")

    postings = classes.select("node", "n", F.explode("bands").alias("token"))
    tokens = postings.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("n", "node")).alias("head")).where("held > 1")
    tokens = cut(tokens.select("token", "held", "head.node", "head.n").withColumnsRenamed({"node": "head", "n": "head_n"}), "sketch-tokens")
    postings = cut(postings.join(tokens, "token"), "sketch-postings")

    stars = postings.where(f"node <> head AND {percent} * n <= 100 * head_n").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    stars = stars.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_may_link(percent), "a long, b long")
    ids = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(node_of).alias("a"), F.max(node_of).alias("b"), F.collect_set(node_of).alias("all")).where("a <> b")
    alike = ids.select("a", F.explode("all").alias("b")).where("a <> b")
    labels = classes.select("node", F.col("node").alias("comp"))
    labels = _relabelled(labels, verified(stars, classes, docs, n, percent).union(alike))

    # the pair of two sets that meet alone was in the first round
    postings = postings.where("held > 2").select("token", "node", "n")
    for partners in (PARTNERS, None):
        owned = postings.join(labels, "node")
        mixed = cut(owned.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token"), "sketch-mixed")
        postings = cut(postings.join(broadcast_if(mixed), "token", "left_semi"), "sketch-left")
        # partners are looked for under a quarter of the keys, which is enough for large groups to form
        asked = postings if partners is None else postings.where(F.pmod(F.xxhash64("token"), F.lit(4)) == 0)
        rows = asked.join(labels, "node").select("token", "node", "n", F.lit(0).alias("pos"), "comp")
        width = exchange_width(spark, postings.count(), ROWS_A_TASK)
        crossed = dealt(rows, classes, width, block, partners is None).mapInArrow(_cross(percent, partners), "a long, b long")
        labels = _relabelled(labels, verified(crossed, classes, docs, n, percent))

    final = classes.join(labels, "node").withColumnRenamed("comp", "top")
    names = final.groupBy("top").agg(F.min("rep_doc").alias("component_id"))
    named = final.join(names, "top").select("n", "set_a", "set_b", "component_id")
    out = signed.select("doc_id", "n", "set_a", "set_b").join(cut(named, "sketch-named"), ["n", "set_a", "set_b"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
