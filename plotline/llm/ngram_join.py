"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is folded into a parity sketch: each shingle falls into one block of
the sketch and flips the 64 bits of its hash there, so a block is the XOR of its shingles' hashes. A
shingle that only one of two sets has changes one block at most: the number of differing blocks bounds
the symmetric difference from below. Sets of Jaccard similarity J or more differ in at most
(a + b)(1 - J) / (1 + J) shingles, fewer than there are blocks, so by the pigeonhole principle some
blocks agree. Blocks are joined per size band; candidate pairs are verified on their whole sets.

Sets join in the band of the larger one; a set is sketched for its own band and, if partners may lie
beyond it, for the next. Equal sets are one class and only its representative is joined. Within a
block's group the pairs with the smallest member are verified first. What a group still holds of
different components is compared by a second parity sketch of 1024 bits, in tiles of bounded size: the
Hamming distance of two sketches bounds the sets' difference from below, so pairs beyond the largest
difference of linked sets are refused without their texts. Each member's nearest pair is verified, and
when these have merged components, all pairs that remain. So no link between classes is lost, and a
group of near copies is never expanded into all its pairs.

Up to ``MAX_BLOCKS`` blocks the pigeonhole argument is certain. Of larger sketches the first
``MAX_BLOCKS`` blocks are used, without empty ones: shingles fall into blocks by their hash, so a pair
at exactly J has each of them agree, not empty, with probability 0.44 or more, and none of 40 with
probability 1e-10 or less.

A block whose group is large separates little. A set may leave large groups only where the pigeonhole
argument still holds for the rest, so only by all blocks of its sketch: linked sets agree in more blocks
than a set may leave. A set of a cut sketch that meets a large group is therefore sketched again with all
blocks. If few of these groups are large, the set leaves the large ones of both sketches, since a partner
shares a small group with it; else it stays in all groups of its cut sketch. Two linked sets that agree
in large groups only are both sketched again, and meet in a small group or, both staying, in a large one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotline.llm._text import arrow_pass, as_bytes, list_of, mix64, shingle_set
from plotline.operators.checkpoints import checkpointed, in_few_files, written
from plotline.operators.components import connected_components

#: Similarity 0.8 as a ratio of whole numbers, so that the test is exact.
NUMERATOR, DENOMINATOR = 80, 100
BAND_RATIO = 1.25
MAX_BLOCKS = 40
#: Blocks that linked sets share at least.
LEAST_SHARED = 2
#: A group of more members is large.
LARGE_GROUP = 16
#: Pairs of one document whose texts are compared in one task, and ids that are broadcast to pick rows, at most.
SHARE = 256
BROADCAST_IDS = 1 << 19
#: ``blocks`` holds the keys of the set's sketches one after the other, ``cuts`` how many each has and ``spare`` how many it may do without, -1 where the sketch is cut.
SKETCH_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, blocks array<long>, cuts array<int>, spare array<int>, bits binary"
#: Bits of the sketch that bounds a pair's difference, and members of a group that are compared at once.
BITS = 1024
TILE = 1024
FULL_SCHEMA = "doc_id long, sketch int, spare int, blocks array<long>"


def band_limits(largest: int, ratio: float = BAND_RATIO) -> np.ndarray:
    """Upper size limits of the bands, inclusive, up to one that holds ``largest``."""
    limits = [3]
    while limits[-1] < largest:
        limits.append(max(limits[-1] + 1, int(limits[-1] * ratio)))
    return np.array(limits, np.int64)


LIMITS = band_limits(1 << 40)


def max_difference(a: int, b: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def bands_of(size: int) -> list[int]:
    """The bands that a set is sketched for: of its own size and of its largest partner."""
    own = int(np.searchsorted(LIMITS, size))
    far = int(np.searchsorted(LIMITS, size * DENOMINATOR // NUMERATOR))
    return [own] if own == far else list(range(own, far + 1))


def sketch(shingles: np.ndarray, band: int, most: int | None) -> tuple[np.ndarray, int]:
    """Block keys of a set for a band, and how many more blocks it may do without.

    A sketch of more than ``most`` blocks is cut to these, and none may go; with None it stays whole.
    """
    differing = max_difference(int(LIMITS[band]), int(LIMITS[band]))
    blocks = differing + 1 + max(3, differing // 4)
    used = min(blocks, most or blocks)
    spare = blocks - differing - LEAST_SHARED
    place = ((shingles >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    kept = place < used
    sums = np.zeros(used, np.uint64)
    np.bitwise_xor.at(sums, place[kept], mix64(shingles[kept]))
    empty = np.bincount(place[kept], minlength=used) == 0
    salt = np.uint64((2 * band + (most is None)) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    keys = mix64(sums + salt + np.arange(used, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if used < blocks:
        return keys[~empty], -1
    # All empty blocks go, or none: a partner that keeps its own would meet nobody in them.
    return (keys[~empty], spare - int(empty.sum())) if empty.sum() <= spare else (keys, spare)


def sketched_bands(size: int) -> list[int]:
    """The bands of a set in which linked sets may differ; equal sets need no sketch."""
    return [b for b in bands_of(size) if max_difference(int(LIMITS[b]), int(LIMITS[b]))] if size else []


def parity_bits(shingles: np.ndarray) -> bytes:
    """The parity sketch of a set: each shingle flips one of ``BITS`` bits."""
    counts = np.bincount((shingles & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _sketches(batch: pa.RecordBatch, most: int) -> pa.RecordBatch:
    sizes, first, second, keys, spares, cuts, bits = [], [], [], [], [], [], []
    for text in batch.column(1).to_pylist():
        shingles = shingle_set(text)
        sizes.append(len(shingles))
        bits.append(parity_bits(shingles))
        first.append(int(np.bitwise_xor.reduce(mix64(shingles))) if len(shingles) else 0)
        second.append(int(np.sum(mix64(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)) if len(shingles) else 0)
        own_keys, own_spare = [np.empty(0, np.uint64)], []
        for band in sketched_bands(len(shingles)):
            found, spare = sketch(shingles, band, most)
            own_spare.append(spare)
            own_keys.append(found)
        keys.append(np.concatenate(own_keys).view(np.int64))
        cuts.append(np.array([len(k) for k in own_keys[1:]], np.int32))
        spares.append(np.array(own_spare, np.int32))
    signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
    return pa.record_batch(
        [batch.column(0), pa.array(sizes, pa.int64()), signed(first), signed(second), list_of(keys, pa.int64()), list_of(cuts, pa.int32()), list_of(spares, pa.int32()), pa.array(bits, pa.binary())],
        names=["doc_id", "n_shingles", "set_a", "set_b", "blocks", "cuts", "spare", "bits"],
    )


def _full_sketches(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Whole sketches of the sets of packed texts, for the numbers of the sketches that are wanted."""
    unpack = zstandard.ZstdDecompressor().decompress
    ids, numbers, spares, keys = [], [], [], []
    for doc_id, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        shingles = shingle_set(unpack(text))
        bands = sketched_bands(len(shingles))
        for number in wanted:
            found, spare = sketch(shingles, bands[number], None)
            ids.append(doc_id)
            numbers.append(number)
            spares.append(spare)
            keys.append(found.view(np.int64))
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(spares, pa.int32()), list_of(keys, pa.int64())], names=["doc_id", "sketch", "spare", "blocks"])


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts compressed, as they travel to their partners."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.record_batch([batch.column(0), pa.array([pack(t or b"") for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "text"])


def _similar(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows ``src, dst, left, right`` whose texts are similar enough, by their whole sets."""
    unpack = zstandard.ZstdDecompressor().decompress
    kept, left_text, left = [], None, None
    for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
        if a != left_text:
            left_text, left = a, shingle_set(unpack(a))
        right = shingle_set(unpack(b))
        shared = len(np.intersect1d(left, right, assume_unique=True))
        kept.append(shared * (DENOMINATOR + NUMERATOR) >= NUMERATOR * (len(left) + len(right)))
    return batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))


def _few(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast if there are few, so that what they pick from needs no shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``src, dst`` that are linked; those of one ``src`` are dealt over several tasks."""
    ids = pairs.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct()
    texts = texts.join(_few(ids), "doc_id", "left_semi")
    srcs = pairs.groupBy("src").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("parts"))
    left = texts.select(F.col("doc_id").alias("src"), F.col("text").alias("left")).join(srcs, "src")
    left = left.select("src", "left", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = texts.select(F.col("doc_id").alias("dst"), F.col("text").alias("right"))
    hot = srcs.where("parts > 1")
    dealt = pairs.join(hot, "src", "left").select("src", "dst", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    joined = dealt.join(right, "dst").join(left, ["src", "part"]).select("src", "dst", "left", "right")
    return arrow_pass(joined, _similar, "src long, dst long")


def _near(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The distinct pairs ``src, dst`` (with sizes ``m, n``) whose parity sketches allow a link."""
    side = lambda name: bits.select(F.col("doc_id").alias(name), F.col("bits").alias(f"{name}_bits"))
    joined = pairs.distinct().join(side("dst"), "dst").join(side("src"), "src").select("src", "dst", "m", "n", "src_bits", "dst_bits")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (4, 5))
        m, n = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
        distance = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        return batch.select([0, 1]).filter(pa.array(distance <= (m + n) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)))

    return arrow_pass(joined, run, "src long, dst long")


def close_pairs(ids: np.ndarray, sizes: np.ndarray, parts: np.ndarray, bits: np.ndarray, tiles: np.ndarray, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group and two of its tiles that may be linked, of different components.

    ``tiles`` tells for each member whether it is of the first tile; in a tile with itself all are. With
    ``nearest`` each member has only its pair of the smallest distance.
    """
    left = np.flatnonzero(tiles)
    right = np.flatnonzero(~tiles) if not tiles.all() else left
    if not len(left) or not len(right) or (parts == parts[0]).all():
        return ids[:0], ids[:0]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(left), 128):
        own = left[at : at + 128]
        a, b = sizes[own][:, None], sizes[right][None, :]
        limit = (a + b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
        distance = np.bitwise_count(bits[own][:, None, :] ^ bits[right][None, :, :]).sum(axis=2, dtype=np.int64)
        fits = (distance <= limit) & (np.minimum(a, b) * DENOMINATOR >= np.maximum(a, b) * NUMERATOR) & (parts[own][:, None] != parts[right][None, :])
        i, j = np.nonzero(fits)
        found.append((own[i], right[j], distance[i, j]))
    i, j, distance = (np.concatenate(x) for x in zip(*found, strict=True))
    if nearest and len(i):
        order = np.lexsort((ids[j], distance, i))
        of_left = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        order = np.lexsort((ids[i], distance, j))
        of_right = order[np.flatnonzero(np.diff(j[order], prepend=-1))]
        chosen = np.unique(np.concatenate([of_left, of_right]))
        i, j = i[chosen], j[chosen]
    return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])


def _compared(members: DataFrame, nearest: bool) -> DataFrame:
    """Pairs ``src, dst`` of ``members`` (key, doc_id, n, component, bits, members) that may be linked.

    A group is dealt into tiles by a hash of its members and each pair of tiles is compared in one place;
    rows stream in sorted order, so a task holds two tiles at most.
    """
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    dealt = members.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    placed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "doc_id", "n", "component", "bits"
    )
    ordered = placed.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "doc_id")

    def compare(keys, tiles, ids, sizes, parts, bits):
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            if b - a > 1:
                yield close_pairs(ids[a:b], sizes[a:b], parts[a:b], bits[a:b], tiles[a:b] == keys[a, 1], nearest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in chain(batches, [None]):
            if batch is not None:
                column = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                bits = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("bits")).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
                new = [np.stack([column("key"), column("low"), column("high")], axis=1), column("tile"), column("doc_id"), column("n").astype(np.int64), column("component"), bits]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
                # The last group may go on in the next batch.
                end = int(np.flatnonzero((held[0] == held[0][-1]).all(axis=1))[0])
            elif held is not None:
                end = len(held[0])
            else:
                return
            pairs = list(compare(*[x[:end] for x in held])) if end else []
            held = [x[end:] for x in held]
            if pairs:
                src, dst = (np.concatenate(x) for x in zip(*pairs, strict=True))
                yield pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return ordered.mapInArrow(run, "src long, dst long").distinct()


def _kept(df: DataFrame) -> DataFrame:
    """A checkpoint of keys and ids."""
    return checkpointed(in_few_files(df))


def _written_few(df: DataFrame) -> DataFrame:
    return written(in_few_files(df))


def similar_groups(df: DataFrame, id_col: str, text_col: str, max_blocks: int | None = MAX_BLOCKS, large_group: int = LARGE_GROUP) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id``: one row per row of ``df``.

    Two documents link when 100 * shared >= 80 * united distinct shingles of five words (``_text``); a
    shorter text is one shingle; a null, empty or blank text has none and is linked with nothing.
    ``class_id`` is the smallest id with an equal set, ``component_id`` the smallest id reachable by
    links, itself included. Rows that repeat an id are one node, linked where any of
    them is. A row without an id takes no
    part: its class and component are null. An empty table gives an empty result. Other columns are
    ignored. With ``max_blocks`` None all sketches are whole, and no link is missed with certainty; a set of n shingles
    then has 0.28 n blocks or so, in each of its bands, where it has 40 at most otherwise.
    """
    texts = as_bytes(df, id_col, text_col)
    sketches = checkpointed(arrow_pass(texts, partial(_sketches, most=max_blocks), SKETCH_SCHEMA))
    usable = sketches.where("doc_id is not null and n_shingles > 0")
    classes = usable.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("class_id"))
    member = ["n_shingles", "set_a", "set_b"]
    leaders = usable.join(classes.select("class_id"), F.col("doc_id") == F.col("class_id"), "left_semi")

    keyed = leaders.select("doc_id", "cuts", F.posexplode("blocks").alias("at", "key")).select(
        "key", "doc_id", F.when(F.col("at") >= F.get("cuts", F.lit(0)), 1).otherwise(0).alias("sketch")
    )
    # Written first, so that Spark deals out both sides of the join and can split a large group.
    shared = _kept(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    bounds = leaders.select("doc_id", F.col("n_shingles").cast("int").alias("n"), F.posexplode("spare").alias("sketch", "spare"))
    own = Window.partitionBy("doc_id", "sketch")
    placed = _kept(
        keyed.join(shared.select("key", (F.col("members") > large_group).alias("large")), "key").withColumn("met", F.count(F.when(F.col("large"), 1)).over(own))
        .join(bounds, ["doc_id", "sketch"]).select(
            "key", "doc_id", "sketch", "n", "large", ((F.col("spare") < 0) & (F.col("met") > 0)).alias("crowded"), ((F.col("spare") >= 0) & (F.col("met") > F.col("spare"))).alias("remains")
        )
    )
    wanted = _few(placed.select("doc_id").distinct())
    needed = checkpointed(arrow_pass(texts, _packed, "doc_id long, text binary").join(wanted, "doc_id", "left_semi"))
    bits = _kept(leaders.join(wanted, "doc_id", "left_semi").select("doc_id", "bits"))

    # Sets of cut sketches that meet a large group are sketched again, with all blocks.
    crowded = placed.where("crowded").select("doc_id", "n", "sketch").distinct()
    again = needed.join(_few(crowded.groupBy("doc_id").agg(F.sort_array(F.collect_set("sketch")).alias("wanted"))), "doc_id").select("doc_id", "text", "wanted")
    full = _kept(arrow_pass(again, _full_sketches, FULL_SCHEMA))
    full_keyed = full.select("doc_id", "sketch", F.explode("blocks").alias("key"))
    full_shared = _kept(full_keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    small = full_keyed.join(full_shared.where(F.col("members") <= large_group), "key")
    large = full_keyed.join(full_shared.where(F.col("members") > large_group), "key").groupBy("doc_id", "sketch").agg(F.count("*").alias("full_large"))
    stays = full.select("doc_id", "sketch", "spare").join(large, ["doc_id", "sketch"]).where("full_large > spare").select("doc_id", "sketch", F.lit(True).alias("stays"))
    kept = _kept(
        placed.join(stays, ["doc_id", "sketch"], "left").where(~F.col("large") | F.col("remains") | F.coalesce("stays", F.lit(False))).select("key", "doc_id", "n")
        .unionByName(small.join(crowded, ["doc_id", "sketch"]).select("key", "doc_id", "n"))
    )
    # The sizes of linked sets alone bound their similarity: the smaller has 0.8 of the larger or more.
    sizes_fit = F.least("n", "m") * DENOMINATOR >= F.greatest("n", "m") * NUMERATOR
    centres = _kept(
        kept.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("c"), F.count("*").alias("members")).where("members > 1")
    )
    pairs = kept.join(centres.select("key", F.col("c.doc_id").alias("src"), F.col("c.n").alias("m")), "key").where((F.col("doc_id") != F.col("src")) & sizes_fit)
    near = _kept(_near(pairs.select("src", F.col("doc_id").alias("dst"), "m", "n"), bits))
    links = _kept(_verified(near, needed))
    parts = connected_components(links, cut=_written_few)

    done = near
    for nearest in (True, False):
        # What a group still holds of different components.
        members = _kept(
            kept.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
        )
        open_keys = _kept(
            members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
            .where("low <> high").select("key", "members")
        )
        rest = _kept(_compared(members.join(open_keys, "key").join(bits, "doc_id"), nearest).join(done, ["src", "dst"], "left_anti"))
        found = _kept(_verified(rest, needed))
        done = done.unionByName(rest)
        parts = connected_components(parts.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(found), cut=_written_few)
    named = classes.join(parts.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        *member, "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    full = sketches.where("doc_id is not null and n_shingles > 0").select("doc_id", *member).join(named, member)
    bare = sketches.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n_shingles", "class_id", "component_id").unionByName(bare)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies among all ``documents``."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
