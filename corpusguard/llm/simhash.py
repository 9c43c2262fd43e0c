"""SimHash near-duplicate classes by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusguard.llm.graph import connected_components
from corpusguard.llm.runtime import broadcast_if_small, map_texts, stored, text_or_empty

#: Seed of the shingle hashes.
SEED = 42
#: Bits of a segment that are flipped where a pair may differ by more than 4 bits.
UNCERTAIN = 8
#: Bits of each of the two segments of a fingerprint.
HALF = 32
#: Buckets with more fingerprints than this are linked through midpoints (one lane, radius 4) or compared as a stream.
COMPARED = 2048


def fingerprint(text: bytes, shingle: int, lanes: int = 1) -> tuple[list[int], list[int]]:
    """The SimHash of a text, 64 bits a lane: majority of the bits of XXH64 over word shingles; and its uncertain bits.

    A-Z are lower-cased, words are runs without ASCII white space, shingles count as
    often as they occur, and a text with fewer words is one shingle. No words: zero.
    The first lane takes the hashes as they are, each further one a fixed mixing of them.
    For each segment of 32 bits the second list holds the ``UNCERTAIN`` bits with the
    narrowest majorities, five bits for each.
    """
    words = text.lower().split()
    if not words:
        return [0] * lanes, [sum(i << 5 * i for i in range(UNCERTAIN))] * 2 * lanes
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return _majorities(np.array([hashed(joined, SEED)], dtype="<u8"), lanes)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    stops = (ends - 1)[shingle - 1 :].tolist()
    return _majorities(np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8"), lanes)


def _majorities(hashes: np.ndarray, lanes: int) -> tuple[list[int], list[int]]:
    found, uncertain = [], []
    for lane in range(lanes):
        if lane:
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes ^= hashes >> np.uint64(32)
        votes = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 8192):
            part = hashes[at : at + 8192]
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        found.append(int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0]))
        order = np.argsort(np.abs(votes * 2 - len(hashes)).reshape(2, HALF), axis=1, kind="stable")[:, :UNCERTAIN]
        uncertain += (order << 5 * np.arange(UNCERTAIN)).sum(1).tolist()
    return found, uncertain


def lane_names(lanes: int) -> list[str]:
    return ["fp", *(f"fp{i}" for i in range(1, lanes))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, lanes: int = 1) -> DataFrame:
    """``id_col``, ``fp`` (64 bits as a long; further lanes ``fp1``, ...) and ``uncertain`` bits for every row; texts stay in their tasks."""

    def start():
        def compute(texts):
            found = [fingerprint(t, shingle, lanes) for t in texts]
            return [*zip(*([_signed(x) for x in fps] for fps, _ in found)), [bits for _, bits in found]]

        return compute

    results = dict.fromkeys(lane_names(lanes), pa.int64()) | {"uncertain": pa.list_(pa.int64())}
    found = map_texts(docs, id_col, text_or_empty(text_col).cast("binary"), results, start)
    return found if lanes > 1 else found.drop("uncertain")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _flipped(value: Column, width: int, flips: int) -> Column:
    """The values within ``flips`` (at most 2) bits of ``value``: an array of keys."""
    masks = [0] + [1 << i for i in range(width)]
    if flips == 2:
        masks += [(1 << i) | (1 << j) for i in range(width) for j in range(i)]
    ball = F.array(*[F.lit(m).cast("long") for m in masks])
    return F.transform(ball, lambda m: value.bitwiseXOR(m))


def _segment(fp: Column, which: int) -> Column:
    return F.shiftrightunsigned(fp, HALF) if which else fp.bitwiseAND(F.lit((1 << HALF) - 1))


def node_name(lanes: int) -> Column:
    """The long that names a node: its fingerprint, or a hash of all lanes where there are several."""
    return F.col("fp") if lanes == 1 else F.xxhash64(*lane_names(lanes))


def ball_masks(uncertain: np.ndarray | None) -> np.ndarray:
    """What to flip in a segment: nothing or any one bit; or up to two of its uncertain bits, a row for each segment."""
    if uncertain is None:
        return np.concatenate([[0], 1 << np.arange(HALF, dtype=np.int64)])[None]
    bits = 1 << (uncertain[:, None] >> 5 * np.arange(UNCERTAIN) & (HALF - 1))
    i, j = np.triu_indices(UNCERTAIN, 1)
    return np.hstack([np.zeros((len(bits), 1), np.int64), bits, bits[:, i] | bits[:, j]])


def forest(rows: np.ndarray, radius: int) -> np.ndarray:
    """Edges that connect what pairs of nodes within ``radius`` bits connect: the lanes of one end, then those of the other.

    A row is a node: its order, then its lanes. Every node of a component is tied to the
    one that is first by order and lanes, so that the many buckets which the members of a
    large group share say the same.
    """
    left, edges = np.unique(rows, axis=0)[:, 1:], []
    while len(left):
        root, reached, left = left[0], [left[0]], left[1:]
        while reached and len(left):
            node = reached.pop()
            near = np.bitwise_count(np.bitwise_xor(left, node).view(np.uint64)).sum(1) <= radius
            if near.any():
                met = left[near]
                edges.append(np.hstack([met, np.broadcast_to(root, met.shape)]))
                reached += list(met)
                left = left[~near]
    return np.concatenate(edges) if edges else np.zeros((0, 2 * (rows.shape[1] - 1)), np.int64)


def links(distinct: DataFrame, radius: int = 4, lanes: int = 1) -> DataFrame:
    """Edges ``(a, b)`` over the distinct fingerprints ``fp`` that connect all pairs within 4 bits.

    Two fingerprints within 4 bits are within 2 bits in one of their 32-bit segments.
    Each fingerprint therefore enters, for each segment, the table under every value of
    the Hamming ball of radius 1 around that segment: two balls of radius 1 meet just
    where the segments are within 2 bits. Rows per fingerprint are fixed (66), and a
    64-bit space split at 32 bits keeps chance meetings rare at any size.

    In buckets of up to 2,048 fingerprints the complete distances are verified, and one
    edge for each fingerprint that has a pair within ``radius`` is all that leaves the task.
    With one lane and a radius of 4 the links are exact, and a larger bucket is never
    compared pair by pair: its members enter a second table under every value near their
    other segment, within what the bucket leaves of the 4 bits, and members that meet
    there are within 4 bits by the triangle inequality; one star for each meeting value
    keeps the classes exact while its rows stay in proportion to the members.

    With several lanes, which a larger radius needs, the ball around a segment has radius
    2 and is taken over its eight most ``uncertain`` bits (37 values): two alike texts
    differ where their majorities are narrow. The complete distance is that over all
    lanes. No guarantee holds there; texts of a similarity of 0.8 meet in one of the eight
    segments of four lanes with a probability of 0.96, of 0.9 with 0.9999. The complete
    distances decide in buckets of every size; a large one reaches its task as a sorted
    stream and takes 8 bytes a lane for each member. Ends of edges are named by :func:`node_name`.
    """
    if radius < 4:
        raise ValueError("the tables are laid out for a radius of 4 or more")
    names = lane_names(lanes)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                node, *fps = (part.column(i).to_numpy() for i in range(lanes + 1))
                uncertain = np.array(part.column(lanes + 1).to_pylist(), np.int64) if lanes > 1 else None
                for s in range(2 * lanes):
                    segment = fps[s // 2] >> HALF & (1 << HALF) - 1 if s % 2 else fps[s // 2] & (1 << HALF) - 1
                    flips = ball_masks(None if uncertain is None else uncertain[:, s])
                    keys = (segment[:, None] ^ flips) | s << HALF
                    columns = [pa.array(keys.ravel()), pa.array(np.repeat(node, keys.shape[1]))]
                    if lanes > 1:
                        columns.append(pa.array(flips.ravel()))
                    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "node", "flip"][: len(columns)])

    nodes = distinct.select(node_name(lanes).alias("node"), *names, *(["uncertain"] if lanes > 1 else []))
    rows = nodes.mapInArrow(tables, "bucket long, node long" + (", flip long" if lanes > 1 else ""))
    in_bucket = Window.partitionBy("bucket")
    if lanes == 1:
        rows = rows.withColumn("n", F.count(F.lit(1)).over(in_bucket)).where("n > 1")
    else:
        # members that flip the same bits have the same segment, and meet under it without a flip as well
        rows = rows.select("*", F.count(F.lit(1)).over(in_bucket).alias("n"), F.min("flip").over(in_bucket).alias("least"), F.max("flip").over(in_bucket).alias("most"))
        rows = rows.where("n > 1 AND (least < most OR most = 0)").select("bucket", "node", "n")
    met = stored(rows)
    if lanes == 1:
        met = met.select("bucket", "n", F.col("node").alias("fp"), F.lit(0).alias("order"))
    else:
        # a node's buckets, 37 a segment at most, are one row of it; where many meet, those that meet most become the ends of edges, so that buckets of one group name the same
        own = met.groupBy("node").agg((-F.sum("n")).alias("order"), F.collect_list(F.struct("bucket", "n")).alias("met"))
        met = stored(own.join(nodes.drop("uncertain"), "node").select(*names, "order", F.inline("met")).select("bucket", "n", *names, "order"))

    ends = [f"{end}{i}" for end in "ab" for i in range(lanes)]
    schema = ", ".join(f"{end} long" for end in ends)

    def batch_of(edges: list[np.ndarray]) -> pa.RecordBatch:
        found = np.concatenate([np.zeros((0, 2 * lanes), np.int64), *edges])
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(2 * lanes)], names=ends)

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of([forest(np.array(fps, dtype=np.int64).reshape(-1, lanes + 1), radius) for fps in batch.column(0).to_pylist()])

    def forests_of_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, lanes + 2)])
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for key, part in zip(keys[[0, *cuts]] if len(keys) else (), np.split(fps, cuts)):
                if parts and key != bucket:
                    yield batch_of([forest(np.concatenate(parts), radius)])
                    parts = []
                bucket = key
                parts.append(part)
        if parts:
            yield batch_of([forest(np.concatenate(parts), radius)])

    def named(edges: DataFrame) -> DataFrame:
        return edges.select(*[(F.col(f"{end}0") if lanes == 1 else F.xxhash64(*[f"{end}{i}" for i in range(lanes)])).alias(end) for end in "ab"])

    members = met.where(F.col("n") <= COMPARED).groupBy("bucket").agg(F.collect_list(F.array("order", *names)).alias("fps"))
    pairs = named(members.select("fps").mapInArrow(forests, schema))

    large = met.where(F.col("n") > COMPARED)
    if lanes > 1 or radius > 4:
        stream = large.select("bucket", "order", *names).repartition("bucket").sortWithinPartitions("bucket")
        return pairs.union(named(stream.mapInArrow(forests_of_stream, schema)))
    table = F.shiftrightunsigned("bucket", HALF)
    other = F.get(F.array(*[_segment(F.col(name), 1 - s) for name in names for s in (0, 1)]), table.cast("int"))
    # both ends together may flip 4 bits: each spends 0 or 1 of its 2 in the bucket and the rest here
    own = F.get(F.array(*[_segment(F.col(name), s) for name in names for s in (0, 1)]), table.cast("int"))
    near = F.when(own == F.col("bucket").bitwiseAND(F.lit((1 << HALF) - 1)), _flipped(other, HALF, 2)).otherwise(_flipped(other, HALF, 1))
    near = large.select("bucket", "fp", F.explode(near).alias("z"))
    centres = near.groupBy("bucket", "z").agg(F.min("fp").alias("c"), F.max("fp").alias("top")).where("c < top")
    stars = near.join(centres, ["bucket", "z"]).where("fp > c").select(F.col("fp").alias("a"), F.col("c").alias("b"))
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, lanes: int = 1) -> DataFrame:
    """One row per row of ``docs``: its fingerprint and the class it belongs to.

    Classes are the connected components of all links of :func:`links`. Equal texts,
    and all texts with one fingerprint (equal in every lane), are one node, so that groups of copies of any
    size cost one row each; the class goes back to the rows by fingerprint.

    Defined cases: null and blank texts have fingerprint zero and are linked like any
    other; rows that repeat an id get a row each; a null id has a class through its text
    (null where no row of the class has an id); an empty table gives an empty result;
    other columns are ignored whatever their names.

    Returns ``id_col``, ``fp`` (long) and ``component_id``, the smallest id of the class.
    """
    names = lane_names(lanes)
    fps = stored(fingerprints(docs, id_col, text_col, shingle, lanes).withColumn("_node", node_name(lanes)))
    # texts of one fingerprint are one node; the uncertain bits of any of them do
    found = [F.min(id_col).alias("id"), *([F.min("uncertain").alias("uncertain")] if lanes > 1 else [])]
    nodes = stored(fps.groupBy("_node", *names).agg(*found).withColumn("last", F.col("id").isNull()))
    # nodes are ranked by their smallest id, so that the smallest node of a component holds its result
    ranks = nodes.select("_node", F.struct("last", "id", "_node").alias("rank"))
    edges = links(nodes, radius, lanes).distinct()
    for end in "ab":
        edges = edges.join(ranks.select(F.col("_node").alias(end), F.col("rank").alias(f"rank_{end}")), end)
    classes = connected_components(edges.select(F.col("rank_a").alias("a"), F.col("rank_b").alias("b")))
    found = classes.select(F.col("node._node").alias("_node"), F.col("component.id").alias("component_id"), F.lit(True).alias("linked"))
    by_node = nodes.select("_node", "id").join(found, "_node", "left").select("_node", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return fps.join(by_node, "_node").select(id_col, "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 44, lanes: int = 4) -> DataFrame:
    """``docs`` with all its columns and one document of each class of near duplicates: the one with the smallest id.

    Four lanes of five-word shingles; at a similarity of 0.8 texts differ by 39 of 256
    bits on average, with a standard deviation of 6 (the angle between the shingle
    vectors is acos(2s / (1 + s))), and the radius is one deviation above. Documents of a
    class without any id all stay, and so does an id of which any row stays. Ids that go
    are narrow: texts are only shuffled where these are more than a broadcast may hold.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, radius, lanes)
    stays = F.col(id_col).eqNullSafe(F.col("component_id"))
    goes = found.groupBy(F.col(id_col).cast("long").alias("_goes")).agg(F.max(stays).alias("stays")).where("NOT stays").select("_goes")
    goes = broadcast_if_small(goes)
    return docs.join(goes, docs[id_col].cast("long").eqNullSafe(goes["_goes"]), "left_anti")
