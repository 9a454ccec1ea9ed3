"""Exact, perceptual and version duplicates, and the groups they form."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.vector import hamming
from corvane.operators.products import TIE, _matrix
from corvane.runtime import Workspace, ship_package
from corvane.schema import Settings

STEM_BLOCK = 2048
HOT = 4096  # hashes of a key that are one group


def exact_groups(files: DataFrame) -> DataFrame:
    """(sha256_hash, n, representative_file_id) of contents that several live files share."""
    return files.where(~F.col("is_deleted") & F.col("sha256_hash").isNotNull()).groupBy("sha256_hash").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("representative_file_id")).where("n > 1")


def hash_parts(classes: DataFrame, parts: int) -> list[list[int]]:
    """The 64 bit positions dealt to parts so that each part tells as much: by how evenly a bit's values are shared, in turns."""
    ones = classes.agg(F.count(F.lit(1)), *[F.sum(F.shiftrightunsigned("phash", i).bitwiseAND(F.lit(1))) for i in range(64)]).first()
    n = max(ones[0], 1)
    order = sorted(range(64), key=lambda i: (abs((ones[i + 1] or 0) / n - 0.5), i))
    turns = [order[at : at + parts] for at in range(0, 64, parts)]
    return [sorted(t[i] if not k % 2 else t[-1 - i] for k, t in enumerate(turns) if i < len(t)) for i in range(parts)]


def cheapest_parts(rows: int, distance: int) -> int:
    """Parts by which looking hashes up costs least: keys of both sides, and the pairs that meet in them by chance."""

    def cost(parts: int) -> float:
        bits, reach = -(-64 // parts), distance // parts
        keys = sum(math.comb(bits, i) for i in range(-(-reach // 2) + 1)) + sum(math.comb(bits, i) for i in range(reach // 2 + 1))
        return parts * (rows * keys + rows * rows * sum(math.comb(bits, i) for i in range(reach + 1)) / 2.0**bits)

    return min(range(2, min(distance, 8) + 1), key=cost) if distance > 1 else 2


def _flips(bits: int, most: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)]


def hamming_pairs(hashes: DataFrame, distance: int = 10, near: int = 5, parts: int | None = None, hot: int = HOT) -> DataFrame:
    """(file_a, file_b, distance, kind) of hashes within a distance: NEAR or SIMILAR. Pairs are between class representatives.

    Equal hashes are one class before the join (see hash_classes). The bits are cut into parts; two hashes
    within the distance are within its share of it in one part. Both sides look that part up: one side with
    up to half of the share's bits flipped, the other with the rest, so that few keys reach far. Where two
    hashes differ in a part, the first side flips the lowest of the bits and the other side the higher
    ones: a pair meets under one key of a part, and counts in the first part that brings it together.
    The number of parts follows from the number of hashes (the more there are, the longer a key), so the
    pairs that meet by chance stay few a hash; bits are dealt by the data, so constant bits don't make one
    part coarse. A key that many hashes share, such as that of flat images, is a grid of bounded groups.
    Both sides are told to merge: Spark takes keys to be as few as the classes they are made from, and would
    send millions of them through the driver. The classes are dealt to all cores, as a small file makes many keys.
    """
    classes = hash_classes(hashes).where("file_id = class_id").select("file_id", "phash")
    work = Workspace(hashes.sparkSession, "hamming")
    classes = work.write(classes.repartition(hashes.sparkSession.sparkContext.defaultParallelism), "classes")
    n = classes.count()
    parts = parts or cheapest_parts(n, distance)
    reach, positions = distance // parts, hash_parts(classes, parts)

    def side(name: str, most: int) -> DataFrame:
        """Keys of one side: (part, key, flipped, file, hash)."""
        rows = None
        for i, bits in enumerate(positions):
            own = reduce(Column.bitwiseOR, [F.shiftleft(F.shiftrightunsigned("phash", b).bitwiseAND(F.lit(1).cast("long")), j) for j, b in enumerate(bits)])
            flips = F.array(*[F.lit(f).cast("long") for f in _flips(len(bits), most)])
            part = classes.select(F.col("file_id").alias(f"file_{name}"), F.col("phash").alias(f"p{name}"), F.lit(i).alias("part"), own.alias("own"), F.explode(flips).alias(f"flip_{name}"))
            part = part.withColumn("key", F.col("own").bitwiseXOR(F.col(f"flip_{name}"))).drop("own")
            rows = part if rows is None else rows.unionByName(part)
        return rows

    a, b = side("a", -(-reach // 2)), side("b", reach // 2)
    if n > hot:  # a key may be hot: deal its hashes to a grid of blocks
        blocks = lambda rows, name: rows.groupBy("part", "key").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias(name)).where(F.col(name) > 1)
        large = work.write(blocks(a, "na").join(blocks(b, "nb"), ["part", "key"], "full").select("part", "key", F.coalesce("na", F.lit(1)).alias("na"), F.coalesce("nb", F.lit(1)).alias("nb")), "hot")
        each = lambda count: F.sequence(F.lit(0), F.coalesce(count, F.lit(1)) - 1)
        a = a.join(large, ["part", "key"], "left").withColumn("ga", F.pmod(F.xxhash64("file_a"), F.coalesce("na", F.lit(1))).cast("int")).withColumn("gb", F.explode(each(F.col("nb")))).drop("na", "nb")
        b = b.join(large, ["part", "key"], "left").withColumn("gb", F.pmod(F.xxhash64("file_b"), F.coalesce("nb", F.lit(1))).cast("int")).withColumn("ga", F.explode(each(F.col("na")))).drop("na", "nb")
    else:
        a, b = a.withColumns({"ga": F.lit(0), "gb": F.lit(0)}), b.withColumns({"ga": F.lit(0), "gb": F.lit(0)})
    flip_a, flip_b = F.col("flip_a"), F.col("flip_b")
    in_order = (flip_b == 0) | ((flip_a < flip_b.bitwiseAND(-flip_b)) & (F.bit_count(flip_a) == -(-reach // 2)))
    met = a.hint("merge").join(b.hint("merge"), ["part", "key", "ga", "gb"]).where(in_order & (F.col("file_a") < F.col("file_b")))
    apart = F.col("pa").bitwiseXOR(F.col("pb"))
    pairs = met.withColumn("distance", hamming(F.col("pa"), F.col("pb"))).where(F.col("distance") <= distance)
    masks = [sum(1 << x for x in bits) for bits in positions]
    meets = F.array(*[F.bit_count(apart.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))) <= reach for m in masks])
    once = pairs.where(F.array_position(meets, True) == F.col("part") + 1)
    return once.select("file_a", "file_b", "distance", F.when(F.col("distance") <= near, "NEAR").otherwise("SIMILAR").alias("kind"))


def hash_classes(hashes: DataFrame) -> DataFrame:
    """(file_id, phash, class_id): files with a hash, and the smallest file with the same one."""
    known = hashes.where(F.col("phash").isNotNull()).select("file_id", "phash")
    return known.join(known.groupBy("phash").agg(F.min("file_id").alias("class_id")), "phash").select("file_id", "phash", "class_id")


def with_copies(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """pairs between class representatives, and a star of pairs at distance 0 from each representative to the files with the same hash."""
    stars = hash_classes(hashes).where("file_id != class_id").select(F.col("class_id").alias("file_a"), F.col("file_id").alias("file_b"), F.lit(0).alias("distance"), F.lit("NEAR").alias("kind"))
    return pairs.unionByName(stars)


def hamming_links(hashes: DataFrame, distance: int = 10) -> DataFrame:
    """(file_id, class_id, n_links): one row a file with a hash, and how many other files are within the distance, copies among them."""
    classes = hash_classes(hashes)
    weight = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = Workspace(hashes.sparkSession, "links").write(hamming_pairs(hashes, distance), "pairs")  # read twice
    both = pairs.select(F.col("file_a").alias("of"), F.col("file_b").alias("class_id")).unionByName(pairs.select(F.col("file_b").alias("of"), F.col("file_a").alias("class_id")))
    beyond = both.join(weight, "class_id").groupBy("of").agg(F.sum("n").alias("m")).withColumnRenamed("of", "class_id")
    told = weight.join(beyond, "class_id", "left").select("class_id", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    return classes.join(told, "class_id").select("file_id", "class_id", "n_links")


def name_stem(name):
    """File name without ending, copy marks and version suffixes."""
    bare = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    return F.regexp_replace(bare, r"([ _-]*(v|ver|version|rev|final|copy|draft)?[ _-]*\(?\d*\)?)+$", "")


def version_pairs(files: DataFrame, embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(file_a, file_b, cosine) of files with the same stem and vectors that are close enough.

    A stem's files are dealt to blocks of about STEM_BLOCK, and every pair of blocks is a group of its own,
    compared by one matrix product; so a stem that very many files have is many bounded tasks.
    """
    ship_package(files.sparkSession)
    floor = settings.version_cosine_threshold
    rows = files.select("file_id", name_stem(F.col("display_name")).alias("stem")).where("stem != ''").join(embeddings.select("file_id", "vector"), "file_id")
    blocks = rows.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("stem", F.ceil(F.col("n") / STEM_BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("file_id"), F.col("blocks")).cast("int")
    sides = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("l"), F.greatest(own, o).alias("r"), own.alias("own")))
    dealt = rows.join(blocks, "stem").select("stem", "file_id", "vector", F.explode(sides).alias("b")).select("stem", "b.l", "b.r", "b.own", "file_id", "vector")
    found = dealt.groupBy("stem", "l", "r").applyInArrow(lambda t: _close_files(t, floor), "file_a long, file_b long, cosine double")
    return found.withColumn("cosine", F.round("cosine", 6)).where(F.col("cosine") >= floor)


def _close_files(t: pa.Table, floor: float) -> pa.Table:
    """Pairs of one pair of blocks whose products reach the floor (before rounding to six places)."""
    t = t.combine_chunks()
    ids, own, left = t.column("file_id").to_numpy(), t.column("own").to_numpy(), t.column("l")[0].as_py()
    x = _matrix(t.column("vector").chunk(0))
    rows = np.flatnonzero(own == left)
    cols = rows if t.column("r")[0].as_py() == left else np.flatnonzero(own != left)
    score = x[rows] @ x[cols].T
    a, b = np.nonzero(score >= floor - TIE)
    i, j, s = ids[rows[a]], ids[cols[b]], score[a, b]
    keep = i < j if rows is cols else i != j
    return pa.table({"file_a": np.minimum(i, j)[keep], "file_b": np.maximum(i, j)[keep], "cosine": s[keep]})


def group_members(pairs: DataFrame) -> DataFrame:
    """(file_id, group_id): groups of linked files, named by their smallest file.

    Each round a file takes the smallest name among its neighbours and their names' names; rounds end
    when nothing changes. The state is checkpointed to the folder that the cluster shares.
    """
    work = Workspace(pairs.sparkSession, "groups")
    both = F.array(F.struct(F.col("file_a").alias("a"), F.col("file_b").alias("b")), F.struct(F.col("file_b").alias("a"), F.col("file_a").alias("b")))  # a union would make the pairs twice
    edges = work.write(pairs.select(F.inline(both)).distinct(), "edges")
    labels = work.write(edges.select(F.col("a").alias("file_id"), F.col("a").alias("group_id")).distinct(), "labels-0")
    i, changed = 0, True
    while changed:
        i += 1
        around = edges.join(labels.select(F.col("file_id").alias("b"), "group_id"), "b").groupBy("a").agg(F.min("group_id").alias("least"))
        step = labels.join(around, F.col("file_id") == F.col("a")).select("file_id", F.least("group_id", "least").alias("group_id"), F.col("group_id").alias("before"))
        jump = step.join(step.select(F.col("file_id").alias("via"), F.col("group_id").alias("far")), F.col("group_id") == F.col("via"), "left")
        new = work.write(jump.select("file_id", F.least("group_id", F.coalesce("far", "group_id")).alias("group_id"), "before"), f"labels-{i}")
        changed = not new.where("group_id != before").isEmpty()
        labels = new.select("file_id", "group_id")
    return labels


def duplicate_groups(exact: DataFrame, near: DataFrame, files: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """(group_type, representative_file_id, file_id, similarity_score) of exact and perceptual groups.

    dismissed: pairs (file_a, file_b) that a user said are none.
    """
    members = files.where(~F.col("is_deleted")).join(exact, "sha256_hash").select(F.lit("EXACT").alias("group_type"), "representative_file_id", "file_id", F.lit(1.0).alias("similarity_score"))
    pairs = near if dismissed is None else near.join(dismissed.select("file_a", "file_b"), ["file_a", "file_b"], "left_anti")
    pairs = Workspace(files.sparkSession, "duplicates").write(pairs, "pairs")  # read for groups and for distances
    closest = pairs.select(F.col("file_a").alias("file_id"), "distance").unionByName(pairs.select(F.col("file_b").alias("file_id"), "distance")).groupBy("file_id").agg(F.min("distance").alias("d"))
    groups = group_members(pairs).join(closest, "file_id").select(F.lit("PERCEPTUAL_NEAR").alias("group_type"), F.col("group_id").alias("representative_file_id"), "file_id", F.round(1 - F.col("d") / 64, 6).alias("similarity_score"))
    return members.unionByName(groups)


def resolve(groups: DataFrame, ids: DataFrame, status: str = "RESOLVED") -> DataFrame:
    """Groups after those of the ids are resolved or dismissed."""
    told = groups.join(ids.select("group_id").distinct().withColumn("_hit", F.lit(True)), "group_id", "left")
    return told.withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).select(groups.columns)
