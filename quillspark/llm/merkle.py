"""Merkle manifest of a table, and proofs of its rows by a recursive query.

H is SHA-256 of the inputs one after another, digests as lowercase hex text. A row's leaf is H of its
fields. The leaves of a group, in order, form a tree: every two consecutive nodes of a level become
their H, a last odd one the H of itself, until one node remains, the group's subroot; the subroots, in
order of the groups, likewise give the root.

Built levels are stored as rows that know their parent. Four levels lie in one row, a page: of up to 16
nodes below, all hashes up to the node that the page stands for, with the number of the parent's page
and the place in it. So a proof of n leaves climbs a quarter of log2(n) steps. A recursive query
ascends from every leaf: a step joins the leaf's state with the page above, emits the siblings of the
way through it, and folds the (perhaps tampered) hash with them. Siblings are emitted, not carried, so
what the query holds grows with the depth and not with its square; they are put together, in order of
the steps, once the climb is over.

The upper pages lie on the way of all leaves. They are stored once for each chunk of leaves, and state
and pages meet by chunk, so that no key has more rows than a chunk.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels in a page, and leaves of a chunk, as powers of two.
HEIGHT, CHUNK = 4, 10
MASK = (1 << HEIGHT) - 1
STATE = "row long, doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def leaf(fields: list[Column]) -> Column:
    """H of the fields, each as `-` if null, else its UTF-8 byte count, a colon and itself."""
    told = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (c.cast("string") for c in fields)]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def _bytes(hexed: Column) -> Column:
    return F.unhex(hexed)


def _text(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def _above(below: Column) -> Column:
    """The next level over a list of hashes."""
    half = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int"))
    return F.transform(half, lambda i: _bytes(F.sha2(F.concat(_text(F.get(below, 2 * i)), F.coalesce(_text(F.get(below, 2 * i + 1)), F.lit(""))).cast("binary"), 256)))


def ranked(rows: DataFrame, order: list[Column], into: str) -> DataFrame:
    """rows, written in the given order, with their place in it from 0 on. Rows are dealt out by range,
    so `order` should tell all of them apart; the driver sees one number for each partition."""
    spark = rows.sparkSession
    n = common.parallelism(spark)
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    held = common.materialize(dealt.withColumns({"_part": F.spark_partition_id(), "_turn": F.monotonically_increasing_id()}), "ordered")
    sizes = dict(held.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before = common.offsets([sizes.get(p, 0) for p in range(n)]).tolist()
    starts = spark.createDataFrame(list(enumerate(before)), "_part int, _start long")  # one row for each partition
    place = F.col("_start") + F.col("_turn").bitwiseAND((1 << 33) - 1)
    return held.join(F.broadcast(starts), "_part").withColumn(into, place).drop("_part", "_turn", "_start")


def leaves_of(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", counted: str = "n_chars") -> DataFrame:
    """Written leaves: row, doc_id (the order), lang (the group), leaf, and changed: the leaf of a
    tampered row, in which `counted` is one more (null stays) where 7 divides the unsigned CRC-32 of the
    decimal `order`; of other rows, also those without `order`, leaf itself."""
    cast = {c: F.col(c).cast("long") if c in (order, counted) else F.col(c).cast("string") for c in fields}
    more = F.when(F.coalesce(F.crc32(cast[order].cast("string").cast("binary")) % 7 == 0, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    changed = cast | {counted: (cast[counted].cast("decimal(20,0)") + more).cast("string")}  # no number is too large
    held = docs.select(cast[order].alias("doc_id"), F.col(group).cast("string").alias("lang"), leaf(list(cast.values())).alias("leaf"), leaf(list(changed.values())).alias("changed"))
    return common.materialize(held.withColumn("row", F.monotonically_increasing_id()), "leaves")


def _pages(entries: DataFrame, level: int) -> DataFrame:
    """entries (tree, at, n, hash): the n nodes of each tree at the foot of a level of pages -> tree, n
    (leaves of the tree), level, page, hash (its top) and levels (hashes of each level below the top).
    The topmost page of a tree ends where one node is left; all others are of full height."""
    page = entries.groupBy("tree", "n", F.shiftright("at", HEIGHT).alias("page")).agg(F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("held"))
    page = page.select("tree", "n", "page", F.col("held.hash").alias("_0"), (F.shiftright(F.col("n") - 1, HEIGHT * (level + 1)) == 0).alias("top"))
    for k in range(HEIGHT):
        below = F.col(f"_{k}")
        page = page.withColumn(f"_{k + 1}", F.when(F.col("top") & (F.size(below) == 1), below).otherwise(_above(below)))
    # A level that equals the one above it was not hashed.
    levels = F.filter(F.array(*(F.when(~(F.col("top") & (F.size(f"_{k}") == 1)), F.col(f"_{k}")) for k in range(HEIGHT))), lambda x: x.isNotNull())
    return page.select("tree", "n", F.lit(level).alias("level"), "page", F.get(f"_{HEIGHT}", F.lit(0)).alias("hash"), levels.alias("levels"), "top")


def _tree(entries: DataFrame, most: int, name: str) -> list[DataFrame]:
    """All levels of pages over entries (tree, at, n, hash), each written; `most` is the largest n."""
    built, level = [], 0
    while True:
        built.append(common.materialize(_pages(entries, level), f"{name}-{level}"))
        most = (most - 1 >> HEIGHT) + 1
        if most <= 1:
            return built
        entries = built[-1].where("NOT top").select("tree", F.col("page").alias("at"), "n", "hash")
        level += 1


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with tree and at, pages) of the leaves of leaves_of(); pages: tree and chunk of the leaves
    below, level and page, up and slot (page and place on the level above, null for the root's), levels,
    and subroot or root where the page's top is one."""
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    placed = ranked(leaves, order, "place")
    trees = placed.groupBy("lang").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    trees = common.materialize(ranked(trees, [F.col("first")], "tree"), "trees")
    most = trees.agg(F.max("n").alias("n"), F.count("*").alias("trees")).first()
    # A tree holds neighbouring places; langs are few as a rule, and Spark broadcasts them if they are.
    same = F.col("t.lang").eqNullSafe(F.col("l.lang"))
    placed = placed.alias("l").join(trees.alias("t"), same).select("l.row", "l.doc_id", "l.leaf", "l.changed", "t.tree", "t.n", (F.col("l.place") - F.col("t.first")).alias("at"))
    placed = common.materialize(placed, "places")
    own = _tree(placed.select("tree", "at", "n", _bytes(F.col("leaf")).alias("hash")), most["n"] or 0, "pages")
    tops = reduce(DataFrame.unionByName, own).where("top").select("tree", F.col("level").alias("last"), "n", "hash")
    tops = common.materialize(tops, "subroots")
    above = _tree(tops.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(most["trees"]).cast("long").alias("n"), "hash"), most["trees"], "root")
    nothing = F.lit(None).cast("binary")
    parts = []
    for p in own:
        level = F.col("level")
        wide = HEIGHT * (level + 1) - CHUNK  # a page holds 2^wide chunks, or a chunk 2^-wide pages
        last = F.shiftright(F.col("n") - 1, CHUNK)
        low = F.when(wide <= 0, F.call_function("shiftright", F.col("page"), F.greatest(-wide, F.lit(0)))).otherwise(F.call_function("shiftleft", F.col("page"), F.greatest(wide, F.lit(0))))
        high = F.when(wide <= 0, low).otherwise(F.least(F.call_function("shiftleft", F.col("page") + 1, F.greatest(wide, F.lit(0))) - 1, last))
        up = F.when(F.col("top"), F.shiftright("tree", HEIGHT)).otherwise(F.shiftright("page", HEIGHT))
        slot = F.when(F.col("top"), F.col("tree")).otherwise(F.col("page")).bitwiseAND(MASK).cast("int")
        parts.append(p.select("tree", F.explode(F.sequence(low, high)).alias("chunk"), "level", "page", up.alias("up"), slot.alias("slot"), "levels", F.when(F.col("top"), F.col("hash")).otherwise(nothing).alias("subroot"), nothing.alias("root")))
    for j, p in enumerate(above):
        of = tops.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, CHUNK))).alias("chunk"), (F.col("last") + 1 + j).alias("level"), F.shiftright("tree", HEIGHT * (j + 1)).alias("page"))
        up, slot = (F.when(~F.col("top"), x) for x in (F.shiftright("page", HEIGHT), F.col("page").bitwiseAND(MASK).cast("int")))
        parts.append(of.join(p.select("page", "levels", "hash", "top"), "page").select("tree", "chunk", "level", "page", up.alias("up"), slot.alias("slot"), "levels", nothing.alias("subroot"), F.when(F.col("top"), F.col("hash")).otherwise(nothing).alias("root")))
    pages = reduce(DataFrame.unionByName, (p.withColumn("level", F.col("level").cast("int")) for p in parts))
    return placed, common.materialize(pages, "manifest")


# way: the sibling on each level of a page, null where the last run is of one node.
CLIMB = """
WITH RECURSIVE climb (row, doc_id, leaf, tree, chunk, level, page, slot, folded, siblings, subroot, root) AS (
  SELECT row, doc_id, leaf, tree, shiftright(at, {chunk}), 0, shiftright(at, {height}), CAST(at & {mask} AS INT), unhex(changed),
    CAST(NULL AS BINARY), CAST(NULL AS BINARY), CAST(NULL AS BINARY) FROM {leaves}
  UNION ALL
  SELECT row, CAST(NULL AS BIGINT), CAST(NULL AS STRING), tree, chunk, level + 1, up, place,
    aggregate(way, folded, (own, x) -> unhex(sha2(CAST(IF(x.right, concat(coalesce(lower(hex(x.sibling)), ''), lower(hex(own))), concat(lower(hex(own)), coalesce(lower(hex(x.sibling)), ''))) AS BINARY), 256))),
    aggregate(way, X'', (all, x) -> concat(all, coalesce(x.sibling, X''))), subroot, root
  FROM (
    SELECT c.row, c.tree, c.chunk, c.level, c.folded, p.up, p.slot AS place, p.subroot, p.root,
      transform(p.levels, (x, k) -> struct(get(x, CAST(shiftright(c.slot, k) ^ 1 AS INT)) AS sibling, (shiftright(c.slot, k) & 1) = 1 AS right)) AS way
    FROM climb c JOIN {pages} p ON p.tree = c.tree AND p.chunk = c.chunk AND p.level = c.level AND p.page = c.page
  )
)
SELECT row, level, doc_id, leaf, page, folded, siblings, subroot, root FROM climb
"""


def climb(leaves: DataFrame, pages: DataFrame, path: str) -> DataFrame:
    """From every leaf to the root: row, doc_id, leaf, subroot, root, proof_sha256 (H of all siblings on
    the way) and folded_root (from `changed` and the stored siblings), written to `path`."""
    spark = leaves.sparkSession
    names = {k: f"{k}_{uuid.uuid4().hex}" for k in ("leaves", "pages")}
    leaves.createOrReplaceTempView(names["leaves"])
    pages.createOrReplaceTempView(names["pages"])
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")  # the rows are those of all steps of all leaves
    try:
        steps = spark.sql(CLIMB.format(chunk=CHUNK, height=HEIGHT, mask=MASK, **names))
        # One row for each step of a leaf, each of at most HEIGHT siblings.
        each = steps.groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.max("leaf").alias("leaf"), F.max("subroot").alias("subroot"), F.max("root").alias("root"),
            F.max(F.when(F.col("page").isNull(), F.col("folded"))).alias("folded"),
            F.array_sort(F.collect_list(F.when(F.col("siblings").isNotNull(), F.struct("level", "siblings")))).alias("way"),
        )
        proof = F.aggregate("way", F.lit(b""), lambda all_, x: F.concat(all_, x["siblings"]))
        told = each.select(
            "row", "doc_id", "leaf", _text(F.col("subroot")).alias("subroot"), _text(F.col("root")).alias("root"),
            F.sha2(_text(proof).cast("binary"), 256).alias("proof_sha256"), _text(F.col("folded")).alias("folded_root"),
        )
        told.write.parquet(path)
        return spark.read.schema(told.schema).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(limit)
        else:
            spark.conf.set(limit, before)
        for name in names.values():
            spark.catalog.dropTempView(name)


def verify(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs (doc_id,
    source, lang, n_chars, text).

    A null group (lang) is a group of its own, the first; null doc_ids come first in theirs. Rows that
    share doc_id and lang are ordered by their leaves; equal rows stay separate leaves of one hash. Null
    and empty fields differ. A group of one leaf has it as its subroot, a table of one group has that
    subroot as root, and the proof of a lone leaf is H of nothing. A row without n_chars can't be
    tampered with. An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    path = common.scratch(spark, "proofs")
    with common.temporary(spark):
        leaves = leaves_of(docs)
        if leaves.limit(1).count():
            found = climb(*build(leaves), path)
        else:
            found = spark.createDataFrame([], STATE)
    return found.drop("row").withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that a tampered one folds to."""
    return verify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_ENCODED = "coalesce(strlen({v}) || ':' || {v}, '-')"
_FIELDS = "sha256(" + " || ".join(_ENCODED.format(v=v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST({n} AS VARCHAR)", "text")) + ")"
# CRC-32, bit by bit over the digits of doc_id.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ord(s)::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)
OP11_SQL = f"""
WITH RECURSIVE src AS (
  SELECT row_number() OVER () AS r, doc_id, lang, {_FIELDS.format(n="n_chars")} AS leaf,
    {_FIELDS.format(n="(n_chars + CASE WHEN doc_id IS NOT NULL AND " + _CRC + " % 7 = 0 THEN 1 ELSE 0 END)")} AS changed FROM documents
),
leafs AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM src
),
own AS (
  SELECT t, 0 AS l, p, n, leaf AS h FROM leafs
  UNION ALL SELECT t, l + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM own WHERE n > 1 GROUP BY t, l, p // 2, n
),
subroots AS (SELECT t, l, h FROM own WHERE n = 1),
above AS (
  SELECT 0 AS l, t AS p, (SELECT count(*) FROM subroots) AS n, h FROM subroots
  UNION ALL SELECT l + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM above WHERE n > 1 GROUP BY l, p // 2, n
),
way AS (
  SELECT f.r, o.l, (f.p >> o.l) & 1 AS side, s.h FROM leafs f JOIN (SELECT DISTINCT t, l, n FROM own WHERE n > 1) o USING (t)
    LEFT JOIN own s ON s.t = f.t AND s.l = o.l AND s.p = xor(f.p >> o.l, 1)
  UNION ALL SELECT f.r, 1000 + o.l, (f.t >> o.l) & 1, s.h FROM leafs f CROSS JOIN (SELECT DISTINCT l, n FROM above WHERE n > 1) o
    LEFT JOIN above s ON s.l = o.l AND s.p = xor(f.t >> o.l, 1)
),
steps AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY l) AS k, coalesce(h, '') AS s FROM way),
fold AS (
  SELECT r, 1 AS k, changed AS h FROM leafs
  UNION ALL SELECT fold.r, fold.k + 1, sha256(CASE WHEN side = 1 THEN s || fold.h ELSE fold.h || s END) FROM fold JOIN steps ON steps.r = fold.r AND steps.k = fold.k
),
folded AS (SELECT r, arg_max(h, k) AS folded_root FROM fold GROUP BY r),
proofs AS (SELECT r, sha256(string_agg(s, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY r)
SELECT CAST(doc_id AS BIGINT) AS doc_id, leaf, subroots.h AS subroot, (SELECT h FROM above WHERE n = 1) AS root,
  coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM above WHERE n = 1) AS verified
FROM leafs JOIN subroots USING (t) JOIN folded USING (r) LEFT JOIN proofs USING (r)
"""
