"""A Merkle manifest of a dataset: aligned subtrees persisted every few levels, proofs regenerated between."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclens.llm.shared import documents, written

#: Levels between two that are persisted: a subtree of 2^STEP nodes is regenerated at a time.
STEP = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<is_left: boolean, digest: string>>"


def field(value: Column) -> Column:
    """A field's part of what a leaf digests: its length in UTF-8 and the value, or - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def parents(nodes: Column) -> Column:
    """Digests of every two consecutive nodes; a last node alone is digested alone."""

    def of(k: Column) -> Column:
        return F.sha2(F.concat(F.get(nodes, 2 * k), F.coalesce(F.get(nodes, 2 * k + 1), F.lit(""))), 256)

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), of)


def _levels(n: Column) -> Column:
    """1 to n, for n up to STEP."""
    return F.filter(F.array(*[F.lit(k) for k in range(1, STEP + 1)]), lambda k: k <= n)


def subtree_top(nodes: Column, n: Column) -> Column:
    """The nodes that are left n levels above nodes."""
    return F.aggregate(_levels(n), nodes, lambda acc, _: parents(acc))


def subtree_levels(nodes: Column, n: Column) -> Column:
    """nodes, and the n levels above them."""
    return F.aggregate(_levels(n), F.array(nodes), lambda acc, _: F.concat(acc, F.array(parents(F.element_at(acc, -1)))))


def folded(digest: Column, proof: Column) -> Column:
    """What a digest becomes by its proof, level by level."""

    def up(acc: Column, s: Column) -> Column:
        other = F.coalesce(s["digest"], F.lit(""))
        return F.sha2(F.when(s["is_left"], F.concat(other, acc)).otherwise(F.concat(acc, other)), 256)

    return F.aggregate(proof, digest, up)


def siblings(proof: Column) -> Column:
    """The digests of a proof, joined."""
    return F.array_join(F.transform(proof, lambda s: F.coalesce(s["digest"], F.lit(""))), "")


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (tree, ...) with i, the place in its tree from 0, and height, the levels above its tree's leaves.

    Rows are sorted by ranges over all partitions, so a tree that holds most rows is spread as well;
    places count from the sizes of the ranges before. Equal rows are told apart by their number.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.select("*", F.monotonically_increasing_id().alias("tie"))
    keys = [F.col("tree"), *order, F.col("tie")]
    ranged = numbered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie")
    ranged = written(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "merkle-leaves")
    sizes = ranged.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("start"))
    before = F.sum("n").over(W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    total = F.sum("n").over(W.partitionBy("tree"))
    # Exact for any count: the bits of the largest place.
    height = F.when(total == 1, 0).otherwise(F.length(F.bin(total - 1))).cast("int")
    sizes = written(sizes.select("tree", "part", "start", F.coalesce(before, F.lit(0)).alias("before"), height.alias("height")), "merkle-sizes")
    joined = ranged.join(sizes.hint("merge"), ["tree", "part"])
    return joined.withColumn("i", F.col("before") + F.col("at") - F.col("start")).drop("part", "at", "start", "before")


def subtrees(nodes: DataFrame, kept: list[str]) -> DataFrame:
    """(tree, g, n, left, nodes) of rows (tree, i, digest, left): aligned subtrees of at most 2^STEP nodes in order.

    left is how many levels the tree has above them, n how many of those the subtree spans.
    """
    own = F.array_sort(F.collect_list(F.struct("i", "digest", *kept))).alias("nodes")
    found = nodes.groupBy("tree", F.shiftright("i", STEP).alias("g")).agg(own, F.first("left").alias("left"))
    return found.select("tree", "g", F.least("left", F.lit(STEP)).alias("n"), "left", "nodes")


def digests_of(nodes: str) -> Column:
    return F.transform(nodes, lambda x: x["digest"])


@dataclass
class Tree:
    """Trees by key: levels[0] are the leaves (tree, i, digest, left, ...), then every STEP-th level; the last has one node a tree."""

    levels: list[DataFrame]
    kept: list[str]

    def tops(self) -> DataFrame:
        """(tree, digest), a row for each tree."""
        return self.levels[-1].select("tree", "digest")


def build(rows: DataFrame, order: list[Column], kept: list[str]) -> Tree:
    """Trees over rows (tree, digest, and the columns kept), leaves in order; only every STEP-th level is written."""
    leaves = placed(rows, order).withColumnRenamed("height", "left").select("tree", "i", "digest", "left", *kept)
    levels = [written(leaves, "merkle-level")]
    height = levels[0].agg(F.max("left").alias("h")).first()["h"] or 0
    for _ in range(-(-height // STEP)):
        above = subtrees(levels[-1], []).select(
            "tree", F.col("g").alias("i"), F.get(subtree_top(digests_of("nodes"), F.col("n")), 0).alias("digest"), F.greatest(F.col("left") - STEP, F.lit(0)).alias("left")
        )
        levels.append(written(above, "merkle-level"))
    return Tree(levels if height else [levels[0], levels[0].select("tree", "i", "digest", "left")], kept)


def proofs(tree: Tree, above: DataFrame | None = None) -> DataFrame:
    """(tree, top, digest, proof, and kept, and what above has): each leaf with its siblings up to its tree's top.

    Levels go down from the tops: a subtree's interior is made again from its persisted nodes,
    its siblings go before those that the node above it has, and the interior is gone with the
    row. above (tree, proof, ...) carries proofs on from the tops, where the trees are
    themselves leaves.
    """
    path = tree.levels[-1].select("tree", F.col("i").alias("g"), F.col("digest").alias("top"), F.array().cast(PROOF).alias("upper"))
    more = []
    if above is not None:
        more = [c for c in above.columns if c not in ("tree", "proof")]
        path = path.drop("upper").join(above.withColumnRenamed("proof", "upper"), "tree")
    for depth in range(len(tree.levels) - 2, -1, -1):
        kept = tree.kept if depth == 0 else []
        joined = subtrees(tree.levels[depth], kept).join(path.hint("merge"), ["tree", "g"])
        # A generator between the steps keeps the optimizer from copying a subtree into every use of it.
        inside = F.explode(F.array(subtree_levels(digests_of("nodes"), F.col("n")))).alias("inside")
        made = joined.select("tree", "n", "nodes", "upper", "top", *more, inside)
        spans = F.filter(F.array(*[F.lit(k) for k in range(STEP)]), lambda k: k < F.col("n"))

        def own(x: Column, spans: Column = spans) -> Column:
            at = x["i"].bitwiseAND(F.lit(2**STEP - 1).cast("bigint")).cast("int")

            def sibling(k: Column) -> Column:
                place = F.call_function("shiftright", at, k)
                is_left = place.bitwiseAND(F.lit(1)) == 1
                return F.struct(is_left.alias("is_left"), F.get(F.get("inside", k), place.bitwiseXOR(F.lit(1))).alias("digest"))

            return F.concat(F.transform(spans, sibling), F.col("upper")).cast(PROOF)

        each = F.transform("nodes", lambda x: F.struct(x.alias("x"), own(x).alias("proof")))  # noqa: B023
        rows = made.select("tree", "top", *more, F.explode(each).alias("e"))
        if depth:
            rows = rows.select("tree", F.col("e.x.i").alias("g"), "top", F.col("e.proof").alias("upper"), *more)
            path = written(rows, "merkle-path")
        else:
            return rows.select("tree", "top", *more, "e.x.digest", "e.proof", *[f"e.x.{c}" for c in tree.kept])
    raise AssertionError("a tree has its leaves and its tops")


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", kept: dict[str, Column] | None = None) -> DataFrame:
    """Each row of docs as a leaf of its group's tree, with its proof up to the root over all groups.

    (doc_id, leaf, subroot, root, proof, and the columns kept): leaf is the SHA-256 of fields;
    leaves of a group ascend by id (null ids first, then by digest), groups by name (the null group
    first). proof lists every level's sibling up to the root, with is_left for one before the
    node and a null digest where a node has none. Proofs need the leaves and every STEP-th level
    only, which is what is written. One row per input row, repeated rows too; other columns are
    left out. Empty input gives an empty result.
    """
    names = list(kept or {})
    tree_key = field(F.col(group_col))
    rows = docs.select(
        tree_key.alias("tree"), F.col(id_col).alias("leaf_id"), leaf_digest([F.col(f"`{c}`") for c in fields]).alias("digest"), *[c.alias(f"kept_{n}") for n, c in (kept or {}).items()]
    )
    groups = written(docs.groupBy(F.col(group_col).alias("name")).agg(F.lit(1).alias("one")), "merkle-groups").select(field(F.col("name")).alias("tree"), "name")
    trees = build(rows, [F.col("leaf_id"), F.col("digest")], ["leaf_id", *[f"kept_{n}" for n in names]])
    over = trees.tops().join(groups, "tree").select(F.lit("").alias("tree"), "digest", F.col("tree").alias("of"), "name")
    roots = proofs(build(over, [F.col("name").asc_nulls_first()], ["of"]))
    roots = written(roots.select(F.col("of").alias("tree"), "proof", F.col("top").alias("root")), "merkle-roots")
    found = proofs(trees, roots)
    return found.select(F.col("leaf_id").alias("doc_id"), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", "proof", *[F.col(f"kept_{n}").alias(n) for n in names])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    changed = leaf_digest([n_chars if c == "n_chars" else F.col(c) for c in FIELDS])
    # Only what tampering changes is carried along.
    found = merkle_manifest(docs, kept={"changed": F.when(tampered, changed)})
    root = folded(F.coalesce("changed", "leaf"), F.col("proof"))
    checked = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), F.explode(F.array(root)).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(v) for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: CRC-32 of a decimal number: its bytes and their eight bits folded with the reversed polynomial.
CRC_SQL = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), "
    "lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT)"
)

OP13_SQL = f"""
WITH RECURSIVE t AS (
  SELECT *, {CRC_SQL} % 7 = 0 AS tampered FROM documents),
leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, {_leaf_sql("n_chars")} AS leaf,
         {_leaf_sql("(CASE WHEN tampered THEN n_chars + 1 ELSE n_chars END)")} AS changed
  FROM t),
tree AS (
  SELECT lang, 0 AS level, i, count(*) OVER (PARTITION BY lang) AS n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 2, any_value(n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, level, i // 2),
subs AS (SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM tree WHERE n = 1),
over_tree AS (
  SELECT 0 AS level, g AS i, n, subroot AS h FROM subs
  UNION ALL
  SELECT level + 1, i // 2, any_value(n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM over_tree WHERE n > 1 GROUP BY level, i // 2),
steps AS (
  SELECT l.doc_id, l.lang, l.i AS row_no, e.level, (l.i >> e.level) & 1 = 1 AS is_left, s.h
  FROM leaves l JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) e ON l.lang IS NOT DISTINCT FROM e.lang
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = e.level AND s.i = xor(l.i >> e.level, 1)
  UNION ALL
  SELECT l.doc_id, l.lang, l.i, 1000 + e.level, (b.g >> e.level) & 1 = 1, s.h
  FROM leaves l JOIN subs b ON l.lang IS NOT DISTINCT FROM b.lang CROSS JOIN (SELECT DISTINCT level FROM over_tree WHERE n > 1) e
  LEFT JOIN over_tree s ON s.level = e.level AND s.i = xor(b.g >> e.level, 1)),
paths AS (
  SELECT lang, row_no, list({{'is_left': is_left, 'h': coalesce(h, '')}} ORDER BY level) AS path FROM steps GROUP BY ALL),
folds AS (
  SELECT l.*, coalesce(path, []) AS path FROM leaves l LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.row_no = l.i),
top AS (SELECT h AS root FROM over_tree WHERE n = 1),
done AS (
  SELECT doc_id, leaf, lang, sha256(array_to_string(list_transform(path, lambda s: s.h), '')) AS proof_sha256,
         list_reduce(list_prepend({{'is_left': false, 'h': changed}}, path),
                     lambda a, s: {{'is_left': false, 'h': sha256(CASE WHEN s.is_left THEN s.h || a.h ELSE a.h || s.h END)}}).h AS folded_root
  FROM folds)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM done JOIN subs ON done.lang IS NOT DISTINCT FROM subs.lang CROSS JOIN top
"""
