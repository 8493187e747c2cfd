"""N-gram Jaccard join: a grouped prefix join of documents by their word shingles.

Equal shingle sets are one class. Of each class only the smallest hashes are
sent out (the extended prefix: two similar sets share several of them). Their
exact frequencies order them, rarest first, and what must still contain a
common token is the prefix. Classes with identical prefix and size are one
group; groups that share a prefix token are group pairs, whose members are
verified exactly. Members that are already connected are not compared again,
which changes no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logistra.llm import tokens
from logistra.llm.components import components
from logistra.llm.frames import let, pick
from logistra.storage import drop_table, stored

# Most rows of a table of class ids that is broadcast: 8 bytes each.
BROADCAST_ROWS = 1_000_000
# What names a bucket: a prefix token and the lower of two size classes.
BUCKET = ["token", "size"]
# What names the large buckets of one first class.
FAMILY = ["hub", "size"]
# Rows of a bucket up to which all its pairs are listed.
SMALL_BUCKET = 32
# Tokens of the classes that one task compares as left and as right sides.
LEFT_TOKENS, RIGHT_TOKENS = 400_000, 1_000_000


class Rule:
    """Similar: inter * den >= num * union, over shingles of k words."""

    def __init__(self, k: int = 5, num: int = 80, den: int = 100, spare: float = 0.5):
        """``spare``: additional tokens of the extended prefix, as a share of the plain prefix."""
        self.k, self.num, self.den, self.spare = k, num, den, spare

    def least(self, n):
        """Smallest overlap, and smallest partner, of a set of n: ceil(n * num / den)."""
        return -(-n * self.num // self.den)

    def shared(self, n):
        """Tokens that the extended prefixes of two similar sets have in common."""
        return np.floor(self.spare * (n - self.least(n))).astype(np.int64) + 1

    def extended(self, n):
        return n - self.least(n) + self.shared(n)

    def prefix(self, n):
        """Rarest tokens of the extended prefix that must hold a common one."""
        return self.extended(n) - self.shared(self.least(n)) + 1


def _sets(rule: Rule, batches: Iterator[pa.RecordBatch]):
    """For each chunk of documents: first row, batch, sizes and sorted distinct shingles."""
    table = tokens.byte_table()
    for batch in batches:
        for first, sizes, found in _found(rule, batch.column("text"), table):
            yield batch, first, sizes, found


def _found(rule: Rule, column: pa.Array, table: np.ndarray):
    for w in tokens.words(column, table):
        found = [
            np.unique(tokens.shingles(w.hashes[i:j], rule.k).view(np.int64))
            for i, j in zip(w.offsets[:-1], w.offsets[1:], strict=True)
        ]
        yield w.first, np.array([len(s) for s in found], dtype=np.int64), found


def _lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(values.astype(np.int64)))


def _classes(sizes: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of each set."""
    total = np.array([tokens.mix(s.view(np.uint64)).sum(dtype=np.uint64) for s in found])
    return tokens.mix(total.astype(np.uint64) + sizes.astype(np.uint64)).view(np.int64)


def _prefix_rows(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, sizes, found in _sets(rule, batches):
            ids = batch.column("doc_id").slice(first, len(found))
            heads = [s[:e] for s, e in zip(found, rule.extended(sizes), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes), pa.array(_classes(sizes, found)), _lists(heads)],
                names=["doc_id", "n", "cid", "head"],
            )

    return run


def _set_rows(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, sizes, found in _sets(rule, batches):
            ids = batch.column("doc_id").slice(first, len(found))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(_classes(sizes, found)), _lists(found)],
                names=["doc_id", "cid", "tokens"],
            )

    return run


def _compare(rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        """Links between left rows and rows of other components in one block.

        All pairs are compared; of the links those that connect what the block's
        links before left apart are returned, so a family of near copies gives
        as many rows as it has components, not as it has pairs.
        """
        parent: dict[int, int] = {}

        def root(component: int) -> int:
            while (above := parent.get(component, component)) != component:
                parent[component] = parent.get(above, above)
                component = above
            return component

        cids, comps = (table.column(c).to_numpy() for c in ("cid", "component"))
        left = np.flatnonzero(table.column("is_left").to_numpy(zero_copy_only=False))
        right = np.flatnonzero(~table.column("is_left").to_numpy(zero_copy_only=False))
        lists = table.column("tokens").combine_chunks()
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        bounds = bounds - bounds[0]
        _, numbers = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        numbers = numbers.astype(np.int32)
        sizes = np.diff(bounds)
        present = np.zeros(len(numbers) + 1, dtype=bool)
        # Only right rows are counted; their tokens lie together after sorting.
        own = np.concatenate([numbers[bounds[r] : bounds[r + 1]] for r in right] or [numbers[:0]])
        starts = np.cumsum(np.concatenate([[0], sizes[right]]))[:-1]
        pairs = []
        for x in left:
            mine = numbers[bounds[x] : bounds[x + 1]]
            present[mine] = True
            inter = np.add.reduceat(present[own], starts, dtype=np.int64) if len(own) else own
            present[mine] = False
            union = sizes[x] + sizes[right] - inter
            hit = right[(inter * rule.den >= rule.num * union) & (comps[right] != comps[x])]
            for component, y in zip(*np.unique(comps[hit], return_index=True), strict=True):
                mine, other = root(int(comps[x])), root(int(component))
                if mine != other:
                    parent[mine] = other
                    pairs.append((cids[x], cids[hit[y]]))
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _members(heads: DataFrame, rule: Rule) -> DataFrame:
    """``(cid, n, gid, prefix)``: of each class the prefix tokens that occur in other rows too.

    Copies may repeat in ``heads``: frequencies are those of rows, which order
    the tokens as well as any other numbers.
    """
    postings = heads.where("n > 0").select("cid", "n", F.explode("head").alias("token"))
    common = postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # Tokens that occur once stand first in the order and can't be shared.
    ordered = (
        postings.join(common, "token")
        .groupBy("cid", "n")
        .agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("shared"))
    )
    least = f"((n * {rule.num} + {rule.den - 1}) div {rule.den})"
    inner = f"(({least} * {rule.num} + {rule.den - 1}) div {rule.den})"
    extended = f"(n - {least} + CAST(floor({rule.spare}D * (n - {least})) AS long) + 1)"
    length = f"({extended} - CAST(floor({rule.spare}D * ({least} - {inner})) AS long))"
    prefix = f"slice(shared.token, 1, CAST(greatest(0, {length} - {extended} + size(shared)) AS int))"
    return (
        ordered.selectExpr("cid", "n", f"{prefix} AS prefix")
        .where("size(prefix) > 0")
        .withColumn("gid", F.xxhash64("n", "prefix"))
    )


def _buckets(members: DataFrame, rule: Rule) -> DataFrame:
    """``(token, size, cid, n, gid, rows)``: groups that share a prefix token with one of like size.

    A group pair exists where a bucket holds two sizes in reach of each other
    or two members of one size; the members of such groups are expanded.
    ``rows`` is the number of members in the bucket.
    """
    groups = members.select("gid", "n", F.explode("prefix").alias("token"))
    groups = groups.groupBy("token", "gid", "n").agg(F.count("*").alias("members"))
    near = f"{{low}} * {rule.den} >= {{high}} * {rule.num}"
    side = "{f}(n) OVER (PARTITION BY token ORDER BY n)"
    below = near.format(low=side.format(f="lag"), high="n")
    above = near.format(low="n", high=side.format(f="lead"))
    sizes = (
        groups.groupBy("token", "n")
        .agg(F.sum("members").alias("members"))
        .selectExpr(
            "token",
            "n",
            "members",
            f"members > 1 OR coalesce({below}, false) OR coalesce({above}, false) AS kept",
        )
        .where("kept")
    )
    # Like sizes are in one size class or in neighbours; a bucket holds two classes.
    step = math.log(rule.den / rule.num) * 1.0001
    kept = groups.join(sizes.select("token", "n"), ["token", "n"]).selectExpr(
        "*", f"CAST(floor(ln(n) / {step!r}D) AS long) AS class"
    )
    kept = kept.selectExpr("*", "explode(array(class, class - 1)) AS size")
    totals = (
        kept.groupBy("token", "size")
        .agg(F.sum("members").alias("rows"), F.max(F.expr("class = size")).alias("low"))
        .where("rows > 1 AND low")
    )
    kept = kept.join(totals, ["token", "size"])
    return kept.select("token", "size", "gid", "rows").join(members.select("gid", "cid", "n"), "gid")


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The links ``(a, b)`` among ``pairs(a, b)``."""
    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("tokens").alias("y")), "b")
    linked = let(
        "size(array_intersect(x, y))",
        "i",
        f"i * {rule.den}L >= {rule.num}L * (size(x) + size(y) - i)",
    )
    return both.where(linked).select("a", "b")


def links(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, n, cid)`` of the documents and components ``(cid, component)``."""
    spark = docs.sparkSession
    texts = pick(docs, "doc_id", "text")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    heads, head_path = stored(
        texts.mapInArrow(_prefix_rows(rule), f"doc_id {id_type}, n long, cid long, head array<long>"),
        "heads",
    )
    rows, _ = stored(heads.select("doc_id", "n", "cid"), "classes")
    members, member_path = stored(_members(heads, rule), "members")
    drop_table(spark, head_path)
    buckets, bucket_path = stored(_buckets(members, rule), "buckets")
    drop_table(spark, member_path)
    # Texts of one row of each class that may have a partner.
    wanted = buckets.select("cid").distinct().join(rows, "cid").groupBy("cid").agg(
        F.min("doc_id").alias("doc_id")
    )
    keys = [F.col("r.cid") == F.col("s.cid"), F.col("r.doc_id").eqNullSafe(F.col("s.doc_id"))]
    small = wanted.count() <= BROADCAST_ROWS
    every = texts.mapInArrow(_set_rows(rule), f"doc_id {id_type}, cid long, tokens array<long>")
    sets, set_path = stored(
        every.alias("s")
        .join((F.broadcast(wanted) if small else wanted).alias("r"), keys, "left_semi")
        .select("cid", "tokens"),
        "sets",
    )
    # All pairs of a small bucket; the first class of a large one with each other.
    few = buckets.where(f"rows <= {SMALL_BUCKET}")
    other = few.select(*BUCKET, F.col("cid").alias("b"), F.col("n").alias("m"))
    near = f"a < b AND least(n, m) * {rule.den} >= greatest(n, m) * {rule.num}"
    pairs = few.withColumnRenamed("cid", "a").join(other, BUCKET).where(near).select("a", "b")
    # Large buckets with the same first class are one: the tokens of a family of
    # near copies have nearly the same rows.
    many = buckets.where(f"rows > {SMALL_BUCKET}")
    hubs = many.groupBy(*BUCKET).agg(F.min("cid").alias("hub"))
    many = many.join(hubs, BUCKET).select("hub", "size", "cid", "n").distinct()
    star = many.where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b"))
    first, first_path = stored(_verified(pairs.union(star).distinct(), sets, rule), "links")
    known = components(first).withColumnRenamed("node", "cid")
    second, second_path = stored(_remaining(many, sets, known, rule), "links")
    found = components(first.union(second)).withColumnRenamed("node", "cid")
    for path in (bucket_path, set_path, first_path, second_path):
        drop_table(spark, path)
    return rows, found


def _remaining(buckets: DataFrame, sets: DataFrame, known: DataFrame, rule: Rule) -> DataFrame:
    """Links between classes of large buckets that their first class did not connect.

    The rows of a bucket outside its largest component are the left sides. They
    are cut into blocks of LEFT_TOKENS, and each block meets the rows of the
    bucket in blocks of RIGHT_TOKENS, so that a task's memory is bounded and no
    table of pairs arises.
    """
    rows = buckets.join(known, "cid", "left").select(
        *FAMILY, "cid", "n", F.coalesce("component", "cid").alias("component")
    )
    parts = rows.groupBy(*FAMILY, "component").agg(F.sum("n").alias("words"))
    plans = (
        parts.groupBy(*FAMILY)
        .agg(
            F.max_by("component", F.struct("words", "component")).alias("largest"),
            F.sum("words").alias("words"),
            F.max("words").alias("most"),
            F.count("*").alias("parts"),
        )
        .where("parts > 1")
        .selectExpr(
            *FAMILY,
            "largest",
            f"1 + (words - most) div {LEFT_TOKENS} AS lefts",
            f"1 + words div {RIGHT_TOKENS} AS rights",
        )
    )
    dealt = rows.join(plans, FAMILY)
    left = dealt.where("component <> largest").selectExpr(
        *FAMILY, "cid", "component", "pmod(xxhash64(cid), lefts) AS l",
        "explode(sequence(0L, rights - 1)) AS r", "true AS is_left",
    )
    right = dealt.selectExpr(
        *FAMILY, "cid", "component", "explode(sequence(0L, lefts - 1)) AS l",
        "pmod(xxhash64(cid, 1), rights) AS r", "false AS is_left",
    )
    blocks = left.union(right).join(sets, "cid")
    compared = blocks.groupBy(*FAMILY, "l", "r").applyInArrow(_compare(rule), "a long, b long")
    return compared.distinct()


def join_components(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs`` (doc_id, text).

    A-Z is lower-cased; words are runs without space and control white space.
    Fewer words than a shingle make one shingle; null, empty and blank texts
    have none and are linked with nothing. component_id is the smallest doc_id
    that links reach. Rows with equal texts are in one component; a null doc_id
    is never the smallest unless all are null.
    """
    rows, found = links(docs, rule or Rule())
    mapped = rows.where("n > 0").join(found, "cid", "left").select(
        "doc_id", "n", F.coalesce("component", "cid").alias("component")
    )
    smallest = mapped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    whole = mapped.join(smallest, "component").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id"
    )
    return whole.union(
        rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    )


def one_of_each(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without the near copies of others, all columns.

    Of the rows that links connect the one with the smallest doc_id stays, null
    ids last; of several such rows that with the smallest text. Rows without
    words are linked with nothing and stay. The classes that lose a row are
    listed, and each row's class is computed again from its text, so no text is
    shuffled while the list is small.
    """
    rule = rule or Rule()
    rows, found = links(docs, rule)
    classes = (
        rows.where("n > 0")
        .groupBy("cid", "doc_id")
        .agg(F.count("*").alias("same"))
        .groupBy("cid")
        .agg(
            F.min("doc_id").alias("first"),
            F.sum("same").alias("rows"),
            F.coalesce(F.min_by("same", "doc_id"), F.sum("same")).alias("firsts"),
        )
    )
    grouped = classes.join(found, "cid", "left").withColumn("family", F.coalesce("component", "cid"))
    keepers = grouped.groupBy("family").agg(
        F.min_by("cid", F.struct(F.col("first").isNull(), "first", "cid")).alias("keeper")
    )
    losing, _ = stored(
        grouped.join(keepers, "family")
        .selectExpr("cid", "first", "rows", "firsts", "cid = keeper AS stays")
        .where("NOT stays OR rows > 1"),
        "losing",
    )
    names, lower = docs.columns, [c.lower() for c in docs.columns]
    place = {c: names.index(c) if c in names else lower.index(c) for c in ("doc_id", "text")}
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = StructType([*plain.schema.fields, StructField("cid", LongType())])
    listed = F.broadcast(losing) if losing.count() <= BROADCAST_ROWS else losing
    marked = plain.mapInArrow(_with_class(rule, place["text"]), schema).join(listed, "cid", "left")
    kept = marked.where(
        F.col("stays").isNull() | F.col("stays") & F.col(f"c{place['doc_id']}").eqNullSafe(F.col("first"))
    )
    out = kept.where("coalesce(firsts, 1) = 1").select(plain.columns)
    if not losing.where("stays AND firsts > 1").isEmpty():
        order = [f"c{place['text']}", *(c for c in plain.columns if c != f"c{place['text']}")]
        equal = kept.where("firsts > 1").groupBy("cid").agg(F.min(F.struct(*order)).alias("row"))
        out = out.union(equal.select("row.*").select(plain.columns))
    return out.toDF(*names)


def _with_class(rule: Rule, place: int):
    """Rows with the class of their text, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.byte_table()
        for batch in batches:
            cids, empty = np.zeros(batch.num_rows, dtype=np.int64), np.ones(batch.num_rows, dtype=bool)
            for first, sizes, found in _found(rule, batch.column(place), table):
                cids[first : first + len(found)] = _classes(sizes, found)
                empty[first : first + len(found)] = sizes == 0
            columns = [*batch.columns, pa.array(cids, mask=empty)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cid"])

    return run
