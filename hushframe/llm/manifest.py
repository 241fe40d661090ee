"""A Merkle tree over a dataset: a leaf for each row, a subtree for each source, proofs that a row belongs to the root.

A row's place in its source comes from histograms of the digits of doc_id, not from a sort: rows are counted by
their high digits, each digit's counts are summed up under the digits before it, and rows are numbered only among those that share all
digits. The digits of a place in base `fanout` name the nodes above it, so nodes that share their longest prefixes are folded
together, LEVELS levels in one step, until one is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Bits of one digit of doc_id; rows that share all digits but the last are numbered in one task.
DIGIT_BITS = 12
#: More rows than this that share all digits repeat a doc_id: they are parted by the digits of their leaves and of their place in the input.
CROWDED = 16 << DIGIT_BITS
#: Levels that one step folds; a group has fanout ** LEVELS nodes at most.
LEVELS = 6
#: Paths that may be broadcast, of some kilobytes each.
BROADCAST_PATHS = 5_000


def field_text(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _digit(number: Column, shift: int) -> Column:
    """DIGIT_BITS bits of a number in the order of signed numbers; null before all."""
    ordered = number.bitwiseXOR(F.lit(-(1 << 63)))
    return F.coalesce(F.shiftrightunsigned(ordered, shift).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int"), F.lit(-1))


def _ahead(counts: DataFrame, group: list[str], digits: list[str]) -> DataFrame:
    """counts (group, digits, __n) with __ahead: how many of the group's rows have smaller digits. A window never holds more rows than one digit has values."""
    before = Window.partitionBy(*group, *digits[:-1]).orderBy(digits[-1]).rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumn("__ahead", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if len(digits) == 1:
        return local
    parents = _ahead(counts.groupBy(*group, *digits[:-1]).agg(F.sum("__n").alias("__n")), group, digits[:-1])
    parents = parents.withColumnRenamed("__ahead", "__above").drop("__n")
    return local.join(parents, [*group, *digits[:-1]]).withColumn("__ahead", F.col("__ahead") + F.col("__above")).drop("__above")


def ranked(leaves: DataFrame) -> tuple[DataFrame, list[str]]:
    """leaves (src, doc_id, leaf, uid) with i, the place from 0 in their src by doc_id (null first), leaf and uid, and n, the src's rows; and scratch paths."""
    span = leaves.agg(F.min("doc_id"), F.max("doc_id")).first()  # two numbers
    differ = ((span[0] or 0) ^ (span[1] or 0)) & ((1 << 64) - 1)
    digits = {"d0": _digit(F.col("doc_id"), DIGIT_BITS)}
    for k, shift in enumerate(range(2 * DIGIT_BITS, max(differ.bit_length(), 1), DIGIT_BITS), 1):
        digits[f"d{k}"] = _digit(F.col("doc_id"), shift)
    names = sorted(digits, key=lambda d: -int(d[1:]))  # the highest first
    rows = leaves.withColumns(digits)
    counts, path = shared.write_table(rows.groupBy("src", *names).agg(F.count("*").alias("__n")), "manifest-counts")
    paths = [path]
    crowded = counts.where(F.col("__n") > CROWDED)
    if not crowded.isEmpty():
        # a repeated doc_id: its rows are parted further
        hot = F.coalesce(F.col("__hot"), F.lit(False))
        finer = {"e0": _digit(F.col("doc_id"), 0), "e1": F.conv(F.substring("leaf", 1, 3), 16, 10).cast("int"), "e2": F.conv(F.substring("leaf", 4, 3), 16, 10).cast("int")}
        finer |= {f"e{k}": _digit(F.col("uid"), shift) for k, shift in enumerate((48, 36, 24, 12), 3)}
        rows = rows.join(shared.small(crowded.select("src", *names, F.lit(True).alias("__hot"))), ["src", *names], "left")
        rows = rows.withColumns({e: F.when(hot, c).otherwise(0) for e, c in finer.items()}).drop("__hot")
        names += list(finer)
        counts, path = shared.write_table(rows.groupBy("src", *names).agg(F.count("*").alias("__n")), "manifest-counts")
        paths.append(path)
    sizes = counts.groupBy("src").agg(F.sum("__n").alias("n"))
    starts, path = shared.write_table(_ahead(counts, ["src"], names).join(shared.small(sizes), "src").drop("__n"), "manifest-starts")
    within = Window.partitionBy("src", *names).orderBy(F.asc_nulls_first("doc_id"), "leaf", "uid")
    numbered = rows.withColumn("__row", F.row_number().over(within)).join(shared.small(starts), ["src", *names])
    return numbered.withColumn("i", F.col("__ahead") + F.col("__row") - 1).drop("__row", "__ahead", "uid", *names), [*paths, path]


def text_ranks(names: DataFrame, limit: int = 1 << 12) -> DataFrame:
    """names (src), all different, with i: the place from 0 in the order of their bytes.

    Groups over `limit` are parted by the four hexadecimal digits after what all their names share (the prefix that their least and
    greatest name share), round by round; only groups' counts are summed up.
    """
    rows = names.select("src", F.hex(F.encode("src", "UTF-8")).alias("h"), F.lit("").alias("g"), F.lit(0).cast("long").alias("before"))
    done = None
    while True:
        sizes = rows.groupBy("g", "before").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        small = sizes.where(F.col("n") <= limit).select("g")
        place = F.row_number().over(Window.partitionBy("g").orderBy("h"))
        settled = rows.join(small, "g", "left_semi").select("src", (F.col("before") + place - 1).alias("i"))
        done = settled if done is None else done.unionAll(settled)
        large = sizes.where(F.col("n") > limit)
        if large.isEmpty():
            return done
        same = F.aggregate(F.sequence(F.lit(1), F.length("lo")), F.lit(0), lambda a, k: F.when((a == k - 1) & (F.substr("lo", k, F.lit(1)) == F.substr("hi", k, F.lit(1))), k).otherwise(a))
        parted = rows.join(large.select("g", same.alias("same")), "g")
        # hex digits stand in the order of bytes; a name that ends sooner comes first
        parted = parted.withColumn("key", F.substr("h", F.col("same") + 1, F.lit(4)))
        counts = parted.groupBy("g", "before", "key").agg(F.count("*").alias("n"))
        ahead = Window.partitionBy("g").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select("g", "key", (F.col("before") + F.coalesce(F.sum("n").over(ahead), F.lit(0))).alias("start"))
        rows, _ = shared.write_table(parted.drop("before").join(counts, ["g", "key"]).select("src", "h", F.concat("g", F.lit("/"), "key").alias("g"), F.col("start").alias("before")), "manifest-names")


def _levels(n: Column, fanout: int) -> Column:
    """How often n nodes are folded until one is left."""
    out = F.lit(0)
    power = 1
    while power < 1 << 63:
        out = out + (n > F.lit(power)).cast("int")
        power *= fanout
    return out


def _grouped(nodes: DataFrame, fanout: int, extra: list[str]) -> DataFrame:
    """nodes (src, i, n, digest, extra) as rows (src, g, n, nodes, m): runs of fanout ** LEVELS nodes in their order, m levels of which are folded now."""
    width = fanout**LEVELS
    node = F.struct("i", "digest", *extra)
    out = nodes.groupBy("src", F.expr(f"i div {width}").alias("g")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(node)).alias("nodes"))
    return out.withColumn("m", F.least(F.lit(LEVELS), _levels(F.col("n"), fanout)))


def _run(level: Column, fanout: int):
    """The digest of a level's j-th run."""
    return lambda j: F.sha2(F.array_join(F.slice(level, j * fanout + 1, F.lit(fanout)), ""), 256)


def _folded(groups: DataFrame, fanout: int) -> DataFrame:
    """groups with level0 ... levelLEVELS: the digests of each level; a level that isn't folded any more repeats the one before."""
    out = groups.withColumn("level0", F.transform("nodes", lambda x: x["digest"]))
    for k in range(LEVELS):
        below = F.col(f"level{k}")
        runs = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(level{k}) - 1) div {fanout} as int)")), _run(below, fanout))
        out = out.withColumn(f"level{k + 1}", F.when(F.col("m") > k, runs).otherwise(below))
    return out


def _up(groups: DataFrame, fanout: int) -> DataFrame:
    """The nodes that groups become, as nodes of the next step."""
    width = fanout**LEVELS
    return _folded(groups, fanout).select("src", F.col("g").alias("i"), F.expr(f"(n + {width - 1}L) div {width}L").alias("n"), F.get(F.col(f"level{LEVELS}"), F.lit(0)).alias("digest"))


def _paths(groups: DataFrame, fanout: int) -> DataFrame:
    """groups with one row for each node: src, g, node, path, an array of struct<before, after> of its siblings' digests, level by level."""

    def path(j: Column) -> Column:
        steps = []
        for k in range(LEVELS):
            level, at = F.col(f"level{k}"), F.floor(j / fanout**k).cast("int")
            first = at - at % fanout
            before = F.array_join(F.slice(level, first + 1, at - first), "")
            after = F.array_join(F.slice(level, at + 2, first + fanout - 1 - at), "")
            steps.append(F.struct(before.alias("before"), after.alias("after")))
        return F.slice(F.array(*steps), F.lit(1), F.col("m"))

    both = F.transform("nodes", lambda x, j: F.struct(x.alias("node"), path(j).alias("path")))
    return _folded(groups, fanout).select("src", "g", F.explode(both).alias("x")).select("src", "g", "x.node", "x.path")


def _climb(groups: DataFrame, fanout: int, top) -> tuple[DataFrame, list[str]]:
    """Rows (src, g, path, found...) for each group: its node's path up to what top(tops) says of its tree, and scratch paths.

    top takes the trees' tops (src, digest) and gives rows (src, path, found...).
    """
    nodes, path = shared.write_table(_up(groups, fanout), "manifest-nodes")
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        above = top(nodes.select("src", "digest"))
        return above.withColumn("g", F.lit(0).cast("long")), [path]
    upper, group_path = shared.write_table(_grouped(nodes, fanout, []), "manifest-groups")
    above, paths = _climb(upper, fanout, top)
    joined = _paths(upper, fanout).withColumnRenamed("path", "__own").join(shared.small(above, BROADCAST_PATHS), ["src", "g"])
    out = joined.withColumn("path", F.concat("__own", "path")).withColumn("g", F.col("node.i")).drop("node", "__own")
    out, out_path = shared.write_table(out, "manifest-paths")
    shared.drop_tables(groups.sparkSession, *paths, path, group_path)
    return out, [out_path]


def folded(path: Column, node: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, node, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), doc_id: str = "doc_id", source: str = "source", tampered: dict[str, Column] | None = None, fanout: int = 3) -> DataFrame:
    """A row for each row of docs: source, doc_id, leaf, subroot, root, path (siblings' digests before and after, level by level), proof_sha256, folded_root, verified.

    tampered replaces fields before the row is folded again with its own path, to show what a proof finds out; without it rows are
    folded as they are. In a source rows go by doc_id, nulls first, those of one doc_id by their leaf; rows equal in all
    fields have equal leaves and take neighbouring places in any order. A null source is a source of its own, the first. Null
    fields and empty texts have leaves of their own (`-`, `0:`). An empty table gives an empty table. Only the fields are read.
    """
    col = lambda c: F.col(f"`{c}`")
    changed = tampered or {}
    leaf = digest(*(field_text(col(c)) for c in fields))
    again = digest(*(field_text(changed.get(c, col(c))) for c in fields)) if changed else leaf
    # "" for null, else what sorts after it: keys that are never null
    src = F.coalesce(F.concat(F.lit("s"), col(source)), F.lit(""))
    rows = docs.select(src.alias("src"), col(doc_id).cast("long").alias("doc_id"), leaf.alias("leaf"), F.when(again != leaf, again).alias("again"), F.monotonically_increasing_id().alias("uid"))
    rows, path = shared.write_table(rows, "manifest-leaves")  # uid is fixed from here
    placed, paths = ranked(rows)
    groups, group_path = shared.write_table(_grouped(placed.withColumnRenamed("leaf", "digest"), fanout, ["doc_id", "again"]), "manifest-groups")
    shared.drop_tables(docs.sparkSession, path, *paths)

    def above_sources(tops: DataFrame) -> DataFrame:
        """The sources' subroots as leaves of the tree whose top is the root."""
        tops, _ = shared.write_table(tops.withColumnRenamed("digest", "subroot"), "manifest-subroots")
        order, _ = shared.write_table(text_ranks(tops.select("src")), "manifest-order")
        n = tops.count()
        nodes = tops.join(order, "src").select(F.lit("").alias("src"), "i", F.lit(n).cast("long").alias("n"), F.col("subroot").alias("digest"), F.col("src").alias("name"))
        upper, _ = shared.write_table(_grouped(nodes, fanout, ["name"]), "manifest-groups")
        root, _ = _climb(upper, fanout, lambda t: t.select("src", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.col("digest").alias("root")))
        own = _paths(upper, fanout).withColumnRenamed("path", "__own").join(shared.small(root, BROADCAST_PATHS), ["src", "g"])
        found = own.select(F.col("node.name").alias("src"), F.col("node.digest").alias("subroot"), "root", F.concat("__own", "path").alias("path"))
        return shared.write_table(found, "manifest-sources")[0]

    above, _ = _climb(groups, fanout, above_sources)
    out = _paths(groups, fanout).withColumnRenamed("path", "__own").join(shared.small(above, BROADCAST_PATHS), ["src", "g"])
    out = out.select(F.when(F.col("src") != "", F.expr("substr(src, 2)")).alias("source"), "node.doc_id", F.col("node.digest").alias("leaf"), "subroot", "root", F.concat("__own", "path").alias("path"), F.coalesce("node.again", "node.digest").alias("__again"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = out.withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn("folded_root", folded(F.col("path"), F.col("__again")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("__again")
