"""Exact Jaccard self-join of documents on their word shingles, by PartEnum signatures (Arasu et al., VLDB 2006).

Two sets of a and b shingles with similarity of s or more differ in at most (1-s)/(1+s) * (a+b) shingles. For sizes up
to R that is k. The shingles' domain is cut by hash into groups of PARTS parts, and all subsets of PARTS - 1 parts of a group are
enumerated; a signature is what such a subset holds. k differences leave at least m subsets alone, wherever they fall, so two linked
sets agree in m signatures. Each set therefore leaves out m - 1 of its signatures, those of the most frequent shingles, or of the
fewest, first: what a subset holds decides whether it goes before another, so of the m or more in which two linked sets agree
the last in that order stays in both. Documents that share a common passage don't all meet that way; frequencies come from a
pass over all documents, and as they only order the subsets, they may be rough. A kept subset that holds nothing names one of the set's rarest
shingles besides, of which two linked sets have one in common, so short texts don't all meet either. Sets are compared within size bands, which
overlap so far that two sizes within the threshold's ratio share a band.

Identical sets are one node. Nodes with a common signature are compared with the one of them that meets most others; exact
intersections decide. Groups whose nodes are then one component need no more. In small groups of several components all pairs of nodes
from different ones are compared. In large ones two such nodes are compared if sketches of their sets differ in no more bits
than linked sets can (close_pairs()); nodes of the hub's own component ask for no partners. So no link between components is lost, and
texts of groups of near copies are compared only where they may be linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, vectext
from .vectext import U, mix, signed

#: A band of sizes reaches from its least size to so many times that; GROUPS: groups of parts for each difference allowed; parts of a group.
BAND, GROUPS, PARTS = 1.75, 0.8, 3
#: Shingles whose frequency is known to all tasks, at most; a task names those that it has met so often.
HOT_SHINGLES, HOT_COUNT = 200_000, 3
#: Shingles counted at once.
COUNTED = 1 << 22
#: Groups of so many nodes are compared pair by pair.
SMALL_GROUP = 8
#: Keys of so many documents that go may be broadcast: two numbers each. Texts are shuffled by their keys only beyond that.
GONE_ROWS = 2_000_000
#: Words of 64 bits of a set's sketch, a power of two and four at least.
SKETCH = 32
_BITS = [f"b{i}" for i in range(SKETCH)]


def _node(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    return mix(vectext.totals(mix(found, 11), at) ^ mix(np.diff(at).astype(U), 12))


def band_plan(percent: int) -> tuple[float, float]:
    """The ratio between neighbouring bands' least sizes and the most differences for each shingle of both sets."""
    return BAND * percent / 100, (100 - percent) / (100 + percent)


class Hot:
    """Levels (log2 of the frequency) of frequent shingles; 0 for others."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        order = np.argsort(shingles)
        self.shingles = shingles[order]
        self.levels = np.log2(np.maximum(counts[order], 2)).astype(np.uint8)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.shingles >> U(42)).astype(np.int64)] = True

    def level(self, found: np.ndarray) -> np.ndarray:
        out = np.zeros(len(found), np.uint8)
        some = np.flatnonzero(self.maybe[(found >> U(42)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.shingles, found[some]), len(self.shingles) - 1)
            out[some] = np.where(self.shingles[at] == found[some], self.levels[at], 0)
        return out


def hot_shingles(docs: DataFrame) -> Hot:
    """The frequent shingles of all documents: tasks name those they meet HOT_COUNT times, and the sums are ordered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def named() -> pa.RecordBatch:
            kinds, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= HOT_COUNT
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(kinds[often])), pa.array(counts[often])], ["shingle", "n"])

        for batch in batches:
            for _, found, _ in _batches(batch.column(0)):
                held.append(found)
                if sum(map(len, held)) >= COUNTED:
                    yield named()
        if held:
            yield named()

    counts = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(HOT_SHINGLES).toArrow()  # bounded
    return Hot(top["shingle"].to_numpy().view(U), top["n"].to_numpy())


def part_plan(k: int) -> tuple[int, int]:
    """How many groups of PARTS parts sets that differ in up to k shingles get, and in how many subsets they agree at least.

    The first difference in a group leaves one of its three pairs of parts alone, a second one none.
    """
    groups = max(k // 2 + 1, ceil(GROUPS * k))
    return groups, 3 * groups - 2 * k if k <= groups else 2 * groups - k


def signatures(found: np.ndarray, at: np.ndarray, percent: int, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sorted sets, and the set each belongs to."""
    step, share = band_plan(percent)
    sizes = np.diff(at)
    level = hot.level(found)
    sigs, owners = [np.empty(0, U)], [np.empty(0, np.int64)]
    top = int(floor(log(max(int(sizes.max(initial=1)), 1), step))) + 1
    for band in range(top + 1):
        low = ceil(step**band - 1e-9)
        high = floor(step**band * BAND + 1e-9)
        chosen = np.flatnonzero((sizes >= low) & (sizes <= high))
        if not len(chosen) or low > high:
            continue
        k = int(floor(share * 2 * high + 1e-9))
        groups, agreed = part_plan(k)
        parts = PARTS * groups
        n = sizes[chosen]
        who = np.repeat(np.arange(len(chosen)), n)
        place = np.arange(len(who)) + np.repeat(at[:-1][chosen] - (np.cumsum(n) - n), n)
        h = found[place]
        part = (((h >> U(32)) * U(parts)) >> U(32)).astype(np.int64)
        # sets are sorted, so a part's shingles follow each other
        cell = who * parts + part
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        filled = cell[begin]
        content, count = np.zeros(len(chosen) * parts, U), np.zeros(len(chosen) * parts, np.int64)
        common = np.full(len(chosen) * parts, 63, np.uint8)  # the level of a part's rarest shingle
        content[filled] = np.add.reduceat(mix(h, 21), begin)
        count[filled] = np.diff(np.append(begin, len(h)))
        common[filled] = np.minimum.reduceat(level[place], begin)
        shape = (len(chosen), groups, PARTS)
        content, count, common = content.reshape(shape), count.reshape(shape), common.reshape(shape)
        subsets = range(PARTS)  # a subset leaves out one part of its group
        rest = [[j for j in range(PARTS) if j != i] for i in subsets]
        total = np.stack([content[:, :, x] + mix(content[:, :, y], 24) for x, y in rest], 2).reshape(len(chosen), -1)
        held = np.stack([count[:, :, x] + count[:, :, y] for x, y in rest], 2).reshape(len(chosen), -1)
        often = np.stack([np.minimum(common[:, :, x], common[:, :, y]) for x, y in rest], 2).reshape(len(chosen), -1)
        sig = mix(total ^ mix(np.arange(total.shape[1], dtype=U) + U(band << 32), 22))
        owner = np.broadcast_to(chosen[:, None], sig.shape)
        if agreed > 1:
            rank_key = ((U(63) - often.astype(U)) << U(58)) | (np.minimum(held, 63).astype(U) << U(52)) | (sig >> U(12))
            kept = np.argpartition(rank_key, agreed - 1, axis=1)[:, agreed - 1 :]
            sig, held, owner = (np.take_along_axis(x, kept, 1) for x in (sig, held, owner))
        blank = held == 0
        sigs.append(sig[~blank])
        owners.append(owner[~blank])
        for i in np.flatnonzero(blank.any(axis=1)):
            own = slice(int(at[chosen[i]]), int(at[chosen[i] + 1]))
            first = np.lexsort((found[own], level[own]))[: n[i] - -(-percent * int(n[i]) // 100) + 1]
            named = mix(sig[i][blank[i]][:, None] ^ mix(found[own][first], 23)[None, :]).ravel()
            sigs.append(named)
            owners.append(np.full(len(named), chosen[i]))
    return np.concatenate(sigs), np.concatenate(owners)


def _batches(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for part in vectext.slices(texts):
        yield part, *vectext.sets(vectext.words(part))


def profile(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, n_shingles, node) for rows (doc_id, text); a document without words has no node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part, found, at in _batches(batch.column(2)):
                n = len(part)
                sizes = np.diff(at)
                node = pa.array(signed(_node(found, at)), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), batch.column(1).slice(done, n), pa.array(sizes, pa.int64()), node], ["doc_id", "text_key", "n_shingles", "node"])
                done += n

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, n_shingles long, node long")


def signature_rows(docs: DataFrame, percent: int, hot: Broadcast[Hot]) -> DataFrame:
    """Rows (sig, node) of all documents' signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = vectext.Seen()
        for batch in batches:
            for _, found, at in _batches(batch.column(0)):
                node = _node(found, at)
                fresh, sizes = seen.fresh(node), np.diff(at)
                own, own_at = found[np.repeat(fresh, sizes)], np.append(0, np.cumsum(sizes[fresh]))
                sig, owner = signatures(own, own_at, percent, hot.value)
                yield pa.RecordBatch.from_arrays([pa.array(signed(sig)), pa.array(signed(node[fresh][owner]))], ["sig", "node"])

    return docs.select("text").mapInArrow(run, "sig long, node long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted rows (sig, node): those of signatures with two nodes or more, each once.

    Only the last row is held from one batch to the next, so a signature of any number of rows takes no more memory.
    """
    held, given = (np.empty(0, np.int64), np.empty(0, np.int64)), False  # the last row, and whether it was given out
    for batch in batches:
        sig, node = (np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held))
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[fresh], node[fresh]
        if not len(sig):
            continue
        same = sig[1:] == sig[:-1]
        keep = np.append(False, same) | np.append(same, False)
        last_given = bool(keep[-1]) or (len(sig) == 1 and given)
        if given:
            keep[0] = False
        given = last_given
        held = (sig[-1:], node[-1:])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(node[keep])], ["sig", "node"])


def groups(rows: DataFrame) -> DataFrame:
    """Rows (sig, node, hub, n): the n nodes of signatures that several nodes have.

    The hub is the node that shares most signatures: a text comes before its altered copies, which differ more from each other.
    """
    met = rows.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_runs, "sig long, node long")
    met, met_at = shared.write_table(met, "met")
    degree, degree_at = shared.write_table(met.groupBy("node").agg(F.count("*").alias("degree")), "degree")
    ranked = met.join(shared.small(degree), "node").groupBy("sig").agg(F.max_by("node", F.struct("degree", "node")).alias("hub"), F.count("*").alias("n"))
    found, _ = shared.write_table(met.join(ranked, "sig").select("sig", "node", "hub", "n"), "groups")
    shared.drop_tables(rows.sparkSession, met_at, degree_at)
    return found


def _pairs_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b, any columns) with both texts, left and right; texts: (node, text)."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    return pairs.join(right, "b").join(left, "a").select(*pairs.columns, "left", "right")


def _both_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """The columns of a pair (a, b, any others) and both sorted sets, of rows of _pairs_of()."""
    for batch in batches:
        size, done = batch.num_rows, 0
        left, right = batch.column("left"), batch.column("right")
        step = max(1, min(size, int((4 << 20) * size // max(1, left.nbytes + right.nbytes))))
        while done < size:
            m = min(step, size - done)
            own = [c.slice(done, m).to_pylist() for c in batch.columns[:-2]]
            x, xat = vectext.sets(vectext.words(left.slice(done, m)))
            y, yat = vectext.sets(vectext.words(right.slice(done, m)))
            for i in np.flatnonzero((signed(_node(x, xat)) == np.array(own[0])) & (signed(_node(y, yat)) == np.array(own[1]))):
                yield tuple(c[i] for c in own), x[xat[i] : xat[i + 1]], y[yat[i] : yat[i + 1]]
            done += m


def _held(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of sorted p sorted q has."""
    return q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets reach the threshold exactly; texts: (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = []
        for (a, b), p, q in _both_sets(batches):
            p, q = (p, q) if len(p) <= len(q) else (q, p)
            if 100 * len(p) >= percent * len(q):
                same = int(np.count_nonzero(_held(p, q)))
                if 100 * same >= percent * (len(p) + len(q) - same):
                    good.append((a, b))
            if len(good) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*good)], ["a", "b"])
                good = []
        if good:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*good)], ["a", "b"])

    return _pairs_of(pairs.select("a", "b"), texts).mapInArrow(run, "a long, b long").distinct()


def sketches(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (hub, node, component, probe, size, b0, b1, ...): a row for each of members (a, b, component, probe), with its set's size and sketch.

    The bits of a sketch tell for each of 64 * SKETCH residues whether an odd number of the set's shingles has it. Two sketches
    differ in at most as many bits as the sets do in shingles.
    """
    names = ["hub", "node", "component", "probe", "size", *_BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, _, v in _both_sets(iter([batch])):
                odd = np.bincount((v & U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1 == 1
                rows.append((*own, len(v), *np.packbits(odd).view(np.int64).tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    types = [f"{n} {'boolean' if n == 'probe' else 'long'}" for n in names]
    return _pairs_of(members.select("a", "b", "component", "probe"), texts).mapInArrow(run, ", ".join(types))


def close_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a hub's members in different components, one of them a probe, that can be linked by their sketches(): no linked pair is left out.

    Linked sets differ in at most f * (their sizes' sum) shingles, f the share of differences allowed, and so in no more bits. A first
    quarter of the bits rules out most pairs.
    """
    index = rows.select("hub", *(F.col(c).alias(f"v_{c}") for c in ("node", "component", "probe", "size", *_BITS)))
    probes = rows.where("probe").select(F.col("hub").alias("u_hub"), *(F.col(c).alias(f"u_{c}") for c in ("node", "component", "size", *_BITS)))
    apart = lambda bits: sum(F.bit_count(F.col(f"u_{b}").bitwiseXOR(F.col(f"v_{b}"))) for b in bits)
    most = (100 - percent) * (F.col("u_size") + F.col("v_size"))
    close = (F.col("hub") == F.col("u_hub")) & (F.col("u_component") != F.col("v_component")) & (~F.col("v_probe") | (F.col("u_node") < F.col("v_node")))
    close &= (100 * F.least("u_size", "v_size") >= percent * F.greatest("u_size", "v_size")) & ((100 + percent) * apart(_BITS[: SKETCH // 4]) <= most) & ((100 + percent) * apart(_BITS) <= most)
    return index.join(probes, close).select(F.least("u_node", "v_node").alias("a"), F.greatest("u_node", "v_node").alias("b")).distinct()


def _open(found: DataFrame, named: DataFrame) -> DataFrame:
    """found's rows of signatures whose nodes lie in several components, with component and hub_component."""
    rows = _named(found, named)
    several = rows.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("sig")
    kept = rows.join(several, "sig", "left_semi").withColumnRenamed("component", "c")
    return _named(kept, named, "hub").withColumnsRenamed({"component": "hub_component", "c": "component"})


def link_nodes(docs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Components (id, component) of the linked nodes; a component's smallest node is its name and not listed."""
    scratch = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        df, at = shared.write_table(df, label)
        scratch.append(at)
        return df

    hot = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs))
    found = groups(signature_rows(docs, percent, hot))
    pairs = found.where("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("votes"))
    # each node with the hub that shares most signatures
    tested = keep(pairs.groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a")).select("a", "b"), "tested")
    # texts of the nodes that are in any group, one row each (or more, of equal texts under one doc_id)
    some = tested.select(F.col("a").alias("node")).union(tested.select("b")).distinct()
    reps = keep(profiles.where("node is not null").groupBy("node").agg(F.min(F.struct("text_key", "doc_id")).alias("rep")).join(some, "node").select("node", "rep.*"), "reps")
    keyed = docs.select(F.xxhash64("text").alias("text_key"), "doc_id", "text").alias("d")
    texts = keyed.join(shared.small(reps).alias("r"), (F.col("d.text_key") == F.col("r.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id"))).select("r.node", "d.text")
    texts = keep(texts, "texts")
    edges = keep(verify(tested, texts, percent), "links")
    named = keep(shared.components(edges), "components")
    # where several components meet: the other hubs, and all pairs of small groups
    several = keep(_open(found, named), "open")
    hubs = several.where("component <> hub_component").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    x, y = (several.where(f"n <= {SMALL_GROUP}").select("sig", F.col("node").alias(c), F.col("component").alias(f"component_{c}")) for c in "ab")
    near = x.join(y, "sig").where("a < b and component_a <> component_b").select("a", "b")
    before = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = keep(hubs.union(near).distinct().join(before, ["a", "b"], "left_anti"), "rest")
    more = keep(verify(rest, texts, percent), "links")
    edges = edges.unionByName(more)
    named = keep(shared.components(edges), "components")
    # members of large groups that are still several components, by sketches
    large = _open(several.where(f"n > {SMALL_GROUP}").select("sig", "node", "hub"), named).where("node <> hub")
    members = keep(large.select(F.col("hub").alias("a"), F.col("node").alias("b"), "component", (F.col("component") != F.col("hub_component")).alias("probe")).distinct(), "members")
    met = close_pairs(keep(sketches(members, texts), "sketches"), percent)
    rest = keep(met.join(before.union(rest), ["a", "b"], "left_anti"), "rest")
    more = keep(verify(rest, texts, percent), "links")
    named, _ = shared.write_table(shared.components(edges.unionByName(more)), "components")
    shared.drop_tables(docs.sparkSession, *scratch)
    return named


def _named(rows: DataFrame, named: DataFrame, node: str = "node") -> DataFrame:
    """rows with their node's component: the node itself where it has no links."""
    other = shared.small(named.select(F.col("id").alias("__id"), F.col("component").alias("__c")))
    return rows.join(other, F.col(node) == F.col("__id"), "left").withColumn("component", F.coalesce("__c", node)).drop("__id", "__c")


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles (long), component_id (smallest doc_id of the component).

    Sets are of five-word shingles, words lower-cased in A-Z; a text of one to four words has its whole sequence as
    its one shingle; an empty or null text has no shingles, no links and its own doc_id as component_id. Rows of equal
    sets are linked. Rows with a null doc_id get the smallest doc_id of their component (null if it has none). Repeated rows stay. Other
    columns aren't read. An empty table gives an empty table.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    profiles, _ = shared.write_table(profile(rows), "profiles")
    named = link_nodes(rows, profiles, percent)
    nodes = _named(profiles.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")), named)
    smallest = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = nodes.join(smallest, "component").where("component_id is not null").select(F.col("node").alias("__node"), "component_id")
    out = profiles.join(by_node, F.col("node") == F.col("__node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay if one document of each component does, the one with the smallest doc_id; docs' own columns.

    Documents without words stay. Of repeated rows, equal in doc_id and text, one stays. A row with a null doc_id stays
    only where its component has no other doc_id.
    """
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    doc, body = names[doc_id], names[text]
    rows = own.select(F.col(doc).alias("doc_id"), F.col(body).alias("text"))
    profiles, _ = shared.write_table(profile(rows), "profiles")
    named = link_nodes(rows, profiles, percent)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    kinds = profiles.where("node is not null").groupBy("node").agg(F.min(order).alias("first"))
    best = _named(kinds, named).groupBy("component").agg(F.min("first").alias("best")).select("best.doc_id", "best.text_key")
    blank = profiles.where("node is null").select("doc_id", "text_key")
    kept, _ = shared.write_table(best.unionByName(blank).distinct(), "kept")
    again, _ = shared.write_table(profiles.where("node is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    same = F.col(doc).eqNullSafe(F.col("doc_id")) & (F.xxhash64(body) == F.col("text_key"))
    # fewer go than stay, so texts are held against those
    keys = profiles.select("doc_id", "text_key").distinct().alias("p")
    gone = keys.join(kept.alias("k"), F.col("p.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("p.text_key") == F.col("k.text_key")), "left_anti")
    gone, _ = shared.write_table(gone, "gone")
    stay = own.join(shared.small(gone, GONE_ROWS), same, "left_anti")
    once = stay.join(shared.small(again), same, "left_anti")
    twice = stay.join(shared.small(again), same, "left_semi").dropDuplicates([doc, body])
    return once.unionByName(twice).select(*(F.col(n).alias(c) for c, n in names.items()))
