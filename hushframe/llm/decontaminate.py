"""Benchmark passages in documents (DataFrame functions only): SimHash of item-sized windows, searched by Hamming blocks.

A window can reach a similarity above 0 only where it shares a shingle with an item, so windows are laid at each place
where a document has any shingle of the benchmark, shifted as in the item and as long as that item. Every such window
gets a SimHash of its shingles. Of BLOCKS blocks of bits two fingerprints that differ in at most RADIUS bits have one in which they
differ in FLIPS bits at most, so a join of the windows' blocks with the items' blocks, flipped in every such way, finds all
windows and items of one length within the radius. Fingerprints count shingles, not their weights, so windows that are similar
by weight may differ in more bits: those are found by the items' heaviest shingles, one of which each of them has. An exact
weighted Jaccard similarity of the shingles then decides.

Equal texts are searched once: results are held by a 128-bit key of the text and joined back to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Words of a shingle; bits that a candidate's fingerprints may differ in; blocks of bits.
SHINGLE, RADIUS, BLOCKS = 5, 15, 8
#: Bits of a block, and how many of them differ at most in one of the blocks: RADIUS // BLOCKS, for which blocks() is written.
BITS, FLIPS = 64 // BLOCKS, 1
_LANES = 0x0000000100000001
#: What names a window.
PLACE = ["k1", "k2", "start", "n_words", "gram"]


@dataclass(frozen=True)
class Benchmark:
    """items: (item_id, i, n_words, gram, grams, print, weight), of one row for each item with words; i names its length and shingles.

    shingles: (i, g, c, w), the times c that i has shingle g, of weight w; outside: the weight of a shingle that one item has or none.
    """

    items: DataFrame
    shingles: DataFrame
    outside: float


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """k1 and k2, the key of the text, and its words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit("key"), whole).alias("k2"), shared.words(F.lower(whole)).alias("words"))


def fingerprint(grams: str) -> list[tuple[str, Column]]:
    """Steps (name, column) that lead to `print`, the SimHash of an array of hashes; later steps use earlier ones.

    Two of 32 bits' counts lie in one long at a time, so 32 sums give all 64 counts, of any array's length.
    """
    lanes = [(f"__s{j}", F.expr(f"aggregate(`{grams}`, 0L, (a, x) -> a + (shiftrightunsigned(x, {j}) & {_LANES}L))")) for j in range(32)]
    bit = lambda j, i: f"(case when 2 * (shiftrightunsigned(__s{j}, {32 * i}) & 4294967295L) > size(`{grams}`) then shiftleft(1L, {32 * i + j}) else 0L end)"
    return [*lanes, ("print", F.expr(" | ".join(bit(j, i) for i in range(2) for j in range(32))))]


def with_print(df: DataFrame, grams: str) -> DataFrame:
    *lanes, (name, whole) = fingerprint(grams)
    return df.withColumns(dict(lanes)).withColumn(name, whole).drop(*(n for n, _ in lanes))


def blocks(df: DataFrame, flips: int = 0) -> DataFrame:
    """df with a row for each block of `print`: its number and its bits; and, for flips = 1, for each way to change one bit of it."""
    parts = F.array(*(F.expr(f"shiftrightunsigned(print, {BITS * i}) & {(1 << BITS) - 1}L") for i in range(BLOCKS)))
    cut = df.select("*", F.posexplode(parts).alias("block", "bits"))
    if not flips:
        return cut
    return cut.withColumn("bits", F.explode(F.array("bits", *(F.col("bits").bitwiseXOR(F.lit(1 << i)) for i in range(BITS)))))


def items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Benchmark:
    """The benchmark's items that have words.

    gram: words of a shingle, 5 or all the item has. A shingle that df of all N items have weighs 1 + ln(N / df).
    """
    base = benchmark.select(F.col(item_id).alias("item_id"), shared.words(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("w")).where(F.size("w") > 0)
    sized = base.withColumn("n_words", F.size("w")).withColumn("gram", F.least(F.lit(SHINGLE), F.size("w")))
    grams = F.when(F.col("gram") == SHINGLE, shared.grams(F.col("w"), SHINGLE))
    for k in range(1, SHINGLE):
        grams = grams.when(F.col("gram") == k, shared.grams(F.col("w"), k))
    table = with_print(sized.withColumn("grams", grams).drop("w").withColumn("i", F.xxhash64("n_words", "grams")), "grams")
    table, table_at = shared.write_table(table, "items")
    n = float(max(table.count(), 1))
    same = table.groupBy("i").agg(F.first("grams").alias("grams"), F.count("*").alias("items"))  # items of equal texts
    counted = same.select("i", "items", F.explode("grams").alias("g")).groupBy("i", "items", "g").agg(F.count("*").alias("c"))
    df = counted.groupBy("g").agg(F.sum("items").alias("df"))
    rows, _ = shared.write_table(counted.join(df, "g").select("i", "g", "c", (1 + F.log(F.lit(n) / F.col("df"))).alias("w")), "shingles")
    weight = rows.groupBy("i").agg(F.sum(F.col("c") * F.col("w")).alias("weight"))
    items, _ = shared.write_table(table.join(weight, "i"), "items")
    shared.drop_tables(benchmark.sparkSession, table_at)
    return Benchmark(items, rows, float(items.sparkSession.range(1).select(1 + F.log(F.lit(n))).first()[0]))


def windows(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Rows (k1, k2, start, n_words, gram, window): each item-sized window once that has an item's shingle in its place."""
    anchors = items.select("gram", "n_words", F.posexplode("grams").alias("offset", "g")).distinct()
    few = anchors.limit(shared.BROADCAST_ROWS + 1).count() <= shared.BROADCAST_ROWS
    keyed = _keyed(docs, text)
    out = None
    for (k,) in items.select("gram").distinct().collect():  # 5 values at most
        own = anchors.where(F.col("gram") == k)
        arrays = keyed.select("k1", "k2", shared.grams(F.col("words"), k).alias("grams"), F.size("words").alias("n"))
        start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("offset"), F.col("n") - F.col("n_words")))
        if few:  # arrays stay with their rows, which no shuffle sees before shingles have been matched
            hits = arrays.select("k1", "k2", "n", "grams", F.posexplode_outer("grams").alias("pos", "g")).join(F.broadcast(own), "g")
            cut = hits.select("k1", "k2", start.alias("start"), "n_words", "gram", "grams").withColumn("window", F.slice("grams", F.col("start") + 1, F.col("n_words") - F.col("gram") + 1)).drop("grams")
        else:
            hits = arrays.select("k1", "k2", "n", F.posexplode_outer("grams").alias("pos", "g")).join(own, "g").select("k1", "k2", start.alias("start"), "n_words", "gram").distinct()
            cut = hits.join(arrays.dropDuplicates(["k1", "k2"]), ["k1", "k2"]).withColumn("window", F.slice("grams", F.col("start") + 1, F.col("n_words") - F.col("gram") + 1)).drop("grams", "n")
        out = cut if out is None else out.unionByName(cut)
    if out is None:
        out = keyed.select("k1", "k2", F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0).alias("gram"), F.array().cast("array<bigint>").alias("window")).limit(0)
    return out.groupBy(*PLACE).agg(F.first("window").alias("window"))


def within(found: DataFrame, bench: Benchmark) -> DataFrame:
    """Rows (PLACE, i): windows and items of one length whose fingerprints differ in up to RADIUS bits."""
    index = blocks(bench.items.select("i", "n_words", "gram", F.col("print")).distinct(), FLIPS).withColumnRenamed("print", "item_print")
    probes = blocks(found.select(*PLACE, "print"))
    met = probes.join(shared.small(index), ["n_words", "gram", "block", "bits"])
    return met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select(*PLACE, "i").distinct()


def heaviest(found: DataFrame, bench: Benchmark, percent: int) -> DataFrame:
    """Rows (PLACE, i): windows with one of an item's heaviest shingles, which each window that is similar enough has.

    An item's shingles, heaviest first, end in ones that weigh less together than the threshold asks of what is shared.
    """
    order = Window.partitionBy("i").orderBy(F.desc("w"), "g").rowsBetween(Window.unboundedPreceding, -1)
    before = bench.shingles.withColumn("before", F.coalesce(F.sum(F.col("c") * F.col("w")).over(order), F.lit(0.0)))
    sizes = bench.items.select("i", "n_words", "gram", "weight").distinct()
    first = before.join(sizes, "i").where(F.col("before") <= (1 - percent / 100 + 1e-9) * F.col("weight")).select("i", "n_words", "gram", "g")
    kinds = found.select(*PLACE, F.explode(F.array_distinct("window")).alias("g"))
    return kinds.join(shared.small(first), ["n_words", "gram", "g"]).select(*PLACE, "i").distinct()


def scored(pairs: DataFrame, found: DataFrame, bench: Benchmark, percent: int) -> DataFrame:
    """Rows (PLACE, i, similarity) of those pairs that reach the threshold; sums over shingles, so a long item takes no more than its length."""
    held = found.join(pairs.select(*PLACE).distinct(), PLACE, "left_semi").select(*PLACE, F.explode("window").alias("g")).groupBy(*PLACE, "g").agg(F.count("*").alias("h"))
    known = bench.shingles.select("g", "w").distinct()
    weighed = held.join(shared.small(known), "g", "left").withColumn("w", F.coalesce("w", F.lit(bench.outside)))
    weighed, path = shared.write_table(weighed, "held")
    own = weighed.groupBy(*PLACE).agg(F.sum(F.col("h") * F.col("w")).alias("own"))
    both = pairs.join(weighed.select(*PLACE, "g", "h"), PLACE).join(shared.small(bench.shingles), ["i", "g"])
    common = both.groupBy(*PLACE, "i").agg(F.sum(F.least("h", "c") * F.col("w")).alias("common"))
    weights = bench.items.select("i", "weight").distinct()
    out = common.join(own, PLACE).join(shared.small(weights), "i").withColumn("similarity", F.col("common") / (F.col("own") + F.col("weight") - F.col("common")))
    out, _ = shared.write_table(out.where(F.col("similarity") >= percent / 100 - 1e-9).select(*PLACE, "i", "similarity"), "scored")
    shared.drop_tables(pairs.sparkSession, path)
    return out


def search(docs: DataFrame, bench: Benchmark, percent: int = 80, text: str = "text") -> DataFrame:
    """Rows (k1, k2, item_id, start_word, n_words, similarity): the best place of each item in each text that has it."""
    found, found_at = shared.write_table(with_print(windows(docs, bench.items, text), "window"), "windows")
    pairs, pairs_at = shared.write_table(within(found, bench).union(heaviest(found, bench, percent)).distinct(), "pairs")
    good = scored(pairs, found, bench, percent).join(shared.small(bench.items.select("i", "item_id")), "i")
    best = good.groupBy("k1", "k2", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words")).alias("b"))
    shared.drop_tables(docs.sparkSession, found_at, pairs_at)
    return best.select("k1", "k2", "item_id", (-F.col("b.s")).cast("long").alias("start_word"), F.col("b.n_words").cast("long").alias("n_words"), F.round("b.similarity", 6).alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row (doc_id, item_id, start_word, n_words, similarity) for each row of docs and item found in it: the best place.

    Words are lower-cased and set apart by [\\x20\\x09-\\x0D]+; similarity is the weighted Jaccard similarity of
    five-word shingles with their counts, of the window that is as long as the item. Items of one to four words are matched as
    their one shingle; items without words match nothing; null texts are empty. Rows with equal texts have equal
    results; a null doc_id or item_id is carried. Empty tables give an empty table. Of equally similar places the first counts.
    """
    items = items_of(benchmark, item_id, item_text)
    hits, _ = shared.write_table(search(docs, items, percent, text), "leaks")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit("key"), whole).alias("k2"))
    return rows.join(shared.small(hits), ["k1", "k2"]).drop("k1", "k2")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, text: str = "text") -> DataFrame:
    """The rows of docs in which no item is found, with docs' own columns."""
    hits, _ = shared.write_table(search(docs, items_of(benchmark), percent, text), "leaks")
    keys = hits.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.join(shared.small(keys), (F.xxhash64(whole) == F.col("__k1")) & (F.xxhash64(F.lit("key"), whole) == F.col("__k2")), "left_anti")
