"""Language-model scores of documents under a bigram backoff automaton that is counted from the corpus itself.

The automaton has a root and a state for each word that training texts hold (and one for a text's beginning). A state has an arc for each
word that follows it in training, with weight (c(h w) - D) / c(h) + f(h) p(w), and a failure arc to the root with weight f(h) =
D T(h) / c(h), where T(h) counts the state's arcs; the root's weights p(w) are counts plus one, over all words and one unknown word. A traversal
goes over a text from left to right, carries its state and adds up the logarithms of the weights.

The automaton grows with the corpus and is never in one place. Documents are packed into blocks of local word numbers. A block asks
for each of its distinct pairs of neighbours once. Questions go to the bucket of their first word, which so has all arcs of its states;
questions of hot words, at most HOT or one for HOT_TOKENS tokens, are spread over all buckets. Buckets answer with counts, and a block traverses its texts with its own arcs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bytes of text in a block (a longer text makes a longer block), and tokens that meet in a bucket, about.
BLOCK_BYTES, BUCKET_TOKENS, LEAST_BUCKETS = 6_000_000, 1_000_000, 64
#: A word is hot if it makes up more than one of so many training tokens, or more than so many: all its arcs would be in one bucket, which must not grow with the corpus.
HOT, HOT_TOKENS = 1_000, BUCKET_TOKENS // 10
#: Taken off each pair's count.
DISCOUNT = 0.75
#: A text's end and beginning: no word holds a space.
END, BEGIN = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" ", b"  "))

BLOCKS = "block long, doc_id array<long>, held_out array<boolean>, sizes array<int>, words array<long>, n array<int>, tokens binary"
QUESTIONS = "bucket long, block long, word binary, word_n binary, follow binary, hot binary, hot_follow binary, next binary, next_n binary"
ANSWERS = "block long, bucket long, word_n binary, arcs binary, next_n binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, first bytes first: what counts mostly share stands together."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


class _Block:
    """Documents as local word numbers; 0 is the end."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {b" ": 0}
        self.doc_ids, self.held, self.tokens, self.bytes, self.first = [], [], [], 0, None

    def add(self, doc_id, held: bool, uid: int, text: str | None) -> None:
        # bytes: lower() takes A-Z, split() goes at space and U+0009 to U+000D
        raw = (text or "").encode("utf-8", "replace").lower()
        numbers = self.numbers
        own = [numbers.setdefault(w, len(numbers)) for w in raw.split()]
        own.append(0)
        self.first = uid if self.first is None else self.first
        self.doc_ids.append(doc_id)
        self.held.append(bool(held))
        self.tokens.append(np.array(own, np.uint32))
        self.bytes += len(raw)

    def row(self) -> dict:
        tokens, sizes = np.concatenate(self.tokens), [len(t) for t in self.tokens]
        trains = np.repeat(~np.array(self.held), sizes)
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), np.uint64, len(self.numbers))
        n = np.bincount(tokens[trains], minlength=len(words))
        return {"block": self.first, "doc_id": self.doc_ids, "held_out": self.held, "sizes": sizes, "words": words.view(np.int64), "n": n.astype(np.int32), "tokens": _pack(tokens)}


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    of = lambda k: pa.list_(kinds[k[6:-1]]) if k.startswith("array<") else kinds[k]
    return pa.schema([(name, of(kind)) for name, kind in (f.split() for f in ddl.split(", "))])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, schema = _Block(), _schema(BLOCKS)
    for batch in batches:
        for values in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "uid", "text"))):
            block.add(*values)
            if block.bytes >= BLOCK_BYTES:
                yield _arrow([block.row()], schema)
                block = _Block()
    if block.doc_ids:
        yield _arrow([block.row()], schema)


class _Pairs:
    """A block's distinct pairs of neighbours, in the order of their buckets."""

    def __init__(self, row: dict, hot: np.ndarray, buckets: int):
        self.sizes, self.held = np.array(row["sizes"], np.int64), np.array(row["held_out"], bool)
        self.tokens = _unpack(row["tokens"])
        words = np.array(row["words"], np.int64).view(np.uint64)
        self.words, size = words, len(words)
        self.starts = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = size  # the beginning
        pairs, place = np.unique(before * size + self.tokens, return_inverse=True)
        trained = np.bincount(place, weights=np.repeat(~self.held, self.sizes), minlength=len(pairs))
        states = np.append(words, BEGIN)
        at = np.searchsorted(hot, states)
        self.hot = np.where((at < len(hot)) & (hot[np.minimum(at, len(hot) - 1)] == states), at, -1)
        first, second = pairs // size, pairs % size
        spread = self.hot[first] >= 0
        mixed = (states[first] * np.uint64(0x9E3779B97F4A7C15)) ^ words[second]
        bucket = (np.where(spread, mixed ^ (mixed >> np.uint64(31)), states[first]) % np.uint64(buckets)).astype(np.int64)
        # in a bucket: pairs of its own words, then spread ones, each by first word
        order = np.lexsort((spread, bucket))
        self.first, self.second, self.spread, self.bucket, self.trained = first[order], second[order], spread[order], bucket[order], trained[order].astype(np.int64)
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.arange(len(order))
        self.place = inverse[place]  # each token's pair
        self.word_bucket = (words % np.uint64(buckets)).astype(np.int64)
        self.word_order = np.argsort(self.word_bucket, kind="stable")
        self.pair_ends = np.searchsorted(self.bucket, np.arange(buckets + 1))
        self.word_ends = np.searchsorted(self.word_bucket[self.word_order], np.arange(buckets + 1))

    def questions(self, block: int, n: np.ndarray) -> Iterator[dict]:
        for b in range(len(self.pair_ends) - 1):
            i, j = self.pair_ends[b], self.pair_ends[b + 1]
            own = np.sort(self.word_order[self.word_ends[b] : self.word_ends[b + 1]])
            if j == i and not len(own):
                continue
            k = i + int(np.searchsorted(self.spread[i:j], True))
            hot, hot_follow = np.unique(self.hot[self.first[k:j]], return_counts=True)
            # the spread pairs in the order of their hot words' numbers
            yield {
                "bucket": b, "block": block, "word": self.words[own].tobytes(), "word_n": _pack(n[own]), "follow": _pack(np.searchsorted(self.first[i:k], own, "right") - np.searchsorted(self.first[i:k], own, "left")),
                "hot": _pack(hot), "hot_follow": _pack(hot_follow), "next": self.words[self.second[self.spread_order(i, k, j)]].tobytes(), "next_n": _pack(self.trained[self.spread_order(i, k, j)]),
            }

    def spread_order(self, i: int, k: int, j: int) -> np.ndarray:
        return np.concatenate([np.arange(i, k), k + np.argsort(self.hot[self.first[k:j]], kind="stable")])


def _ask(hot: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(QUESTIONS)
        for batch in batches:
            for row in batch.to_pylist():
                rows = list(_Pairs(row, hot, buckets).questions(row["block"], np.array(row["n"], np.int64)))
                for at in range(0, len(rows), 256):
                    yield _arrow(rows[at : at + 256], schema)

    return run


def _answer(hot: np.ndarray):
    """All questions to one bucket, answered: how often words and pairs are in training, and how many arcs its states have.

    Arcs of hot states, which are spread, are counted in a row without a block."""

    def run(table: pa.Table) -> pa.Table:
        schema = _schema(ANSWERS)
        asked = table.sort_by("block").to_pydict()
        rows = range(len(asked["block"]))
        words = [np.frombuffer(x, np.uint64) for x in asked["word"]]
        nexts = [np.frombuffer(x, np.uint64) for x in asked["next"]]
        known, place = np.unique(np.concatenate(words), return_inverse=True)
        places = np.split(place, np.cumsum([len(w) for w in words])[:-1])
        word_n = np.bincount(place, weights=np.concatenate([_unpack(x) for x in asked["word_n"]]), minlength=len(known))
        # the state of each pair: own words by place, hot ones behind them
        states = [np.concatenate([np.repeat(places[r], _unpack(asked["follow"][r])), len(known) + np.repeat(_unpack(asked["hot"][r]), _unpack(asked["hot_follow"][r]))]) for r in rows]
        state, word = np.concatenate(states).astype(np.uint64), np.concatenate(nexts)
        order = np.lexsort((word, state))
        state, word = state[order], word[order]
        new = np.ones(len(order), bool)
        new[1:] = (state[1:] != state[:-1]) | (word[1:] != word[:-1])
        number = np.cumsum(new) - 1
        counts = np.bincount(number, weights=np.concatenate([_unpack(x) for x in asked["next_n"]])[order])
        pair_n = np.empty(len(order))
        pair_n[order] = counts[number] if len(order) else 0
        arcs = np.bincount(state[new][counts > 0].astype(np.int64), minlength=len(known) + len(hot))
        split = np.split(pair_n, np.cumsum([len(x) for x in nexts])[:-1])
        bucket = asked["bucket"][0]
        out = [{"block": asked["block"][r], "bucket": bucket, "word_n": _pack_long(word_n[places[r]]), "arcs": _pack_long(arcs[places[r]]), "next_n": _pack_long(split[r])} for r in rows]
        return pa.Table.from_batches([_arrow([*out, {"block": None, "bucket": bucket, "word_n": None, "arcs": _pack_long(arcs[len(known) :]), "next_n": None}], schema)])

    return run


def _pack_long(numbers: np.ndarray) -> bytes:
    """As _pack(), for counts over all documents."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack_long(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel().astype(np.int64)


def _traverse(hot: np.ndarray, hot_arcs: np.ndarray, buckets: int, total: int, distinct: int, discount: float):
    """A block's texts scored: the state before each token, its arc or else its failure arc, and the sum over each text."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        pairs = _Pairs(row, hot, buckets)
        word_n, arcs, pair_n = np.zeros(len(pairs.words), np.int64), np.zeros(len(pairs.words) + 1, np.int64), np.zeros(len(pairs.first), np.int64)
        for a in answers.to_pylist():
            b = a["bucket"]
            own = np.sort(pairs.word_order[pairs.word_ends[b] : pairs.word_ends[b + 1]])
            word_n[own], arcs[own] = _unpack_long(a["word_n"]), _unpack_long(a["arcs"])
            i, j = pairs.pair_ends[b], pairs.pair_ends[b + 1]
            pair_n[pairs.spread_order(i, i + int(np.searchsorted(pairs.spread[i:j], True)), j)] = _unpack_long(a["next_n"])
        is_hot = pairs.hot >= 0
        arcs[is_hot] = hot_arcs[pairs.hot[is_hot]]
        left = np.append(word_n, word_n[0]).astype(float)  # how often each state is left; a text begins as often as one ends
        root = (word_n + 1) / (total + distinct + 1)
        failure = np.divide(discount * arcs, left, out=np.ones(len(left)), where=left > 0)  # a state that isn't there is the root itself
        arc = np.divide(np.maximum(pair_n - discount, 0), left[pairs.first], out=np.zeros(len(pair_n)), where=left[pairs.first] > 0)
        steps = np.log10(arc + failure[pairs.first] * root[pairs.second])[pairs.place]
        sums = lambda x: np.add.reduceat(x, pairs.starts)
        columns = [row["doc_id"], row["held_out"], pairs.sizes, sums((word_n > 0).astype(np.int64)[pairs.tokens]), sums(np.log10(root)[pairs.tokens]), sums(steps)]
        schema = _schema(SCORES)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", discount: float = DISCOUNT) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts of rows for which held_out is false (or null) are the training texts. A text's tokens are its words, A-Z in lower case, and one end; a null
    or empty text has the end only. n_known counts tokens that training has, train_tokens all of its tokens; base_score is the root's
    log10 probability of the text, score the automaton's. Without training texts all words are unknown. Rows of equal doc_id or
    text count one by one. An empty table gives an empty table. Only the two columns and those of held_out are read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.monotonically_increasing_id().alias("uid"), F.col(f"`{text}`").cast("string").alias("text"))
    blocks, _ = shared.write_table(rows.mapInArrow(_blocks, BLOCKS), "lm-blocks")
    words, path = shared.write_table(blocks.select(F.inline(F.arrays_zip("words", "n"))).where("n > 0").groupBy("words").agg(F.sum("n").alias("n")), "lm-words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a + s))).first()[0] or 0
    often = words.where((F.col("n") * HOT > total) | (F.col("n") > HOT_TOKENS)).select("words").collect()  # fewer than HOT, or than one in HOT_TOKENS tokens
    shared.drop_tables(docs.sparkSession, path)
    hot = np.sort(np.append(np.array([r[0] for r in often], np.int64).view(np.uint64), BEGIN))
    buckets = max(LEAST_BUCKETS, -(-tokens // BUCKET_TOKENS))
    questions = blocks.select(*_names(BLOCKS)).mapInArrow(_ask(hot, buckets), QUESTIONS)
    answers, _ = shared.write_table(questions.groupBy("bucket").applyInArrow(_answer(hot), ANSWERS), "lm-answers")
    hot_arcs = np.zeros(len(hot), np.int64)
    arcs = answers.where("block IS NULL").select("arcs").mapInArrow(_hot_arcs, "hot int, n long").groupBy("hot").agg(F.sum("n"))
    for k, n in arcs.collect():  # a row for each hot word
        hot_arcs[k] = n
    run = _traverse(hot, hot_arcs, buckets, total, distinct, discount)
    scored = blocks.groupBy("block").cogroup(answers.where("block IS NOT NULL").groupBy("block")).applyInArrow(run, SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _hot_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = sum((_unpack_long(x) for x in batch.column("arcs").to_pylist()), np.int64(0))
        sums = np.atleast_1d(sums) if batch.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums, pa.int64())], ["hot", "n"])
