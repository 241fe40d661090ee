"""Language-model scores, Merkle manifests and tokenizer alignment against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hushframe.llm import align, lm, manifest

from . import helpers as H

public_tokenizers = pytest.importorskip("public_tokenizers")
#: Extra columns have names that the operators use themselves.
EXTRA = "doc_id long, source string, lang string, n_chars long, text string, src string, leaf string, i long, n long, uid long, block long, words string, a string, b string, pairs string"


def table(spark, rows):
    """rows of doc_id, source, text."""
    return spark.createDataFrame([(d, s, "en" if d and d % 2 else None, None if t is None else len(t), t, "x", "y", 1, 2, 3, 4, "w", "a", "b", "p") for d, s, t in rows], EXTRA)


def texts(seed=0, n=60):
    rng = random.Random(seed)
    out = [H.prose(rng, rng.randrange(1, 60), 40) for _ in range(n)]
    return out + ["", None, " \t\n", "The THE the\x0bthe", "É é", "line\nline\n\n", "word " * 3000, "x" * 5000, out[0], out[0]]


# ---- manifests


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def merkle(rows, fanout, changed):
    """(source, doc_id, leaf, subroot, root, proof, folded root) of each row, level by level."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(d, s, t, shown):
        return sha("".join(map(field, (d, s, "en" if d and d % 2 else None, None if t is None else len(t), shown))))

    def climb(nodes):
        ways = [[] for _ in nodes]
        owners = [[k] for k in range(len(nodes))]
        original = [leaf_ for leaf_ in nodes]
        while len(nodes) > 1:
            runs = [range(k, min(k + fanout, len(nodes))) for k in range(0, len(nodes), fanout)]
            for run in runs:
                for k in run:
                    for own in owners[k]:
                        ways[own].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
            owners = [[o for k in run for o in owners[k]] for run in runs]
            nodes = [sha("".join(nodes[k] for k in run)) for run in runs]
        return nodes[0], ways, original

    by = defaultdict(list)
    for d, s, t in rows:
        by[s].append((d is not None, d, leaf(d, s, t, t), t))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: climb([x[2] for x in sorted(by[s], key=lambda x: (x[0], x[1] or 0, x[2]))]) for s in names}
    root, ways, _ = climb([tops[s][0] for s in names])
    out = []
    for s, above in zip(names, ways):
        for (_, d, own, t), way in zip(sorted(by[s], key=lambda x: (x[0], x[1] or 0, x[2])), tops[s][1]):
            acc = leaf(d, s, t, changed(d, t))
            for before, after in way + above:
                acc = sha(before + acc + after)
            out.append((s, d, own, tops[s][0], root, sha("".join(b + a for b, a in way + above)), acc))
    return out


@pytest.mark.parametrize("fanout, crowded, limit", [(3, manifest.CROWDED, 1 << 12), (2, 8, 2), (5, 1 << 30, 3)])
def test_manifest(spark, monkeypatch, fanout, crowded, limit):
    monkeypatch.setattr(manifest, "CROWDED", crowded)
    monkeypatch.setattr(manifest, "LEVELS", 2)
    monkeypatch.setattr(manifest.text_ranks, "__defaults__", (limit,))
    rng = random.Random(fanout)
    sources = [None, "", "a", "aé", "host/long/name/1", "host/long/name/2", "host/long/name", "é", "z", "💡"]
    rows = [(i * 5000 - 40_000, sources[i % len(sources)], t) for i, t in enumerate(texts(1))]
    rows += [(7, "hot", f"text {k % 9}\n") for k in range(60)] + [(None, "hot", str(k)) for k in range(5)] + [((1 << 62) + k, "hot", "x\ny") for k in range(3)] + [(1, "alone", "one")]
    rng.shuffle(rows)
    hit = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0, F.lit(False))
    out = manifest.manifest(table(spark, rows).repartition(3), tampered={"text": F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}, fanout=fanout).collect()
    changed = lambda d, t: t.replace("\n", "") if t and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else t
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted([(r.source, r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in out], key=key)
    assert got == sorted(merkle(rows, fanout, changed), key=key)
    assert all(r.verified == (r.folded_root == r.root) for r in out) and 0 < sum(r.verified for r in out) < len(out)


def test_manifest_of_few(spark):
    assert manifest.manifest(table(spark, [])).collect() == []
    (only,) = manifest.manifest(table(spark, [(3, "s", "t")])).collect()
    assert only.leaf == only.subroot == only.root and only.proof_sha256 == sha("") and only.verified


def test_text_ranks(spark):
    rng = random.Random(5)
    names = {"".join(rng.choice("abé/💡") for _ in range(rng.randrange(12))) for _ in range(300)} | {"common/prefix/" * 9 + str(k) for k in range(120)}
    got = {r.src: r.i for r in manifest.text_ranks(spark.createDataFrame([(n,) for n in names], "src string"), 7).collect()}
    assert sorted(names, key=str.encode) == sorted(got, key=got.get) and sorted(got.values()) == list(range(len(names)))


# ---- language models


def plain_scores(rows, d=lm.DISCOUNT):
    """(doc_id, held, n_tokens, n_known, N, base, score) of (doc_id, held, text)."""
    tokens = [(i, h, H.words(t) + [" "]) for i, h, t in rows]
    known, arcs = Counter(), defaultdict(Counter)
    for _, held, w in tokens:
        if not held:
            known.update(w)
            for x, y in zip(["  ", *w], w):
                arcs[x][y] += 1
    total = sum(known.values())
    root = lambda w: (known[w] + 1) / (total + len(known) + 1)

    def step(h, w):
        if h not in arcs:
            return root(w)
        n = sum(arcs[h].values())
        return max(arcs[h][w] - d, 0) / n + d * len(arcs[h]) / n * root(w)

    return [(i, h, len(w), sum(known[x] > 0 for x in w), total, sum(math.log10(root(x)) for x in w), sum(math.log10(step(x, y)) for x, y in zip(["  ", *w], w))) for i, h, w in tokens]


@pytest.mark.parametrize("block, hot, least", [(lm.BLOCK_BYTES, lm.HOT, lm.LEAST_BUCKETS), (300, 5, 3), (1, 1_000_000, 7)])
def test_lm_scores(spark, monkeypatch, block, hot, least):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "LEAST_BUCKETS", least)
    rows = [(None if k == 3 else k, "s", t) for k, t in enumerate(texts(2))]
    out = lm.score(table(spark, rows).repartition(4), F.col("doc_id") % 7 == 2).collect()
    want = plain_scores([(d, d is not None and d % 7 == 2, t) for d, _, t in rows])
    got = {r.doc_id: r for r in out}
    assert len(out) == len(want)
    for i, h, n, known, total, base, score in want:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-8) and r.score == pytest.approx(score, abs=1e-8)


def test_lm_words_that_would_fill_a_bucket_are_spread(spark, monkeypatch):
    """However rare among all tokens a word is, a bucket doesn't get all its arcs once it has many."""
    monkeypatch.setattr(lm, "HOT", 1)  # no word is more than all tokens
    monkeypatch.setattr(lm, "HOT_TOKENS", 30)
    spread = []
    answer = lm._answer
    monkeypatch.setattr(lm, "_answer", lambda hot: spread.append(len(hot)) or answer(hot))
    rng = random.Random(8)
    rows = [(i, "s", " ".join(f"w{rng.randrange(40)}" for _ in range(30))) for i in range(60)]
    train = Counter(w for i, _, t in rows if i % 7 != 2 for w in t.split())
    out = {r.doc_id: r for r in lm.score(table(spark, rows), F.col("doc_id") % 7 == 2).collect()}
    assert spread == [sum(n > 30 for n in [*train.values(), sum(i % 7 != 2 for i, _, _ in rows)]) + 1] and spread[0] > 20  # the end and the beginning, too
    for i, *_, score in plain_scores([(i, i % 7 == 2, t) for i, _, t in rows]):
        assert out[i].score == pytest.approx(score, abs=1e-8)


def test_lm_of_few(spark):
    assert lm.score(table(spark, []), F.lit(False)).collect() == []
    (r,) = lm.score(table(spark, [(1, "s", "a b")]), F.lit(True)).collect()  # no training text at all
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_lm_beats_single_words_on_held_out_text(spark):
    rng = random.Random(3)
    after = {f"w{k}": [f"w{rng.randrange(80)}" for _ in range(4)] for k in range(80)}

    def walk():
        w = ["w0"]
        for _ in range(80):
            w.append(rng.choice(after[w[-1]]))
        return " ".join(w)

    rows = [(k, "s", walk()) for k in range(300)]
    sums = lm.score(table(spark, rows), F.col("doc_id") % 7 == 2).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert sums[0] / sums[2] > -1.0 > -1.6 > sums[1] / sums[2]  # log10 of four ways, and of eighty


# ---- alignment


def plain_alignment(all_texts):
    """Token by token with both libraries, all links listed."""
    import sentencepiece
    from tokenizers import Tokenizer

    from hushframe.llm.bpe import byte_letters

    ours = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours.encode_special_tokens = True
    theirs = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = {c: b for b, c in enumerate(byte_letters())}
    docs = []
    for t in all_texts:
        a = ours.encode(" " + t, add_special_tokens=False).ids if t else []
        b = theirs.encode(t) if t else []
        a_bytes = [bytes(byte[c] for c in ours.id_to_token(i)) for i in a]
        names = [theirs.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(n[3:5], 16)]) if n.startswith("<0x") and len(n) == 6 else n.replace("▁", " ").encode() for n in names]
        if not t or not b"".join(a_bytes) == b"".join(b_bytes) == b" " + t.encode():
            docs.append(([], [], []))
            continue
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 3000 else list(__import__("itertools").accumulate(map(len, parts)))
        at_a, at_b = ends(a_bytes), ends(b_bytes)
        groups, last = [], 0
        for cut in sorted(set(at_a) & set(at_b)):
            groups.append(([x for x, e in zip(a, at_a) if last < e <= cut], [x for x, e in zip(b, at_b) if last < e <= cut]))
            last = cut
        docs.append((a, b, groups))
    links = [[(x, y) for xs, ys in g for x in xs for y in ys] for _, _, g in docs]
    n = Counter(p for own in links for p in set(own))
    most = defaultdict(int)
    for (x, _), c in n.items():
        most[x] = max(most[x], c)
    digest = lambda g: hashlib.sha256(";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g).encode()).hexdigest() if g else ""
    return [(len(a), len(b), len(g), len(own), sum(n[p] == most[p[0]] for p in own), sum(n[p] for p in own), digest(g)) for (a, b, g), own in zip(docs, links)]


ODD = ["", None, " a", "a ", "a  b", "x\n y", " \n", "▁x", "a\t b", "ﬁ é é", "<|endoftext|> <s> <0x41>", "😀😀 👩‍👩‍👧", "a" * 700, "ab" * 400 + " z", "　x y", "नमस्ते दुनिया", "x   y", "中文字符测试，没有空格" * 9, "don't 12345 §§", "\x00\x1f", "a b c\xa0d"]


@pytest.mark.parametrize("broadcast, together, keep, wide", [(align.BROADCAST_PAIRS, align.TOGETHER, align.KEEP_WORDS, align.WIDE), (40, 50, 10, 1)])
def test_alignment(spark, monkeypatch, broadcast, together, keep, wide):
    monkeypatch.setattr(align, "TOGETHER", together)
    monkeypatch.setattr(align, "KEEP_WORDS", keep)
    monkeypatch.setattr(align, "WIDE", wide)
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    assert align.Aligner(*paths).align(["a b"])["n_groups"].tolist() == [2]
    rows = [(k, "s", t) for k, t in enumerate(ODD + [t for t in texts(4, 30) if t and len(t) < 4000])] + [(None, "s", "a text without an id")]
    out = align.alignment(table(spark, rows).repartition(3), *paths, broadcast_pairs=broadcast).collect()
    got = {r.doc_id: tuple(r)[1:] for r in out}
    assert len(out) == len(rows) and got == {d: w for (d, _, _), w in zip(rows, plain_alignment([t for _, _, t in rows]))}


def test_alignment_of_none(spark):
    assert align.alignment(table(spark, []), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).collect() == []


def test_encoders_agree_on_all_code_points():
    """The word encoder splits at the same characters as the library of the vocabulary file."""
    from tokenizers import Tokenizer

    ours = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode, _ = align._byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    probes = ["".join(f"a{c}1{c} {c}!{c}{c}" for c in chars[k : k + 8]) for k in range(0, len(chars), 8)]
    assert [e.ids for e in ours.encode_batch_fast(probes, add_special_tokens=False)] == [encode(p) for p in probes]
