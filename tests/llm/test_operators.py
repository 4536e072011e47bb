"""The operators against brute force, and on nulls, empty tables, ties, repeats and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from pagequarry.llm import byte_bpe, fingerprints, html_text, jaccard, language, packing, quality, queries, substring_dedup, token_output, topk, word_tokens

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, part string, n int"
LONG = " ".join(f"word{i % 997}" for i in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs away from all of the bears in the dark old wood near here. "
    texts = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (5, "one"), (5, "one"), (6, "Two words"), (7, LONG), (8, base * 4), (9, base * 4 + "end"), (None, base), (None, None), (10, "naïve Ünï ﬁ 漢字 😀 ́x"), (11, "!!! ???"), (12, base)]
    return spark.createDataFrame([(i, t, None, None, None, "c", "p", 1) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{FOLDER}/documents.parquet")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(texts, n, num, den):
    """By id: set size, component and number of links."""
    sets = {i: shingles(t, n) for i, t in texts.items()}
    parent, degree = {i: i for i in sets}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in seen[s])
        for j, k in shared.items():
            if den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
                degree.update((i, j))
        for s in sets[i]:
            seen[s].append(i)
    return {i: (len(sets[i]), root(i), degree[i]) for i in sets}


@pytest.mark.parametrize("measure", [jaccard.Measure(3, 90, 100), jaccard.Measure(5, 80, 100)])
@pytest.mark.parametrize("long_list", [2, 1024])
def test_jaccard_on_edited_copies(spark, measure, long_list, monkeypatch):
    """Copies with few edits, so that many pairs are near the threshold; a low bound makes tokens frequent, another splits lists."""
    monkeypatch.setattr(jaccard, "LIST", long_list)
    rng = random.Random(5)
    texts, k = {}, 0
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            texts[k] = " ".join(copy)
            k += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components(texts, measure.words, measure.num, measure.den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, measure, frequent=3).collect()} == {i: x[:2] for i, x in want.items()}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.linked(df, measure, frequent=3).collect()} == want


def test_op1_whole_table(spark, docs):
    want = brute_components(dict(zip(docs.doc_id, docs.text, strict=True)), 3, 90, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_jaccard_join(spark, FOLDER).collect()} == {i: x[:2] for i, x in want.items()}
    linked = jaccard.linked(spark.read.parquet(f"{FOLDER}/documents.parquet"), jaccard.Measure(3, 90, 100))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in linked.collect()} == want


def test_jaccard_odd(odd, none):
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.join(odd, jaccard.Measure(3, 90, 100)).collect()), key=str)
    assert (1, 1) in got and (2, 2) in got and got.count((5, 4)) == 2 and (None, None) in got and (9, 8) in got
    assert len(got) == 15 and jaccard.join(none).count() == 0 and jaccard.linked(none).count() == 0
    links = sorted(((r.doc_id, r.n_links) for r in jaccard.linked(odd, jaccard.Measure(3, 90, 100)).collect()), key=str)
    assert (1, 0) in links and (None, 0) in links and links.count((5, 2)) == 2 and (4, 2) in links and {(8, 2), (9, 1), (12, 1)} <= set(links)
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 8, 10, 11]  # 9 is near 8, and 12 has 20 of its 24 shingles
    assert kept.where("doc_id is null").count() == 2


def test_tokens_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokens.default_path())
    files = token_output.write_tokens(odd, block_ids=500)
    got = token_output.read_tokens(spark, files).orderBy("start").collect()
    want = Counter((r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in odd.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    names = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert names == sorted(names)
    assert token_output.read_tokens(spark, token_output.write_tokens(none)).count() == 0


@pytest.mark.parametrize(("bits", "top"), [(1, 1 << 16), (2, 1 << 32)])
def test_rank_code(bits, top):
    for n in (0, 1, 7, 8, 9, 1000):
        ranks = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
        ranks[::2] //= 5000
        control, data = token_output.encode_ranks(ranks, bits)
        back, used = token_output.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n, bits)
        assert (back == ranks).all() and used == len(data)


def test_word_encoder_is_the_library():
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(word_tokens.default_path()), random.Random(3)
    alphabet = "aabcd  \n\t12é!!'s't ßÄ²½\xa0\xad\x0b\x1c\x85ΣİIȩ́漢😀<|endoftext|>Q,."
    own = word_tokens.WordEncoder(word_tokens.default_path(), cached_words=50)
    for i in range(800):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(80)))
        if i % 4 == 0:
            text = "".join(rng.choice([text[:9], "<|endoftext|>", "<|startoftext|>", " ", "<|", "|>"]) for _ in range(6))
        assert next(own.documents([text], 1)).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_vocabulary_that_spans_blanks():
    """One whose pieces hold blanks goes through the library text by text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, own = Tokenizer.from_file(path), word_tokens.WordEncoder(path)
    for text in ("", "two words  here\n and 'tis so", "naïve 漢字 😀 <|endoftext|> x"):
        assert own.split is None and next(own.documents([text], 1)).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def tiktoken_own():
    import base64

    import public_tokenizers
    import tiktoken

    with open(byte_bpe.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_chunks_of_byte_bpe(tiktoken_own):
    bpe, rng = byte_bpe.coder(byte_bpe.default_path()), random.Random(4)
    for i in range(600):
        text = "".join(rng.choice("aab  \n\t12é!!'s't're 'll漢😀 x") for _ in range(rng.randrange(120)))
        text = text.replace("b", "a" * 17) if i % 3 == 0 else text
        for chunk, overlap in ((16, 4), (20, 8), (12, 1)):
            assert byte_bpe.encode_text(bpe, text, chunk, overlap) == tiktoken_own.encode_ordinary(text)


def test_op5_whole_table(spark, docs, tiktoken_own):
    """Every row against the library; most characters go through stitched chunks."""
    got = {r.doc_id: r for r in queries.op5_byte_bpe(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = tiktoken_own.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    sizes = docs.text.str.len()
    assert sizes[sizes > byte_bpe.CHUNK].sum() > 0.8 * sizes.sum()


def test_byte_bpe_odd(odd, none):
    got = byte_bpe.decode(byte_bpe.encode(odd, chunk=1000, overlap=50))
    assert Counter((r.doc_id, bytes(r.bytes)) for r in got.collect()) == Counter((r.doc_id, (r.text or "").encode()) for r in odd.collect())
    assert byte_bpe.encode(none, form=byte_bpe.Digests).count() == 0


def test_byte_bpe_dealt_over_tasks(spark, tiktoken_own):
    """Long texts whose chunks meet, and one with a pre-token longer than the overlap."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("aab  \n12é!!'s'll漢😀 x") for _ in range(rng.randrange(900))) for _ in range(30)] + ["ab " * 200 + "c" * 300 + " d" * 200, "1" * 700, ""]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(3, texts[3], 1, 2)], "doc_id long, text string, row int, k int")
    got = byte_bpe.encode(df, form=byte_bpe.Ids, dealt=200, dealt_overlap=20, chunk=50, overlap=8).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, np.array(tiktoken_own.encode_ordinary(t), "<u4").tobytes()) for i, t in [*enumerate(texts), (3, texts[3])])
    digests = byte_bpe.encode(df, form=byte_bpe.Digests, dealt=200, dealt_overlap=20).where("doc_id = 5").first()
    assert digests.ids_sha256 == hashlib.sha256(" ".join(map(str, tiktoken_own.encode_ordinary(texts[5]))).encode()).hexdigest()


def check_packing(rows, size):
    where = defaultdict(list)
    for r in rows:
        where[r.sequence_id].append((r.offset, r.length))
    for parts in where.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(where)


def test_packing(spark, odd, none):
    rows = packing.pack(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()
    assert check_packing(rows, 4096) <= 1.01 * -(-sum(r.length for r in rows) // 4096) + 1
    rows = packing.pack(odd, size=64).collect()
    check_packing(rows, 64)
    assert sum(r.piece == 0 for r in rows) == 15 and all(r.length == 64 for r in rows if (r.doc_id, r.piece) == (7, 0))
    assert packing.pack(none).count() == 0
    ids = next(word_tokens.encoder(word_tokens.default_path()).documents([LONG], 1))
    assert sorted((r.start, r.ids_crc32) for r in rows if r.doc_id == 7) == [(s, zlib.crc32(ids[s : s + 64].astype("<u4").tobytes())) for s in range(0, len(ids), 64)]


def test_op10_whole_table(spark, docs):
    """Every piece of every document against the library's ids, and the sequences without gaps."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokens.default_path())
    rows = queries.op10_packing(spark, FOLDER).collect()
    want = Counter()
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert check_packing(rows, 4096) <= 1.01 * -(-sum(r.length for r in rows) // 4096) + 1


def test_op2_whole_table(spark, docs):
    from tokenizers import Tokenizer

    tokenizer, at = Tokenizer.from_file(word_tokens.default_path()), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_token_output(spark, FOLDER).collect()}
    for i, text in sorted(zip(docs.doc_id, docs.text, strict=True)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


def brute_top_k(rows, k, scale=64):
    """Answers of all query rows, as a bag: ``rows`` of (id, finite vector of one length)."""
    whole = [(i, np.floor(scale * np.array(x)).astype(int)) for i, x in rows]
    return Counter((q, tuple(sorted(((i, int(x @ y)) for i, y in whole if i != q), key=lambda t: (-t[1], t[0]))[:k])) for q, x in whole if q % 20 == 0)


def answers(found):
    """Query rows of one id can't be told apart in the result: their answers as one bag of ranks."""
    got = defaultdict(Counter)
    for r in found:
        got[r.query_id][(r.rank, r.vec_id, r.score)] += 1
    return got


def as_ranks(brute):
    want = defaultdict(Counter)
    for (q, best), times in brute.items():
        for rank, (i, s) in enumerate(best, 1):
            want[q][(rank, i, s)] += times
    return want


@pytest.mark.parametrize("block", [None, 40])
def test_top_k_against_brute_force(spark, monkeypatch, block):
    """Ties, repeated candidates and query rows, other lengths, clashing columns, full nodes of several blocks."""
    if block:
        for name in ("DATA_BLOCK", "QUERY_BLOCK", "LEAST_BLOCK"):
            monkeypatch.setattr(topk, name, block)
        monkeypatch.setattr(topk, "GROUP", 2)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 8)).round(1)
    v[::7] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(40, v[40].tolist()), (60, v[41].tolist()), (60, v[0].tolist()), (3, v[3].tolist())]
    odd = [(2000, None), (2020, [1.0] * 3), (2040, [float("nan")] * 8), (2060, [float("inf")] + [0.0] * 7), (None, [0.0] * 8), (2080, []), (2100, [None] * 8)]
    df = spark.createDataFrame([(i, x, "n", 1.0, 2) for i, x in rows + odd], "vec_id long, embedding array<double>, node string, score double, rank int")
    assert answers(topk.top_k(df, k=15).collect()) == as_ranks(brute_top_k(rows, 15))
    assert topk.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [3.0])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(few).collect()} == {(0, 1, 20, 64 * 192), (0, 2, 1, 64 * 128), (20, 1, 1, 192 * 128), (20, 2, 0, 64 * 192)}


def test_op3_whole_table(spark):
    e = pd.read_parquet(f"{FOLDER}/embeddings.parquet")
    assert answers(queries.op3_topk_search(spark, FOLDER).collect()) == as_ranks(brute_top_k([(i, np.array(x, float)) for i, x in zip(e.vec_id, e.embedding, strict=True)], 20))


def test_trees_prune_what_can_be_pruned():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32)) * 64
    v = np.floor(centres[rng.integers(0, 60, 12_000)] + rng.normal(size=(12_000, 32))).astype(np.int64)
    d, q = (topk.Tree.unpacked(topk.Tree(i, v[i]).packed()) for i in (np.arange(12_000), np.arange(0, 12_000, 20)))
    best = topk.Best(len(q.ids), 20)
    assert topk.search(q, d, best) < 0.5 * len(q.ids) * len(d.ids)
    scores = v[q.ids] @ v.T
    scores[np.arange(len(q.ids)), q.ids] = -(10**12)
    assert (best.score == -np.sort(-scores, axis=1)[:, :20]).all()


def test_language(spark, odd, none, docs):
    got = queries.op4_language_id(spark, FOLDER).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id")
    out = got[got.held_out]
    assert len(out) > 20 and (out.lang_pred == out.lang).mean() > 0.95 and got.score.between(0, 1).all()
    model = language.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    found = {r.doc_id: r.lang_pred for r in language.predicted(odd, model).where("doc_id is not null").collect()}
    assert found[1] == found[2] == found[3] == found[11] == "und" and found[8] == "en"
    assert language.fit(none).languages == [] and language.predicted(odd, language.fit(none)).where("lang_pred <> 'und'").isEmpty()


def brute_segmentations(word, pieces, p, unknown):
    """All ways to cut a marked word into pieces, as lists of places in the table."""
    if not word:
        return [[]]
    out = []
    for k in range(1, len(word) + 1):
        i = pieces.get(word[:k], unknown if k == 1 else None)
        if i is not None:
            out += [[i, *rest] for rest in brute_segmentations(word[k:], pieces, p, unknown)]
    return out


@pytest.mark.parametrize("short", [3, 24])
def test_forward_and_backward_against_all_segmentations(short, monkeypatch):
    """Words of mixed lengths at once, short ones and padded ones, two languages, unknown letters."""
    monkeypatch.setattr(language, "SHORT", short)
    monkeypatch.setattr(language, "RESCALED", 2)
    rng = random.Random(1)
    pieces = {x: i for i, x in enumerate(["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bbbb", "c"])}
    table = language.probabilities(np.random.default_rng(2).random((len(pieces) + 1, 2)))
    words = ["".join(rng.choice("abcx") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    got = language.log_likelihoods(words, pieces, table)
    counts, want = np.arange(1.0, 61.0), np.zeros(len(pieces) + 1)
    for i, w in enumerate(words):
        cuts = brute_segmentations("▁" + w, pieces, table, len(pieces))
        mass = np.array([np.prod(table[c], axis=0) for c in cuts])
        assert np.allclose(got[i], np.log(mass.sum(axis=0)))
        for c, m in zip(cuts, mass[:, 0], strict=True):
            for piece in c:
                want[piece] += counts[i] * m / mass[:, 0].sum()
    assert np.allclose(language.expected_counts(words, counts, pieces, table[:, :1]), want)
    long = "ab" * 4000  # no probability but its logarithm
    assert np.isclose(language.log_likelihoods([long, "a"], pieces, table)[0, 0] / language.log_likelihoods([long * 2], pieces, table)[0, 0], 0.5, atol=1e-3)
    assert language.expected_counts([long], np.ones(1), pieces, table[:, :1]).sum() > 2000


def test_every_language_is_learned(spark):
    rows = [(i, f"l{i % 300}", f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 30) for i in range(1200)]
    docs = spark.createDataFrame([*rows, (5000, None, "ab"), (None, "l1", "ab")], "doc_id long, lang string, text string")
    model = language.fit(docs)
    assert model.languages == sorted({f"l{i}" for i in range(300)})
    kept = language.predicted(docs, language.fit(docs.withColumn("lang", F.lit(None).cast("string"))), least_score=0.5)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 2


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "▁ab": 5}
    table = language.probabilities(np.arange(1.0, 8.0)[:, None])
    p = dict(zip(pieces, table[:, 0], strict=False))
    want = p["▁"] * (p["a"] * p["b"] + p["ab"]) + p["▁a"] * p["b"] + p["▁ab"]
    assert np.isclose(np.exp(language.log_likelihoods(["ab"], pieces, table)[0, 0]), want)
    counts = language.expected_counts(["ab"], np.array([2.0]), pieces, table)
    assert np.isclose(counts[5], 2 * p["▁ab"] / want)


def test_quality(spark, odd, none):
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet")
    got = queries.op7_quality(spark, FOLDER).toPandas().merge(labels, on="doc_id")
    out = got[got.held_out]
    assert (out.predicted == out.quality).mean() > 0.85 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(odd, no_labels)
    assert quality.scored(odd, model).count() == 15 and quality.scored(odd, model, only_good=True).columns == odd.columns
    assert quality.scored(none, quality.fit(none, no_labels)).count() == 0
    fitted = quality.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    clash = odd.withColumn("quality_score", odd.n).withColumn("x", odd.n).withColumn("w", odd.n)
    rows = quality.scored(clash, fitted).collect()
    assert len(rows) == 15 and all(0 <= r.quality_score <= 1 for r in rows) and len({r.quality_score for r in rows if not r.text}) == 1
    assert len({r.quality_score for r in rows if r.text == "one"}) == 1 and quality.scored(none, fitted).count() == 0
    assert np.allclose(quality.isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4)), [0.1, 0.4, 0.4, 0.9])


def test_quality_against_one_solve(spark):
    """Weights from summed equations over repeated and null labels against one solve over all rows."""
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet")[["doc_id", "quality"]]
    given = pd.concat([labels, labels.iloc[:30], pd.DataFrame({"doc_id": [None, 5], "quality": [1, None]})])
    model = quality.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.createDataFrame([(None if pd.isna(a) else int(a), None if pd.isna(b) else int(b)) for a, b in given.itertuples(index=False)], "doc_id long, quality int"))
    used = given.dropna().merge(docs, on="doc_id")
    used = used[[zlib.crc32(str(int(i)).encode()) % 4 != 2 for i in used.doc_id]]
    raw = [t.encode() for t in used.text]
    x = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.allclose(model.mean, x.mean(axis=0))
    z, y = model.features(x), used.quality.to_numpy(float)
    penalty = np.diag([quality.RIDGE] * (z.shape[1] - 1) + [0.0])
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + penalty + 1e-9 * np.eye(len(penalty)), z.T @ y), atol=1e-5)
    assert (np.diff(model.values) >= 0).all() and (np.diff(model.knots) >= 0).all()


def test_html():
    page = """<html><head><title>t</title></head><body><header>Site</header><nav><a href=/>Menu</a></nav><div class="cookie-notice">We use cookies, as all do, and more.</div>
    <article><h1>A &amp; B</h1><p>First para, with   commas, and\n words enough to count for a paragraph here.<br>more</p><script>var x = "</p>";</script>
    <ul><li>one<li>two</ul><div class="comments"><p>Reader says, well, this is a long comment, with commas, indeed.</p></div></article>
    <aside class=sidebar><p>Other things, many of them, to be read elsewhere.</p></aside><footer>&copy; all</footer></body></html>"""
    assert html_text.main_text(page) == "A & B First para, with commas, and words enough to count for a paragraph here. more one two"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"


def test_html_keeps_the_article():
    page = """<body><div class="share-buttons"><p>Share this, or that, with all of your friends now.</p></div><article><h1>Drug</h1><p>A long first paragraph, with commas, and with words enough to count.</p>
    <h2 id="side-effects">Side effects</h2><p class="alert">Take care.</p><section id="discussion"><h2 id="social-impact">Social impact</h2><p>Some, <span class="notice">but not much</span>.</p></section>
    <p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds. <svg><path d="M0"/><text>Axis</text></svg></p><div class="side-notes">A note.</div>
    <ul><li><a href="1">First source</a></li><li><a href="2">Second source</a></li></ul><div class="related-posts"><p>Other posts, many of them.</p></div><div id="comments">I say so.</div></article></body>"""
    want = "Drug A long first paragraph, with commas, and with words enough to count. Side effects Take care. Social impact Some, but not much. Here x=2 holds. Axis A note. First source Second source"
    assert html_text.main_text(page) == want
    plain = "<body><ul><li><a href=1>Home</a></ul><section><h2>One</h2><p>" + "Many words, with commas, in a long paragraph. " * 9 + "</p></section><section><h2>Two</h2><p>Short one.</p></section></body>"
    assert html_text.main_text(plain).endswith("Two Short one.") and "Home" not in html_text.main_text(plain)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p><a href="foo>link</a> world</p>', "link world"),
        ("<p class=a'b>it</p><p title='x>y'>is</p><p x=\"1\" y>so</p>", "it is so"),
        ('<p data-a="1>2" hidden-not>a</p><img alt="a > b">b', "a b"),
        ('<div class="post-share"><p>Tell all of your friends about this.</p></div><p>Body</p>', "Body"),
        ('<div class="story-related">More</div><div class="main-menu">Home</div><p>Body</p>', "Body"),
        ('<div class="article-newsletter"><p>Sign up, please, for our letters.</p></div><p>Body</p>', "Body"),
        ('<div class="entry-header"><h1>Title</h1></div><div class="content has-sidebar"><p>Body</p></div>', "Title Body"),
        ("<p>a<", "a<"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ],
)
def test_html_tags_and_names(page, want):
    assert html_text.main_text(f"<body><article>{page}</article></body>".replace("a<</article></body>", "a<")) == want


def test_html_time_follows_length():
    page = "<body><article>" + "<p title=\"it's>" * 20_000 + "".join(f"<p class='x{i}' title=\"{i}\">word {i}</p>" for i in range(20_000)) + "</article></body>"
    begin = time.perf_counter()
    assert html_text.main_text(page).endswith("word 19999") and time.perf_counter() - begin < 20


def test_html_rows(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>a</p>", 2), (1, "u", "<p>a</p>", 2)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.text, r.n_chars) for r in html_text.extract(df).collect()) == [("", 0), ("a", 1), ("a", 1)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_substrings(spark, odd, none):
    passage = "Alpha beta gamma delta. Epsilon zeta eta theta iota kappa lambda mu nu xi omicron. Pi rho sigma tau upsilon phi chi psi omega."
    rows = [(1, f"Own words here first.\n{passage}\nTail of one is here now."), (2, f"Other start of text. {passage} Ends quite otherwise."), (3, passage.upper() + "\nRest stays as it is."), (4, "Short one.\nAlpha beta gamma delta.")]
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[4].text == rows[3][1]
    assert got[2].text == "Other start of text. Ends quite otherwise." and got[3].text == "Rest stays as it is."
    span = got[2].removed_spans[0]
    assert rows[1][1][span.start : span.end].strip() == passage and span.kept_doc_id == 1
    clash = spark.createDataFrame([(i, t, 7, "x", 1) for i, t in rows], "doc_id long, text string, _id long, _th string, place int")
    assert {r.doc_id: (r.text, r._id, r._th, r.place) for r in substring_dedup.dedup(clash).collect()} == {i: (r.text, 7, "x", 1) for i, r in got.items()}
    out = substring_dedup.dedup(odd)
    assert out.columns == [*odd.columns, "removed_spans"] and out.count() == 15 and substring_dedup.dedup(none).count() == 0


def brute_repeats(texts, size):
    """Words of each text that stand in a window of ``size`` words of an earlier text."""
    seen, out = set(), {}
    for i in sorted(texts):
        w = texts[i].lower().split()
        grams = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
        out[i] = {k + j for k, g in enumerate(grams) if g in seen for j in range(size)}
        seen.update(grams)
    return out


def test_substrings_within_sentences(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    short = " ".join(sentence(k) for k in (25, 4, 4, 5, 4, 26))  # inner sentences of 17 words together
    unstopped = " ".join(word() for _ in range(60))
    rows = [(1, f"{sentence(9)} {short} {sentence(7)}"), (2, f"{sentence(8)} {unstopped} {sentence(6)}")]
    for i, source in enumerate((short, unstopped)):
        w = source.split()
        inner = w[5:-5] if i else w[8:-9]
        assert len(inner) >= 50
        rows.append((3 + i, f"{sentence(11)} {word()} {' '.join(inner)} {word()} {sentence(12)}"))
    rows.append((5, f"{sentence(9)}\n" + re.sub(r"((?:\S+ ){7})", r"\1\n", short)))  # wrapped otherwise
    texts = dict(rows)
    want = brute_repeats(texts, 20)
    for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        gone = set()
        for s in r.removed_spans:
            first = len(texts[r.doc_id][: s.start].split())
            gone |= set(range(first, first + len(texts[r.doc_id][s.start : s.end].split())))
        assert gone <= want[r.doc_id]
        assert (len(want[r.doc_id]) >= 50) == (r.doc_id > 2) == bool(gone)
        left = sorted(want[r.doc_id] - gone)
        assert all(sum(a <= k < a + 20 for k in left) < 20 for a in left)


def test_substrings_of_short_lines(spark):
    rng = random.Random(6)
    lines = lambda n: "\n".join(f"{x} {y}" for x, y in (rng.sample(range(10**6), 2) for _ in range(n)))
    verse, own, bounds = lines(30), lines(30), "A line that many pages have at the top\n{}\nA line that many pages have at the end"
    chinese = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(120))
    rows = [(1, verse), (2, verse), (3, bounds.format(lines(2))), (4, bounds.format(own)), (5, chinese), (6, f"\u5b57{chinese[:70]}\u5b57 else"), (7, "\u3042" + chinese[30:90] + "\U00020000\u3002")]
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == verse and got[2].text == "" and got[2].removed_spans[0].kept_doc_id == 1
    assert got[3].text == rows[2][1] and got[4].text == rows[3][1] and got[5].text == chinese
    for i, n in ((6, 70), (7, 60)):
        gone = sum(s.end - s.start for s in got[i].removed_spans)
        assert n - 2 * 20 <= gone <= n and rows[i - 1][1].startswith(got[i].text[:1]) and got[i].text.endswith(rows[i - 1][1][-2:])
    assert [len(x) for x in substring_dedup.pieces(np.frombuffer("a\u4e00b \u3002\U00020000c".encode(), np.uint8), np.array([0, 14]))] == [6, 6, 1]


@pytest.mark.parametrize(("unit", "split"), [("line", "\n"), ("paragraph", "\n\n")])
def test_repeated_lines_and_paragraphs(spark, unit, split):
    """Against a loop over all units in order: every later occurrence goes, with its offsets."""
    rng = random.Random(9)
    texts = [split.join(f"{rng.choice('abc')} {rng.choice('XyZ')}{'  w' * rng.randrange(3)}." for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, None), (51, ""), (52, "\n\n"), (None, texts[0])]
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit, least_words=3).collect()}
    seen: dict[str, int] = {}
    for i, t in enumerate(texts):
        kept, gone = [], []
        for line in t.split(split):
            key = " ".join(line.lower().split())
            if len(key.split()) >= 3 and key in seen:
                gone.append((line, seen[key]))
            else:
                kept.append(key)
                seen.setdefault(key, i)
        assert " ".join(got[i].text.lower().split()) == " ".join(kept)
        assert "".join(t[s.start : s.end] for s in got[i].removed_spans).split() == " ".join(line for line, _ in gone).split()
        assert {s.kept_doc_id for s in got[i].removed_spans} <= {k for _, k in gone}
    assert got[None].text == texts[0] and got[50].text is None and got[52].text == "\n\n"


def own_sketch(text, k=128):
    """The least distinct shingle hashes as Spark makes them: each word's hash is the next one's seed."""
    w = text.lower().split()
    grams = [w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else [w] if w else []
    found = set()
    for gram in grams:
        h = 42
        for x in gram:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        found.add(h - (1 << 64) if h >> 63 else h)
    return sorted(found)[:k]


def own_likeness(a, b, k=128):
    if not a or not b:
        return float(a == b)
    both = sorted({*a, *b})[:k]
    return len({*both} & {*a} & {*b}) / len(both)


def check_fingerprints(rows, texts):
    """All columns of all rows; ``texts`` by id, in any order."""
    down = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(rows) == len(texts)
    for i, name in enumerate(down):
        text, after, r = texts[name] or "", texts[down[(i + 1) % len(down)]] or "", got[name]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = map(own_sketch, (text, edited, after))
        for shown, want in ((r.fingerprint, a), (r.edited_fingerprint, b)):
            assert [int(x, 16) for x in shown.split()] == [x % (1 << 64) for x in want]
        assert abs(r.near_edited - own_likeness(a, b)) < 1e-12 and abs(r.near_next - own_likeness(a, c)) < 1e-12


def test_op9_whole_table(spark, docs):
    rows = queries.op9_fingerprints(spark, FOLDER).collect()
    check_fingerprints(rows, dict(zip(docs.doc_id, docs.text, strict=True)))
    errors = [abs(r.near_edited - len(a & b) / max(1, len(a | b))) for r, a, b in ((r, *(shingles(" ".join(t.lower().split()), 5) for t in edited_pair(docs, r.doc_id))) for r in rows)]
    assert np.mean(errors) < 0.05 and max(errors) < 0.25


def edited_pair(docs, name):
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    down = sorted(texts, reverse=True)
    text, after = texts[name], texts[down[(down.index(name) + 1) % len(down)]]
    return text, text[: len(text) - len(text) // 2] + after[: len(text) // 2]


@pytest.mark.parametrize("group", [1, 3, 1000])
def test_fingerprints_of_any_ids(spark, group, monkeypatch):
    """Outlying, negative and very large ids, nulls and empty texts, in groups of any size."""
    monkeypatch.setattr(fingerprints.with_next, "__defaults__", (group,))
    rng = random.Random(2)
    ids = [-(2**63), -5, *range(20), 2**40, 2**62, 2**62 + 1, 2**63 - 1]
    texts = {i: rng.choice([None, "", " ", "a b c", " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(90)))]) for i in ids}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, tie string, sketch int").repartition(3)
    check_fingerprints(fingerprints.digests(df).collect(), texts)
    one = spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")
    check_fingerprints(fingerprints.digests(one).collect(), {7: "a b c d e f"})


def test_fingerprints_odd(odd, none):
    got = fingerprints.digests(odd).collect()
    assert len(got) == 15 and fingerprints.digests(none).count() == 0
    assert len({r.fingerprint for r in got if r.doc_id in (4, 5)}) == 1 and all(r.near_next == 0 for r in got if r.doc_id is None)
    plan = fingerprints.digests(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sketches_merge(spark):
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(" ".join(words[:2000]), " ".join(words[1996:]), " ".join(words))], "a string, b string, c string")
    s = [fingerprints.sketch(df[c]) for c in "abc"]
    row = df.select((fingerprints.merge(s[0], s[1]) == s[2]).alias("same"), fingerprints.distinct_shingles(s[2]).alias("n"), fingerprints.containment(s[0], s[2]).alias("c"), fingerprints.resemblance(s[0], s[2]).alias("j")).first()
    assert row.same and 2200 < row.n < 3900 and row.c > 0.8 and 0.5 < row.j < 0.85
