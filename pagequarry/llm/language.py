"""Language ID: unigram pieces of a public vocabulary, marginalised over segmentations.

Every language has a probability for each piece of a fixed vocabulary. The likelihood of a word
(a run of letters, lower case, with the vocabulary's word mark before it) is the sum over all
its segmentations into pieces, found by a forward pass over the whole word whatever its length;
words are independent, so a text's likelihood is the product over its words, and each distinct
word is scored once. Probabilities are fitted by expectation maximisation: a forward-backward
pass gives the expected count of each piece over the segmentations of the training words.

The fit takes at most about ``max_docs`` labelled documents of each language, chosen by a hash;
their word counts are summed by Spark and the passes over words run in tasks that send one
number a piece and language. Every value of ``lang`` is learned: the model has one number a piece
and language (about 180 kB a language), which the driver and every worker hold.

Defined cases: ``und`` with score 0.0 where text is null or has no letter, or where nothing
could be learned; null ``lang`` is not learned from; repeated rows count each; null ``doc_id``
is predicted and never learned from; ties go to the language that sorts first; extra columns are
passed through by ``predicted`` (those named like its own are replaced).
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import CACHES, dropped, forget_caches, held_out, text_groups, written

MAX_DOCS, ROUNDS, SMOOTHING = 2_000, 2, 0.1
CACHED_WORDS = 400_000
PART = 1 << 18  # code points of text that are scored at a time
#: Words up to SHORT letters are worked on with others of their length, longer ones with those near in length.
SHORT, TOGETHER, CELLS, RESCALED = 24, 4096, 1 << 16, 16
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")

_PIECES: dict[str, dict[str, int]] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of lower-case letters, with or without the word mark, and their places."""
    if path not in _PIECES:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            body = piece.removeprefix(MARK)
            if not model.is_control(i) and not model.is_byte(i) and not model.is_unknown(i) and (not body or LETTERS.fullmatch(body)) and body == body.lower():
                kept[piece] = len(kept)
        _PIECES[path] = kept
    return _PIECES[path]


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Trie:
    """The vocabulary letter by letter: from a node and a letter to the next node, and each node's piece."""

    def __init__(self, pieces: dict[str, int]) -> None:
        self.depth = max(map(len, pieces), default=1)
        steps: dict[tuple[int, str], int] = {}
        at_end = {0: -1}
        for piece, i in pieces.items():
            node = 0
            for c in piece:
                node = steps.setdefault((node, c), len(steps) + 1)
            at_end[node] = i
        keys = np.array([n << 21 | ord(c) for n, c in steps] or [0], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(steps.values()) or [0], np.int64)[order]
        self.piece = np.full(len(steps) + 1, -1, np.int32)
        for node, i in at_end.items():
            self.piece[node] = i

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece at [word, start, length - 1], -1 none, -2 an unknown letter; and the words' lengths."""
        lengths = np.array(list(map(len, words)))
        n = int(lengths.max())
        codes = np.frombuffer("".join([w.ljust(n, "\0") for w in words]).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(words), n)
        out = np.full((len(words), n, min(n, self.depth)), -1, np.int32)
        word, start = np.nonzero(codes)
        node = np.zeros(len(word), np.int64)
        for k in range(out.shape[2]):
            key = node << 21 | codes[word, start + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            word, start, node = word[on], start[on], self.child[at[on]]
            out[word, start, k] = self.piece[node]
            inside = start + k + 1 < n
            word, start, node = word[inside], start[inside], node[inside]
            if not len(word):
                break
        single = out[:, :, 0]
        single[(single == -1) & (codes > 0)] = -2
        return out, lengths


#: The vocabulary stands beside its trie, so that nothing else can have its identity.
_TRIES: dict[int, tuple[dict[str, int], Trie]] = {}


def trie(pieces: dict[str, int]) -> Trie:
    """The trie of a vocabulary, made once in each Python process."""
    if id(pieces) not in _TRIES:
        _TRIES[id(pieces)] = (pieces, Trie(pieces))
    return _TRIES[id(pieces)][1]


def batches_of(words: list[str]):
    """Groups of marked words of like length, with their places in ``words``."""
    groups: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        groups[min(len(w), SHORT)].append(i)
    for length, found in groups.items():
        if length < SHORT:
            cuts = range(0, len(found) + TOGETHER, TOGETHER)
        else:
            found.sort(key=lambda i: len(words[i]))
            cuts, start = [0], 0
            for k, i in enumerate(found):
                if (k - start) * len(words[i]) > CELLS:
                    cuts.append(k)
                    start = k
            cuts.append(len(found))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if found[a:b]:
                yield found[a:b], [MARK + words[i] for i in found[a:b]]


def log_likelihoods(words: list[str], pieces: dict[str, int], table: np.ndarray) -> np.ndarray:
    """A row of log-likelihoods, one a language, for each word: sums over all segmentations."""
    own, unknown = trie(pieces), len(table) - 2
    out = np.zeros((len(words), table.shape[1]))
    for at, marked in batches_of(words):
        lat, lengths = own.lattice(marked)
        count, n, depth = lat.shape
        # alpha of the last places only, each language scaled by itself.
        ring, logs = np.zeros((depth + 1, count, table.shape[1])), np.zeros((count, table.shape[1]))
        ring[0] = 1
        found = np.empty_like(logs)
        for j in range(1, n + 1):
            one = lat[:, j - 1, 0]
            new = ring[(j - 1) % (depth + 1)] * table[np.where(one >= 0, one, unknown)]
            for k in range(2, min(depth, j) + 1):
                piece = lat[:, j - k, k - 1]
                use = np.flatnonzero(piece >= 0)
                if len(use):
                    new[use] += ring[(j - k) % (depth + 1)][use] * table[piece[use]]
            ring[j % (depth + 1)] = new
            done = lengths == j
            if done.any():
                found[done] = logs[done] + np.log(new[done])
            if j % RESCALED == 0:
                scale = ring.max(axis=0)
                ring /= scale
                logs += np.log(scale)
        out[at] = found
    return out


def expected_counts(words: list[str], counts: np.ndarray, pieces: dict[str, int], table: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces, then the unknown letter) over all segmentations; one language."""
    own, unknown = trie(pieces), len(pieces)
    out, p = np.zeros(len(pieces) + 1), table[:, 0]
    for at, marked in batches_of(words):
        lat, lengths = own.lattice(marked)
        count, n, depth = lat.shape
        weight, row = counts[at].astype(np.float64), np.arange(count)
        lat = np.where(lat == -2, unknown, lat)
        edges = [[(use, lat[use, i, k - 1]) for k in range(1, min(depth, n - i) + 1) for use in [np.flatnonzero(lat[:, i, k - 1] >= 0)]] for i in range(n)]
        # Both passes carry the logarithm of what they were scaled by, place by place.
        alpha, alpha_log = np.zeros((count, n + 1)), np.zeros((count, n + 1))
        alpha[:, 0] = 1
        beta, beta_log = np.zeros((count, n + 1)), np.zeros((count, n + 1))
        beta[row, lengths] = 1
        for j in range(1, n + 1):
            level = alpha_log[:, j - 1]
            for k in range(1, min(depth, j) + 1):
                use, piece = edges[j - k][k - 1]
                alpha[use, j] += alpha[use, j - k] * np.exp(alpha_log[use, j - k] - level[use]) * p[piece]
            top = np.where(alpha[:, j] > 0, alpha[:, j], 1)
            alpha[:, j] /= top
            alpha_log[:, j] = level + np.log(top)
        for i in range(n - 1, -1, -1):
            level = beta_log[:, i + 1]
            for k, (use, piece) in enumerate(edges[i], 1):
                beta[use, i] += beta[use, i + k] * np.exp(beta_log[use, i + k] - level[use]) * p[piece]
            top = np.where(beta[:, i] > 0, beta[:, i], 1)
            beta[:, i] /= top
            beta_log[:, i] = level + np.log(top)
        total = np.log(alpha[row, lengths]) + alpha_log[row, lengths]
        for i in range(n):
            for k, (use, piece) in enumerate(edges[i], 1):
                if len(use):
                    share = weight[use] * alpha[use, i] * p[piece] * beta[use, i + k] * np.exp(alpha_log[use, i] + beta_log[use, i + k] - total[use])
                    out += np.bincount(piece, share, minlength=len(out))
    return out


def probabilities(expected: np.ndarray) -> np.ndarray:
    """Rows of pieces, then the unknown letter, then a zero row; a column a language."""
    p = expected + SMOOTHING
    return np.concatenate([p / p.sum(axis=0), np.zeros((1, p.shape[1]))])


@dataclass
class LanguageModel:
    """Languages, and piece probabilities: a fixed vocabulary times the languages."""

    path: str
    languages: list[str]
    table: np.ndarray


def fit(docs: DataFrame, path: str | None = None, max_docs: int = MAX_DOCS, rounds: int = ROUNDS) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of the documents that are not held out."""
    path = path or default_path()
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().collect()  # a row a language
    languages = sorted(r["lang"] for r in counts)
    size = len(vocabulary(path))
    if not languages:
        return LanguageModel(path, [], np.zeros((size + 2, 0)))
    share = spark.createDataFrame([(r["lang"], min(1_000_000, int(1_000_000 * max_docs / r["count"]) + 1)) for r in counts], "lang string, share int")
    sample = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.col("share")).select("lang", "text")

    def count_words(batches):
        for batch in batches:
            total: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.update((lang, w) for w in words_of(text))
                if len(total) > 200_000:
                    yield _rows(total)
                    total = Counter()
            yield _rows(total)

    def _rows(total):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "word", "n"])

    words = written(sample.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    index = {x: i for i, x in enumerate(languages)}
    table = probabilities(np.ones((size + 1, len(languages))))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(table)

        def expect(batches, shared=shared):
            pieces = vocabulary(path)
            total = np.zeros((len(pieces) + 1, len(languages)))
            for batch in batches:
                lang = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
                found = np.array(batch.column(1).to_pylist(), object)
                n = batch.column(2).to_numpy().astype(np.float64)
                for k in np.unique(lang).tolist():
                    use = lang == k
                    total[:, k] += expected_counts(found[use].tolist(), n[use], pieces, shared.value[:, k : k + 1])
            at, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(k, pa.int32()), pa.array(total[at, k])], ["piece", "k", "n"])

        sums = words.mapInArrow(expect, "piece long, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n"))
        expected = np.zeros((size + 1, len(languages)))
        got = sums.toPandas()  # a row a piece and language at most
        expected[got["piece"].to_numpy(np.int64), got["k"].to_numpy(np.int64)] = got["n"].to_numpy()
        table = probabilities(expected)
    dropped(words)
    return LanguageModel(path, languages, table)


class Scorer:
    """Word scores of a model, kept up to a bound."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.pieces = model, vocabulary(model.path)
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.model.languages)))

    def _of(self, words: list[str]) -> np.ndarray:
        rows = list(map(self.rows.get, words))
        if None in rows:
            if len(self.rows) > CACHED_WORDS:
                self._clear()
            fresh = list({w for w in words if w not in self.rows})
            first = len(self.rows)
            while first + len(fresh) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[first : first + len(fresh)] = log_likelihoods(fresh, self.pieces, self.model.table)
            self.rows.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            rows = list(map(self.rows.get, words))
        return self.scores[rows]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and its share of the likelihood, for each text."""
        if not self.model.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        langs, shares = [], []
        for a, b in text_groups([t or "" for t in texts], PART):
            found = [words_of(t or "") for t in texts[a:b]]
            counts = np.array([len(w) for w in found])
            ends = np.concatenate([[0], np.cumsum(counts)])
            sums = np.zeros((b - a, len(self.model.languages)))
            flat = [w for words in found for w in words]
            if flat:
                run = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(self._of(flat), axis=0)])
                sums = run[ends[1:]] - run[ends[:-1]]
            best = sums.argmax(axis=1)
            share = 1 / np.exp(np.maximum(sums - sums.max(axis=1, keepdims=True), -700)).sum(axis=1)
            for words, i, s in zip(found, best.tolist(), share.tolist(), strict=True):
                letter = any(any(map(str.isalpha, w)) for w in words)
                langs.append(self.model.languages[i] if letter else "und")
                shares.append(s if letter else 0.0)
        return langs, shares


_SCORERS: dict[str, Scorer] = {}


CACHES.append(_SCORERS.clear)


def scorer(key: str, model: LanguageModel) -> Scorer:
    """The scorer of this Python process for the model named ``key``."""
    if key not in _SCORERS:
        forget_caches()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def predicted(docs: DataFrame, model: LanguageModel, least_score: float | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` after its columns.

    With ``least_score`` the rows that are ``und`` or score less go, and no column is added. A
    model of no language rejects nothing but texts without letters.
    """
    if least_score is not None and not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    if least_score is None:
        docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    at = docs.columns.index("text")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        own = scorer(key, shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                langs, shares = own.predict(part.column(at).to_pylist())
                if least_score is not None:
                    yield part.filter(pa.array([x != "und" and s >= least_score for x, s in zip(langs, shares, strict=True)], pa.bool_()))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(shares, pa.float64())], [*part.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, fields if least_score is not None else f"{fields}, lang_pred string, lang_score double")
