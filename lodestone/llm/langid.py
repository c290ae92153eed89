"""Language identification with segmentation-marginalised unigrams.

Each language has one probability per piece of a fixed public vocabulary. A word's probability is
the sum over all its segmentations into pieces, found by the forward algorithm; a text's is the
product over its words. The piece probabilities are fitted by expectation maximisation: the
expected piece counts come from the forward and backward sums over a sample of labelled rows.

Defined results: a null text, or one without a letter, is `und` with score 0; a null label is never
learned from; equal likelihoods go to the smallest label by code point; with no labelled row at all
every text is `und`; other columns are kept as they are, and the added ones replace columns of the
same names; rows that are repeated are predicted alike, and count each in the fit. Letter runs of any
length, as in unspaced scripts, are one word: from LONG letters on, its forward and backward sums run
in logarithms over blocks of BLOCK letters, each handing its last positions to the next, so only the
word's own characters grow with it and no segmentation is lost at a block's end. More than MAX_LANGUAGES
labels are an error: such a column holds no languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, tidy

LETTERS = re.compile(r"[^\W\d_]+")
#: Words of this many letters or more are summed one by one, in blocks of so many letters.
LONG = 32
BLOCK = 1024
MAX_LANGUAGES = 256
#: Each letter's share of the scaling that keeps the forward sums inside a double's range.
SCALE = 256.0
#: Letters of text that one unit of the reported score stands for.
SCORE_LETTERS = 20
START = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters only, lower case, with or without the word-start mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size())}
    keep = {p for p in pieces if (b := p.removeprefix(START)) == p.lower().removeprefix(START) and (not b or LETTERS.fullmatch(b))}
    return sorted(keep | {START})


class Pieces:
    """Piece ids of all substrings of many words at once, through a two-level hash table."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        self.levels = []
        left = np.arange(self.n)
        for bits, factor in ((20, 0x9E3779B97F4A7C15), (16, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9)):
            slot = ((self.hashes[left] * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)
            table = np.full(1 << bits, -1, dtype=np.int32)
            table[slot] = left
            self.levels.append((np.uint64(factor), np.uint64(64 - bits), table))
            left = left[table[slot] != left]
        if len(left):
            raise ValueError("the vocabulary's hashes collide")

    @staticmethod
    def _hash(piece: str) -> int:
        h = 7
        for c in piece:
            h = (h * 1_000_003 + ord(c) + 1) & (1 << 64) - 1
        return h

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, -1, dtype=np.int32)
        for factor, shift, table in self.levels:
            i = table[(h * factor) >> shift]
            ok = (i >= 0) & (self.hashes[i] == h)
            out[ok] = i[ok]
        return out

    def matches(self, words: list[str]) -> tuple[np.ndarray, list[list[tuple[int, np.ndarray, np.ndarray]]]]:
        """Lengths with the start mark; by end position, (piece length, word rows, piece ids)."""
        lengths = np.array([len(w) + 1 for w in words])
        width = int(lengths.max(initial=1))
        flat = np.frombuffer("".join(START + w.ljust(width - 1, "\0") for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), width).astype(np.uint64)
        ends: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(width + 1)]
        for a in range(width):
            h = np.full(len(words), 7, dtype=np.uint64)
            rows = np.flatnonzero(lengths > a)
            h = h[rows]
            for b in range(a + 1, min(width, a + self.longest) + 1):
                keep = lengths[rows] >= b
                rows, h = rows[keep], h[keep]
                if not len(rows):
                    break
                h = h * np.uint64(1_000_003) + flat[rows, b - 1] + np.uint64(1)
                i = self.ids(h)
                hit = i >= 0
                if b == a + 1:  # a letter that is no piece counts as the unknown piece
                    i[~hit] = self.n
                    hit[:] = True
                if hit.any():
                    ends[b].append((b - a, rows[hit], i[hit]))
        return lengths, ends


def _forward(lengths, ends, prob):
    """alpha[position, word, language], scaled by SCALE a letter."""
    alpha = np.zeros((len(ends), len(lengths), prob.shape[1]))
    alpha[0] = 1
    for b in range(1, len(ends)):
        for n, rows, ids in ends[b]:
            alpha[b, rows] += alpha[b - n, rows] * prob[ids] * SCALE**n
    return alpha


def _sum(x: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials over the first axis."""
    top = x.max(0)
    return top + np.log(np.exp(x - top).sum(0))


class LongWord:
    """The forward and backward sums of one word of any length, in logarithms.

    Position p lies before letter p of the start mark and the word. A window is the sums of as many
    positions as the longest piece has letters.
    """

    def __init__(self, word: str, pieces: Pieces, log_prob: np.ndarray):
        self.codes = np.frombuffer((START + word).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        self.pieces, self.log_prob, self.reach = pieces, log_prob, pieces.longest

    def _ids(self, lo: int, hi: int) -> np.ndarray:
        """[a - lo, n - 1]: the piece of n letters that starts at lo <= a < hi, -1 where there is none."""
        out = np.full((hi - lo, self.reach), -1, dtype=np.int32)
        h = np.full(hi - lo, 7, dtype=np.uint64)
        for n in range(1, self.reach + 1):
            m = min(hi, len(self.codes) - n + 1) - lo
            if m <= 0:
                break
            h = h[:m] * np.uint64(1_000_003) + self.codes[lo + n - 1 : lo + n - 1 + m] + np.uint64(1)
            out[:m, n - 1] = self.pieces.ids(h)
        out[out[:, 0] < 0, 0] = self.pieces.n  # a letter that is no piece counts as the unknown piece
        return out

    def _logs(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids[..., None] >= 0, self.log_prob[ids], -np.inf)

    def _forward(self, window: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Sums at positions lo - reach + 1 to hi; window: those up to lo."""
        first = max(0, lo + 1 - self.reach)
        logs = self._logs(self._ids(first, hi))
        start = np.arange(lo + 1, hi + 1)[:, None] - np.arange(1, self.reach + 1) - first
        logs = np.where(start[..., None] >= 0, logs[np.maximum(start, 0), np.arange(self.reach)], -np.inf)
        out = np.empty((self.reach + hi - lo, window.shape[1]))
        out[: self.reach] = window
        for i in range(hi - lo):
            out[self.reach + i] = _sum(out[i : i + self.reach][::-1] + logs[i])
        return out

    def _start(self) -> np.ndarray:
        window = np.full((self.reach, self.log_prob.shape[1]), -np.inf)
        window[-1] = 0
        return window

    def log_probability(self) -> np.ndarray:
        window = self._start()
        for lo in range(0, len(self.codes), BLOCK):
            window = self._forward(window, lo, min(lo + BLOCK, len(self.codes)))[-self.reach :]
        return window[-1]

    def add_counts(self, weights: np.ndarray, total: np.ndarray) -> None:
        """Add the expected counts of the word's pieces, times its weight in each language."""
        ends, windows = len(self.codes), [self._start()]
        for lo in range(0, ends, BLOCK):
            windows.append(self._forward(windows[-1], lo, min(lo + BLOCK, ends))[-self.reach :].copy())
        whole = windows.pop()[-1]
        after = np.full((self.reach, len(whole)), -np.inf)  # sums from positions hi to hi + reach - 1 on
        after[0] = 0
        for lo in range((ends - 1) // BLOCK * BLOCK, -1, -BLOCK):
            hi = min(lo + BLOCK, ends)
            alpha = self._forward(windows.pop(), lo, hi)[self.reach - 1 : -1]
            ids = self._ids(lo, hi)
            logs = self._logs(ids)
            beta = np.empty((hi - lo + self.reach, len(whole)))
            beta[hi - lo :] = after
            for i in range(hi - lo - 1, -1, -1):
                beta[i] = _sum(beta[i + 1 : i + 1 + self.reach] + logs[i])
            after = beta[: self.reach].copy()
            for n in range(1, self.reach + 1):
                own = ids[:, n - 1] >= 0
                flow = np.exp(alpha[own] + logs[own, n - 1] + beta[n : n + hi - lo][own] - whole) * weights
                for k in range(len(whole)):
                    total[:, k] += np.bincount(ids[own, n - 1], flow[:, k], minlength=len(total))


def _split_long(words: list[str]) -> tuple[list[int], list[int]]:
    """Indexes of the words of less than LONG letters, by length, and of the others."""
    short = sorted((i for i, w in enumerate(words) if len(w) < LONG), key=lambda i: len(words[i]))
    return short, [i for i, w in enumerate(words) if len(w) >= LONG]


def log_probabilities(words: list[str], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log probability of each word for each language, over all segmentations."""
    out = np.empty((len(words), prob.shape[1]))
    order, long = _split_long(words)
    for a in range(0, len(order), 4096):
        part = order[a : a + 4096]
        lengths, ends = pieces.matches([words[i] for i in part])
        alpha = _forward(lengths, ends, prob)
        last = alpha[lengths, np.arange(len(part))]
        out[part] = np.log(np.maximum(last, 1e-300)) - lengths[:, None] * np.log(SCALE)
    log_prob = np.log(np.maximum(prob, 1e-300)) if long else None
    for i in long:
        out[i] = LongWord(words[i], pieces, log_prob).log_probability()
    return out


def expected_counts(words: list[str], weights: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts by language of words that occur `weights[word, language]` times."""
    total = np.zeros((pieces.n + 1, prob.shape[1]))
    order, long = _split_long(words)
    for a in range(0, len(order), 4096):
        part = order[a : a + 4096]
        lengths, ends = pieces.matches([words[i] for i in part])
        alpha = _forward(lengths, ends, prob)
        every = np.arange(len(part))
        beta = np.zeros_like(alpha)
        beta[lengths, every] = weights[part] / np.maximum(alpha[lengths, every], 1e-300)
        for b in range(len(ends) - 1, 0, -1):
            for n, rows, ids in ends[b]:
                flow = prob[ids] * SCALE**n * beta[b, rows]
                beta[b - n, rows] += flow
                for k in range(prob.shape[1]):
                    total[:, k] += np.bincount(ids, flow[:, k] * alpha[b - n, rows, k], minlength=len(total))
    log_prob = np.log(np.maximum(prob, 1e-300)) if long else None
    for i in long:
        LongWord(words[i], pieces, log_prob).add_counts(weights[i], total)
    return total


def words_of(text: str) -> list[str]:
    """Lower-cased letter runs."""
    return LETTERS.findall(text.lower())


@dataclass
class LanguageModel:
    """Fitted piece probabilities; small (pieces x languages), whatever the corpus."""

    languages: list[str]
    pieces: list[str]
    prob: np.ndarray


def fit(docs: DataFrame, *, train: str = "true", vocabulary: str | None = None, max_rows: int = 8000, rounds: int = 3, smoothing: float = 0.02) -> LanguageModel:
    """Fit on rows for which the SQL condition `train` holds and `lang` is not null.

    max_rows bounds the sample of labelled rows: about max_rows / languages of each, chosen by a
    hash of doc_id; smaller languages are taken whole.
    """
    pieces = read_pieces(vocabulary or default_vocabulary())
    rows = docs.where(F.expr(train) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels in lang")
    shares = {lang: min(1_000_000, max_rows * 1_000_000 // len(counts) // n + 1) for lang, n in counts.items()}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    sample = rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(20)), F.lit(1_000_000)) < share).select("lang", "text")
    code = {x: i for i, x in enumerate(languages)}
    schema = pa.schema([("lang", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                seen: Counter = Counter()
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    k = code[lang]
                    seen.update((k, w) for w in words_of(text))
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int32()), pa.array([w for _, w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], schema=schema)

    words = materialise(sample.mapInArrow(tidy(count), "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    prob = np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1))
    for _ in range(rounds):
        total = np.zeros_like(prob)
        for r in words.mapInArrow(tidy(_expect(pieces, prob)), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toLocalIterator():
            total[r["piece"], r["lang"]] = r["n"]
        total += smoothing
        prob = total / total.sum(0)
    return LanguageModel(languages, pieces, prob)


def _expect(pieces: list[str], prob: np.ndarray):
    schema = pa.schema([("piece", pa.int32()), ("lang", pa.int32()), ("n", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = Pieces(pieces), np.zeros_like(prob)
        for batch in batches:
            words = batch.column("word").to_pylist()
            weights = np.zeros((len(words), prob.shape[1]))
            weights[np.arange(len(words)), batch.column("lang").to_numpy()] = batch.column("n").to_numpy()
            if words:
                total += expected_counts(words, weights, table, prob)
        i, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(k, pa.int32()), pa.array(total[i, k])], schema=schema)

    return run


class Scorer:
    """Scores texts; remembers the words it has seen, in bounded memory."""

    def __init__(self, model: LanguageModel, remember: int = 150_000):
        self.languages, self.prob, self.remember = model.languages, model.prob, remember
        self.table, self.known, self.rows = Pieces(model.pieces), {}, np.zeros((0, len(model.languages)), dtype=np.float32)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [words_of(t) if t else [] for t in texts]
        if len(self.known) > self.remember:
            self.known, self.rows = {}, self.rows[:0]
        every = set().union(*words) if self.languages else set()
        new = [w for w in every if len(w) < LONG and w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, log_probabilities(new, self.table, self.prob).astype(np.float32)])
        rare = [w for w in every if len(w) >= LONG]  # not remembered: they may be as long as a text
        long = dict(zip(rare, log_probabilities(rare, self.table, self.prob), strict=True))
        langs, scores = [], []
        for ws in words:
            if not self.languages or not any(c.isalpha() for w in ws for c in w):
                langs.append("und")
                scores.append(0.0)
                continue
            short = [self.known[w] for w in ws if len(w) < LONG] if long else list(map(self.known.__getitem__, ws))
            total = self.rows[np.array(short, dtype=np.int64)].sum(0, dtype=np.float64)
            if len(short) < len(ws):
                total = total + sum(long[w] for w in ws if len(w) >= LONG)
            best = int(np.argmax(total))
            ratio = min(1.0, SCORE_LETTERS / sum(map(len, ws)))
            scores.append(float(1 / np.exp((total - total[best]) * ratio).sum()))
            langs.append(self.languages[best])
        return langs, scores


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of docs, with lang_pred and score added. Only `text` is looked at."""
    kept = docs.drop("lang_pred", "score")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for batch in slices(whole, "text"):
                langs, scores = scorer.score(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(tidy(run), schema)


#: Rows held out of the fit by the query's contract.
HELD_OUT = "crc32(cast(doc_id as string)) % 4 = 2"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: doc_id, held_out, lang_pred, score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "text", "lang"), train=f"not coalesce({HELD_OUT}, false)")
    held = F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "lang_pred", "score")
