"""Secret scanning: fixed rules, and a character convolutional network over every candidate.

The rules find assignments to a secret-like name, access keys and long hexadecimal runs. Candidates
are the values that they find and every token of LEAST_TOKEN characters or more with a digit and a
letter in it. Each is scored by a small convolutional network over all characters of the candidate,
whatever its length, and SIDE characters of its surroundings on either side; its features are the
filters' maxima and means over all positions. A candidate that no rule covers and whose score
reaches the threshold is a finding of its own; the rules' findings stay, with their score.

The network, in numpy, is trained on labelled findings from all documents: the rules' findings and
secrets of known formats planted in the documents' texts, against ordinary words and harmless tokens
(hosts, paths, versions, dates, identifiers) planted likewise. So no label comes from the candidates
that it is to judge. A third of the examples is held out to calibrate the scores (Platt) and to choose
the threshold: the highest one that still finds RECALL of the held-out secrets.

Training is shared out: in each of ROUNDS rounds tasks go on from the same network, each over examples
of its own, and their networks' means, weighted by examples, are the next one. Every other example takes
part. Few examples are one share, which is gone over several times. Which share an example belongs to
follows from its own hash, and scores are calibrated on exact counts of the held-out examples' logits
in steps of 1/STEPS, so results don't depend on how tasks divide the table.

Defined results: null text is empty and stays null when masked; a text without findings has an empty
list; equal texts have equal findings; without any text to learn from, only the rules speak; other
columns, whatever their names, are kept where documents are masked and not looked at elsewhere.
Texts and candidates of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices, tidy

NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_VALUE = 6
LEAST_TOKEN = 8
#: What may be a secret besides: a token with a digit and a letter in it.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[0-9+/_.=-]*[A-Za-z])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{%d,}" % LEAST_TOKEN)
KINDS = ("assign", "access", "hex", "cnn")

#: Characters of the surroundings that are looked at, before and after a candidate.
SIDE = 24
#: A character's code: 0 for none, 1 to 95 for printable ASCII, OTHER; those of the candidate come after.
OTHER = 96
INSIDE = OTHER + 1
_CODES = np.full(256, OTHER, dtype=np.uint8)
_CODES[32:127] = np.arange(1, 96)
_CODES[0] = 0  # all above ASCII, at 255 those above Latin-1, are OTHER
RECALL = 0.98
#: Rounds of shared training, examples of a share in a round, shares at most (a network of 21 kB each).
ROUNDS, SHARE, MOST_SHARES = 8, 4096, 1024
#: Examples that a share sees in all at least, some of them again, but none more than MOST_VISITS times.
VISITS, MOST_VISITS = 24_576, 6
#: Logits are counted in steps of 1/STEPS, up to LARGEST.
STEPS, LARGEST = 128, 64


def rules(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the rules' matches, in order."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Candidate tokens that no rule's match overlaps."""
    out, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while i < len(found) and found[i][0] < b:
            reach = max(reach, found[i][2])
            i += 1
        if reach <= a:
            out.append((a, b))
    return out


def example(text: str, start: int, end: int) -> bytes:
    """The codes of a candidate and of its surroundings."""

    first = max(0, start - SIDE)
    points = np.frombuffer(text[first : end + SIDE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.zeros(end - start + 2 * SIDE, dtype=np.uint8)
    at = SIDE - (start - first)
    out[at : at + len(points)] = _CODES[np.minimum(points, 255)]
    out[SIDE : SIDE + end - start] += np.uint8(INSIDE)
    return out.tobytes()


@dataclass
class Network:
    """Embedding, one convolution, maxima and means over positions, one logistic unit; its calibration."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 1.0
    #: Of the held-out examples: how many secrets and harmless ones, and how many of each are found.
    report: dict = field(default_factory=dict)

    WIDTH = 5
    #: Positions that are looked at together; a longer candidate's parts are joined by maximum and sum.
    PART = 256

    @classmethod
    def start(cls, rng: np.random.Generator, dim: int = 8, n: int = 24) -> Network:
        return cls(rng.normal(0, 0.3, (2 * INSIDE, dim)), rng.normal(0, (cls.WIDTH * dim) ** -0.5, (cls.WIDTH * dim, n)), np.zeros(n), rng.normal(0, (2 * n) ** -0.5, 2 * n + 1))

    def _columns(self, codes: np.ndarray) -> np.ndarray:
        e = self.embed[codes]
        n = codes.shape[1] - self.WIDTH + 1
        return np.concatenate([e[:, i : n + i] for i in range(self.WIDTH)], axis=2)

    @staticmethod
    def _padded(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), max(map(len, rows))), dtype=np.uint8)
        for x, r in zip(out, rows, strict=True):
            x[: len(r)] = r
        return out

    def _active(self, columns: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """The filters' positive parts; nothing beyond an example's own positions."""
        act = np.maximum(columns @ self.filters + self.bias, 0)
        return act * (np.arange(act.shape[1]) < positions[:, None])[..., None]

    def features(self, examples: list[bytes]) -> np.ndarray:
        """Maxima and means of the filters over all positions of each example."""
        own, parts, more = [], [], self.WIDTH - 1
        for i, x in enumerate(examples):
            codes = np.frombuffer(x, dtype=np.uint8)
            for a in range(0, len(codes) - more, self.PART):
                own.append(i)
                parts.append(codes[a : a + self.PART + more])
        n = self.filters.shape[1]
        top, total, count = np.zeros((len(examples), n)), np.zeros((len(examples), n)), np.zeros(len(examples))
        order = sorted(range(len(parts)), key=lambda j: len(parts[j]))
        for a in range(0, len(order), 256):
            pick = order[a : a + 256]
            positions = np.array([len(parts[j]) - more for j in pick])
            act = self._active(self._columns(self._padded([parts[j] for j in pick])), positions)
            of = np.array([own[j] for j in pick])
            np.maximum.at(top, of, act.max(1))
            np.add.at(total, of, act.sum(1))
            np.add.at(count, of, positions)
        return np.concatenate([top, total / np.maximum(count, 1)[:, None]], axis=1)

    def logits(self, examples: list[bytes]) -> np.ndarray:
        return self.features(examples) @ self.out[:-1] + self.out[-1]

    def scores(self, examples: list[bytes]) -> np.ndarray:
        return self.probabilities(self.logits(examples))

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -50, 50)))

    def gradients(self, examples: list[bytes], labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted mean logistic loss, by embed, filters, bias and out."""
        codes = self._padded([np.frombuffer(x, dtype=np.uint8) for x in examples])
        positions = np.array([len(x) - self.WIDTH + 1 for x in examples])
        n, dim, rows = self.filters.shape[1], self.embed.shape[1], np.arange(len(examples))
        x = self._columns(codes)
        act = self._active(x, positions)
        arg = act.argmax(1)
        top = np.take_along_axis(act, arg[:, None], 1)[:, 0]
        pooled = np.concatenate([top, act.sum(1) / positions[:, None]], axis=1)
        p = 1 / (1 + np.exp(-np.clip(pooled @ self.out[:-1] + self.out[-1], -50, 50)))
        g = (p - labels) * weight / len(labels)
        g_act = (g / positions)[:, None, None] * self.out[n:-1] * (act > 0)
        g_act[rows[:, None], arg, np.arange(n)] += g[:, None] * self.out[:n] * (top > 0)
        g_columns = (g_act @ self.filters.T).reshape(len(examples), -1, self.WIDTH, dim)
        g_embed = np.zeros_like(self.embed)
        for i in range(self.WIDTH):
            at = codes[:, i : i + act.shape[1]].ravel()
            part = g_columns[:, :, i].reshape(-1, dim)
            for k in range(dim):
                g_embed[:, k] += np.bincount(at, part[:, k], minlength=len(g_embed))
        g_filters = np.tensordot(x, g_act, axes=([0, 1], [0, 1]))
        return [g_embed, g_filters, g_act.sum((0, 1)), np.r_[pooled.T @ g, g.sum()]]

    def train(self, examples: list[bytes], labels: np.ndarray, rng: np.random.Generator, rounds: int = 6, batch: int = 128, rate: float = 0.01) -> None:
        """By Adam, on examples of any length up to PART."""
        params = [self.embed, self.filters, self.bias, self.out]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        weight = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        for _ in range(rounds):
            order = rng.permutation(len(examples))
            for a in range(0, len(order), batch):
                i = order[a : a + batch]
                t += 1
                grads = self.gradients([examples[j] for j in i], labels[i], weight[i])
                for p_, g_, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g_ - m)
                    v += 0.001 * (g_ * g_ - v)
                    p_ -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, examples: list[bytes], labels: np.ndarray, recall: float) -> None:
        self.calibrate_counts(self.logits(examples), labels, np.ones(len(labels)), recall)

    def calibrate_counts(self, z: np.ndarray, labels: np.ndarray, times: np.ndarray, recall: float) -> None:
        """Platt scaling by Newton's method; the highest threshold with that recall. times: how often a logit occurs."""
        x = np.stack([z, np.ones_like(z)], axis=1)
        n1, n0 = (labels * times).sum(), ((1 - labels) * times).sum()
        target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (times * (target - p)) - 1e-6 * w)
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.offset = float(w[0]), float(w[1])
        p = self.probabilities(z)
        secrets = np.flatnonzero(labels > 0)
        secrets = secrets[np.argsort(p[secrets], kind="stable")]
        self.threshold = float(p[secrets[np.searchsorted(np.cumsum(times[secrets]), int((1 - recall) * n1), side="right")]])
        hit = times * (p >= self.threshold)
        self.report = {"secrets": int(n1), "found": int(hit[labels > 0].sum()), "harmless": int(n0), "taken_for_secrets": int(hit[labels == 0].sum())}

    def packed(self) -> bytes:
        return np.concatenate([p.ravel() for p in (self.embed, self.filters, self.bias, self.out)]).tobytes()

    def unpacked(self, values: np.ndarray) -> Network:
        """A network of this one's shape with these parameters."""
        parts, at = [], 0
        for p in (self.embed, self.filters, self.bias, self.out):
            parts.append(values[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        return Network(*parts)


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = _DIGITS + _LOWER + _LOWER.upper()
_WORD = re.compile(r"[A-Za-z]{3,}")
#: How well-known kinds of keys begin, and what stands before secrets and other tokens.
PREFIXES = ("ghp_", "glpat-", "sk-", "pk_live_", "xoxb-", "AIza", "hf_", "npm_")
SECRET_CUES = ("key ", "pwd=", "Bearer ", "auth: ", "credential: ", "pass ", "with ", "")
PLAIN_CUES = ("see ", "file ", "in ", "id: ", "name=", "from ", "", "")


def planted_secret(rng: np.random.Generator) -> str:
    """A random secret of one of the known formats."""

    def run(letters: str, low: int, high: int) -> str:
        return "".join([letters[i] for i in rng.integers(0, len(letters), int(rng.integers(low, high + 1))).tolist()])

    kind = int(rng.integers(7))
    if kind == 0:
        return run(_ALNUM, 16, 48)
    if kind == 1:
        return run(_ALNUM + "+/", 22, 86) + "=" * int(rng.integers(3))
    if kind == 2:
        return PREFIXES[rng.integers(len(PREFIXES))] + run(_ALNUM, 20, 40)
    if kind == 3:
        return run(_DIGITS + "ABCDEF", 20, 40)
    if kind == 4:
        return "-".join(run(_DIGITS + _LOWER.upper(), 5, 5) for _ in range(rng.integers(4, 7)))
    if kind == 5:
        return run(_ALNUM + "+/_.=-", 10, 16) + run(_DIGITS, 1, 2)
    return "eyJ" + run(_ALNUM + "_-", 20, 40) + ".eyJ" + run(_ALNUM + "_-", 20, 60) + "." + run(_ALNUM + "_-", 30, 43)


def planted_plain(rng: np.random.Generator, words: list[str]) -> str:
    """A harmless token made of a text's words."""

    def w() -> str:
        return words[rng.integers(len(words))]

    d, kind = int(rng.integers(10 ** int(rng.integers(1, 5)))), int(rng.integers(10))
    return (
        f"{w()}{d}.{w()}.com", f"{w()}/{w()}{d}.{w()[:3].lower()}", f"v{d}.{d % 7}.{d % 13}-{w()}", f"20{d % 100:02}-{d % 12 + 1:02}-{d % 28 + 1:02}T{d % 24:02}",
        f"{w()}_{w()}{d}", f"{w().title()}{w().title()}{d}", f"{w()}.{d}", f"{d}{w()}{w()}", f"{w()}-{w()}-{d}", f"{w()}{w()}",
    )[kind]


def examples(docs: DataFrame, seed: int = 42) -> DataFrame:
    """(codes, label) from each document: its findings, a planted secret, an ordinary word, a planted harmless token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                codes, labels = [], []

                def add(text: str, a: int, b: int, label: int) -> None:
                    if b - a <= Network.PART - 2 * SIDE:
                        codes.append(example(text, a, b))
                        labels.append(label)

                for text in batch.column("text").to_pylist():
                    rng = np.random.default_rng([seed, zlib.crc32(text.encode("utf-8", "surrogatepass"))])
                    found = rules(text)
                    for _, _, end, value in found:
                        add(text, value, end, 1)
                    words = _WORD.findall(text) or ["word"]
                    for label, cues in ((1, SECRET_CUES), (0, PLAIN_CUES)):
                        token = planted_secret(rng) if label else planted_plain(rng, words)
                        at = text.rfind(" ", 0, int(rng.integers(len(text) + 1))) + 1
                        left = text[max(0, at - SIDE) : at] + cues[rng.integers(len(cues))]
                        quote = ("", "", '"', "'")[rng.integers(4)]
                        add(f"{left}{quote}{token}{quote} {text[at : at + SIDE]}", len(left) + len(quote), len(left) + len(quote) + len(token), label)
                    at = text.rfind(" ", 0, int(rng.integers(len(text) + 1))) + 1
                    end = min(i if i >= 0 else len(text) for i in (text.find(" ", at), text.find("\n", at)))
                    if end > at and not any(s < end and at < e for s, _, e, _ in found) and not CANDIDATE.search(text, at, end):
                        add(text, at, end, 0)
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(labels, pa.int32())], names=["codes", "label"])

    return docs.select("text").mapInArrow(tidy(run), "codes binary, label int")


def trained(net: Network, some: DataFrame, shares: int, visits: int, seed: int) -> Network:
    """The mean of the networks that shares of some(codes, label) make of net."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("codes").to_pylist(), table.column("label").to_pylist(), strict=True))
        labels, own = np.array([y for _, y in rows], dtype=np.float64), net.unpacked(np.frombuffer(net.packed()))
        share = table.column("share")[0].as_py()
        own.train([x for x, _ in rows], labels, np.random.default_rng([seed, share]), rounds=visits)
        return pa.table({"share": pa.array([share], pa.int64()), "n": pa.array([len(rows)], pa.int64()), "params": pa.array([own.packed()], pa.binary())})

    dealt = some.select("codes", "label", F.pmod(F.xxhash64(F.lit(seed + 1), "codes"), F.lit(shares)).cast("long").alias("share"))
    made = sorted(dealt.groupBy("share").applyInArrow(run, "share long, n long, params binary").collect())
    if not made:
        return net
    total = sum(r["n"] for r in made)
    return net.unpacked(sum(np.frombuffer(r["params"]) * (r["n"] / total) for r in made))


def counted_logits(net: Network, some: DataFrame) -> DataFrame:
    """(label, step, n): how many of some(codes, label) have a logit of step / STEPS or a little more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                z = np.clip(net.logits(part.column("codes").to_pylist()), -LARGEST, LARGEST)
                # rounded first: the last bits depend on which examples are scored together
                steps = np.floor(np.round(z, 6) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(steps, pa.int64())], names=["label", "step"])

    return some.select("codes", "label").mapInArrow(tidy(run), "label int, step long").groupBy("label", "step").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, *, recall: float = RECALL, seed: int = 42) -> Network | None:
    """Train on the examples of all documents, calibrate on the third of them that is held out."""
    seen = materialise(examples(docs.where("text is not null"), seed).distinct(), "secrets-examples")
    held = F.pmod(F.xxhash64(F.lit(seed), "codes"), F.lit(3)) == 0
    counts = {(r["label"], r["held"]): r["n"] for r in seen.groupBy("label", held.alias("held")).agg(F.count("*").alias("n")).collect()}
    if any(counts.get((y, True), 0) + counts.get((y, False), 0) < 6 for y in (0, 1)):
        return None
    # so few that none of a kind is on one side: all are trained and calibrated on
    whole = any(not counts.get((y, h)) for y in (0, 1) for h in (True, False))
    fitted = seen if whole else seen.where(~held)
    n = sum(k for (_, h), k in counts.items() if whole or not h)
    net = Network.start(np.random.default_rng(seed))
    shares = max(1, min(MOST_SHARES, n // (ROUNDS * SHARE)))
    visits = max(1, min(MOST_VISITS, -(-VISITS // (n // shares))))
    if shares == 1:
        net = trained(net, fitted, 1, visits, seed)
    else:
        for i in range(ROUNDS):
            net = trained(net, fitted.where(F.pmod(F.xxhash64(F.lit(seed + 2), "codes"), F.lit(ROUNDS)) == i), shares, visits, seed + i)
    found = sorted(counted_logits(net, seen if whole else seen.where(held)).collect())
    label, step, times = (np.array([r[c] for r in found], dtype=np.float64) for c in ("label", "step", "n"))
    net.calibrate_counts(step / STEPS, label, times, recall)
    return net


def find(texts: list[str], net: Network | None) -> list[list[tuple[int, int, int, int, float]]]:
    """(start, kind, end, value, score) of all findings of each text, in order.

    Without a network, the rules' findings have score 1.
    """
    out: list[list[tuple[int, int, int, int, float]]] = []
    codes, places = [], []
    for i, text in enumerate(texts):
        found = rules(text)
        if net is None:
            out.append([(*f, 1.0) for f in found])
            continue
        out.append([])
        for start, kind, end, value in found + [(a, 3, b, a) for a, b in candidates(text, found)]:
            codes.append(example(text, value, end))
            places.append((i, start, kind, end, value))
    if codes:
        for (i, start, kind, end, value), p in zip(places, net.scores(codes).tolist(), strict=True):
            if kind < 3 or p >= net.threshold:
                out[i].append((start, kind, end, value, p))
    return [sorted(f) for f in out]


_FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, findings) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = find([t or "" for t in batch.column("text").to_pylist()], net)
                rows = [[{"kind": KINDS[k], "start": a, "end": b, "score": p} for a, k, b, _, p in fs] for fs in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _ARROW)], names=["doc_id", "findings"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("findings", _FINDINGS)]))


MASK = "[secret]"


def mask(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with every found secret (of an assignment, its value) replaced; n_chars, if any, follows."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                out: list[str | None] = []
                for text, found in zip(texts, find([t or "" for t in texts], net), strict=True):
                    at, parts = 0, []
                    for _, _, end, value, _ in found:
                        if end > at:
                            parts += [text[at : max(at, value)], MASK]
                            at = end
                    out.append("".join(parts) + text[at:] if parts else text)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    masked = docs.mapInArrow(tidy(run), docs.schema)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else masked


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: counts and digests of every document's findings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs, fit(docs))
    text = "concat_ws(':', f.kind, f.start, f.end)"
    return out.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(findings, f -> f.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:3]],
        F.expr(f"sha2(array_join(transform(filter(findings, f -> f.kind <> 'cnn'), f -> {text}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(transform(findings, f -> {text}), ',')").alias("spans"),
    )
