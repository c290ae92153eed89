"""Personal data: fixed rules, and identifiers that bootstrapped contextual patterns find.

The rules find e-mail addresses, IP addresses, card numbers (by their check digit) and international
phone numbers. Their findings are the seeds. Every other token with DIGITS digits, or with an @ inside,
is a candidate. The words around a finding or candidate make lexical patterns: the word before, the two
before, the words on either side, the two behind; digits in them count as 0, letters as lower case.

Distinct (pattern, instance) pairs are a graph, scored in rounds by joins and sums. A pattern is taken
when SUPPORT of its instances or more are known identifiers, and these are a share of SCORE or more of
its instances and one. Each pattern taken adds -ln(1 - share) to its instances, and an instance whose
sum reaches -ln(1 - SURE) becomes a known identifier, which next round counts for the patterns. ROUNDS
bounds how far this goes from the seeds; it ends sooner when a round adds nothing. A candidate is then
a span where its instance is known and one of its own patterns is taken. The rules' findings all stay.

Weights are summed in whole millionths, so the order of tasks decides nothing. A pair counts once,
however many copies of a document there are.

Defined results: null text is empty; a text without findings has spans ''; equal texts have equal
spans; an empty table gives no rows; rows are looked at one by one, also of one doc_id; columns other
than doc_id and text are not looked at. Texts and tokens of any length are read whole; a context is the
words that begin within CONTEXT characters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, slices, tidy

KINDS = ("email", "ip", "card", "phone", "context")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What candidates are made of; a candidate holds one of MARKS, which is where it is looked for.
INNER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@._+/-")
INNER_RUN = re.compile(r"[A-Za-z0-9@._+/-]*")
MARKS = re.compile(r"[0-9@]")
DIGITS = 4
LEAST_LENGTH = 5
CONTEXT = 48
SUPPORT = 3
SCORE = 0.6
SURE = 0.95
ROUNDS = 4


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@host, each @ looked at once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def small_parts(ip: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in ip.split("."))


def luhn(card: str) -> bool:
    digits = [int(c) for c in card if c not in " -"] if len(card) <= 40 else []
    if not 14 <= len(digits) <= 19:
        return False
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def rules(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' matches, by start and kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if small_parts(m.group())]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 14 and luhn(m.group())]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(out)


def candidates(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens that may be identifiers and that no rule's match overlaps."""
    out, free, i, reach = [], 0, 0, 0
    m = MARKS.search(text)
    while m:
        start = m.start()
        while start > free and text[start - 1] in INNER:
            start -= 1
        free = end = INNER_RUN.match(text, m.end()).end()
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while start < end and not text[start].isalnum():
            start += 1
        token = text[start:end]
        if len(token) >= LEAST_LENGTH and ("@" in token or sum("0" <= c <= "9" for c in token) >= DIGITS):
            while i < len(found) and found[i][0] < end:
                reach = max(reach, found[i][2])
                i += 1
            if reach <= start:
                out.append((start, end))
        m = MARKS.search(text, free)
    return out


_DIGIT = str.maketrans("123456789", "000000000")


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a place: `_` is what stands there."""
    before, after = text[max(0, start - CONTEXT) : start].lower().translate(_DIGIT), text[end : end + CONTEXT].lower().translate(_DIGIT)
    left, right = before.split()[-2:], after.split()[:2]
    a, b = ("" if before and not before[-1].isspace() else " "), ("" if after and not after[0].isspace() else " ")
    out = []
    if left:
        out.append(f"{left[-1]}{a}_")
        if len(left) == 2:
            out.append(f"{left[0]} {left[1]}{a}_")
        if right:
            out.append(f"{left[-1]}{a}_{b}{right[0]}")
    if len(right) == 2:
        out.append(f"_{b}{right[0]} {right[1]}")
    return out


_PLACES = "array<struct<kind: int, start: long, end: long, instance: string, patterns: array<string>>>"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def places(text: str) -> list[dict]:
    """The rules' findings and the candidates of a text, by start and kind, with their patterns."""
    found = rules(text)
    both = sorted(found + [(a, 4, b) for a, b in candidates(text, found)])
    return [{"kind": k, "start": a, "end": b, "instance": text[a:b], "patterns": patterns(text, a, b)} for a, k, b in both]


def look(docs: DataFrame) -> DataFrame:
    """(row, doc_id, places) of every row of docs(doc_id, text), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [places(t or "") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _ARROW)], names=["doc_id", "places"])

    seen = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), f"doc_id long, places {_PLACES}")
    return materialise(seen.withColumn("row", F.monotonically_increasing_id()), "identifiers-places")


def millionths(share: float) -> int:
    return round(-1e6 * math.log(1 - share))


class Bootstrap:
    """Known identifiers (instance) and the patterns taken (pattern, weight), grown from the rules' findings."""

    def __init__(self, seen: DataFrame, *, support: int = SUPPORT, score: float = SCORE, sure: float = SURE, rounds: int = ROUNDS):
        self.support, self.score, self.sure = support, score, sure
        each = seen.select(F.explode("places").alias("p"))
        pairs = each.select(F.explode("p.patterns").alias("pattern"), F.col("p.instance").alias("instance")).distinct()
        pairs = materialise(pairs, "identifiers-pairs")
        many = pairs.groupBy("pattern").agg(F.count("*").alias("instances")).where(F.col("instances") >= support)
        self.edges = materialise(pairs.join(many, "pattern"), "identifiers-edges")
        self.seeds = materialise(each.where("p.kind < 4").select(F.col("p.instance").alias("instance")).distinct(), "identifiers-seeds")
        self.known, self.taken, size = self.seeds, None, -1
        for _ in range(rounds):
            self.taken = materialise(self._take(), "identifiers-patterns")
            self.known = materialise(self._know(), "identifiers-known")
            now = self.known.count()
            if now == size:  # the known only grow
                break
            size = now

    def _take(self) -> DataFrame:
        held = self.edges.join(self.known, "instance", "left_semi").groupBy("pattern").agg(F.count("*").alias("good"), F.first("instances").alias("instances"))
        share = F.col("good") / (F.col("instances") + 1)
        weight = F.round(-1e6 * F.log(1 - share)).cast("long")
        return held.where((F.col("good") >= self.support) & (share >= self.score)).select("pattern", weight.alias("weight"))

    def _know(self) -> DataFrame:
        sums = self.edges.join(self.taken, "pattern").groupBy("instance").agg(F.sum("weight").alias("weight"))
        return sums.where(F.col("weight") >= millionths(self.sure)).select("instance").unionByName(self.known).distinct()

    def spans(self, seen: DataFrame) -> DataFrame:
        """(row, found): the candidates of a row that are known identifiers where a taken pattern stands."""
        each = seen.select("row", F.explode("places").alias("p")).where("p.kind = 4").select("row", "p.kind", "p.start", "p.end", "p.instance", "p.patterns")
        each = each.join(self.known, "instance", "left_semi").withColumn("pattern", F.explode("patterns"))
        each = each.join(self.taken, "pattern", "left_semi").select("row", "kind", "start", "end").distinct()
        return each.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("found"))


def find(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, spans) of every row of docs(doc_id, text): spans (start, kind, end) by start and kind."""
    shared_dir(docs.sparkSession)
    seen = look(docs)
    found = Bootstrap(seen, **options).spans(seen)
    base = F.expr("transform(filter(places, p -> p.kind < 4), p -> struct(p.start as start, p.kind as kind, p.end as end))")
    both = seen.select("row", "doc_id", base.alias("base")).join(found, "row", "left")
    return both.select("doc_id", F.array_sort(F.when(F.col("found").isNull(), F.col("base")).otherwise(F.concat("base", "found"))).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: counts, digest and spans of every document's personal data."""
    out = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    told = f"concat_ws(':', {names}[s.kind], s.start, s.end)"
    return out.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.expr(f"sha2(array_join(transform(filter(spans, s -> s.kind < 4), s -> {told}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(transform(spans, s -> {told}), ',')").alias("spans"),
    )
