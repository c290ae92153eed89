"""Source divergence audit: how far apart the sources of a language are, and by which terms.

Terms are runs of ASCII letters (lower-cased) and of characters beyond ASCII. A language keeps the
terms that at least LEAST_DOCUMENTS of its documents hold. A group (language, source) gives a kept
term that it holds c times the probability 1 + floor(10^9 (c + 5) / (N + 5 V)), V being the kept terms
of the language and N the group's occurrences of them; the language as a whole likewise.

The counts come from one sorted stream. Blocks of documents are counted first (a row for each language,
source and term of a block, so the words of every document shrink before anything moves); the rows are
dealt by ranges of (lang, term, source, block) and sorted,
language and term being one string, so a very frequent term spans as many
partitions as it needs, and one scan over the runs gives document frequencies and counts. A run that a
partition's border cuts leaves its parts to a small sum by key; every other run is settled where it is
scanned. A second scan reads the kept runs term by term, after the sizes of the language's groups, and
gives partial distances of pairs and each group's best terms so far, which are then summed and ranked.

Defined results: null text, lang and source are ''; every row is a document, repeated rows count each;
a group without terms takes part in pairs; a language that keeps no term has pairs of value 0 and no
terms; ties go to the smaller item by UTF-8; an empty table gives no rows; other columns are not looked
at. All arithmetic is on whole numbers, exact up to 9 * 10^15 occurrences a group.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, slices, tidy

#: On UTF-8: bytes of 128 and above are all of characters beyond ASCII, and bytes.lower is that of ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
LEAST_DOCUMENTS = 30
MOST_TERMS = 50
SMOOTHING = 5
#: A block of documents ends when it has so many (language, source, term) rows.
BLOCK_TERMS = 600_000
#: Occurrences in longer texts are counted one by one, without a list of them.
LIST_BYTES = 4 << 20
#: Counts of terms by sources that the second scan holds at a time, and pairs of sources that it sums by itself.
CELLS = 1 << 20

#: Between a language and a term in the key that both make; no term holds it.
BETWEEN = "\0"

_BLOCKS = "key string, source string, block long, df long, n long"
_RUNS = "lang string, term string, source string, df long, n long, whole boolean"
_FOUND = "lang string, source string, part string, item string, value long"


def terms(text: str) -> tuple[list | Counter, set]:
    """Occurrences of a text's terms, and the terms, in UTF-8."""
    data = text.encode().lower()
    found = TERM.findall(data) if len(data) <= LIST_BYTES else Counter(m.group() for m in TERM.finditer(data))
    return found, set(found)


def count_blocks(docs: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(key, source, block, df, n), key being the language and the term as one sortable string.

    A row for each group of a block has the language alone, without BETWEEN and a term, and how many documents it has.
    """
    names = ["key", "source", "block", "df", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        held: dict = defaultdict(lambda: [Counter(), Counter(), 0])

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal block
            for (lang, source), (df, n, k) in held.items():
                words = list(df)
                size = len(words) + 1
                head = lang + BETWEEN
                columns = [pa.array([lang, *[head + w.decode() for w in words]], pa.string()), pa.array([source] * size), pa.array([block] * size, pa.int64())]
                columns += [pa.array([k, *df.values()], pa.int64()), pa.array([0, *[n[w] for w in words]], pa.int64())]
                whole = pa.RecordBatch.from_arrays(columns, names=names)
                yield from (whole.slice(a, 50_000) for a in range(0, size, 50_000))
            held.clear()
            block += 1

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                for text, lang, source in zip(*[batch.column(c).to_pylist() for c in ("text", "lang", "source")], strict=True):
                    found, distinct = terms(text or "")
                    own = held[lang or "", source or ""]
                    own[0].update(distinct)
                    own[1].update(found)
                    own[2] += 1
                if sum(len(x[0]) for x in held.values()) > block_terms:
                    yield from rows()
        yield from rows()

    return docs.select("text", "lang", "source").mapInArrow(tidy(run), _BLOCKS)


def _starts(batch: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which any of the keys differs from the row before."""
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for k in keys if n > 1 else []:
        c = batch.column(k)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def scan_runs(blocks: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, source, df, n, whole) of rows in the order of (key, source).

    whole: all of the language's rows of the term are in this partition, and it is kept. Of other
    terms, those that a border may cut are given with what the partition has of them.
    """
    keys = ["key", "source"]
    schema = pa.schema([*[(k, pa.string()) for k in keys], ("df", pa.int64()), ("n", pa.int64())])

    def reduced(table: pa.Table) -> pa.Table:
        at = _starts(table, keys)
        sums = [np.add.reduceat(table.column(c).to_numpy(), at) if len(at) else np.zeros(0, np.int64) for c in ("df", "n")]
        return pa.table([*[table.column(k).take(pa.array(at)) for k in keys], *map(pa.array, sums)], schema=schema)

    def told(table: pa.Table, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        """The runs of whole terms but for the first and last of the partition, which may go on elsewhere."""
        at = _starts(table, ["key"])
        if not len(at):
            return
        total = np.add.reduceat(table.column("df").to_numpy(), at)
        whole = np.ones(len(at), dtype=bool)
        whole[:1] &= not first
        whole[-1:] &= not last
        each = np.diff(np.r_[at, table.num_rows])
        keep = np.repeat(~whole | (total >= least), each)
        out = table.append_column("whole", pa.array(np.repeat(whole, each))).filter(pa.array(keep))
        parts = [k.rpartition(BETWEEN) for k in out.column("key").to_pylist()]
        columns = [pa.array([p[0] for p in parts], pa.string()), pa.array([p[2] for p in parts], pa.string()), *[out.column(c) for c in ("source", "df", "n", "whole")]]
        yield from pa.table(columns, names=["lang", "term", "source", "df", "n", "whole"]).combine_chunks().to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for batch in batches:
            table = pa.table([batch.column(c) for c in schema.names], schema=schema)
            table = reduced(pa.concat_tables([held, table]).combine_chunks() if held is not None else table)
            at = _starts(table, ["key"])
            if len(at) > 1:
                yield from told(table.slice(0, at[-1]), first, False)
                first = False
            held = table.slice(at[-1]) if len(at) else None
        if held is not None:
            yield from told(held, first, True)

    return blocks.mapInArrow(tidy(run), _RUNS)


def kept_runs(docs: DataFrame, least: int = LEAST_DOCUMENTS, block_terms: int = BLOCK_TERMS) -> tuple[DataFrame, DataFrame]:
    """(lang, term, source, n) of kept terms, and the groups (lang, source) that occur."""
    blocks = materialise(count_blocks(docs, block_terms), "divergence-blocks")
    term = F.col("n") > 0
    groups = blocks.where(~term).select(F.col("key").alias("lang"), "source").distinct()
    order = ["key", "source", "block"]
    dealt = blocks.where(term).repartitionByRange(*order).sortWithinPartitions(*order)
    runs = materialise(scan_runs(dealt, least), "divergence-runs")
    cut = runs.where("not whole")
    kept = cut.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= least).select("lang", "term")
    joined = cut.join(kept, ["lang", "term"]).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    return runs.where("whole").select("lang", "term", "source", "n").unionByName(joined), groups


def per_billion(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """floor(10^9 x / d), exactly, for 0 <= x and d below 9 * 10^15."""
    q, r = np.divmod(x, d)
    for _ in range(3):
        a, r = np.divmod(r * 1000, d)
        q = q * 1000 + a
    return q


class Audit:
    """What one task finds of one language: sums of distances, and each source's best terms."""

    def __init__(self, lang: str, sources: list[str], sizes: np.ndarray, kept: int, most: int, cells: int):
        self.lang, self.sources, self.most = lang, sources, most
        self.divisor, self.all = sizes + SMOOTHING * kept, np.int64(sizes.sum() + SMOOTHING * kept)
        self.place = {s: i for i, s in enumerate(sources)}
        self.sums = np.zeros((len(sources),) * 2, dtype=np.int64) if len(sources) ** 2 <= cells else None
        self.best: list[list[tuple[int, str]]] = [[] for _ in sources]

    def _pairs(self, i: int, sums: np.ndarray) -> pa.RecordBatch:
        others = [j for j in range(len(self.sources)) if j != i]
        n = len(others)
        return _batch([self.lang] * n, [self.sources[i]] * n, ["pair"] * n, [self.sources[j] for j in others], sums[others])

    def add(self, words: list[str], term: np.ndarray, source: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Take in whole terms; row k says that words[term[k]] occurs n[k] times in sources[source[k]]."""
        counts = np.zeros((len(words), len(self.sources)), dtype=np.int64)
        counts[term, source] = n
        p = 1 + per_billion(counts + SMOOTHING, self.divisor)
        more = p - (1 + per_billion(counts.sum(1) + SMOOTHING, self.all))[:, None]
        for i in range(len(self.sources)):
            sums = np.abs(p - p[:, i : i + 1]).sum(0)
            if self.sums is None:
                yield self._pairs(i, sums)
            else:
                self.sums[i] += sums
            at = np.flatnonzero((counts[:, i] > 0) & (more[:, i] > 0))
            value = more[at, i]
            if len(at) > self.most:  # ties with the last one stay
                least = -np.partition(-value, self.most - 1)[self.most - 1]
                at, value = at[value >= least], value[value >= least]
            own = self.best[i] + [(-v, words[k]) for v, k in zip(value.tolist(), at.tolist(), strict=True)]
            self.best[i] = sorted(own)[: self.most]

    def found(self) -> Iterator[pa.RecordBatch]:
        for i, best in enumerate(self.best):
            if self.sums is not None:
                yield self._pairs(i, self.sums[i])
            yield _batch([self.lang] * len(best), [self.sources[i]] * len(best), ["term"] * len(best), [w for _, w in best], [-v for v, _ in best])


def _batch(lang: list, source: list, part: list, item: list, value: list | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array(x, pa.string()) for x in (lang, source, part, item)], pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


def scan_kept(stream: DataFrame, most: int = MOST_TERMS, cells: int = CELLS) -> DataFrame:
    """Partial results of rows (lang, term, source, n, kept) in the order of (lang, term).

    A language begins with its groups: rows of null term, n being their size, kept the number of terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit: Audit | None = None
        header: list[tuple[str, int, int]] = []
        words: list[str] = []
        rows: list[tuple[int, int, int]] = []
        lang = None

        def flush() -> Iterator[pa.RecordBatch]:
            if words:
                t, s, n = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
                yield from audit.add(words, t, s, n)
            words.clear()
            rows.clear()

        def end() -> Iterator[pa.RecordBatch]:
            if audit is not None:
                yield from flush()
                yield from audit.found()

        for batch in batches:
            for of, term, source, n, kept in zip(*[batch.column(c).to_pylist() for c in ("lang", "term", "source", "n", "kept")], strict=True):
                if of != lang:
                    yield from end()
                    lang, audit, header = of, None, []
                if term is None:
                    header.append((source, n, kept))
                    continue
                if audit is None:
                    audit = Audit(lang, [h[0] for h in header], np.array([h[1] for h in header], dtype=np.int64), header[0][2], most, cells)
                if not words or words[-1] != term:
                    if (len(words) + 1) * len(header) > cells:
                        yield from flush()
                    words.append(term)
                rows.append((len(words) - 1, audit.place[source], n))
        yield from end()

    return stream.mapInArrow(tidy(run), _FOUND)


def audit(docs: DataFrame, *, least: int = LEAST_DOCUMENTS, most: int = MOST_TERMS, block_terms: int = BLOCK_TERMS, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) for docs(text, lang, source)."""
    spark = docs.sparkSession
    shared_dir(spark)
    runs, seen = kept_runs(docs, least, block_terms)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = materialise(runs.withColumn("to", F.pmod(F.xxhash64("lang", "term"), F.lit(parts)).cast("int")), "divergence-kept")
    sizes = runs.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = runs.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    groups = materialise(seen.join(sizes, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["n", "kept"]), "divergence-groups")
    headers = runs.select("lang", "to").distinct().join(groups, "lang").withColumn("term", F.lit(None).cast("string"))
    columns = ["to", "lang", "term", "source", "n", "kept"]
    stream = headers.select(*columns).unionByName(runs.withColumn("kept", F.lit(0).cast("long")).select(*columns))
    stream = stream.repartitionById(parts, "to").sortWithinPartitions("lang", F.col("term").asc_nulls_first(), "source")
    other = groups.where("kept = 0").select("lang", F.col("source").alias("item"))
    none = groups.where("kept = 0").join(other, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    found = scan_kept(stream, most, cells).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.unionByName(none).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= most))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: distances of all sources of a language, and the terms that tell each from the language."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with d as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct r) >= 30),
v as (select lang, count(*) as v from kept group by lang),
c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by lang, source, term),
g as (select distinct lang, source from d),
size as (select g.lang, g.source, coalesce(sum(n), 0) as n from g left join c on c.lang = g.lang and c.source = g.source group by g.lang, g.source),
p as (select s.lang, s.source, kept.term, coalesce(c.n, 0) as n,
  1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (s.n + 5 * v.v) as p
  from size s join kept on kept.lang = s.lang join v on v.lang = s.lang
  left join c on c.lang = s.lang and c.source = s.source and c.term = kept.term),
q as (select a.lang, a.term, 1 + (1000000000::hugeint * (a.n + 5)) // (b.n + 5 * v.v) as q
  from (select lang, term, sum(n) as n from c group by lang, term) a
  join (select lang, sum(n) as n from size group by lang) b on b.lang = a.lang join v on v.lang = a.lang),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source
  left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by a.lang, a.source, b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, (p.p - q.q)::bigint as value
  from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p.p > q.q),
f as (select * from pairs union all select * from terms)
select lang, source, part, item, value, rank::int as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from f) ranked
where part = 'pair' or rank <= 50
"""
