"""Source divergence audit: how far the sources of a language differ in their terms, and by which terms.

Counts are made by shards of language and term. A task counts the terms of its documents, some megabytes of text at a time, and
writes a compressed block of (language, source, term, count, documents) for each shard. A shard's blocks meet in one task, where
DuckDB adds them up, keeps the terms of enough documents, and later makes the shard's part of every pair's sum and its highest
terms. Spark adds the parts and ranks them.

All terms count for every source, those it lacks too, but only what occurs is ever a row. With f(p, q) the value of a
pair of shares and p0 the share of a term that a source lacks, the sum over all terms of sources a and b is

    terms * f(p0a, p0b)  +  sum over a's terms of f(pa, p0b) - f(p0a, p0b)  +  sum over b's terms of f(p0a, pb) - f(p0a, p0b)
    +  sum over the terms of both of f(pa, pb) - f(pa, p0b) - f(p0a, pb) + f(p0a, p0b)

The middle sums depend on a term's count alone, so they are taken over the histogram of a source's counts; only the last one
meets sources by twos, in the shards, on terms that both have. Integers throughout: hugeint in the shards, decimals in Spark.

A shard is bounded by the text it is cut from (the number of shards grows with the corpus), and a term of all sources is one row
for a source and a task. Nothing is collected or broadcast: a shard's totals come to it as rows of the groups that occur there.

Defined cases: null texts, languages and sources are empty strings; a document without terms still makes its group occur;
a language whose terms are all too rare has pairs with value 0 and no terms; a source alone in its language has no pairs; equal
values rank by the item's UTF-8 bytes; repeated rows count as often as they occur; texts of any length are cut whole; no rows
give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinsework.llm import spans
from rinsework.llm.workers import tidy
from rinsework.session import staged

UNIT = 10**9
AT_ONCE = 24 << 20  # bytes of text whose counts make one set of blocks
SHARD = 32 << 20  # bytes of text for each shard
TERM = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SOME = "shard int, lang string, source string, block binary"
COUNTED = "kind string, shard int, lang string, source string, n long, block binary"
PARTS = "kind string, lang string, source string, item string, n long, value decimal(38,0)"


def _duckdb() -> Any:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})  # a shard is bounded: nothing spills
    con.execute("set preserve_insertion_order = false")
    return con


def packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def unpacked(blocks: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(b)).read_all() for b in blocks])


def counts_of(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, count, documents) of each term that occurs in a group. group: a number for each text."""
    data, bounds = spans.flat(texts)
    data = LOWER[data]
    inside = TERM[data]
    starts = np.zeros(len(data) + 1, bool)
    starts[1:-1] = inside[1:] != inside[:-1]
    starts[bounds] = True
    at = np.flatnonzero(starts)
    own = np.flatnonzero(inside[at[:-1]])
    terms = spans.chunks(data, at).take(pa.array(own)).dictionary_encode()
    size = max(len(terms.dictionary), 1)
    doc = np.searchsorted(bounds, at[:-1][own], "right") - 1
    by_doc, n = np.unique(doc * size + terms.indices.to_numpy(), return_counts=True)
    key, place, docs = np.unique(group[by_doc // size] * size + by_doc % size, return_inverse=True, return_counts=True)
    return key // size, terms.dictionary.take(pa.array(key % size)), np.bincount(place, n, len(key)).astype(np.int64), docs


def blocks(docs: DataFrame, shards: int) -> DataFrame:
    """A row for each shard and some megabytes of text, and one for each group there (with no block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duckdb()
        for texts, langs, sources in _gathered(batches):
            numbers: dict[tuple[str, str], int] = {}
            group = np.array([numbers.setdefault(x, len(numbers)) for x in zip(langs, sources, strict=True)], np.int64)
            code, term, n, n_docs = counts_of(texts, group)
            names = [pa.array(x, pa.string()) for x in zip(*numbers, strict=True)]
            own = pa.table({"lang": names[0].take(pa.array(code)), "source": names[1].take(pa.array(code)), "term": term.cast(pa.binary()).cast(pa.string()), "n": n, "docs": n_docs})  # noqa: F841 (named in the SQL)
            cut = con.sql(f"select (hash(lang, term) % {shards})::int as shard, * from own order by shard, lang, term").to_arrow_table()
            ends = np.searchsorted(cut["shard"].to_numpy(), np.arange(shards + 1))
            cut = cut.drop_columns("shard")
            for column in ("lang", "source"):
                cut = cut.set_column(cut.column_names.index(column), column, cut[column].combine_chunks().dictionary_encode())
            for i in range(shards):
                if ends[i] < ends[i + 1]:
                    yield _rows([(i, None, None, packed(cut.slice(ends[i], ends[i + 1] - ends[i])))], SOME)
            yield _rows([(hash_of(x, shards), *x, None) for x in numbers], SOME)

    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(said("text"), said("lang"), said("source")).mapInArrow(tidy(run), SOME)


def hash_of(group: tuple[str, str], shards: int) -> int:
    import zlib

    return zlib.crc32("\0".join(group).encode()) % shards


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], list[str]]]:
    """Consecutive rows of at most AT_ONCE bytes of text, one row at least."""
    kept: list[tuple[pa.Array, list[str], list[str]]] = []
    size = 0

    def whole() -> tuple[pa.Array, list[str], list[str]]:
        return pa.concat_arrays([k[0] for k in kept]), [x for k in kept for x in k[1]], [x for k in kept for x in k[2]]

    for b in batches:
        langs, sources, at = b.column(1).to_pylist(), b.column(2).to_pylist(), 0
        for texts in spans.slices(b.column(0), AT_ONCE):
            more = int(spans.flat(texts)[1][-1])
            if kept and size + more > AT_ONCE:
                yield whole()
                kept, size = [], 0
            kept.append((texts, langs[at : at + len(texts)], sources[at : at + len(texts)]))
            at, size = at + len(texts), size + more
    if kept:
        yield whole()


ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "decimal(38,0)": pa.decimal128(38, 0)}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ARROW[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _by_shard(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of one shard after another, of a stream that is sorted by shard."""
    now, kept = None, []
    for b in batches:
        for row in b.select(names).to_pylist():
            if row["shard"] != now and kept:
                yield now, kept
                kept = []
            now = row["shard"]
            kept.append(row)
    if kept:
        yield now, kept


KEPT = """
with counts as (select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from parts group by all),
kept as (select lang, term from counts group by all having sum(docs) >= {least})
select lang, source, term, n from counts semi join kept using (lang, term) order by lang, term, source
"""


def kept_terms(found: DataFrame, least: int) -> DataFrame:
    """COUNTED. For each shard: a block of (lang, source, term, n) of terms in `least` documents of the language, how many these are by
    language ("terms"), the occurrences by group there ("part"), and the groups as they occur ("group")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duckdb()
        for shard, rows in _by_shard(batches, ["shard", "lang", "source", "block"]):
            out = [("group", shard, r["lang"], r["source"], 0, None) for r in rows if r["block"] is None]
            own = [r["block"] for r in rows if r["block"] is not None]
            if own:
                parts = unpacked(own)  # noqa: F841 (named in the SQL)
                kept = con.sql(KEPT.format(least=least)).to_arrow_table()
                out.append(("block", shard, None, None, kept.num_rows, packed(kept)))
                out += [("terms", shard, *r) for r in con.sql("select lang, null, count(distinct term), null from kept group by lang").fetchall()]
                out += [("part", shard, *r) for r in con.sql("select lang, source, sum(n)::bigint, null from kept group by all").fetchall()]
            yield _rows(out, COUNTED)

    dealt = found.repartition(F.col("shard")).sortWithinPartitions("shard")
    return staged(dealt.mapInArrow(tidy(run), COUNTED), "terms")


def totals(counted: DataFrame) -> DataFrame:
    """lang, source, n, terms, lang_n of every group that occurs."""
    terms = counted.filter("kind = 'terms'").groupBy("lang").agg(F.sum("n").alias("terms"))
    groups = counted.filter("kind in ('group', 'part')").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    whole = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    return groups.join(whole, "lang").join(terms, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)).cast("long"))


SHARES = """
create or replace temp table shares as
select c.lang, c.source, term, c.n, lang_n, terms, sum(c.n) over (partition by c.lang, term) as in_lang,
  (1 + ({unit}::hugeint * (c.n + 1)) // (g.n + terms))::bigint as p, (1 + {unit}::hugeint // (g.n + terms))::bigint as p0
from counts c join sizes g on g.lang = c.lang and g.source = c.source
"""
TERMS = """
with known as (select lang, source, term, p, (1 + ({unit}::hugeint * (in_lang + 1)) // (lang_n + terms))::bigint as q from shares)
select 'term', lang, source, term, null, ((p - q) * (p - q) // q)::decimal(38, 0) as value from known where p > q
qualify row_number() over (partition by lang, source order by value desc, term) <= {most}
"""
PAIRS = """
with met as (
  select a.lang, a.source as x, b.source as y, a.p, a.p0, b.p as q, b.p0 as q0, (a.p - b.p) * (a.p - b.p) as d, (a.p - b.p0) * (a.p - b.p0) as d1,
    (a.p0 - b.p) * (a.p0 - b.p) as d2, (a.p0 - b.p0) * (a.p0 - b.p0) as d0
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source < b.source),
sums as (select lang, x, y, sum(d // q - d1 // q0 - d2 // q + d0 // q0) as xy, sum(d // p - d2 // p0 - d1 // p + d0 // p0) as yx from met group by all)
select 'pair', lang, x, y, null, xy::decimal(38, 0) from sums union all select 'pair', lang, y, x, null, yx::decimal(38, 0) from sums
"""
COUNTS = "select 'count', lang, source, null, n, count(*)::decimal(38, 0) from counts group by all"


def parts(counted: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """PARTS. For each shard: the last sum of every two sources that share a term ("pair"), the histogram of counts ("count"), and the
    `most` highest terms of each group ("term")."""
    here = counted.filter("kind = 'part'").select("shard", "lang", "source").join(sizes, ["lang", "source"]).select("shard", "lang", "source", "n", "terms", "lang_n", F.lit(None).cast("binary").alias("block"))
    rows = counted.filter("kind = 'block'").select("shard", *(F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n", "long"), ("terms", "long"), ("lang_n", "long"))), "block").unionByName(here)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duckdb()
        for _, own in _by_shard(batches, ["shard", "lang", "source", "n", "terms", "lang_n", "block"]):
            counts = unpacked([r["block"] for r in own if r["block"] is not None])  # noqa: F841 (named in the SQL)
            sizes = pa.Table.from_pylist([r for r in own if r["block"] is None], pa.schema([("lang", pa.string()), ("source", pa.string()), *((c, pa.int64()) for c in ("n", "terms", "lang_n"))]))  # noqa: F841
            con.execute(SHARES.format(unit=UNIT))
            for sql in (TERMS.format(unit=UNIT, most=most), PAIRS, COUNTS):
                found = con.sql(sql).to_arrow_table()
                for b in found.combine_chunks().to_batches():
                    yield pa.RecordBatch.from_arrays([c.cast(ARROW[f.split()[1]]) for c, f in zip(b.columns, PARTS.split(", "), strict=True)], [f.split()[0] for f in PARTS.split(", ")])

    dealt = rows.repartition(F.col("shard")).sortWithinPartitions("shard")
    return staged(dealt.mapInArrow(tidy(run), PARTS), "parts")


def _whole(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("decimal(38,0)")


def _share(count: Column | int, n: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (n + terms)), a whole number of at most UNIT + 1; without terms there is nothing to share."""
    above = (_whole(count).cast("decimal(20,0)") + 1).cast("decimal(21,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", above, F.greatest(n + terms, F.lit(1)).cast("decimal(20,0)")) + 1


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank. docs: text, lang, source."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    counted = kept_terms(blocks(docs, max(1, -(-size // SHARD))), least)
    sizes = staged(totals(counted), "sizes")
    found = parts(counted, sizes, most)
    side = lambda n: sizes.select("lang", F.col("source").alias(n), F.col("n").alias(f"{n}_n"), "terms") if n == "source" else sizes.select("lang", F.col("source").alias(n), F.col("n").alias(f"{n}_n"))
    pairs = side("source").join(side("item"), "lang").filter("source <> item")
    none = pairs.withColumn("p", _share(0, F.col("source_n"), F.col("terms"))).withColumn("q", _share(0, F.col("item_n"), F.col("terms")))
    base = none.select("lang", "source", "item", (_whole(_value(F.col("p"), F.col("q"))) * _whole(F.col("terms"))).cast("decimal(38,0)").alias("value"))
    counts = found.filter("kind = 'count'").groupBy("lang", "source", F.col("n").alias("count")).agg(F.sum("value").cast("long").alias("many"))
    with_all = (
        counts.join(none, ["lang", "source"])
        .withColumn("own", _share(F.col("count"), F.col("source_n"), F.col("terms")))
        .withColumn("nothing", _value(F.col("p"), F.col("q")))
        .withColumn("back", _value(F.col("q"), F.col("p")))
    )
    more = lambda v, b: F.sum(_whole(F.col("many")) * _whole(v - F.col(b))).cast("decimal(38,0)").alias("value")
    ahead = with_all.groupBy("lang", "source", "item").agg(more(_value(F.col("own"), F.col("q")), "nothing"))
    behind = with_all.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(more(_value(F.col("q"), F.col("own")), "back"))
    met = found.filter("kind = 'pair'").select("lang", "source", "item", "value")
    summed = base.unionByName(ahead).unionByName(behind).unionByName(met).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")).withColumn("part", F.lit("pair"))
    terms = found.filter("kind = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"), F.lit("term").alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    highest = terms.withColumn("rank", rank).filter(F.col("rank") <= most)
    return summed.withColumn("rank", rank).unionByName(highest).select("lang", "source", "part", "item", "value", "rank")
