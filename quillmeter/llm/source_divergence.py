"""How the sources of a language differ in their terms: each term is one wide array of shares, indexed by source."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.llm._store import Store

#: Bytes of terms stay (A-Z in lower case), all others become spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Counts that a task holds before it hands them on, and bytes of a text that are split at once.
HELD, SEGMENT = 300_000, 1 << 20
#: Groups up to which a row for each language is broadcast; beyond, it is joined by shuffling, in salted copies.
BROADCAST_GROUPS, SALTS = 20_000, 32
#: Shares are whole numbers in units of one in this many.
UNIT = 1_000_000_000


def _segments(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a segment at a time."""
    text, at = text.translate(_TERMS), 0
    while at < len(text):
        end = len(text) if len(text) - at <= SEGMENT else text.find(b" ", at + SEGMENT)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents), summed over the rows at hand; a row without a term for each group."""
    total: defaultdict[tuple, Counter] = defaultdict(Counter)
    held: defaultdict[tuple, Counter] = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        langs, sources, terms, n, docs = [], [], [], [], []
        for (lang, source), found in total.items():
            own = held[lang, source]
            langs += [lang] * (len(found) + 1)
            sources += [source] * (len(found) + 1)
            terms += [None, *found]
            n += [0, *found.values()]
            docs += [0, *(own[t] for t in found)]
        total.clear()
        held.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()).cast(pa.string()) for c in (langs, sources, terms)), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns), strict=True):
            counts, distinct = total[lang or b"", source or b""], set()
            for terms in _segments(text or b""):
                counts.update(terms)
                distinct.update(terms)
            held[lang or b"", source or b""].update(distinct)
        if sum(map(len, total.values())) + len(total) > HELD:
            yield flush()
    yield flush()


def _share(count: str, size: str) -> str:
    """SQL of the share of a count: exact, since a count times UNIT may pass 64 bits."""
    return f"1 + cast((cast({count} + {{prior}} as decimal(20, 0)) * {UNIT}) div cast({size} as decimal(20, 0)) as bigint)"


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 30, prior: int = 5, top: int = 50, store: Store | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language, how far the other sources' term shares are
    from its own (part pair, all of them), and the terms it has more of than its language (part term, the first top).

    A language keeps the terms that at least min_docs of its documents hold. A term's share in a source or language is
    1 + floor(UNIT * (count + prior) / (N + prior * V)), for N occurrences of V kept terms. A pair's value is the sum of
    the shares' differences over all kept terms, 0 if there are none; a term's is its share less the language's.

    Null texts, languages and sources count as empty strings; each (lang, source) of the table is a group, also without
    terms; repeated rows count as often as they stand. Ties are ordered by the item's bytes. Extra columns are ignored;
    an empty table gives no row. A lone source has no pair.

    Tasks add up counts before they shuffle them, so a source or word that is everywhere is a row for each task. Each kept
    term becomes one row with an array of its sources' shares; pairs of shares are compared by array functions, a source
    at a time, and summed on the map side. That work is kept terms times pairs of sources, as the result is defined.
    """
    store = store or Store(docs.sparkSession, "divergence")
    raw = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source)), F.col(text).cast("string")).toDF("lang", "source", "text")
    counted = raw.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = store.table(counted, "counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts")).where(F.col("docs") >= min_docs)
    kept = store.table(kept.drop("docs"), "kept")

    groups = counts.where("term is null").select("lang", "source")
    sizes = kept.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sides = groups.join(sizes, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    sides = sides.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").select(
        "lang", F.expr("transform(g, x -> x.source)").alias("sources"), F.coalesce("v", F.lit(0)).alias("v"),
        F.expr(f"transform(g, x -> x.n + {prior} * coalesce(v, 0))").alias("sizes"), F.expr(f"aggregate(g, 0L, (s, x) -> s + x.n) + {prior} * coalesce(v, 0)").alias("size"),
    )
    sides = store.table(sides, "sides")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS

    def with_sides(df: DataFrame, *salt: str) -> DataFrame:
        if few:
            return df.join(F.broadcast(sides), "lang")
        salted = sides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return df.withColumn("salt", F.pmod(F.hash(*salt), F.lit(SALTS))).join(salted, ["lang", "salt"]).drop("salt")

    wide = with_sides(kept, "term").select("lang", "term", "sizes", "size", F.expr("transform(sources, s -> coalesce(try_element_at(counts, s), 0L))").alias("n"))
    wide = wide.select(
        "lang", "term", "n", F.expr("transform(n, (c, i) -> " + _share("c", "sizes[i]").format(prior=prior) + ")").alias("p"), F.expr(_share("aggregate(n, 0L, (s, x) -> s + x)", "size").format(prior=prior)).alias("q")
    )
    wide = store.table(wide, "wide")

    each = wide.select("lang", "p", F.posexplode("p").alias("i", "x"))
    each = each.select("lang", "i", F.posexplode(F.expr("transform(slice(p, i + 2, size(p)), y -> abs(y - x))")).alias("d", "f"))
    pairs = each.groupBy("lang", "i", (F.col("i") + F.col("d") + 1).alias("j")).agg(F.sum("f").alias("value"))
    bare = sides.where("v = 0").select("lang", F.posexplode("sources").alias("i", "_"), "sources")
    bare = bare.select("lang", "i", F.explode(F.expr("slice(sequence(0, size(sources)), i + 2, size(sources) - i - 1)")).alias("j"), F.lit(0).cast("long").alias("value"))
    both = pairs.unionByName(bare).select("lang", "value", F.explode(F.expr("array(struct(i, j), struct(j as i, i as j))")).alias("e"))
    both = with_sides(both, "e").select("lang", F.expr("sources[e.i]").alias("source"), F.lit("pair").alias("part"), F.expr("sources[e.j]").alias("item"), "value")
    both = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    over = wide.select("lang", "term", "p", "q", F.posexplode("n").alias("i", "c")).select("lang", "i", "term", "c", F.expr("p[i] - q").alias("value")).where("c > 0 and value > 0")
    over = over.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "i").orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)
    over = with_sides(over, "i", "rank").select("lang", F.expr("sources[i]").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return both.unionByName(over)
