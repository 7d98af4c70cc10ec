"""URL filtering by association rules: FP-growth over the URL tokens of labelled pages, matched by inverted index.

What was judged before are the verdicts of listed rules and, for pages without one, labels. Every token's counts are
taken over all judged pages. FP-growth then mines combinations of frequent tokens that aren't in nearly all pages, tokens
that always stand together as one item. Pages with so many items that their sets of all sizes would be too many are mined
level by level up to a rule's size, and what either way finds is counted over all pages: no token of a page is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from statistics import NormalDist

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from quillmeter.llm._store import Store

#: Of the contract: (host, path, verdict); a rule fits its host, all subdomains, and paths that start with its path.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
BLOCK = "label:block"
#: Smallest share and number of judged pages with a rule's tokens, confidence, lift over the base rate, and chance that
#: any rule is there by accident.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MIN_LIFT, ACCIDENT = 0.002, 20, 0.5, 1.25, 0.01
#: Tokens in nearly all pages tell nothing; groups (tokens that always stand together) of a page up to which FP-growth,
#: which finds sets of every size, takes it: it is in 1023 sets at most; groups of a rule.
NEARLY_ALL, GROWN, MOST_TOKENS = 0.95, 10, 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end.

    Both are empty for a null URL or one without ://.
    """
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as a string, its verdict) of the longest rule that fits, null if none does; rules is a short fixed list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: host labels with their place from the right, path segments with digits as #, query names."""
    labels = F.reverse(F.split(host, r"\."))
    segments = F.filter(F.split(F.regexp_replace(path, r"\d+", "#"), "/"), lambda s: s != "")
    query = F.regexp_extract_all(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    parts = F.concat(
        F.transform(labels, lambda s, i: F.concat(F.lit("h"), F.least(i, F.lit(4)).cast("string"), F.lit(":"), s)),
        F.transform(segments, lambda s, i: F.concat(F.lit("p"), F.least(i, F.lit(4)).cast("string"), F.lit(":"), s)),
        F.transform(query, lambda s: F.concat(F.lit("q:"), s)),
    )
    return F.array_distinct(F.filter(parts, lambda s: ~s.endswith(":")))


def _tokens(labelled: DataFrame, least: float, most: float) -> dict[str, tuple[str, int, int]]:
    """token: (group, judged pages, blocked ones) of the tokens in at least and at most so many judged pages. Tokens that
    stand in the same pages have one group, the first of them. Their number is bounded: pages' mean tokens by support."""
    mark = lambda seed: F.sum(F.pmod(F.xxhash64("tokens", F.lit(seed)), F.lit(1 << 40))).alias(f"m{seed}")
    rows = labelled.select("blocked", "tokens", F.explode("tokens").alias("token"))
    found = rows.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad"), mark(1), mark(2)).where(F.col("n").between(least, most)).collect()
    first: dict[tuple, str] = {}
    for r in sorted(found):
        first.setdefault(r[1:], r["token"])
    return {r["token"]: (first[r[1:]], r["n"], r["bad"]) for r in found}


def _transactions(spark: SparkSession, known: dict[str, tuple[str, int, int]]):
    """A column function from tokens to all groups of a page, in order."""
    shared = spark.sparkContext.broadcast({t: g for t, (g, _, _) in known.items()})

    @F.pandas_udf(ArrayType(StringType()))
    def project(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        groups = shared.value
        for batch in column:
            yield pd.Series([sorted({groups[t] for t in row if t in groups}) for row in batch], dtype=object)

    return project


def _extended(sets: DataFrame) -> DataFrame:
    """Every set of a page (items) with each one of the rest of its groups, and what comes after that."""
    rows = sets.select("blocked", "items", "rest", F.posexplode("rest").alias("_i", "_g"))
    return rows.select("blocked", F.array_append("items", F.col("_g")).alias("items"), F.slice("rest", F.col("_i") + 2, F.size("rest")).alias("rest"))


def _by_level(pages: DataFrame, least: int, most: int, store: Store) -> list[DataFrame]:
    """The sets (items) of two groups up to most that at least so many pages hold; a set is extended while it is frequent."""
    sets, found = _extended(pages), []
    for size in range(2, most + 1):
        sets = _extended(sets)
        found.append(store.table(sets.groupBy("items").count().where(F.col("count") >= least).select("items"), f"level{size}"))
        sets = sets.join(found[-1], "items", "left_semi")
    return found


def _counted(pages: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """(items, n, bad) of the wanted sets: the pages that hold one, and the blocked ones, over all pages."""
    sets, counts = _extended(pages), None
    for size in range(2, most + 1):
        begun = wanted.where(F.size("items") >= size).select(F.slice("items", 1, size).alias("items")).distinct()
        sets = _extended(sets).join(begun, "items", "left_semi")
        now = sets.groupBy("items").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad"))
        counts = now if counts is None else counts.union(now)
    return counts


def _sets(rows: DataFrame, least: float, needed: int, most: int, grown: int, store: Store) -> DataFrame:
    """(items, n, bad) of all sets of two groups up to most that at least so many pages (blocked, items) hold.

    Pages of at most grown groups go through FP-growth, longer ones by level. A set that enough pages hold is held by half
    as many on one side or the other; so each side is mined down to that half, and all pages count what was found.
    """
    short, long = rows.where(F.size("items") <= grown), rows.where(F.size("items") > grown)
    lengths = rows.agg(F.count_if(F.size("items") <= grown).alias("short"), F.count_if(F.size("items") > grown).alias("long")).first()
    if not lengths["long"]:
        # A rule's blocked pages are fewer than its pages: sets are mined down to as many as the least rule needs.
        marked = F.when(F.col("blocked"), F.array_append("items", F.lit(BLOCK))).otherwise(F.col("items"))
        sets = FPGrowth(itemsCol="items", minSupport=(needed - 0.5) / lengths["short"]).fit(short.select(marked.alias("items"))).freqItemsets
        sets = sets.select(F.array_sort(F.array_remove("items", BLOCK)).alias("items"), F.array_contains("items", BLOCK).alias("blocked"), "freq").where(F.size("items").between(2, most))
        found = sets.groupBy("items").agg(F.max(F.when(~F.col("blocked"), F.col("freq"))).alias("n"), F.coalesce(F.max(F.when(F.col("blocked"), F.col("freq"))), F.lit(0)).alias("bad"))
        return found.where(F.col("n") >= least)
    half, begin = math.ceil(least / 2), (F.col("blocked"), F.array().cast("array<string>").alias("items"), F.col("items").alias("rest"))
    found = _by_level(long.select(*begin), half, most, store) if lengths["long"] >= half else []
    if lengths["short"] >= half:
        sets = FPGrowth(itemsCol="items", minSupport=(half - 0.5) / lengths["short"]).fit(short.select("items")).freqItemsets
        found.append(sets.where(F.size("items").between(2, most)).select(F.array_sort("items").alias("items")))
    if not found:
        return rows.select("items", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad")).limit(0)
    wanted = store.table(reduce(DataFrame.union, found).distinct(), "wanted")
    return _counted(rows.select(*begin), wanted, most).where(F.col("n") >= least)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, accident: float = ACCIDENT, most_tokens: int = MOST_TOKENS, grown: int = GROWN) -> list[tuple[frozenset[str], float, int]]:
    """[(tokens, confidence, count)] of the sets that point to block; labelled has tokens and blocked (boolean).

    A rule stays if its support, its confidence and its lift over the base rate reach the minimum, the lift is more than
    chance explains (over as many sets as were looked at), and no smaller rule within it is as confident. Rules of one
    token (or group) are counted for all tokens; larger ones are sets of at most most_tokens, of all groups of the pages.
    The driver gets the sets that pass by themselves; support and the pages' lengths bound their number, whatever the
    input's size.
    """
    rows = labelled.where(F.size("tokens") > 0)
    total, bad = rows.agg(F.count("*"), F.count_if("blocked")).first()
    if not 0 < bad < total:
        return []
    rate, least = bad / total, max(min_support * total, min_count)
    known = _tokens(rows, least, NEARLY_ALL * total)
    if not known:
        return []
    members: dict[str, list[str]] = {}
    for token, (group, _, _) in known.items():
        members.setdefault(group, []).append(token)
    store = Store(labelled.sparkSession, "mine")
    items = _transactions(labelled.sparkSession, known)(F.col("tokens"))
    pages = store.table(rows.select("blocked", items.alias("items")), "pages")
    needed = math.ceil(max(min_confidence, min_lift * rate) * least)
    sets = store.table(_sets(pages, least, needed, most_tokens, grown, store), "sets")
    counts = {frozenset([g]): known[g][1:] for g in members}
    clear = NormalDist().inv_cdf(1 - accident / (len(counts) + sets.count()))
    n, k = F.col("n"), F.col("bad")
    passed = sets.where((k >= max(min_confidence, min_lift * rate) * n) & (k - n * rate > clear * F.sqrt(n * rate * (1 - rate)) - 1e-6))
    counts |= {frozenset(r["items"]): (r["n"], r["bad"]) for r in passed.collect()}
    store.drop("")
    kept: dict[frozenset[str], float] = {}
    for groups in sorted(counts, key=lambda s: (len(s), sorted(s))):
        n, k = counts[groups]
        within = (frozenset(c) for m in range(1, len(groups)) for c in combinations(groups, m))
        if k >= max(min_confidence, min_lift * rate) * n and k - n * rate > clear * (n * rate * (1 - rate)) ** 0.5 and all(kept.get(w, 0.0) < k / n for w in within):
            kept[groups] = k / n
    return [(frozenset(t for g in groups for t in members[g]), c, counts[groups][0]) for groups, c in kept.items()]


def matcher(spark: SparkSession, rules: list[tuple[frozenset[str], float, int]]):
    """A column function from tokens to the confidence of the best rule whose tokens are all there, null if none.

    The inverted index lists, for each token, the rules that hold it; a rule fires when all its tokens were met.
    """
    index: dict[str, list[int]] = {}
    for k, (items, _, _) in enumerate(rules):
        for t in items:
            index.setdefault(t, []).append(k)
    shared = spark.sparkContext.broadcast((index, [len(r[0]) for r in rules], [r[1] for r in rules]))

    @F.pandas_udf(DoubleType())
    def match(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        postings, sizes, scores = shared.value
        for batch in column:
            out = []
            for row in batch:
                met: dict[int, int] = {}
                for t in row if row is not None else ():
                    for k in postings.get(t, ()):
                        met[k] = met.get(k, 0) + 1
                out.append(max((scores[k] for k, n in met.items() if n == sizes[k]), default=None))
            yield pd.Series(out, dtype="float64")

    return match


def measure(learned: DataFrame, asked: DataFrame, **mining) -> dict[str, int]:
    """How rules mined from learned (tokens, blocked) judge asked (the same): rules, pages, those blocked by their label,
    those for which a rule fires, and those that are both. Precision is both / fired, recall both / blocked."""
    rules = mine(learned, **mining)
    fires = matcher(asked.sparkSession, rules)(F.col("tokens")).isNotNull()
    counted = asked.select("blocked", fires.alias("fires")).agg(F.count("*").alias("pages"), F.count_if("blocked").alias("blocked"), F.count_if("fires").alias("fired"), F.count_if(F.col("blocked") & F.col("fires")).alias("both"))
    return {"rules": len(rules)} | counted.first().asDict()


def filter_urls(pages: DataFrame, labels: DataFrame, url: str = "url", key: str = "page_id", label_key: str = "doc_id", rules: list[tuple[str, str, str]] | None = None, **mining) -> DataFrame:
    """pages with host, path, rule, score and verdict; no row is dropped, added or shuffled.

    A listed rule decides first; else a page is blocked if a mined rule fires, of which score is the confidence. Mining
    learns from the listed rules' verdicts and, on pages without one, from labels, joined by key: quality 0 or toxic 1
    counts as blocked, a row without either is left out. Null and malformed URLs have no tokens and an empty host and
    path: allowed unless listed. Repeated rows are judged alike, and count as often in mining. A column of pages named
    host, path, rule, score or verdict is replaced. Without anything judged no rule is mined.
    """
    spark, store = pages.sparkSession, Store(pages.sparkSession, "urls")
    host, path = host_and_path(F.col(url))
    verdict = listed_rule(F.col("host"), F.col("path"), rules or [])[1]
    rows = pages.select(F.col(key).alias("_k"), F.col(url).alias("_u"), host.alias("host"), path.alias("path")).select("_k", tokens(F.col("host"), F.col("path"), F.col("_u")).alias("tokens"), verdict.alias("listed"))
    seen = labels.select(F.col(label_key).alias("_k"), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("blocked")).where(F.coalesce("quality", "toxic").isNotNull())
    judged = rows.where("listed is not null").select("tokens", (F.col("listed") == "block").alias("blocked")).union(rows.where("listed is null").join(seen, "_k").select("tokens", "blocked"))
    match = matcher(spark, mine(store.table(judged, "judged"), **mining))
    store.drop("judged")
    out = pages.drop("host", "path", "rule", "score", "verdict").withColumns({"host": host, "path": path})
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules or [])
    out = out.withColumn("score", match(tokens(F.col("host"), F.col("path"), F.col(url))))
    return out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("score").isNotNull(), "block").otherwise("allow"))})
