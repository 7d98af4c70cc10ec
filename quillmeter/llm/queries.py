"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.llm import collocations, decontaminate, html_density, jaccard_join, packing, pseudo_lm, repeat_bytes, source_divergence, swap_packing, toxicity, url_rules, vector_dedup, warc_zstd
from quillmeter.llm._store import Store


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL: the longest listed rule's, else that of mined rules."""
    out = url_rules.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), _read(spark, sf_dir, "labels"), rules=url_rules.RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op2_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_density.extract_pages(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents"), special=True)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document occurs in benchmark items, and in which."""
    out = decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at a cosine of 0.95 or more, and its component."""
    return vector_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's summed log-probability of its words, each given its neighbours."""
    return pseudo_lm.score_documents(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the written archives."""
    pages = _read(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    records = warc_zstd.read_archives(warc_zstd.write_archives(pages, Store(spark, "warc")))
    return records.select(F.col("record_key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels of the held-out quarter are never learned from."""
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), keep=["doc_id"])


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 200-byte strings, as a digest."""
    return repeat_bytes.remove_repeats(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and its component of near duplicates."""
    return jaccard_join.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return swap_packing.pack(_read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases."""
    return collocations.mine(_read(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source against the other sources of its language, and its own terms."""
    return source_divergence.audit(_read(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("int"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_rules, op2_text_density, op3_pack, op4_decontaminate, op5_multi_index, op6_pseudo_likelihood, op7_warc, op8_toxicity, op9_repeats, op10_jaccard,
        op11_swap_packing, op12_collocations, op13_source_divergence,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op7_warc": r"""
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
        f as (select d, min(page_id) as first from p where n >= 100 group by d)
        select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
          case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
          case when first <> page_id then first end as refers_to
        from p left join f using (d)
    """,
    "op4_decontaminate": r"""
        with w as (select doc_id, i, word from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')) as word,
            generate_subscripts(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), 1) as i from documents)),
        b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') as ws from benchmark),
        pat as (select distinct item_id, least(13, len(ws)) as n, array_to_string(ws[s : s + least(13, len(ws)) - 1], ' ') as p
            from b, unnest(generate_series(1, greatest(len(ws) - 12, 1))) as t(s) where len(ws) > 0),
        sizes as (select distinct n from pat),
        dw as (select doc_id, i, n, string_agg(word, ' ') over (partition by doc_id, n order by i rows between current row and 12 following) as p13, w.word from w, (select 13 as n)),
        occ as (select doc_id, i, pat.n, item_id from dw join pat on dw.p13 = pat.p and pat.n = 13),
        short as (select x.doc_id, x.i, pat.n, item_id from pat join w x on x.word = split_part(pat.p, ' ', 1) and pat.n < 13
            where (select string_agg(y.word, ' ' order by y.i) from w y where y.doc_id = x.doc_id and y.i between x.i and x.i + pat.n - 1) = pat.p),
        o as (select * from occ union all select * from short),
        hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as k from o) group by doc_id),
        it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from o group by doc_id),
        n as (select doc_id, count(*) as n_words from w group by doc_id)
        select d.doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
          sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) as contaminated
        from documents d left join n using (doc_id) left join hit using (doc_id) left join it using (doc_id)
    """,
    "op5_multi_index": r"""
        with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
        g as (select * from v where list_sum(list_transform(e, lambda x: x * x)) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
        l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
        r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
        c as (select v.vec_id, least(v.vec_id, coalesce(min(r.b), v.vec_id)) as component_id from v left join r on r.a = v.vec_id group by v.vec_id)
        select c.vec_id, cast(coalesce(k, 0) as bigint) as n_links, component_id, component_id = c.vec_id as kept from c left join (select a, count(*) as k from l group by a) on a = c.vec_id
    """,
    "op9_repeats": r"""
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
        w as (select doc_id, p, md5(substr(x, 2 * p + 1, 400)) as h from d, unnest(generate_series(0, cast(length(x) // 2 - 200 as bigint))) as t(p) where length(x) >= 400),
        twice as (select h from w group by h having count(*) > 1),
        s as (select doc_id, p, case when p > lag(p) over (partition by doc_id order by p) + 200 or lag(p) over (partition by doc_id order by p) is null then 1 else 0 end as new from w where h in (select h from twice)),
        g as (select *, sum(new) over (partition by doc_id order by p rows unbounded preceding) as no from s),
        r as (select doc_id, no, min(p) as a, max(p) + 200 as b from g group by 1, 2),
        k as (select doc_id, sum(b - a) as removed, count(*) as spans, list(a order by a) as la, list(b order by a) as lb from r group by 1)
        select d.doc_id, cast(length(x) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans,
          sha256(unhex(case when la is null then x else array_to_string(list_transform(range(0, len(la) + 1), lambda i: substr(x, 2 * (case when i = 0 then 0 else lb[i] end) + 1, 2 * ((case when i = len(la) then length(x) // 2 else la[i + 1] end) - (case when i = 0 then 0 else lb[i] end)))), '') end)) as kept_sha256
        from d left join k using (doc_id)
    """,
    "op10_jaccard": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{09}-\x{0D}]+') as ws from documents),
        sh as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as s from w, unnest(generate_series(1, greatest(len(ws) - 4, 1))) as t(i) where len(ws) > 0),
        n as (select doc_id, count(*) as n from sh group by 1),
        p as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
        l as (select x, y from p join n a on x = a.doc_id join n b on y = b.doc_id where 100 * c >= 75 * (a.n + b.n - c)),
        e as (select x as a, y as b from l union all select y, x from l),
        r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
        select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id
        from documents d left join n using (doc_id) left join (select a, min(b) as m from r group by a) on a = d.doc_id
    """,
    "op12_collocations": r"""
        with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x{0A}-\x{0D}]')) as piece from documents),
        w as (select lang, regexp_extract_all(piece, '[^\x{20}\x{09}]+') as ws from p),
        g as (select lang, k, array_to_string(ws[i : i + k - 1], ' ') as phrase from w, (select unnest([1, 2, 3]) as k), unnest(generate_series(1, len(ws) - k + 1)) as t(i) where len(ws) >= k),
        f as (select lang, k, phrase, count(*) as n from g group by 1, 2, 3),
        n as (select lang, sum(n) as n from f where k = 1 group by 1),
        c as (select lang, k, phrase, n as a, string_split(phrase, ' ') as ws from f where k >= 2 and n >= 10),
        cut as (select c.lang, phrase, a, j, array_to_string(ws[1 : j], ' ') as x, array_to_string(ws[j + 1 : k], ' ') as y from c, unnest([1, 2]) as t(j) where j < k),
        s as (select cut.lang, cut.phrase, a, j, x.n as l, y.n as r, cast(cast(1000000 as hugeint) * a * a // (cast(x.n as hugeint) * y.n) as bigint) as score
            from cut join f x on x.lang = cut.lang and x.phrase = cut.x and x.k < 3 join f y on y.lang = cut.lang and y.phrase = cut.y and y.k < 3),
        o as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
        longer as (select lang, part, max(a) as b from (select lang, a, ws[1] || ' ' || ws[2] as part from c where k = 3 union all select lang, a, ws[2] || ' ' || ws[3] from c where k = 3) group by 1, 2),
        kept as (select o.* from o left join longer on longer.lang = o.lang and longer.part = o.phrase where b is null or 100 * b < 50 * a),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
        select ranked.lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n.n as bigint) as n, score
        from ranked join n on n.lang = ranked.lang where rank <= 2000
    """,
    "op13_source_divergence": r"""
        with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        w as (select id, lang, source, unnest(regexp_extract_all(t, '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) as term from d),
        k as (select lang, term from w group by 1, 2 having count(distinct id) >= 30),
        v as (select lang, count(*) as v from k group by 1),
        c as (select w.lang, w.source, w.term, count(*) as c from w join k on k.lang = w.lang and k.term = w.term group by 1, 2, 3),
        g as (select distinct lang, source from d),
        gn as (select g.lang, g.source, coalesce(sum(c), 0) as n from g left join c on c.lang = g.lang and c.source = g.source group by 1, 2),
        p as (select gn.lang, gn.source, k.term, coalesce(c, 0) as c, 1 + cast(cast(1000000000 as hugeint) * (coalesce(c, 0) + 5) // (n + 5 * v) as bigint) as p
            from gn join k on k.lang = gn.lang join v on v.lang = gn.lang left join c on c.lang = gn.lang and c.source = gn.source and c.term = k.term),
        lt as (select lang, term, sum(c) as c from c group by 1, 2),
        ln as (select lang, sum(n) as n from gn group by 1),
        q as (select lt.lang, lt.term, 1 + cast(cast(1000000000 as hugeint) * (lt.c + 5) // (ln.n + 5 * v) as bigint) as q from lt join ln on ln.lang = lt.lang join v on v.lang = lt.lang),
        f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
        pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
            from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
        terms as (select p.lang, p.source, 'term' as part, p.term as item, p.p - q as value from p join q on q.lang = p.lang and q.term = p.term where p.c > 0 and p.p > q),
        r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
        select lang, source, part, item, value, cast(rank as int) as rank from r where part = 'pair' or rank <= 50
    """,
}
