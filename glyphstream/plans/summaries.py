"""Summaries, pivots and exports over the driver's tables, with their SQL; they register beside plans.queries."""

from __future__ import annotations

import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphstream.functions import codon, sequence as q, text as t
from glyphstream.operators import panels, retrieval, stability, tokens
from glyphstream.plans.queries import AMBIGUOUS, DIST, DRAWN_TOKENS, ORACLE_SQL, QUERIES, REPLICATES, SEQ, TRANSLATED, _codons, _dist, _overlap, query, r6, sequences
from glyphstream.runtime import shared_dir, table
from glyphstream.sources.catalogue import Catalogue

WORST = "case when length(amino) <= 1 then 0 else length(amino[1 : length(amino) - 1]) - length(replace(amino[1 : length(amino) - 1], '*', '')) end"
QUALITY = f"{TRANSLATED}, aa as (select doc_id, string_agg(amino, '' order by i) as amino from ct group by 1), v as (select lang, s, coalesce(amino, '') as amino from seq left join aa using (doc_id)), w as (select lang, length(s) as n, length(translate(s, 'ACGT', '')) > 0 as ambiguous, {WORST} as stops from v)"


@query(f"""with {SEQ}, {QUALITY} select lang, count(*) as n, count(*) filter (where n % 3 <> 0 or n = 0) as frame_fail, count(*) filter (where ambiguous) as ambiguous_fail,
count(*) filter (where stops > 0) as internal_stop_fail, count(*) filter (where n % 3 = 0 and n > 0 and not ambiguous and stops = 0) as reliable, max(stops)::bigint as most_stops, round(avg(stops), 6) as mean_stops from w group by 1""")
def translation_summary(spark, sf_dir):
    rows = sequences(spark, sf_dir).select("lang", *codon.quality(F.col("s")))
    count = lambda c: F.count_if(F.col(c))
    return rows.groupBy("lang").agg(
        F.count("*").alias("n"), count("frame_fail").alias("frame_fail"), count("ambiguous_fail").alias("ambiguous_fail"), count("internal_stop_fail").alias("internal_stop_fail"),
        count("codon_reliable").alias("reliable"), F.max("internal_stops").alias("most_stops"), F.round(F.avg("internal_stops"), 6).alias("mean_stops"),
    )


@query(f"""with {SEQ}, {QUALITY} select lang, (n % 3)::int as length_mod_3, least(stops, 5)::int as stops, count(*) as n from w group by 1, 2, 3""")
def failure_breakdown(spark, sf_dir):
    """Length modulo 3 by internal stops, five and more together."""
    rows = sequences(spark, sf_dir).select("lang", (F.length("s") % 3).alias("length_mod_3"), *codon.quality(F.col("s")))
    return rows.groupBy("lang", "length_mod_3", F.least("internal_stops", F.lit(5)).cast("int").alias("stops")).agg(F.count("*").alias("n"))


@query(f"""with r as ({ORACLE_SQL["coding_rescue"]}) select d.lang, count(*) as n, count(*) filter (where status = 'strict_pass') as strict_pass, count(*) filter (where status = 'rescued') as rescued,
count(*) filter (where status = 'unrescued') as unrescued, count(*) filter (where status = 'ambiguous') as ambiguous from r join documents d using (doc_id) group by 1""")
def rescue_summary(spark, sf_dir):
    rows = codon.rescued(sequences(spark, sf_dir).select("lang", "s")).select("lang", "status")
    of = lambda x: F.count_if(F.col("status") == x).alias(x)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), of("strict_pass"), of("rescued"), of("unrescued"), of("ambiguous"))


@query(f"""with {SEQ}, {_overlap(3)}, {DIST}, h as (select lang, sum(n) as n, round(sum(-share * log2(share)), 6) as entropy from dist group by 1),
r as (select lang, token, row_number() over (partition by lang order by n desc, token) as rank from dist)
select h.lang, h.n::bigint as n, entropy, max(token) filter (where rank = 1) as top1, max(token) filter (where rank = 2) as top2, max(token) filter (where rank = 3) as top3 from h join r on r.lang = h.lang group by 1, 2, 3""")
def entropy_with_top3(spark, sf_dir):
    """Entropy of each group, its three most frequent tokens as columns."""
    dist = _dist(spark, sf_dir, 3)
    d = tokens.diversity(dist, ["lang"]).select("lang", F.col("n_tokens").alias("n"), r6("entropy", "entropy"))
    top = tokens.top_tokens(dist, "lang", 3).groupBy("lang").agg(*(F.max(F.when(F.col("rank") == i, F.col("token"))).alias(f"top{i}") for i in (1, 2, 3)))
    return d.join(top, "lang")


@query(f"""with {SEQ}, {_overlap(2)}, {DIST} select lang, coalesce(sum(n) filter (where token = 'AA'), 0)::bigint as aa, coalesce(sum(n) filter (where token = 'CG'), 0)::bigint as cg, coalesce(sum(n) filter (where token = 'TA'), 0)::bigint as ta, coalesce(sum(n) filter (where token = '--'), 0)::bigint as gap from dist group by 1""")
def token_pivot(spark, sf_dir):
    """Groups by a fixed list of tokens, absent ones 0."""
    wanted = {"AA": "aa", "CG": "cg", "TA": "ta", "--": "gap"}
    got = _dist(spark, sf_dir, 2).groupBy("lang").pivot("token", list(wanted)).agg(F.sum("n"))
    return got.select("lang", *(F.coalesce(F.col(f"`{k}`"), F.lit(0)).cast("long").alias(v) for k, v in wanted.items()))


@query()
def bootstrap_enrichment(spark, sf_dir):
    """Top enriched tokens of each language in each redraw of the counts."""
    redrawn = stability.resampled_counts(_dist(spark, sf_dir, 4), "lang", REPLICATES, DRAWN_TOKENS, 7)
    shares = redrawn.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("replicate", "lang")))
    total = F.sum("n").over(Window.partitionBy("replicate"))
    own = F.sum("n").over(Window.partitionBy("replicate", "lang"))
    token_n = F.sum("n").over(Window.partitionBy("replicate", "token"))
    ratio = (F.col("share") + 1e-6) / (F.try_divide(token_n - F.col("n"), total - own) + 1e-6)
    place = Window.partitionBy("replicate", "lang").orderBy(F.desc("ratio"), "token")
    rows = shares.withColumn("ratio", ratio).where("n >= 5")
    return rows.withColumn("rank", F.row_number().over(place)).where("rank <= 5").select("replicate", "lang", "rank", "token", r6("ratio", "ratio"))


@query("""with o as (select o_custkey, min(o_orderdate)::date::varchar as day from orders group by 1),
l as (select c_custkey as id, case when c_custkey % 9 > 0 then r_name || ' / ' || n_name || '/' || case when c_custkey % 4 > 0 then c_mktsegment else ' ' end end as place,
case c_custkey % 6 when 1 then ' Unassigned' when 2 then '6B.1A.' || c_nationkey when 3 then '3C.2a1b.' || c_nationkey when 4 then c_nationkey || '.' || c_custkey % 10 || '.' || c_custkey when 5 then c_mktsegment end as clade, day
from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey left join o on o_custkey = c_custkey),
p as (select *, list_filter(list_transform(string_split(place, '/'), lambda x: trim(x)), lambda x: x <> '') as parts from l)
select id, parts[1] as continent, parts[2] as country, parts[3] as place,
case when clade is null or lower(trim(clade)) in ('', 'nan', 'none') then null when lower(trim(clade)) = 'unassigned' then 'unassigned' when starts_with(trim(clade), '6B.1A') then '6B.1A' when starts_with(trim(clade), '3C.2a1b') then '3C.2a1b' else array_to_string(string_split(trim(clade), '.')[1:2], '.') end as clade,
coalesce(nullif(regexp_extract(day, '^([0-9]{4})', 1), '')::int, -1) as year from p""")
def record_labels(spark, sf_dir):
    """Places, clades and years of records, as a metadata scan derives them, for customers: a path of region, nation and segment, a dotted label, the first order's date."""
    c, n, r, o = (table(spark, sf_dir, x) for x in ("customer", "nation", "region", "orders"))
    first = o.groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").cast("string").alias("day"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(first, F.col("o_custkey") == F.col("c_custkey"), "left")
    i, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    place = F.when(i % 9 > 0, F.concat("r_name", F.lit(" / "), "n_name", F.lit("/"), F.when(i % 4 > 0, F.col("c_mktsegment")).otherwise(F.lit(" "))))
    labels = {1: F.lit(" Unassigned"), 2: F.concat(F.lit("6B.1A."), nation), 3: F.concat(F.lit("3C.2a1b."), nation), 4: F.concat_ws(".", nation, i % 10, i), 5: F.col("c_mktsegment")}
    clade = F
    for left, label in labels.items():
        clade = clade.when(i % 6 == left, label)
    parts = t.location_parts(place)
    at = lambda k: F.get(parts, F.lit(k))
    return rows.select(i.alias("id"), at(0).alias("continent"), at(1).alias("country"), at(2).alias("place"), t.major_clade(clade).alias("clade"), F.coalesce(t.leading_year(F.col("day")), F.lit(-1)).alias("year"))


@query("""select o_orderstatus as status, case when year(o_orderdate) <= 1996 then '<=1996' when year(o_orderdate) <= 1998 then '<=1998' when year(o_orderdate) <= 2000 then '<=2000' when o_orderdate is not null then '>2000' else 'unknown' end as bin, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1, 2""")
def temporal_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), q.year_bin(F.year("o_orderdate"), [1996, 1998, 2000]).alias("bin"), "o_totalprice")
    return rows.groupBy("status", "bin").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@query("""select 'lm_' || sha256('latent::' || vec_id::varchar)[1:18] as point_id, label, round(embedding[1]::double, 6) as x, round(embedding[2]::double, 6) as y from embeddings""")
def latent_points(spark, sf_dir):
    """Points with salted ids, coded as arrays and decoded by their schema again."""
    rows = table(spark, sf_dir, "embeddings").select(q.salted_id(F.col("vec_id"), "latent", "lm", 18).alias("id"), "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    coded = rows.select(F.to_json(F.array(F.col("id"), F.col("label").cast("string"), F.col("x").cast("string"), F.col("y").cast("string"))).alias("point"))
    p = F.from_json("point", "array<string>")
    return coded.select(p[0].alias("point_id"), p[1].cast("int").alias("label"), r6(p[2].cast("double"), "x"), r6(p[3].cast("double"), "y"))


@query(f"""with {SEQ}, {_overlap(3, 'doc_id')}, k as (select doc_id, token, count(*) as n from tok where regexp_full_match(token, '[ACGT]+') group by 1, 2), h as (select doc_id, round(sum(-p * log2(p)), 6) as k3_entropy from (select doc_id, n / sum(n) over (partition by doc_id) as p from k) group by 1)
select seq.doc_id, lang, length(s)::bigint as length, round({AMBIGUOUS}, 6) as ambiguous, round((length(s) - length(translate(s, 'GC', ''))) / nullif(length(s) - length(translate(s, 'ACGT', '')), 0)::double, 6) as gc, k3_entropy from seq left join h on h.doc_id = seq.doc_id""")
def metric_rows(spark, sf_dir):
    """One wide row of metrics for each sequence."""
    s = F.col("s")
    own = ["doc_id", "lang", F.length(s).cast("long").alias("length"), r6(q.ambiguous_fraction(s), "ambiguous"), r6(q.gc_content(s), "gc")]
    kept, m = ["doc_id", "lang", "length", "ambiguous", "gc"], F.col("measures")[0]
    rows = tokens.row_measures(sequences(spark, sf_dir).select(*own, "s"), [tokens.tokenizer("overlap_k3")], kept, letters=q.SYMBOLS)
    return rows.select(*kept, F.when(m["n_tokens"] > 0, F.round(m["entropy"], 6)).alias("k3_entropy"))


STOPS = ", ".join(f"'{w}'" for w in t.STOP_WORDS)


@query(f"""with x as (select item_id, list_filter(string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+'), lambda w: length(w) > 1) as w from benchmark)
select item_id, len(list_distinct(list_filter(w, lambda x: x not in ({STOPS}))))::bigint as n_terms from x""")
def question_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(t.terms(F.col("text"))).cast("long").alias("n_terms"))


@query("""with j as (select d.doc_id, d.lang, l.quality from documents d left join labels l on l.doc_id = d.doc_id) select lang, count(*) as n, count(quality) as matched, count(*) filter (where quality is null) as missed, count(*) filter (where quality = 1) as good from j group by 1""")
def metadata_coverage(spark, sf_dir):
    joined = panels.join_one(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("matched"), F.count_if(F.col("quality").isNull()).alias("missed"), F.count_if(F.col("quality") == 1).alias("good"))


@query("""with a as (select doc_id from documents where lang = 'en'), b as (select doc_id from labels where toxic = 0) select 'except' as op, count(*) as n from (select doc_id from a except select doc_id from b) union all select 'intersect', count(*) from (select doc_id from a intersect select doc_id from b) union all select 'union', count(*) from (select doc_id from a union select doc_id from b)""")
def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    b = table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id")
    parts = {"except": a.subtract(b), "intersect": a.intersect(b), "union": a.union(b).distinct()}
    rows = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, d in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(r"""with p as (select page_id, list_filter(list_transform(string_split_regex(html, '(?m)^\s*#+'), lambda x: trim(x)), lambda x: length(x) >= 80)[1:8] as parts, html from pages)
select page_id, len(parts)::bigint as n_sections, sha256(array_to_string(list_transform(parts, lambda x: x[1:950]), chr(10))) as sections_sha256,
length(trim(regexp_replace(regexp_replace(regexp_replace(html, '[ACGTN]{80,}', '[sequence]', 'g'), '(?s)```.*?```', ' ', 'g'), '\s+', ' ', 'g')))::bigint as guide_chars from p""")
def guide_sections(spark, sf_dir):
    """Pages cut at headings, and their length as guide prose."""
    parts = t.sections(F.col("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.size(parts).cast("long").alias("n_sections"), F.sha2(F.array_join(parts, "\n"), 256).alias("sections_sha256"), F.length(t.guide_text(F.col("html"))).cast("long").alias("guide_chars")
    )


WIDE = ", ".join(f"coalesce(sum(n) filter (where codon = '{c}'), 0)::bigint as n_{c.lower()}" for c in sorted(codon.CODONS))


@query(f"""with {SEQ}, r as (select lang, s from seq where length(s) > 0 and length(s) % 3 = 0 and length(translate(s, 'ACGT', '')) = 0), {_codons("r", "lang")}, n as (select lang, codon, count(*) as n from cod group by 1, 2)
select lang, {WIDE} from n group by 1""")
def codon_wide(spark, sf_dir):
    """64 codon counts of each language, over sequences in frame and without ambiguity."""
    s = F.col("s")
    rows = sequences(spark, sf_dir).where(codon.valid_frame(s) & (q.count_of(s, q.SYMBOLS) == F.length(s)))
    n = codon.codon_counts(rows, ["lang"], "s")
    return n.groupBy("lang").agg(*(F.coalesce(F.sum(F.when(F.col("codon") == c, F.col("n"))), F.lit(0)).cast("long").alias(f"n_{c.lower()}") for c in sorted(codon.CODONS)))


@query("""with d as (select r_name as region, n_name as country, year(o_orderdate) as year from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select coalesce(region, 'all') as region, coalesce(country, 'all') as country, coalesce(year, -1)::int as year, count(*) as n from d group by grouping sets ((), (region), (region, country), (region, year))""")
def atlas_rollup(spark, sf_dir):
    """Totals, regions, countries and region-years from one pass: orders are counted by customer before any join."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("k"))
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    d = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "year").agg(F.sum("k").alias("k"))
    d = d.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("country"), "year", "k")
    sets = [[], ["region"], ["region", "country"], ["region", "year"]]
    got = d.groupingSets([[F.col(c) for c in s] for s in sets], "region", "country", "year").agg(F.sum("k").alias("n"))
    return got.select(F.coalesce("region", F.lit("all")).alias("region"), F.coalesce("country", F.lit("all")).alias("country"), F.coalesce("year", F.lit(-1)).alias("year"), "n")


def cards(spark: SparkSession, glossary: dict[str, str], section: str = "glossary") -> DataFrame:
    """Guide chunks (id, title, section, tags, text) of a dictionary of terms."""
    rows = [(i, k, section, v) for i, (k, v) in enumerate(sorted(glossary.items()))]
    return spark.createDataFrame(rows, "id int, title string, section string, text string").withColumn("tags", t.topics(F.col("title"), F.col("text"), F.col("section")))


def composed(question: str, chunks: DataFrame, top: int = 4) -> str:
    """An answer of the best chunks' first sentences with their sources and the view that shows more; questions that ask
    for claims are told first that the guide describes only."""
    asked = chunks.sparkSession.range(1).select(t.mentions(F.lit(question)).alias("claims")).first()
    rows = retrieval.answer(chunks, question, top).select(t.first_sentence(F.col("text")).alias("s"), "title", "section", "tags").collect()
    opening = "Out of scope: this is a descriptive guide." if asked.claims else f"Short answer: {rows[0].s if rows else 'nothing is known.'}"
    tags = {g for r in rows for g in r.tags}
    hint = next((view for names, view in retrieval.VIEWS if tags & set(names)), "guide")
    return "\n".join([opening, *(f"- {r.s} [{i}] {r.title} ({r.section})" for i, r in enumerate(rows, 1)), f"See: {hint}"])


#: The views of the bundle by the queries they come from, and those of the catalogue.
VIEWS = {
    "overview": "panel_rollup", "metrics": "metric_summary", "tokenization": "tokenizer_audit", "stability": "bootstrap_interval", "latent": "latent_points",
    "distances": "js_distance_k3", "catalog": "metadata_coverage", "atlas": "geographic_atlas", "temporal": "temporal_counts",
}
LISTED = VIEWS | {"tokens": "top_tokens"}


def catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    """The allow-list of views over these tables."""
    return Catalogue({name: partial(QUERIES[q_], spark, sf_dir) for name, q_ in LISTED.items()}, frozenset({"s", "sequence", "text", "raw_sequence", "refined_sequence"}))


def bundle(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The guarded export: named aggregate tables, each refused if it holds sequences, long symbol runs or long tokens."""
    views = catalogue(spark, sf_dir)
    return {name: retrieval.require_safe(_short(views.view(name)), set(views.forbidden)) for name in VIEWS}


def _short(df: DataFrame) -> DataFrame:
    return retrieval.require_short_tokens(df) if "token" in df.columns else df


@query(" union all ".join(f"""select '{name}' as "view", count(*) as n_rows, {'max(length(token))' if name == 'tokens' else 'null::bigint'} as longest_token from ({ORACLE_SQL[q_]})""" for name, q_ in LISTED.items()))
def catalogue_contents(spark, sf_dir):
    """Rows and longest tokens of every view of the catalogue, exported and read again."""
    path = f"{shared_dir(spark)}/glyphstream/{spark.sparkContext.applicationId}/catalogue-{uuid.uuid4().hex}"
    views = catalogue(spark, sf_dir)
    views.export(path)
    counts = []
    for name in LISTED:
        rows = views.load(spark, path, name)
        longest = F.max(F.length("token")) if "token" in rows.columns else F.lit(None)
        counts.append(rows.agg(F.lit(name).alias("view"), F.count("*").alias("n_rows"), longest.cast("long").alias("longest_token")))
    return reduce(DataFrame.unionByName, counts)
