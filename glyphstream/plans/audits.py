"""Pairs, panels and token audits over the driver's tables, each query beside its SQL; they register beside plans.queries.

A document's sequence is cut in halves, which stand for the two segments of a pair; its language stands for the
subtype, the year of the order of the same number for its year, its labels for the richer metadata.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphstream.functions import codon, sequence as q, text as t
from glyphstream.operators import features, panels, quantiles, stability, tokens
from glyphstream.plans.queries import AMBIGUOUS, CODE, DRAWN_ROWS, DRAWN_TOKENS, ORACLE_SQL, REPLICATES, SEQ, _codons, kmer_matrix, query, r6, sequences, texts
from glyphstream.runtime import materialize, table

#: Bounds of the two segments' lengths, the share of unclear symbols, allowed subtypes, and sizes and seed of panels.
BOUNDS, UNCLEAR, ALLOWED, SMOKE, MVP, SEED = {"first": (100, 5000), "second": (120, None)}, 0.02, ["en", "de", "fr"], 24, 60, 42


def _qc_sql(part: str) -> str:
    low, high = BOUNDS[part]
    share = AMBIGUOUS.replace("(s", f"({part}").replace("length(s)", f"length({part})")
    flags = f"length({part}) >= {low} as {part}_long_enough, {'true' if high is None else f'length({part}) <= {high}'} as {part}_short_enough"
    both = f"length({part}) >= {low}" + ("" if high is None else f" and length({part}) <= {high}")
    return f"""length({part})::bigint as {part}_length, {share} as {part}_ambiguous, length(translate({part}, 'ACGTN', ''))::bigint as {part}_invalid, {flags}, {both} as {part}_length_ok,
{share} <= {UNCLEAR} as {part}_clear, length(translate({part}, 'ACGTN', '')) = 0 as {part}_valid_alphabet, {both} and {share} <= {UNCLEAR} and length(translate({part}, 'ACGTN', '')) = 0 as {part}_passes"""


PAIRS = f"""{SEQ}, halves as (select seq.doc_id, seq.lang as subtype, seq.source, substr(s, 1, length(s) // 2) as first, substr(s, length(s) // 2 + 1) as second, year(o_orderdate)::int as year,
  l.doc_id is not null as rich, coalesce(l.quality = 1, false) as human, case when l.quality = 1 then seq.source end as clade_rich, case seq.doc_id % 4 when 0 then 'missing' when 1 then 'unknown' when 2 then null else seq.lang end as clade_dedup
  from seq left join labels l on l.doc_id = seq.doc_id left join orders on o_orderkey = seq.doc_id),
checked as (select *, {_qc_sql("first")}, {_qc_sql("second")}, sha256(sha256(first) || '|' || sha256(second)) as pair_sha, year is not null as dated, subtype in ('en', 'de', 'fr') as allowed, coalesce(clade_rich, clade_dedup) as clade from halves),
pairs as (select *, first_passes and second_passes and dated and allowed as passes, coalesce(lower(clade) not in ('', 'nan', 'missing'), false) as clade_known, count(*) over (partition by pair_sha) as copies from checked)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with both segments' quality, checked joins to two metadata tables, and the first clade that either gives."""
    half = F.floor(F.length("s") / 2).cast("int")
    rows = sequences(spark, sf_dir).select("doc_id", F.col("lang").alias("subtype"), "source", F.substr("s", F.lit(1), half).alias("first"), F.substr("s", half + 1).alias("second"))
    rich = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("rich"))
    years = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"))
    rows = panels.join_one(panels.join_one(rows, rich, "doc_id"), years, "doc_id")
    for part, (low, high) in BOUNDS.items():
        rows = rows.select("*", *(c.alias(f"{part}_{n}") for n, c in zip(panels.QC, panels.sequence_qc(F.col(part), low, high, UNCLEAR))))
    human = F.coalesce(F.col("quality") == 1, F.lit(False))
    dedup = F.when(F.col("doc_id") % 4 == 0, "missing").when(F.col("doc_id") % 4 == 1, "unknown").when(F.col("doc_id") % 4 == 3, F.col("subtype"))
    rows = rows.withColumns({
        "rich": F.coalesce("rich", F.lit(False)), "human": human, "clade": F.coalesce(F.when(human, F.col("source")), dedup), "dated": F.col("year").isNotNull(),
        "allowed": F.col("subtype").isin(ALLOWED), "pair_sha": F.sha2(F.concat_ws("|", F.sha2("first", 256), F.sha2("second", 256)), 256),
    }).drop("first", "second", "quality")
    passes = F.col("first_passes") & F.col("second_passes") & F.col("dated") & F.col("allowed")
    rows = materialize(rows.withColumns({"passes": passes, "clade_known": t.has_clade(F.col("clade"))}), "pairs")
    return rows.join(rows.groupBy("pair_sha").agg(F.count("*").alias("copies")), "pair_sha")


FLAGS_OUT = [f"{part}_{n}" for part in BOUNDS for n in panels.QC if n != "ambiguous"]


@query(f"with {PAIRS} select doc_id, {', '.join(FLAGS_OUT)}, round(first_ambiguous, 6) as first_ambiguous, round(second_ambiguous, 6) as second_ambiguous, dated, allowed, passes, rich, human, clade, clade_known, copies from pairs")
def pair_table(spark, sf_dir):
    return pairs(spark, sf_dir).select("doc_id", *FLAGS_OUT, r6("first_ambiguous", "first_ambiguous"), r6("second_ambiguous", "second_ambiguous"), "dated", "allowed", "passes", "rich", "human", "clade", "clade_known", "copies")


def _balanced_sql(name: str, source: str, target: int, seed: int) -> str:
    return f"""{name}_d as (select doc_id, subtype, year, sha256('{seed}|' || doc_id::varchar) as r from {source}), {name}_z as (select subtype, count(distinct year) as parts from {name}_d group by 1),
{name}_c as (select subtype, floor({target} / count(*) over ()) + (row_number() over (order by subtype) <= {target} % count(*) over ())::int as quota, parts from {name}_z),
{name}_p as (select d.*, quota, greatest(1, ceil(quota / parts)) as cap, row_number() over (partition by d.subtype, year order by r, doc_id) as p from {name}_d d join {name}_c c on c.subtype = d.subtype),
{name}_s as (select *, row_number() over (partition by subtype order by (p > cap)::int, r, doc_id) as s from {name}_p),
{name} as (select doc_id from {name}_s order by (s > quota)::int, r, doc_id limit {target})"""


PANELS = f"""{PAIRS}, ranked as (select *, row_number() over (partition by pair_sha order by passes desc, rich desc, human desc, clade_known desc, subtype, year, doc_id) as rn from pairs where passes),
full_panel as (select * from ranked where rn = 1), liked as (select * from full_panel where rich and human),
preferred as (select * from full_panel where (rich and human) or (select count(*) from liked) < {MVP}),
{_balanced_sql("smoke", "preferred", SMOKE, SEED)}, {_balanced_sql("mvp", "preferred", MVP, SEED + 1)},
panels as (select 'full' as panel, * from full_panel union all select 'smoke', * from full_panel where doc_id in (select doc_id from smoke) union all select 'mvp', * from full_panel where doc_id in (select doc_id from mvp))"""


def phase_panels(rows: DataFrame) -> dict[str, DataFrame]:
    """Smoke, mvp and full panels: eligible pairs once each, the preferred ones balanced by subtype and year."""
    order = [F.desc("passes"), F.desc("rich"), F.desc("human"), F.desc("clade_known"), F.col("subtype"), F.col("year"), F.col("doc_id")]
    full = materialize(panels.keep_first(rows.where("passes"), ["pair_sha"], order), "full-panel")
    liked = panels.preferred(full, [F.col("rich"), F.col("human")], MVP)
    pick = lambda n, seed: panels.balanced_sample(liked, n, "subtype", "year", seed, "doc_id")
    return {"full": full, "smoke": pick(SMOKE, SEED), "mvp": pick(MVP, SEED + 1)}


def _named(parts: dict[str, DataFrame], name: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (d.withColumn(name, F.lit(k)) for k, d in parts.items()))


@query(f"with {PANELS} select panel, doc_id, subtype, year from panels")
def panel_rows(spark, sf_dir):
    return _named(phase_panels(pairs(spark, sf_dir)), "panel").select("panel", "doc_id", "subtype", "year")


MEASURES = """count(*) as n_pairs, 2 * count(*) as n_records, count(distinct pair_sha) as n_unique, count(*) - count(distinct pair_sha) as n_duplicates, count(*) filter (where rich) as n_rich, count(*) filter (where human) as n_human,
coalesce(min(year), 0)::int as year_min, coalesce(max(year), 0)::int as year_max"""


@query(f"with {PANELS} select panel, subtype, {MEASURES} from panels group by 1, 2")
def panel_summary(spark, sf_dir):
    return _named(phase_panels(pairs(spark, sf_dir)), "panel").groupBy("panel", "subtype").agg(*panels.stage_measures())


STAGES = ["valid", "unique", "rich", "human", "smoke", "mvp", "full"]


@query(f"""with {PANELS}, stages as (select 'valid' as stage, pairs.* from pairs where passes union all select 'rich', pairs.* from pairs where rich union all select 'human', pairs.* from pairs where human
union all select 'unique', * exclude (panel, rn) from panels where panel = 'full' union all select panel, * exclude (panel, rn) from panels),
names as (select unnest([{', '.join(f"'{s}'" for s in STAGES)}]) as stage),
m as (select stage, {MEASURES}, count(*) filter (where subtype = 'en') as n_en, count(*) filter (where subtype = 'de') as n_de from stages group by 1)
select names.stage, {', '.join(f'coalesce({c}, 0) as {c}' for c in ('n_pairs', 'n_records', 'n_unique', 'n_duplicates', 'n_rich', 'n_human', 'year_min', 'year_max', 'n_en', 'n_de'))} from names left join m on m.stage = names.stage""")
def stage_summary(spark, sf_dir):
    """Seven stages of selection by the same measures; a stage without rows has zeros."""
    rows = pairs(spark, sf_dir)
    made = phase_panels(rows)
    stages = {"valid": rows.where("passes"), "unique": made["full"], "rich": rows.where("rich"), "human": rows.where("human"), **made}
    found = _named(stages, "stage").groupBy("stage").agg(*panels.stage_measures(), F.count_if(F.col("subtype") == "en").alias("n_en"), F.count_if(F.col("subtype") == "de").alias("n_de"))
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    return names.join(found, "stage", "left").na.fill(0)


@query(f"""with {PANELS}, frames as (select 'valid' as panel, subtype, first_length, second_length, first_ambiguous, second_ambiguous, first_invalid, second_invalid, first_passes, second_passes from pairs where passes
union all select panel, subtype, first_length, second_length, first_ambiguous, second_ambiguous, first_invalid, second_invalid, first_passes, second_passes from panels),
long as (select panel, subtype, 'first' as segment, first_length as size, first_ambiguous as unclear, first_invalid as invalid, first_passes as ok from frames union all select panel, subtype, 'second', second_length, second_ambiguous, second_invalid, second_passes from frames)
select panel, subtype, segment, count(*) as n, min(size)::bigint as shortest, round(quantile_cont(size, 0.05), 6) as p05, round(median(size), 6) as median, round(avg(size), 6) as mean, round(quantile_cont(size, 0.95), 6) as p95, max(size)::bigint as longest,
count(*) filter (where unclear > 0) as n_unclear, round(avg(unclear), 6) as mean_unclear, count(*) filter (where invalid > 0) as n_invalid, count(*) filter (where ok) as n_pass from long group by 1, 2, 3""")
def length_quality(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    frames = _named({"valid": rows.where("passes"), **phase_panels(rows)}, "panel")
    part = lambda p: F.struct(F.lit(p).alias("segment"), F.col(f"{p}_length").alias("size"), F.col(f"{p}_ambiguous").alias("unclear"), F.col(f"{p}_invalid").alias("invalid"), F.col(f"{p}_passes").alias("ok"))
    long = frames.select("panel", "subtype", F.inline(F.array(*map(part, BOUNDS))))
    long, key = materialize(long, "lengths"), ["panel", "subtype", "segment"]
    stats = long.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("size").alias("shortest"), F.round(F.avg("size"), 6).alias("mean"), F.max("size").alias("longest"), F.count_if(F.col("unclear") > 0).alias("n_unclear"),
        F.round(F.avg("unclear"), 6).alias("mean_unclear"), F.count_if(F.col("invalid") > 0).alias("n_invalid"), F.count_if("ok").alias("n_pass"),
    )
    ends = quantiles.exact(long, key, "size", {"p05": 0.05, "median": 0.5, "p95": 0.95})
    return quantiles.beside(stats, ends, key).withColumns({c: F.round(c, 6) for c in ("p05", "median", "p95")})


RECORDS = f"""{SEQ}, records as (select doc_id, s, case when doc_id % 5 = 0 then 'seg ha h1n1' when doc_id % 5 = 1 then 'Neuraminidases of H3N2' when doc_id % 5 = 2 then 'na h5n1x' when doc_id % 5 = 3 then 'than hay' else source end as description from seq),
named as (select *, case when regexp_matches(lower(description), 'hemagglutinin|\\bha\\b') then 'HA' when regexp_matches(lower(description), 'neuraminidase|\\bna\\b') then 'NA' end as segment, nullif(regexp_extract(upper(description), '(H[0-9]+N[0-9]+)', 1), '') as subtype from records)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with a description, and the segment and subtype that it tells."""
    kind = F.col("doc_id") % 5
    text = F.when(kind == 0, "seg ha h1n1").when(kind == 1, "Neuraminidases of H3N2").when(kind == 2, "na h5n1x").when(kind == 3, "than hay").otherwise(F.col("source"))
    rows = sequences(spark, sf_dir).select("doc_id", "s", text.alias("description"))
    return rows.select("*", t.segment_in(F.col("description")).alias("segment"), t.subtype_in(F.col("description")).alias("subtype"))


@query(f"with {RECORDS} select doc_id, description, segment, subtype, length(s)::bigint as length, round({AMBIGUOUS}, 6) as ambiguous from named")
def record_summary(spark, sf_dir):
    return records(spark, sf_dir).select("doc_id", "description", "segment", "subtype", F.length("s").cast("long").alias("length"), r6(q.ambiguous_fraction(F.col("s")), "ambiguous"))


@query(f"with {RECORDS} select coalesce(segment, 'unknown') as segment, coalesce(subtype, 'unknown') as subtype, count(*) as n from named group by 1, 2")
def segment_subtype_counts(spark, sf_dir):
    return records(spark, sf_dir).groupBy(F.coalesce("segment", F.lit("unknown")).alias("segment"), F.coalesce("subtype", F.lit("unknown")).alias("subtype")).agg(F.count("*").alias("n"))


@query(f"""with {RECORDS}, f as (select *, row_number() over (partition by s order by doc_id) as rn from named where length(s) >= case segment when 'HA' then 500 when 'NA' then 900 else 0 end and {AMBIGUOUS} <= {UNCLEAR})
select doc_id, coalesce(segment, 'unknown') as segment from f where rn = 1""")
def filtered_records(spark, sf_dir):
    """Records long enough for their segment, clear enough, and the first of their sequence."""
    got = panels.filtered_records(records(spark, sf_dir), {"HA": 500, "NA": 900}, UNCLEAR, ["doc_id"])
    return got.select("doc_id", F.coalesce("segment", F.lit("unknown")).alias("segment"))


# Token audits

SPECS = ["codon", "overlap_k3", "step_k6", "frame1_k3"]


def _spec_sql(name: str) -> str:
    k = tokens.CATALOG[name]
    step = 1 if k.kind == "overlap" else k.k
    return f"select doc_id, '{name}' as tokenizer, i - 1 as start, i - 1 + {k.k} as stop, s[i : i + {k.k - 1}] as token from (select doc_id, s, unnest(range({k.offset + 1}, greatest(length(s) - {k.k - 2}, 1), {step})) as i from seq)"


TOKENS = f"""{SEQ}, tok as ({' union all '.join(map(_spec_sql, SPECS))}),
n as (select doc_id, tokenizer, token, count(*) as n, sum((floor((stop - 1) / 3) > floor(start / 3))::int) as n_cross from tok group by 1, 2, 3),
p as (select *, n / sum(n) over (partition by doc_id, tokenizer) as p from n),
a as (select doc_id, tokenizer, sum(n) as n_tokens, count(*) as vocabulary, sum(-p * log2(p)) as entropy, sum(n_cross) as n_cross, sum(case when contains(token, 'CG') then n else 0 end) as n_cg, sum(case when contains(token, 'TA') then n else 0 end) as n_ta from p group by 1, 2),
kinds(tokenizer, mode, k, "offset") as (values {', '.join(f"('{n}', '{tokens.CATALOG[n].kind}', {tokens.CATALOG[n].k}, {tokens.CATALOG[n].offset})" for n in SPECS)}),
audit as (select seq.doc_id, lang, source, kinds.tokenizer, mode, k, "offset", length(s)::bigint as length, coalesce(n_tokens, 0)::bigint as n_tokens, coalesce(vocabulary, 0)::bigint as vocabulary, coalesce(entropy, 0.0) as entropy, pow(2.0, coalesce(entropy, 0.0)) as effective_vocabulary,
  coalesce(n_tokens, 0) * 1000.0 / nullif(length(s), 0) as tokens_per_kb, n_cg / n_tokens as cg, n_ta / n_tokens as ta, n_cross / n_tokens as crossing from seq cross join kinds left join a on a.doc_id = seq.doc_id and a.tokenizer = kinds.tokenizer)"""
REALS = ["entropy", "effective_vocabulary", "tokens_per_kb", "cg", "ta", "crossing"]


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.summary_rows(sequences(spark, sf_dir), [tokens.CATALOG[n] for n in SPECS], "doc_id", ["lang", "source"])


@query(f"""with {TOKENS} select doc_id, lang, source, tokenizer, mode, k, "offset", length, n_tokens, vocabulary, {', '.join(f'round({c}, 6) as {c}' for c in REALS)} from audit""")
def token_summary(spark, sf_dir):
    """A row for each sequence and tokenizer."""
    return audit(spark, sf_dir).select("doc_id", "lang", "source", "tokenizer", "mode", "k", "offset", "length", "n_tokens", "vocabulary", *(r6(c, c) for c in REALS))


@query(f"""with {TOKENS}, v as (select tokenizer, count(distinct token) as observed_vocabulary from n group by 1)
select audit.tokenizer, mode, k, "offset", observed_vocabulary, count(distinct doc_id) as n_sequences, sum(n_tokens)::bigint as total_tokens, round(avg(length), 6) as mean_length, round(avg(n_tokens), 6) as mean_tokens, round(avg(vocabulary), 6) as mean_vocabulary,
{', '.join(f'round(avg({c}), 6) as mean_{c}' for c in REALS)} from audit left join v on v.tokenizer = audit.tokenizer group by 1, 2, 3, 4, 5""")
def tokenizer_summary(spark, sf_dir):
    """Means of each tokenizer, joined with the vocabulary seen in all sequences."""
    rows = audit(spark, sf_dir)
    seen = tokens.group_counts(sequences(spark, sf_dir), [tokens.CATALOG[n] for n in SPECS], []).groupBy("tokenizer").agg(F.count("*").alias("observed_vocabulary"))
    means = [F.round(F.avg(c), 6).alias(f"mean_{n}") for n, c in (("length", "length"), ("tokens", "n_tokens"), ("vocabulary", "vocabulary"), *((c, c) for c in REALS))]
    got = rows.groupBy("tokenizer", "mode", "k", "offset").agg(F.countDistinct("doc_id").alias("n_sequences"), F.sum("n_tokens").alias("total_tokens"), *means)
    return got.join(seen, "tokenizer", "left")


@query(f"""with {TOKENS} select tokenizer, lang, count(distinct doc_id) as n_sequences, round(avg(entropy), 6) as mean_entropy, round(median(entropy), 6) as median_entropy, round(stddev_samp(entropy), 6) as sd_entropy, round(avg(effective_vocabulary), 6) as mean_effective_vocabulary,
{', '.join(f'round(avg({c}), 6) as mean_{c}, round(median({c}), 6) as median_{c}' for c in ('cg', 'ta', 'crossing'))} from audit group by 1, 2""")
def token_group_summary(spark, sf_dir):
    """Entropy, CG and TA shares and boundary crossings of each tokenizer and group."""
    rows, key, measured = materialize(audit(spark, sf_dir), "audit"), ["tokenizer", "lang"], ["entropy", "cg", "ta", "crossing"]
    stats = rows.groupBy(*key).agg(
        F.countDistinct("doc_id").alias("n_sequences"), F.round(F.stddev_samp("entropy"), 6).alias("sd_entropy"),
        *(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in (*measured, "effective_vocabulary")),
    )
    middle = quantiles.exact(rows.select(*key, *(F.col(c).cast("double").alias(c) for c in measured)).unpivot(key, measured, "metric", "value"), [*key, "metric"], "value", {"m": 0.5})
    middle = middle.groupBy(*key).agg(*(F.max(F.when(F.col("metric") == c, F.round("m", 6))).alias(f"median_{c}") for c in measured))
    return quantiles.beside(stats, middle, key)


@query()
def tokenizer_ranking(spark, sf_dir):
    """Tokenizers by the robustness of their bootstraps: distance, its spread, top tokens, entropy, coverage."""
    counted = tokens.group_counts(sequences(spark, sf_dir), [tokens.CATALOG[n] for n in SPECS], ["lang"])
    dists = materialize(tokens.distribution(counted, ["tokenizer", "lang"]), "dist")
    parts: dict[str, list[DataFrame]] = {"js": [], "jaccard": []}
    for name in SPECS:
        dist = dists.where(F.col("tokenizer") == name).drop("tokenizer")
        js = stability.bootstrap_divergence(dist, "lang", REPLICATES, DRAWN_TOKENS, 7).groupBy("replicate").agg(F.avg("distance").alias("v"))
        parts["js"].append(stability.interval(js.withColumn("tokenizer", F.lit(name)), ["tokenizer"], "v"))
        top = stability.top_stability(dist, "lang", REPLICATES, DRAWN_TOKENS, 20, 7).withColumn("tokenizer", F.lit(name))
        parts["jaccard"].append(stability.interval(top, ["tokenizer", "lang"], "jaccard"))
    rows = audit(spark, sf_dir).select("doc_id", "lang", "tokenizer", "entropy")
    rows = materialize(rows.withColumn("group", F.concat_ws("|", "tokenizer", "lang")), "audit")
    drawn = stability.bootstrap_rows(rows, "group", "doc_id", REPLICATES, DRAWN_ROWS, 7).groupBy("tokenizer", "lang", "replicate").agg(F.avg("entropy").alias("v"))
    entropy = stability.interval(drawn, ["tokenizer", "lang"], "v")
    coverage = rows.groupBy("tokenizer").agg(F.countDistinct("doc_id").alias("n_sequences"))
    got = stability.tokenizer_ranking(reduce(DataFrame.unionByName, parts["js"]), reduce(DataFrame.unionByName, parts["jaccard"]), entropy, coverage)
    return got.select("tokenizer", "rank", r6("robustness", "robustness"))


# Wide metric rows

PAIRS2 = [a + b for a in q.SYMBOLS for b in q.SYMBOLS]


@query(f"""with d as ({ORACLE_SQL["dinucleotide_odds"]}), k as ({ORACLE_SQL["kmer_profiles"]}), m as ({ORACLE_SQL["sequence_composition"]}),
w as (select doc_id, {', '.join(f"max(odds) filter (where token = '{x}') as odds_{x.lower()}" for x in PAIRS2)} from d group by 1),
e as (select doc_id, {', '.join(f"max({c}) filter (where k = {i}) as k{i}_{c}" for i in (3, 4, 5) for c in ("n_kmers", "distinct_kmers", "entropy"))} from k group by 1)
select m.doc_id, length, ambiguous, gc, w.* exclude (doc_id), e.* exclude (doc_id) from m left join w on w.doc_id = m.doc_id left join e on e.doc_id = m.doc_id""")
def sequence_metric_rows(spark, sf_dir):
    """One wide row for each sequence: composition, sixteen odds, and profiles of 3 to 5 symbols, from one pass of a task over its text."""
    specs = [tokens.tokenizer(f"overlap_k{k}") for k in (3, 4, 5)]
    rows = tokens.row_measures(texts(spark, sf_dir), specs, ["doc_id"], letters=q.SYMBOLS, dense=tokens.tokenizer("overlap_k2"))
    rows = rows.select("doc_id", "measures", F.transform("counts", lambda n: F.nullif(n, F.lit(0)).cast("double")).alias("n"), "symbols.*")
    rows = rows.withColumn("bases", sum((F.col(x) for x in q.SYMBOLS[1:]), F.col("A"))).withColumn("valid_n", F.aggregate("n", F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0))))
    own = ["length", r6(F.coalesce(F.try_divide(F.col("length") - F.col("bases"), "length"), F.lit(1.0)), "ambiguous"), r6(F.try_divide(F.col("G") + F.col("C"), "bases"), "gc")]
    odds = lambda i, x: F.round(F.col("n")[i] * F.col("bases") * F.col("bases") / (F.col("valid_n") * F.col(x[0]) * F.col(x[1])), 9).alias(f"odds_{x.lower()}")
    of = lambda i, c: F.when(F.col("measures")[i]["n_tokens"] > 0, F.col("measures")[i][c])
    profile = lambda i, k: [of(i, "n_tokens").alias(f"k{k}_n_kmers"), of(i, "vocabulary").alias(f"k{k}_distinct_kmers"), F.round(of(i, "entropy"), 6).alias(f"k{k}_entropy")]
    return rows.select("doc_id", *own, *(odds(i, x) for i, x in enumerate(PAIRS2)), *(c for i, k in enumerate((3, 4, 5)) for c in profile(i, k)))


SENSE = [c for c, a in sorted(codon.CODONS.items()) if a != "*"]


@query(f"""with {SEQ}, r as (select doc_id, substr(s, 1, length(s) - length(s) % 3) as s from seq), {_codons("r", "doc_id")}, {CODE}, n as (select doc_id, codon, count(*) as n from cod where regexp_full_match(codon, '[ACGT]{{3}}') group by 1, 2),
deg as (select *, count(*) over (partition by amino) as deg from code),
u as (select doc_id, n.codon, n, n / sum(n) over (partition by doc_id) as frequency, case when amino <> '*' then n * deg / sum(n) over (partition by doc_id, amino) end as rscu from n join deg using (codon))
select doc_id, {', '.join(f"coalesce(max(n) filter (where codon = '{c}'), 0)::bigint as n_{c.lower()}, round(coalesce(max(frequency) filter (where codon = '{c}'), 0), 6) as f_{c.lower()}" for c in sorted(codon.CODONS))},
{', '.join(f"round(max(rscu) filter (where codon = '{c}'), 6) as rscu_{c.lower()}" for c in SENSE)} from u group by 1""")
def codon_metric_rows(spark, sf_dir):
    """64 counts and shares and 61 relative usages of each sequence's whole codons, in one row."""
    used = codon.usage(codon.codon_counts(sequences(spark, sf_dir), ["doc_id"], "s"), ["doc_id"])
    of = lambda c, v: F.max(F.when(F.col("codon") == c, F.col(v)))
    counts = [x for c in sorted(codon.CODONS) for x in (F.coalesce(of(c, "n"), F.lit(0)).alias(f"n_{c.lower()}"), F.round(F.coalesce(of(c, "frequency"), F.lit(0.0)), 6).alias(f"f_{c.lower()}"))]
    return used.groupBy("doc_id").agg(*counts, *(F.round(of(c, "rscu"), 6).alias(f"rscu_{c.lower()}") for c in SENSE))


@query("""with v as (select label, vec_id, embedding, len(embedding) as dim from embeddings) select coalesce(label::varchar, 'all') as label, count(*) as n, min(dim)::int as least_dim, max(dim)::int as most_dim, min(vec_id)::bigint as first_id, max(vec_id)::bigint as last_id from v group by grouping sets ((), (label))""")
def embedding_summary(spark, sf_dir):
    """Size and dimensions of the stored vectors, in all and by label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("label"), "vec_id", F.size("embedding").alias("dim"))
    got = rows.rollup("label").agg(F.count("*").alias("n"), F.min("dim").alias("least_dim"), F.max("dim").alias("most_dim"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))
    return got.withColumn("label", F.coalesce("label", F.lit("all")))


MATRIX3 = f"{SEQ}, m as (select doc_id, lang, token as feature, count(*)::double as value from (select doc_id, lang, unnest(list_transform(range(1, greatest(length(s) - 1, 1)), lambda i: s[i : i + 2])) as token from seq) where regexp_full_match(token, '[ACGT]+') group by 1, 2, 3)"


@query(f"""with {MATRIX3}, e as (select doc_id, lang, sum(-p * log2(p)) as h from (select doc_id, lang, value / sum(value) over (partition by doc_id) as p from m) group by 1, 2)
select lang, count(*) as n, round(avg(h), 6) as mean, round(median(h), 6) as median from e group by 1""")
def feature_entropy(spark, sf_dir):
    """Entropy of the rows of a k-mer matrix, by group."""
    m = materialize(kmer_matrix(spark, sf_dir), "matrix")
    h = features.row_entropy(m.select("doc_id", "feature", "value"), "doc_id").join(m.select("doc_id", "lang").distinct(), "doc_id")
    h = materialize(h.select("lang", "entropy"), "entropies")
    stats = h.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("entropy"), 6).alias("mean"))
    return quantiles.beside(stats, quantiles.exact(h, ["lang"], "entropy", {"median": 0.5}), ["lang"]).withColumn("median", F.round("median", 6))


@query("""with c as (select label, i, avg(x) as x from (select label, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as i from embeddings) group by 1, 2)
select a.label as a, b.label as b, round(sqrt(sum((a.x - b.x) ^ 2)), 5) as distance from c a join c b on a.i = b.i and a.label < b.label group by 1, 2""")
def label_distances(spark, sf_dir):
    """Distances of all pairs of the labels' mean vectors."""
    mean = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    points = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("v"))
    return features.pairwise_distances(points, "label", "v").select("a", "b", F.round("distance", 5).alias("distance"))


@query(f"""with m as ({ORACLE_SQL["metric_summary"]}) select metric, arg_min(lang, (mean, lang)) as lowest, round(min(mean), 6) as low, arg_max(lang, (mean, -ascii(lang))) as highest, round(max(mean), 6) as high from m where mean is not null group by 1""")
def metric_extremes(spark, sf_dir):
    """The groups with the least and the greatest mean of each metric."""
    from glyphstream.plans.queries import metric_summary

    m = metric_summary(spark, sf_dir).where(F.col("mean").isNotNull() & ~F.isnan("mean"))
    return m.groupBy("metric").agg(F.min_by("lang", F.struct("mean", "lang")).alias("lowest"), F.round(F.min("mean"), 6).alias("low"), F.max_by("lang", F.struct("mean", -F.ascii("lang"))).alias("highest"), F.round(F.max("mean"), 6).alias("high"))


def run_documents(spark, sf_dir):
    """(run, doc): a day's events as a nested metrics document, as stored results of runs have it."""
    k = F.get_json_object("props", "$.k").cast("double")
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("run"), F.col("event_type").alias("metric"), F.concat(F.lit("u"), F.col("user_id") % 2).alias("subtype"), "value", k.alias("k"))
    rho = F.struct("metric", "subtype", "rho", "valid")
    runs = rows.groupBy("run", "metric", "subtype").agg(F.corr("value", "k").alias("rho"), F.count("*").cast("double").alias("valid")).where("valid >= 10")
    runs = runs.groupBy("run").agg(F.sort_array(F.collect_list(rho)).alias("spearman"))
    part = F.struct(F.col("n"), F.col("n95"), F.array("low", "high").alias("explained"))
    groups = rows.groupBy("run", "metric").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("value") > 20).cast("int").alias("n95"), F.min("value").alias("low"), F.max("value").alias("high"))
    groups = groups.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("metric", part))).alias("pca"))
    return groups.join(runs, "run", "left").select("run", F.to_json(F.struct("spearman", "pca")).alias("doc"))


@query("""with r as (select event_type as metric, 'u' || user_id % 2 as subtype, ts::date as run, corr(value, (props::json->>'k')::double) as rho, count(*) as valid from events group by 1, 2, 3 having count(*) >= 10)
select metric, subtype, round(avg(rho), 6) as rho_mean, round(stddev_samp(rho), 6) as rho_sd, round(avg(valid), 6) as valid_mean, count(*) as n_runs from r group by 1, 2""")
def run_summary(spark, sf_dir):
    """Repeated runs of nested metrics documents, summarised."""
    runs = run_documents(spark, sf_dir).select(F.from_json("doc", "spearman array<struct<metric:string,subtype:string,rho:double,valid:double>>").alias("j"))
    rows = runs.select(F.inline("j.spearman"))
    return rows.groupBy("metric", "subtype").agg(F.round(F.avg("rho"), 6).alias("rho_mean"), F.round(F.stddev_samp("rho"), 6).alias("rho_sd"), F.round(F.avg("valid"), 6).alias("valid_mean"), F.count("*").alias("n_runs"))


@query("""select ts::date::varchar as run, event_type as "group", count(*)::int as n, count(*) filter (where value > 20)::int as n95, min(value) as top1, max(value) as top2 from events group by 1, 2""")
def nested_metrics(spark, sf_dir):
    """Groups of nested metrics documents as rows; what a group lacks is null."""
    docs = run_documents(spark, sf_dir).select("run", F.from_json("doc", "pca map<string,struct<n:int,n95:int,explained:array<double>>>").alias("j"))
    return docs.select("run", F.explode("j.pca").alias("group", "x")).select("run", "group", "x.n", "x.n95", F.get("x.explained", F.lit(0)).alias("top1"), F.get("x.explained", F.lit(1)).alias("top2"))


@query(f"""with m as ({ORACLE_SQL["matrix_summary"]}), h as ({ORACLE_SQL["label_distances"]}) select 'baseline' as family, 'kmer3' as representation, n_rows, n_features, sparsity, null::double as mean_distance from m
union all select 'learned', 'embedding', (select count(*) from embeddings), (select max(len(embedding)) from embeddings), null, (select round(avg(distance), 4) from h)""")
def representation_comparison(spark, sf_dir):
    """One row for each family of representations, from the summaries of both."""
    from glyphstream.plans.queries import matrix_summary

    base = matrix_summary(spark, sf_dir).select(F.lit("baseline").alias("family"), F.lit("kmer3").alias("representation"), "n_rows", "n_features", "sparsity", F.lit(None).cast("double").alias("mean_distance"))
    far = label_distances(spark, sf_dir).agg(F.round(F.avg("distance"), 4).alias("mean_distance")).withColumn("one", F.lit(1))
    own = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n_rows"), F.max(F.size("embedding")).cast("long").alias("n_features")).withColumn("one", F.lit(1)).join(far, "one")
    return base.unionByName(own.select(F.lit("learned").alias("family"), F.lit("embedding").alias("representation"), "n_rows", "n_features", F.lit(None).cast("double").alias("sparsity"), "mean_distance"))


@query(f"""with r as ({ORACLE_SQL["residue_signals"]}) select lang, count(*) as n_positions, round(avg(gc), 5) as mean_gc, round(avg(cg), 5) as mean_cg, round(avg(ta), 5) as mean_ta, round(avg(entropy), 5) as mean_entropy, round(max(entropy), 5) as most_entropy from r group by 1""")
def signal_catalog(spark, sf_dir):
    """Positions and means of the residue signals of each group."""
    from glyphstream.plans.queries import residue_signals

    mean = lambda c: F.round(F.avg(c), 5).alias(f"mean_{c}")
    return residue_signals(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_positions"), *map(mean, ("gc", "cg", "ta", "entropy")), F.round(F.max("entropy"), 5).alias("most_entropy"))
