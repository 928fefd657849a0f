"""Queries over document chunks and packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistrata.functions import packing as P
from evistrata.functions import text as X
from evistrata.functions.values import cosine
from evistrata.operators import packing as ops
from evistrata.plans.registry import query, table

TERMS = ["the", "and", "with", "of the", "le"]
SIZES = {"window": 1500, "overlap": 200, "radius": 60, "gap": 40, "front": 400, "tail": 300}
BUDGET = 2500


def headed(spark, d):
    """Every third document gets section headings; the others stay as they are."""
    t = F.col("text")
    with_heads = F.concat(F.lit("Front line\nAbstract\n"), t, F.lit("\n2. Results:\n"), F.substring("text", 1, 700), F.lit("\nMETHODS\ntable 1 of the study\nIV. Findings\n"),
                          F.substring("text", 1, 300), F.lit("\nReferences\nthe and with"))
    return table(spark, d, "documents").select("doc_id", "text").select("doc_id", F.when(F.col("doc_id") % 3 == 0, with_heads).otherwise(t).alias("text"))


STRIP = r"regexp_replace({0}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"


def s(expr: str) -> str:
    return STRIP.format(expr)


HEADED_SQL = """
doc as (select doc_id, case when doc_id % 3 = 0 then 'Front line' || chr(10) || 'Abstract' || chr(10) || text || chr(10) || '2. Results:' || chr(10) || substr(text, 1, 700)
    || chr(10) || 'METHODS' || chr(10) || 'table 1 of the study' || chr(10) || 'IV. Findings' || chr(10) || substr(text, 1, 300) || chr(10) || 'References' || chr(10) || 'the and with'
  else text end as text from documents)"""
LINES_SQL = f"""
line0 as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from doc),
line as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0)::bigint as off,
  lower(regexp_replace(regexp_replace({s('line')}, '^(\\d+(\\.\\d+)*|[IVXivx]+)[).\\s:-]+', ''), '[:.\\s]+$', '')) as name from line0),
head as (select doc_id, off, {s('line')} as heading, case when name in ('abstract', 'summary') then 'abstract' when name in ('results', 'findings') then 'results'
  when name in ('methods', 'method') then 'methods' when name in ('references', 'bibliography') then 'references' end as section from line
  where name in ('abstract', 'summary', 'results', 'findings', 'methods', 'method', 'references', 'bibliography'))"""
CHUNK_SQL = f"""
{HEADED_SQL}, {LINES_SQL},
span0 as (select h.*, lead(off) over (partition by h.doc_id order by off) as nxt, count(*) over (partition by h.doc_id) as heads from head h),
span as (select doc_id, 'detected_section' as source, section, left(heading, 100) as heading, off as a, coalesce(nxt, length(text)) as b,
  {s('substr(text, off + 1, coalesce(nxt, length(text)) - off)')} as txt from span0 join doc using (doc_id) where heads >= 2),
win as (select doc_id, 'fallback_window' as source, 'unknown' as section, '' as heading, a, least(length(text), a + {SIZES['window']}) as b,
    {s('substr(text, a + 1, ' + str(SIZES['window']) + ')')} as txt
  from (select doc_id, text, unnest(generate_series(0, length(text) - 1, {SIZES['window'] - SIZES['overlap']})) as a from doc where length(text) > 0)
  where (a = 0 or a - {SIZES['window'] - SIZES['overlap']} + {SIZES['window']} < length(text)) and doc_id not in (select doc_id from span)),
struct0 as (select * from span where txt <> '' union all select * from win where txt <> ''),
structural as (select *, left(case source when 'detected_section' then 's' else 'w' end, 1) ||
  lpad(cast(row_number() over (partition by doc_id order by a) - 1 as varchar), 3, '0') as chunk_id from struct0)"""


def _hits(term: str) -> str:
    return f"""select doc_id, n, '{term}' as term, plen, length(text) as size,
      sum(plen + {len(term)}) over (partition by doc_id order by n) - {len(term)} as pos from
      (select doc_id, text, unnest(list_transform(string_split(lower(text), '{term}'), lambda x: length(x))) as plen,
        generate_subscripts(string_split(lower(text), '{term}'), 1) as n, len(string_split(lower(text), '{term}')) as pieces from doc) where n < pieces"""


KEYWORD_SQL = f"""
hit as ({' union all '.join(_hits(t) for t in TERMS)}),
rng as (select doc_id, greatest(pos - {SIZES['radius']}, 0)::bigint as a, least(size, pos + length(term) + {SIZES['radius']})::bigint as b from hit),
isl0 as (select *, case when a > max(b) over (partition by doc_id order by a, b rows between unbounded preceding and 1 preceding) + {SIZES['gap']} then 1 else 0 end as fresh from rng),
isl1 as (select *, sum(fresh) over (partition by doc_id order by a, b rows unbounded preceding) as isl from isl0),
merged as (select doc_id, isl, min(a) as a, max(b) as b from isl1 group by 1, 2),
kw as (select m.doc_id, 'keyword_window' as source, 'keyword_context' as section, '' as heading, a, b, {s('substr(text, a + 1, b - a)')} as txt,
  'k' || lpad(cast(isl as varchar), 3, '0') as chunk_id from merged m join doc using (doc_id))"""
BOUNDARY_SQL = f"""
bound as (select doc_id, 'front_matter' as source, 'front_matter' as section, '' as heading, 0 as a, least(length(text), {SIZES['front']}) as b,
    {s('substr(text, 1, ' + str(SIZES['front']) + ')')} as txt, 'front000' as chunk_id from doc
  union all select doc_id, 'tail', 'tail', '', greatest({SIZES['front']}, length(text) - {SIZES['tail']}), length(text),
    {s('substr(text, greatest(' + str(SIZES['front']) + ', length(text) - ' + str(SIZES['tail']) + ') + 1)')}, 'tail000' from doc where length(text) > {SIZES['front']})"""
ALL_SQL = f"""
{CHUNK_SQL}, {KEYWORD_SQL}, {BOUNDARY_SQL},
allc as (select *, 0 as grp from bound where txt <> '' union all select *, 1 from structural union all select *, 2 from kw where txt <> ''),
posd as (select *, row_number() over (partition by doc_id order by grp, a, chunk_id desc) as pos,
  {', '.join(f"(length(txt) - length(replace(lower(txt), '{t}', ''))) // {len(t)} as n{i}" for i, t in enumerate(TERMS))} from allc),
scored as (select *, length(txt) as size, case section when 'abstract' then 5 when 'results' then 4 when 'methods' then 2 else 0 end + {' + '.join(f'least(n{i}, 5)' for i in range(len(TERMS)))}
  + regexp_matches(lower(txt), '(^|[^\\p{{L}}\\p{{N}}_])(table|figure|表|图)($|[^\\p{{L}}\\p{{N}}_])|(^|[^\\p{{L}}\\p{{N}}_])fig\\.[\\p{{L}}\\p{{N}}_]')::int as score,
  {' + '.join(f'(n{i} > 0)::int' for i in range(len(TERMS)))} as nhits from posd)"""


@query("p17_p18_headings", rf"""
with {HEADED_SQL}, line0 as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from doc),
b as (select doc_id, n, {s('line')} as bare from line0),
c as (select *, lower(regexp_replace(regexp_replace(bare, '(?i)^(\d+(\.\d+)*|[IVX]+)[).\s:-]+', ''), '[:.\s]+$', '')) as name, regexp_replace(bare, '[^A-Za-z]', '', 'g') as letters from b),
e as (select *, case when name in ('abstract', 'summary') then 'abstract' when name in ('results', 'findings') then 'results'
  when name in ('methods', 'method') then 'methods' when name in ('references', 'bibliography') then 'references' end as section from c)
select doc_id, cast(n as bigint) as n, section, case when bare <> '' and length(bare) <= 100 and (section is not null or regexp_matches(bare, '(?i)^(\d+(\.\d+)*|[IVX]+)\s+[\p{{L}}\p{{N}}_(]')
  or (length(letters) >= 4 and letters = upper(letters) and len(string_split_regex(bare, '[\s\pZ]+')) <= 8)) then 1 else 0 end as heading from e""")
def p17(spark, d):
    lines = headed(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return lines.select("doc_id", (F.col("n") + 1).cast("bigint").alias("n"), X.canonical_section("line").alias("section"), X.looks_like_heading("line").cast("int").alias("heading"))


@query("w7_sections_and_windows", f"""
with {CHUNK_SQL} select doc_id, chunk_id, source, section, heading, cast(a as bigint) as char_start, cast(b as bigint) as char_end, md5(txt) as digest from structural""")
def w7(spark, d):
    rows = ops.chunk_rows(ops.split_sections(headed(spark, d), window=SIZES["window"], overlap=SIZES["overlap"]))
    return _slim(rows)


def _slim(rows):
    return rows.select("doc_id", "chunk_id", "source", "section", "heading", F.col("char_start").cast("bigint").alias("char_start"),
                       F.col("char_end").cast("bigint").alias("char_end"), F.md5("text").alias("digest"))


@query("j26_keyword_windows", f"""
with {HEADED_SQL}, {KEYWORD_SQL} select doc_id, chunk_id, a as char_start, b as char_end, md5(txt) as digest from kw where txt <> ''""")
def j26(spark, d):
    rows = ops.explode_chunks(headed(spark, d), P.keyword_windows("text", TERMS, SIZES["radius"], SIZES["gap"]))
    return _slim(rows).drop("source", "section", "heading")


@query("w8_boundary_chunks", f"with {HEADED_SQL}, {BOUNDARY_SQL} select doc_id, chunk_id, cast(a as bigint) as char_start, cast(b as bigint) as char_end, md5(txt) as digest from bound where txt <> ''")
def w8(spark, d):
    rows = ops.explode_chunks(headed(spark, d), P.boundary_chunks("text", SIZES["front"], SIZES["tail"]))
    return _slim(rows).drop("source", "section", "heading")


@query("w6_merge_ranges", """
with r as (select l_orderkey as doc_id, (l_partkey % 1000 - 20)::bigint as a, (l_partkey % 1000 - 20 + l_quantity)::bigint as b from lineitem),
c as (select doc_id, greatest(a, 0) as a, greatest(b, 0) as b from r where b > a),
f as (select *, case when a > max(b) over (partition by doc_id order by a, b rows between unbounded preceding and 1 preceding) + 30 then 1 else 0 end as fresh from c),
g as (select *, sum(fresh) over (partition by doc_id order by a, b rows unbounded preceding) as isl from f)
select doc_id, min(a) as "start", max(b) as "end" from g group by doc_id, isl""")
def w6(spark, d):
    start = (F.col("l_partkey") % 1000 - 20)
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + F.col("l_quantity")).cast("bigint").alias("end"))
    return ops.merge_range_rows(r, gap=30)


# One key owns every row: the places of all line items along one axis.
@query("w6_merge_hot_key", """
with r as (select 1 as doc_id, l_orderkey * 200 + l_partkey % 150 as a, (l_orderkey * 200 + l_partkey % 150 + l_quantity)::bigint as b from lineitem),
f as (select *, case when a > max(b) over (order by a, b rows between unbounded preceding and 1 preceding) + 30 then 1 else 0 end as fresh from r where b > a),
g as (select *, sum(fresh) over (order by a, b rows unbounded preceding) as isl from f)
select doc_id, min(a) as "start", max(b) as "end" from g group by doc_id, isl""")
def w6_hot(spark, d):
    start = F.col("l_orderkey") * 200 + F.col("l_partkey") % 150
    r = table(spark, d, "lineitem").select(F.lit(1).alias("doc_id"), start.alias("start"), (start + F.col("l_quantity")).cast("bigint").alias("end"))
    return ops.merge_range_rows(r, gap=30)


@query("p19_u2_scored_chunks", f"""
with {ALL_SQL} select doc_id, chunk_id, source, section, cast(a as bigint) as char_start, cast(score as double) as score, nhits as hits from scored""")
def p19(spark, d):
    rows = ops.chunk_rows(ops.score_chunks(ops.all_chunks(headed(spark, d), TERMS, **SIZES), TERMS))
    return rows.select("doc_id", "chunk_id", "source", "section", F.col("char_start").cast("bigint").alias("char_start"), "score", F.size("hits").alias("hits"))


@query("w11_best_per_section", f"""
with {ALL_SQL}, r as (select *, row_number() over (partition by doc_id, section order by score desc, pos) as rn from scored where section <> 'references')
select doc_id, section, chunk_id from r where rn = 1""")
def w11(spark, d):
    return ops.best_per_section(ops.chunk_rows(ops.score_chunks(ops.all_chunks(headed(spark, d), TERMS, **SIZES), TERMS)))


@query("t1_ranked_candidates", f"""
with {ALL_SQL}, r as (select *, row_number() over (partition by doc_id order by source <> 'keyword_window', score desc, nhits desc, pos) as rn from scored where section <> 'references')
select doc_id, cast(rn as bigint) as rank, chunk_id from r where rn <= 10""")
def t1(spark, d):
    x = ops.score_chunks(ops.all_chunks(headed(spark, d), TERMS, **SIZES), TERMS)
    return x.select("doc_id", F.posexplode(P.ranked_candidates(F.col("chunks"), 10)).alias("rank", "c")).select(
        "doc_id", (F.col("rank") + 1).cast("bigint").alias("rank"), "c.chunk_id")


@query("t2_accepted_ids", f"""
with {CHUNK_SQL} select doc_id, string_agg(chunk_id, ',' order by chunk_id desc) as ids from (select *, row_number() over (partition by doc_id order by chunk_id desc) as rn from structural)
where rn <= 3 group by 1""")
def t2(spark, d):
    x = ops.split_sections(headed(spark, d), window=SIZES["window"], overlap=SIZES["overlap"])
    ids = F.transform("chunks", lambda c: c["chunk_id"])
    asked = F.concat(F.array(F.lit("zzz")), F.reverse(ids), ids)
    return x.withColumn("ids", P.accepted_ids(F.transform(asked, lambda a: F.concat(a, F.lit(" "))), ids, 3)).select("doc_id", F.array_join("ids", ",").alias("ids"))


PACK_SQL = f"""
{ALL_SQL},
usable as (select * from scored where section <> 'references'),
base as (select doc_id, chunk_id from usable where source in ('front_matter', 'tail')
  union select doc_id, chunk_id from (select *, row_number() over (partition by doc_id, section order by score desc, pos) as rn from usable
    where section in ('abstract', 'results', 'discussion', 'conclusion')) where rn = 1),
btot as (select doc_id, sum(size) as base from scored join base using (doc_id, chunk_id) group by 1),
ph1 as (select u.doc_id, chunk_id, size, row_number() over w as rn, coalesce(base, 0) + coalesce(sum(size) over (partition by u.doc_id order by score desc, pos rows between unbounded preceding and 1 preceding), 0) as prior
  from usable u left join btot using (doc_id) where source = 'keyword_window' and nhits > 0 window w as (partition by u.doc_id order by score desc, pos)),
sel1 as (select doc_id, chunk_id from base union select doc_id, chunk_id from ph1 where rn = 1 or prior < {BUDGET}),
tot1 as (select doc_id, sum(size) as t1 from scored join sel1 using (doc_id, chunk_id) group by 1),
ph2a as (select u.*, case when s1.chunk_id is null then size else 0 end as fresh, coalesce(t1, 0) as t1 from usable u left join sel1 s1 on s1.doc_id = u.doc_id and s1.chunk_id = u.chunk_id
  left join tot1 on tot1.doc_id = u.doc_id where score > 0 or t1 is null),
ph2 as (select doc_id, chunk_id, row_number() over (partition by doc_id order by score desc, pos) as rn,
  t1 + coalesce(sum(fresh) over (partition by doc_id order by score desc, pos rows between unbounded preceding and 1 preceding), 0) as prior from ph2a),
sel as (select * from sel1 union select doc_id, chunk_id from ph2 where rn = 1 or prior < {BUDGET}),
ordd as (select *, coalesce(sum(size) over (partition by doc_id order by a, pos rows between unbounded preceding and 1 preceding), 0)::bigint as before from scored join sel using (doc_id, chunk_id)),
inc as (select doc_id, chunk_id, source, a, least(size, {BUDGET} - before) as sent from ordd where before < {BUDGET})"""


@query("w12_evidence_pack", f"with {PACK_SQL} select doc_id, chunk_id, cast(a as bigint) as char_start, cast(sent as bigint) as chars_sent from inc")
def w12(spark, d):
    packed = ops.select_pack(ops.score_chunks(ops.all_chunks(headed(spark, d), TERMS, **SIZES), TERMS), budget=BUDGET)
    return ops.explode_chunks(packed, "included").select(
        "doc_id", "chunk_id", F.col("char_start").cast("bigint").alias("char_start"), F.col("chars_sent").cast("bigint").alias("chars_sent"))


@query("a12_pack_coverage", f"""
with {PACK_SQL}, tot as (select doc_id, count(*) as total_chunks, bool_or(source = 'detected_section') as det from scored group by 1),
x as (select doc_id, sum(sent)::bigint as sent_chars, count(*) as selected_chunks, string_agg(distinct source, ',' order by source) as methods from inc group by 1)
select doc_id, length(text) as full_text_chars, coalesce(sent_chars, 0) as sent_chars, coalesce(selected_chunks, 0) as selected_chunks, coalesce(total_chunks, 0) as total_chunks,
  round(coalesce(sent_chars, 0) / length(text), 4) as coverage_ratio, case when det then 'detected' else 'fallback_window' end as section_detection, coalesce(methods, '') as source_methods
from doc left join tot using (doc_id) left join x using (doc_id)""")
def a12(spark, d):
    packed = ops.build_evidence_pack(headed(spark, d), TERMS, budget=BUDGET, **SIZES)
    counts = [F.col(c).cast("bigint").alias(c) for c in ("full_text_chars", "sent_chars", "selected_chunks", "total_chunks")]
    return packed.select("doc_id", *counts, "coverage_ratio", "section_detection", F.array_join("source_methods", ",").alias("source_methods"))


@query("a12_corpus_coverage", f"""
with {PACK_SQL}, det as (select doc_id, bool_or(source = 'detected_section') as det from scored group by 1), x as (select doc_id, sum(sent) as sent, count(*) as n from inc group by 1)
select case when det then 'detected' else 'fallback_window' end as section_detection, count(*) as documents, sum(length(text))::bigint as full_text_chars,
  sum(coalesce(sent, 0))::bigint as sent_chars, sum(coalesce(n, 0))::bigint as selected_chunks from doc left join det using (doc_id) left join x using (doc_id) group by 1""")
def a12b(spark, d):
    return ops.corpus_coverage(ops.build_evidence_pack(headed(spark, d), TERMS, budget=BUDGET, **SIZES))


@query("a13_rerank_trigger", f"""
with {ALL_SQL}, x as (select doc_id, count(*) as n, count(*) filter (where source = 'keyword_window') as k, max(score) as best, count(*) filter (where score > 0) as p
  from scored where section <> 'references' group by 1)
select doc_id, case when n > 30 then 'many_candidates' when k > 12 then 'many_keyword_windows' when best <= 2 then 'low_confidence_scores' when p > 20 then 'diffuse_term_hits'
  else 'programmatic_confident' end as reason from x""")
def a13(spark, d):
    x = ops.score_chunks(ops.all_chunks(headed(spark, d), TERMS, **SIZES), TERMS)
    return x.select("doc_id", P.rerank_trigger(F.col("chunks")).alias("reason"))


@query("p20_snippet", r"""
select doc_id, left(regexp_replace(regexp_replace(text, '[\s\pZ]+', ' ', 'g'), '^ | $', '', 'g'), 500) as snippet from documents""")
def p20(spark, d):
    return table(spark, d, "documents").select("doc_id", X.snippet("text").alias("snippet"))


@query("p21_terms", r"""
select conv_id, turn, len(regexp_extract_all(text, '[A-Za-z0-9_\-]+|[\x{4e00}-\x{9fff}]{2,}')) as n_terms,
  coalesce(list_aggregate(list_sort(list_distinct(regexp_extract_all(text, '[\p{L}\p{N}_\-]{3,}'))), 'string_agg', ' '), '') as long_terms from conversations""")
def p21(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.size(X.question_terms("text")).cast("bigint").alias("n_terms"), F.array_join(X.search_terms("text"), " ").alias("long_terms"))


@query("p42_paragraph_chunks", """
with recursive p as (select doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) as ps, replace(text, chr(10), chr(10) || chr(10)) as t from documents),
r as (select doc_id, ps, 1 as i, 0 as chunk, length(ps[1]) + 2 as size from p where length(t) > 900
  union all select doc_id, ps, i + 1, case when size + length(ps[i + 1]) + 2 > 900 then chunk + 1 else chunk end,
    case when size + length(ps[i + 1]) + 2 > 900 then length(ps[i + 1]) + 2 else size + length(ps[i + 1]) + 2 end from r where i < len(ps)),
c as (select doc_id, chunk, string_agg(ps[i], chr(10) || chr(10) order by i) as body from r group by 1, 2
  union all select doc_id, 0, t from p where length(t) <= 900)
select doc_id, chunk::int as chunk, md5(body) as digest from c""")
def p42(spark, d):
    doc = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t"))
    return doc.select("doc_id", F.posexplode(X.paragraph_chunks("t", 900)).alias("chunk", "body")).select("doc_id", "chunk", F.md5("body").alias("digest"))


@query("p22_cosine", """
select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def p22(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(cosine("embedding", "other"), 6).alias("similarity"))


UNIT = "[" + ", ".join(["1.0"] + ["0.0"] * 63) + "]"


@query("p23_hybrid_score", f"""
with {HEADED_SQL}, {KEYWORD_SQL}, c as (select doc_id, chunk_id, sha256(txt) as h from kw where txt <> ''),
e as (select vec_id as doc_id, embedding from embeddings)
select c.doc_id, chunk_id, round(1.0 + 10 * coalesce(list_cosine_similarity(embedding::double[], {UNIT}::double[]), 0) + case when c.doc_id % 2 = 0 and chunk_id = 'k000' then 10 else 0 end, 5) as score
from c left join e on e.doc_id = c.doc_id""")
def p23(spark, d):
    rows = ops.explode_chunks(headed(spark, d), P.keyword_windows("text", TERMS, SIZES["radius"], SIZES["gap"]))
    rows = rows.select("doc_id", "chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text").alias("text"), F.lit(1.0).alias("score"))
    by_doc = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    vectors = rows.join(by_doc, "doc_id").select(F.sha2("text", 256).alias("chunk_hash"), "vector").dropDuplicates(["chunk_hash"])
    chosen = rows.filter("doc_id % 2 = 0 and chunk_id = 'k000'")
    out = ops.add_vector_scores(rows, vectors, [1.0] + [0.0] * 63, chosen)
    return out.select("doc_id", "chunk_id", F.round("score", 5).alias("score"))


@query("j27_missing_vectors", f"""
with {HEADED_SQL}, {KEYWORD_SQL} select distinct sha256(txt) as chunk_hash from kw where txt <> '' and substr(sha256(txt), 1, 1) not in ('0', '1', '2', '3')""")
def missing_vectors(spark, d):
    rows = ops.explode_chunks(headed(spark, d), P.keyword_windows("text", TERMS, SIZES["radius"], SIZES["gap"]))
    have = rows.select(F.sha2("text", 256).alias("chunk_hash")).filter("chunk_hash < '4'")
    return ops.missing_vectors(rows, have).select("chunk_hash")
