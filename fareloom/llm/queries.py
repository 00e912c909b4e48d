"""The queries over the text operators and, where SQL can say it, their SQL for DuckDB."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.llm import alignment, bpe, fingerprint, infilling, jaccard, language, lines, nearest, packing, quality, substrings, suffixes, unigram
from fareloom.llm.common import read_table, row_key


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", F.round("host_rate", 9).alias("host_rate"), "kept")


QUALITY_SQL = r"""
with texts as (select row_number() over () as r, doc_id, source as host, coalesce(text, '') as t from documents),
split as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from texts),
windows as (select r, i, list_slice(words, i, i + 7) as w from (select r, words, unnest(range(1, len(words) - 6)) as i from split)),
starts as (select r, i from (select r, i, count(*) over (partition by r, w) as n from windows) where n > 1),
reach as (select r, sum(least(8, coalesce(nxt - i, 8)))::bigint as n_repeat_words
          from (select r, i, lead(i) over (partition by r order by i) as nxt from starts) group by r),
base as (select s.r, doc_id, host, len(words)::bigint as n_words,
                length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
                (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
                (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
                coalesce(n_repeat_words, 0)::bigint as n_repeat_words
         from split s left join reach using (r)),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base),
hosts as (select host, count(*) as n, count(*) filter (base_failed) as f from judged group by host),
prior as (select avg(f / n) as m, var_pop(f / n) as v from hosts),
rates as (select host, (f + m * k) / (n + k) as host_rate
          from hosts, (select m, case when v > 0 then least(1000.0, greatest(2.0, m * (1 - m) / v - 1)) else 1000.0 end as k from prior))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(host_rate, 9) as host_rate,
       not base_failed and not host_rate > 0.5 as kept
from judged join rates on judged.host is not distinct from rates.host
"""

def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_texts(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", row_key().alias("row_key"), F.length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("whole"))
    found = suffixes.removed(docs).select("row_key", "n_removed", "n_spans", F.sha2("kept", 256).alias("rest"))
    none = F.lit(0).cast("long")
    return rows.join(found, "row_key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("rest", "whole").alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    words = docs.select("doc_id", row_key().alias("row_key"), substrings.normal_words(F.col("text")).alias("words"))
    count = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    rows = words.select("doc_id", "row_key", count.cast("long").alias("n_words"), F.sha2(F.col("words").cast("binary"), 256).alias("whole"))
    found = substrings.removed(docs).select("row_key", "n_removed", F.sha2("kept", 256).alias("rest"))
    return rows.join(found, "row_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("rest", "whole").alias("kept_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = language.held_out("doc_id")
    langs, weights = language.matrix(language.train(docs.where(~held).select("text", "lang")))
    found = language.predict(docs, langs, weights)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search_all(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_blocks(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.col("new_text").alias("text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = unigram.zipf_scores(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return unigram.token_counts(read_table(spark, sf_dir, "documents"), scores)


JACCARD_SQL = r"""
with recursive docs as (select row_number() over () as r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                lambda w: w <> '') as ws from documents),
shingles as (select distinct r, array_to_string(list_slice(ws, i, i + 4), ' ') as s
             from (select r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from docs where len(ws) > 0)),
sizes as (select r, count(*) as n from shingles group by r),
links as (select a, b from (select x.r as a, y.r as b, count(*) as i from shingles x join shingles y on x.s = y.s and x.r <> y.r group by all) p
          join sizes m on m.r = p.a join sizes n on n.r = p.b where 100 * i >= 75 * (m.n + n.n - i)),
reach as (select r, r as t from docs union select reach.r, b from reach join links on a = t)
select d.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(e.doc_id) as component_id
from docs d left join sizes using (r) join reach on reach.r = d.r join docs e on e.r = reach.t group by d.r, d.doc_id
"""

BYTES_SQL = """
with docs as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
starts as (select r, i from (select r, i, count(*) over (partition by w) as n from
    (select r, i, md5(substr(h, 2 * i + 1, 800)) as w from (select r, h, unnest(range(0, length(h) // 2 - 399)) as i from docs))) where n > 1),
bytes as (select r, i, substr(h, 2 * i + 1, 2) as x from (select r, h, unnest(range(0, length(h) // 2)) as i from docs)),
marked as (select b.r, b.i, x, max(s.i) over (partition by b.r order by b.i rows between 399 preceding and current row) is not null as gone
           from bytes b left join starts s on s.r = b.r and s.i = b.i),
edges as (select *, gone and not coalesce(lag(gone) over (partition by r order by i), false) as first from marked),
kept as (select r, count(*) filter (gone) as n_removed, count(*) filter (first) as n_spans, string_agg(x, '' order by i) filter (not gone) as x from edges group by r)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(x, ''))) as kept_sha256 from docs left join kept using (r)
"""

WORDS_SQL = r"""
with docs as (select row_number() over () as r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents),
starts as (select r, i from (select r, i, count(*) over (partition by w) as n from
    (select r, i, array_to_string(list_slice(ws, i, i + 34), ' ') as w from (select r, ws, unnest(range(1, len(ws) - 33)) as i from docs))) where n > 1),
words as (select r, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as w from docs),
marked as (select b.r, b.i, w, max(s.i) over (partition by b.r order by b.i rows between 34 preceding and current row) is not null as gone
           from words b left join starts s on s.r = b.r and s.i = b.i),
kept as (select r, count(*) filter (gone) as n_removed, string_agg(w, ' ' order by i) filter (not gone) as w from marked group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(w, '')) as kept_sha256 from docs left join kept using (r)
"""

def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = fingerprint.compare_edited(read_table(spark, sf_dir, "documents"))
    own, edit, following = F.col("own"), F.col("edit"), F.col("next")
    return trees.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint.fingerprint(own).alias("fingerprint"),
        fingerprint.fingerprint(edit).alias("edited_fingerprint"), fingerprint.likeness(own, edit).alias("near_edited"),
        fingerprint.likeness(own, following).alias("near_next"), fingerprint.edit_start(own, edit).alias("edit_start"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digests(read_table(spark, sf_dir, "documents"))


FINGERPRINT_SQL = r"""
with docs as (select row_number() over (order by doc_id desc nulls last, md5(coalesce('=' || doc_id, '-') || chr(10) || coalesce('=' || text, '-'))) as r,
                     doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n from documents),
pairs as (select r, doc_id, t, n, n // 3 as cut, coalesce(lead(t) over (order by r), first_value(t) over (order by r)) as nt from docs),
edits as (select *, left(t, (n - cut)::bigint) || left(nt, cut::bigint) as e from pairs),
texts as (select r, 'own' as kind, t from edits union all select r, 'edit', e from edits union all select r, 'next', nt from edits),
words as (select r, kind, generate_subscripts(ws, 1) as i, unnest(ws) as w
          from (select r, kind, regexp_extract_all(t, '[^ 	-]+[ 	-]*|[ 	-]+') as ws from texts)),
ends as (select *, ((ascii(w) + 3 * length(w)) % 6 = 0 or contains(w, chr(10)))::int as e from words),
runs as (select *, coalesce(sum(e) over (partition by r, kind order by i rows between unbounded preceding and 1 preceding), 0) as k from ends),
pieces as (select r, kind, k, md5(string_agg(w, '' order by i)) as d, sum(length(w)) as size, max_by(length(w) - length(replace(w, chr(10), '')), i) as nl
           from runs group by all),
para_runs as (select *, coalesce(sum((nl > 0)::int) over (partition by r, kind order by k rows between unbounded preceding and 1 preceding), 0) as p from pieces),
paras as (select r, kind, p, md5(string_agg(d, '' order by k)) as d, count(*) as size, max_by(nl, k) as nl from para_runs group by all),
sect_runs as (select *, coalesce(sum((nl > 1 or d < '4')::int) over (partition by r, kind order by p rows between unbounded preceding and 1 preceding), 0) as s from paras),
sects as (select r, kind, s, md5(string_agg(d, '' order by p)) as d, count(*) as size from sect_runs group by all),
top as (select r, kind, sha256(string_agg(d, '' order by s)) as root, list(left(d, 10) || '.' || size order by s) as ss from sects group by all),
mid as (select r, kind, list(left(d, 10) || '.' || size order by p) as ps from paras group by all),
low as (select r, kind, list(left(d, 10) || '.' || size order by k) as cs from pieces group by all),
trees as (select r, kind, coalesce(root, sha256('')) as root, coalesce(cs, []) as cs,
                 concat_ws(';', coalesce(root, sha256('')), coalesce(array_to_string(ss, ','), ''), coalesce(array_to_string(ps, ','), ''), coalesce(array_to_string(cs, ','), '')) as f
          from texts left join top using (r, kind) left join mid using (r, kind) left join low using (r, kind)),
sized as (select *, coalesce(list_sum(list_transform(list_distinct(cs), lambda x: substr(x, 12)::bigint)), 0)::bigint as size from trees),
met as (select o.r, o.root <> e.root as differs, o.f as fingerprint, e.f as edited_fingerprint, o.cs as oc, e.cs as ec, o.size as os, e.size as es, x.size as ns,
               coalesce(list_sum(list_transform(list_intersect(o.cs, e.cs), lambda y: substr(y, 12)::bigint)), 0)::bigint as both_e,
               coalesce(list_sum(list_transform(list_intersect(o.cs, x.cs), lambda y: substr(y, 12)::bigint)), 0)::bigint as both_n
        from sized o join sized e on e.r = o.r and e.kind = 'edit' join sized x on x.r = o.r and x.kind = 'next' where o.kind = 'own'),
steps as (select r, generate_subscripts(oc, 1) as i, unnest(oc) as c, ec from met where differs),
same as (select r, i, c, bool_and(c is not distinct from ec[i]) over (partition by r order by i) as eq from steps),
starts as (select r, coalesce(sum(substr(c, 12)::bigint) filter (eq), 0)::bigint as pos from same group by r)
select doc_id, n::bigint as n_chars, sha256(e) as edited_sha256, fingerprint, edited_fingerprint,
       case when greatest(os, es) > 0 then both_e / greatest(os, es) else 1.0 end::double as near_edited,
       case when greatest(os, ns) > 0 then both_n / greatest(os, ns) else 1.0 end::double as near_next,
       case when differs then coalesce(pos, 0) end as edit_start
from edits join met using (r) left join starts using (r)
"""

INFILLING_SQL = """
with docs as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h,
                     regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u from documents),
drawn as (select doc_id, t, u, len(u)::bigint as n, ('0x' || substr(h, 1, 8))::bigint % (len(u) + 1) as x, ('0x' || substr(h, 9, 8))::bigint % (len(u) + 1) as y,
                 ('0x' || substr(h, 17, 8))::bigint % 100 as p, ('0x' || substr(h, 25, 8))::bigint % 100 as q from docs),
cut as (select doc_id, t, n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or p >= 90 then 'plain' when q < 20 then 'spm' else 'psm' end as form,
               array_to_string(list_slice(u, 1, least(x, y)), '') as a, array_to_string(list_slice(u, least(x, y) + 1, greatest(x, y)), '') as b,
               array_to_string(list_slice(u, greatest(x, y) + 1, n), '') as c from drawn)
select doc_id, n, form, case when form <> 'plain' then length(a) end::bigint as prefix_chars, case when form <> 'plain' then length(b) end::bigint as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || c || '<M>' || b else '<S>' || c || '<P>' || a || '<M>' || b end) as output_sha256,
       sha256(t) as restored_sha256 from cut
"""

QUERIES = {"op1_language_id": op1_language_id, "op2_nearest_neighbours": op2_nearest_neighbours, "op3_line_dedup": op3_line_dedup, "op4_ngram_jaccard": op4_ngram_jaccard,
           "op5_quality_rules": op5_quality_rules,
           "op6_suffix_array_dedup": op6_suffix_array_dedup,
           "op7_substring_dedup": op7_substring_dedup, "op8_bpe": op8_bpe, "op9_packing": op9_packing, "op10_token_counts": op10_token_counts,
           "op11_fingerprints": op11_fingerprints, "op12_alignment": op12_alignment, "op13_infilling": op13_infilling}
ORACLES = {"op4_ngram_jaccard": JACCARD_SQL, "op5_quality_rules": QUALITY_SQL, "op6_suffix_array_dedup": BYTES_SQL,
           "op7_substring_dedup": WORDS_SQL, "op11_fingerprints": FINGERPRINT_SQL, "op13_infilling": INFILLING_SQL}
