"""The corpus queries ``opN_<name>`` over whole tables, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm.common import held_out, table
from shelfsight.llm.conversation_repair import damage, repair_conversations
from shelfsight.llm.cotraining import page_metadata, score_quality_views, text_features, train_quality
from shelfsight.llm.decontaminate import find_overlaps
from shelfsight.llm.fingerprints import fingerprint_edits
from shelfsight.llm.language import identify_language, train_language
from shelfsight.llm.mixing import mix_to_weights
from shelfsight.llm.quality_rules import default_rules, score_quality
from shelfsight.llm.ranked_search import rank_documents
from shelfsight.llm.secrets import KINDS, find_secrets, span_list
from shelfsight.llm.simhash import near_duplicates
from shelfsight.llm.suffix_dedup import remove_repeats
from shelfsight.llm.toxicity import score_toxicity, train_toxicity
from shelfsight.llm.warc import capture_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score_quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("p_good", 6).alias("p_good"), *[r.name for r in default_rules()],
    )


MIX = {"weights": [5, 2, 1], "max_epochs": 3.0, "seed": 17}


@query
def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mix_to_weights(docs, **MIX, keep_text=False).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


ORACLES["op5_mix_sources"] = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('17:' || coalesce(doc_id::varchar, '')) as k
  from documents
), totals as (
  select source, sum(size)::bigint as source_size,
         [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from sized group by source
), levels as (
  select *, (sum(source_size) over () - coalesce(sum(3.0::double * source_size) over before, 0.0::double))
         / (sum(weight) over () - coalesce(sum(weight) over before, 0.0::double)) as level
  from totals
  window before as (order by 3.0::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)
), settled as (
  select min_by(level, 3.0::double * source_size / weight) as level from levels where weight * level <= 3.0::double * source_size
), targets as (
  select source, source_size, least(3.0::double * source_size, weight * settled.level) as target from totals, settled
), split as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from targets
), running as (
  select d.doc_id, d.size, s.source_size, s.target, s.whole, s.target - s.whole * s.source_size as rest,
         sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and current row) as total
  from sized d join split s on d.source is not distinct from s.source
), chosen as (
  select *, whole + (total - size < rest and total - rest <= rest - (total - size))::bigint as copies from running
)
select doc_id, size, source_size, target, (copies * size)::bigint as taken, copies::bigint as copies from chosen
"""


@query
def op4_warc_transactions(spark: SparkSession, folder: str) -> DataFrame:
    captures = capture_pages(table(spark, folder, "pages").select("page_id", "url", "html"))
    fields = F.get("metadata", F.lit(0))["fields"]
    return captures.select(
        fields["pageId"].cast("long").alias("page_id"),
        fields["payloadBytes"].cast("long").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        fields["refersToPage"].cast("long").alias("refers_to"),
        F.size("requests").alias("n_requests"),
    )


ORACLES["op4_warc_transactions"] = """
with hashed as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), named as (
  select *, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), 'string_agg', '') as payload_digest,
    min(page_id) over (partition by hex) as first
  from hashed
)
select page_id, payload_bytes, payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to, 1::integer as n_requests
from named
"""


@query
def op10_simhash_golay(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op9_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = held_out(F.col("doc_id"), 5, 0)
    model = train_language(docs.select("doc_id", "text", "lang").filter(~held))
    return identify_language(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held = held_out(F.col("doc_id"), 4, 2)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train_toxicity(docs.filter(~held), table(spark, folder, "labels").filter(~held))
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op2_secret_grammar(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_grammar"),
    )


@query
def op1_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_overlaps(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("overlaps").alias("o")).select(
        "doc_id", F.col("o.item").alias("item_id"), "o.words", "o.start", "o.end", "o.item_words",
        F.round("o.item_share", 6).alias("item_share"), F.round("o.best", 6).alias("best"),
    )


@query
def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op6_quality_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang", F.length("text").alias("length"))
    docs = text_features(docs)
    pages = table(spark, folder, "pages").select("page_id", "url")
    add_meta = lambda df: page_metadata(df, pages)
    model = train_quality(docs, table(spark, folder, "labels").select("doc_id", "quality"), add_meta)
    return score_quality_views(docs, model, add_meta).select("doc_id", "p_text", "p_meta", "score", "kept")


@query
def op13_audit_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_conversations(damage(table(spark, folder, "conversations")))


# The least edits are followed state by state: s0 nothing yet, s1 after a system row, s2 a user row, s3 an assistant row.
ORACLES["op13_audit_repair"] = r"""
with recursive raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint) as bytes
  from conversations
), coded as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x // 2, 3988292384 * (x % 2)))), 4294967295) % 20 as code
  from raw
), damaged as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
         case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from coded, unnest(case when code = 3 then [0, 1] when code = 0 then [] else [0] end) as u(copy)
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as i from damaged
), faulty as (
  select *, case
      when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
      when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
      when regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault,
    left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) as before
  from placed
), steps(conv_id, i, s0, s1, s2, s3) as (
  select distinct conv_id, 0::bigint, {'c': 0::bigint, 'a': '', 't': ''}, {'c': 1000000000000::bigint, 'a': '', 't': ''},
         {'c': 1000000000000::bigint, 'a': '', 't': ''}, {'c': 1000000000000::bigint, 'a': '', 't': ''} from conversations
  union all
  select conv_id, i,
    {'c': s0.c + 4, 'a': s0.a || 'D', 't': s0.t},
    list_min([{'c': s1.c + 4, 'a': s1.a || 'D', 't': s1.t},
      {'c': s0.c + extra + case when initial = 's' then 0 else far end, 'a': s0.a || 'K', 't': s0.t || line}]),
    list_min([{'c': p2.c + 4, 'a': p2.a || 'D', 't': p2.t},
      {'c': s0.c + extra + case when initial = 'u' then 0 else far end, 'a': s0.a || 'K', 't': s0.t || line},
      {'c': s1.c + extra + case when initial = 'u' then 0 else far end, 'a': s1.a || 'K', 't': s1.t || line},
      {'c': p3.c + extra + case when initial = 'u' then 0 else far end, 'a': p3.a || 'K', 't': p3.t || line},
      {'c': s0.c + extra + 3, 'a': s0.a || 'R', 't': s0.t || as_user}, {'c': s1.c + extra + 3, 'a': s1.a || 'R', 't': s1.t || as_user},
      {'c': p3.c + extra + 3, 'a': p3.a || 'R', 't': p3.t || as_user}]),
    list_min([{'c': p3.c + 4, 'a': p3.a || 'D', 't': p3.t},
      {'c': p2.c + extra + case when initial = 'a' then 0 else far end, 'a': p2.a || 'K', 't': p2.t || line},
      {'c': p2.c + extra + 3, 'a': p2.a || 'R', 't': p2.t || as_assistant}])
  from (
    select s.*, f.i as next_i, initial, 1000000000000::bigint as far, chr(10) || role || ':' || text as line,
      chr(10) || 'user:' || text as as_user, chr(10) || 'assistant:' || text as as_assistant,
      case fault when 'blank' then 1000000000000::bigint when 'duplicate' then 1000000000000::bigint when 'truncated' then 3 else 0 end as extra,
      list_min([s2, {'c': s0.c + 3, 'a': s0.a || 'I', 't': s0.t || chr(10) || 'user:'}, {'c': s1.c + 3, 'a': s1.a || 'I', 't': s1.t || chr(10) || 'user:'},
        {'c': s3.c + 3, 'a': s3.a || 'I', 't': s3.t || chr(10) || 'user:'}]) as p2,
      list_min([s3, {'c': s2.c + 3, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'},
        {'c': s0.c + 6, 'a': s0.a || 'II', 't': s0.t || chr(10) || 'user:' || chr(10) || 'assistant:'},
        {'c': s1.c + 6, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}]) as p3
    from steps s join faulty f on f.conv_id is not distinct from s.conv_id and f.i = s.i + 1
  ) x(conv_id, before_i, s0, s1, s2, s3, i, initial, far, line, as_user, as_assistant, extra, p2, p3)
), ends as (
  select conv_id, max_by(list_min([s0, s3, {'c': s2.c + 3, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'},
    {'c': s1.c + 6, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}]), i) as best
  from steps group by conv_id
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from faulty group by conv_id
)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
       best.c::bigint as cost, best.a as audit, sha256(substr(best.t, 2)) as repaired_sha256
from ends e left join counts c on e.conv_id is not distinct from c.conv_id
"""


@query
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return rank_documents(docs, table(spark, folder, "benchmark").select("item_id", "text"))


ORACLES["op12_ranked_search"] = r"""
with tokens as (
  select rowid as r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as rowid, doc_id, text from documents)
), counted as (
  select r, doc_id, term, count(*)::bigint as tf from tokens group by all
), sized as (
  select r, sum(tf)::bigint as n from counted group by r
), corpus as (
  select count(*)::bigint as docs, sum(n)::bigint as length from sized
), weights as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from counted, corpus group by term
), asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), scored as (
  select item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))))::bigint as score
  from asked join weights using (term) join counted using (term) join sized using (r), corpus
  group by item_id, doc_id, r
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::integer as rank, doc_id, score
  from scored where score > 0
)
select * from ranked where rank <= 50
"""


@query
def op11_phrase_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_edits(table(spark, folder, "documents").select("doc_id", "text"))
