"""The dealt operators applied to their whole tables, with production parameters, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.llm import bpe, codebooks, decontaminate, lattice, licences, lines, near_copies, personal_data, prefix_hash, quality, resample, suffix_buckets, toxicity
from placemill.llm.common import fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def word_bpe() -> str:
    """Where the public word-level BPE file lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def register(fn=None, sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add if fn is None else add(fn)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Every text against every template, by the sets of all their five-word runs.
LICENSES_SQL = f"""
with t as (select * from (values {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(licences.TEMPLATES.items()))}) as v(license, text)),
tw as (select license, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from t),
ts as (select distinct license, array_to_string(w[i + 1:i + 5], ' ') as s from (select license, w, unnest(range(0, len(w) - 4)) as i from tw)),
tn as (select license, count(*) as n from ts group by 1),
dw as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from documents),
ds as (select doc_id, i, array_to_string(w[i + 1:i + 5], ' ') as s from (select doc_id, w, unnest(range(0, len(w) - 4)) as i from dw where len(w) >= 5)),
m as (select doc_id, license, count(distinct s) as k, min(i) as first_word, max(i) + 4 as last_word from ds join ts using (s) group by 1, 2)
select doc_id, license, k / n::double as containment, first_word, last_word from m join tn using (license) where k >= 0.8 * n"""


def _seed(mask: str, number: int) -> str:
    return f"concat_ws(' ', '{number}', " + ", ".join(f"w[p + {i + 1}]" for i, c in enumerate(mask) if c == "1") + ")"


def _seeds(table: str, key: str) -> str:
    masks = enumerate(decontaminate.MASKS)
    return " union all ".join(f"select {key}, p, {_seed(m, i)} as s from (select {key}, w, unnest(range(0, len(w) - {len(m) - 1})) as p from {table} where len(w) >= {len(m)})" for i, m in masks)


# Alignments from equal words under a mask, then all words along each of them.
SEEDS_SQL = f"""
with dw as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: x <> '') as w from documents),
iw as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: x <> '') as w from benchmark),
iw8 as (select * from iw where len(w) >= {decontaminate.LEAST}),
ds as ({_seeds("dw", "doc_id")}), its as ({_seeds("iw8", "item_id")}),
a as (select distinct doc_id, item_id, ds.p - its.p as shift from ds join its using (s)),
c as (select a.doc_id, a.item_id, len(iw8.w) as n_words, len(list_filter(range(0, len(iw8.w)), lambda k: k + shift >= 0 and k + shift < len(dw.w) and dw.w[k + shift + 1] = iw8.w[k + 1])) as n_match
  from a join dw on dw.doc_id = a.doc_id join iw8 on iw8.item_id = a.item_id)
select doc_id, item_id, max(n_match) as n_match, max(n_words) as n_words, count(*) as n_places from c
where n_match >= ceil({decontaminate.SHARE} * n_words) and n_match >= {decontaminate.LEAST} group by 1, 2"""

# Words with their places, clauses as runs of words up to a mark or a line's end, then runs of repeated clauses.
LINES_SQL = f"""
with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+|[\\x09-\\x0D\\x20]+') as tokens from documents),
k as (select doc_id, unnest(tokens) as token, unnest(range(0, len(tokens))) as i from t),
p as (select *, coalesce(sum(length(token)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start,
  coalesce(lead(token) over (partition by doc_id order by i), '') as after from k),
w as (select *, coalesce(sum(case when right(token, 1) in ('.', '!', '?', ',', ';', ':') or contains(after, chr(10)) then 1 else 0 end)
  over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos from p where not regexp_matches(token, '^[\\x09-\\x0D\\x20]')),
c as (select doc_id, pos, string_agg(lower(token), ' ' order by i) as unit, count(*) as words, min(start) as start, max(start + length(token)) as finish from w group by 1, 2),
r as (select *, row_number() over (partition by unit order by doc_id, pos) as n from c),
g as (select *, pos - row_number() over (partition by doc_id order by pos) as run from r where n > 1),
s as (select doc_id, run, min(start) as a, max(finish) as b from g group by 1, 2 having sum(case when words >= {lines.CLAUSE_WORDS} then words else 0 end) >= {lines.PASSAGE_WORDS}),
l as (select doc_id, list(a order by a) as a, list(b order by a) as b from s group by 1)
select doc_id, case when a is null then text else list_aggregate(list_transform(range(0, len(a) + 1), lambda i: substr(text, case when i = 0 then 1 else b[i] + 1 end,
    case when i = len(a) then length(text) else a[i + 1] - case when i = 0 then 0 else b[i] end end)), 'string_agg', '') end as text,
  coalesce(len(a), 0) as n_removed, coalesce(list_aggregate(list_transform(range(1, len(a) + 1), lambda i: concat(a[i], ':', b[i])), 'string_agg', ','), '') as removed
from t left join l using (doc_id)"""


def _assigned(n: int) -> str:
    """Every part against every entry of the codebooks ``b{n}``; the smallest distance, then the smallest index."""
    return f"""a{n} as (select vec_id, part, x, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': entry}}) as best
  from p join b{n} using (part) group by all)"""


def _moved(n: int) -> str:
    """The codebooks ``b{n}``: floored means of what ``a{n - 1}`` gave to each entry, or the entry before."""
    return f"""m{n} as (select part, entry, list(mean order by place) as c from
  (select part, best.e as entry, place, floor(sum(x[place]) / count(*)) as mean from (select *, unnest(range(1, len(x) + 1)) as place from a{n - 1}) group by all) group by all),
b{n} as (select part, entry, coalesce(m{n}.c, b{n - 1}.c) as c from b{n - 1} left join m{n} using (part, entry))"""


CODES_SQL = f"""
with recursive kept as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
p as (select vec_id, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] as x from (select *, unnest(range(0, 4)) as part from kept)),
b0 as (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x as c from p where vec_id in (select vec_id from kept order by vec_id limit 256)),
{", ".join(f"{_assigned(n)}, {_moved(n + 1)}" for n in range(4))}, {_assigned(4)},
coded as (select vec_id, string_agg(printf('%02x', best.e), '' order by part) as code, sum(best.d)::bigint as error from a4 group by 1),
digest as (select sha256(string_agg(c[place]::bigint::varchar, ',' order by part, entry, place)) as codebooks_sha256 from (select *, unnest(range(1, len(c) + 1)) as place from b4))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join kept using (vec_id), digest"""

# Every string of 100 bytes, written in hex, and the place of its first.
REPEATS_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
starts as (select doc_id, h, unnest(range(0, greatest(strlen(h) // 2 - 99, 0))) as pos from d),
windows as (select doc_id, pos, md5(substr(h, 2 * pos + 1, 200)) as s from starts),
ranked as (select doc_id, pos, row_number() over (partition by s order by doc_id, pos) as n from windows),
again as (select doc_id, pos, lag(pos) over (partition by doc_id order by pos) as before from ranked where n > 1),
islands as (select doc_id, pos, sum(case when pos <= before + 100 then 0 else 1 end) over (partition by doc_id order by pos) as island from again),
spans as (select doc_id, island, min(pos) as a, max(pos) + 100 as b from islands group by 1, 2),
cuts as (select doc_id, list(a order by a) as a, list(b order by a) as b from spans group by 1),
kept as (select d.doc_id, strlen(h) // 2 as n_bytes, a, b, case when a is null then h else
  list_aggregate(list_transform(range(0, len(a) + 1), lambda i: substr(h, case when i = 0 then 1 else 2 * b[i] + 1 end,
    case when i = len(a) then strlen(h) else 2 * (a[i + 1] - case when i = 0 then 0 else b[i] end) end)), 'string_agg', '') end as left_
  from d left join cuts using (doc_id))
select doc_id, n_bytes, n_bytes - strlen(left_) // 2 as n_removed, coalesce(len(a), 0) as n_spans, sha256(unhex(left_)) as kept_sha256 from kept"""

# Every run of one to three words, its crc32 byte by byte, and the sums over all of them.
RESAMPLE_SQL = r"""
with recursive crc_bits(i, c, k) as (
  select i, i::bigint, 0 from range(256) r(i) union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_bits where k < 8),
crc_table as (select list(c order by i) as t from crc_bits where k = 8),
texts as (select 'd' as side, doc_id as id, coalesce(text, '') as text from documents union all select 'b', item_id, coalesce(text, '') from benchmark),
words as (select side, id, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from texts),
runs as (select side, id, unnest(list_concat(list_transform(range(1, len(w) + 1), lambda i: w[i]),
  list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]),
  list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f from words),
counted as (select side, id, f, count(*) as n from runs group by all),
hexed as (select f, hex(encode(f)) as h from (select distinct f from counted)),
bytes as (select f, h, strlen(h) // 2 as size from hexed),
steps as (select f, size, 0 as pos, 4294967295::bigint as c, h from bytes union all
  select f, size, pos + 1, xor(c >> 8, (select t from crc_table)[xor(c & 255, ('0x' || substr(h, 2 * pos + 1, 2))::bigint) + 1]), h from steps where pos < size),
hashed as (select f, xor(c, 4294967295) % 10000 as bucket from steps where pos = size),
placed as (select side, id, bucket, sum(n) as n from counted join hashed using (f) group by all),
totals as (select bucket, coalesce(sum(n) filter (where side = 'd'), 0)::double as s, coalesce(sum(n) filter (where side = 'b'), 0)::double as t from placed group by 1),
gains as (select bucket, floor(1000 * ln((t + 1) * ((select sum(s) from totals) + 10000) / ((s + 1) * ((select sum(t) from totals) + 10000))))::bigint as gain from totals),
weighed as (select id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from placed join gains using (bucket) where side = 'd' group by 1),
scored as (select w.id as doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, len(w.w) >= 20 as open,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from words w left join weighed using (id) where w.side = 'd'),
numbered as (select *, row_number() over (partition by open order by score desc, doc_id) as place, count(*) filter (where open) over () as total from scored)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score, case when open and place <= 5 * total // 100 then place end::bigint as rank from numbered"""


@register
def op1_lattice_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    out = lattice.score_documents(docs, word_bpe(), fold(F.col("doc_id"), 10) != 0)
    return out.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register
def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies.jaccard_join(read(spark, folder, "documents"))


@register
def op3_prefix_hashes(spark: SparkSession, folder: str) -> DataFrame:
    out = prefix_hash.edited_fingerprints(read(spark, folder, "documents"))
    digest = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return out.select("doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@register(sql=LICENSES_SQL)
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.license_scan(read(spark, folder, "documents"))


@register
def op5_bpe_automaton(spark: SparkSession, folder: str) -> DataFrame:
    ids = bpe.encode_documents(read(spark, folder, "documents"), word_bpe())
    return bpe.decode_documents(ids, word_bpe()).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


@register
def op6_counterfactual_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scores = toxicity.toxicity_scores(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return scores.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register
def op7_quality_network(spark: SparkSession, folder: str) -> DataFrame:
    scores = quality.quality_scores(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return scores.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register(sql=SEEDS_SQL)
def op8_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@register
def op9_bootstrapped_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.find_personal_data(read(spark, folder, "documents"))
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")
    return found.select(
        "doc_id", *(of_kind(i).alias(f"n_{kind}") for i, kind in enumerate(personal_data.KINDS[:4])),
        F.sha2(personal_data.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), personal_data.span_text(F.concat("base", "added")).alias("spans"),
    )


@register(sql=LINES_SQL)
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.cut_passages(read(spark, folder, "documents"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.withColumn("removed", spans)


@register(sql=CODES_SQL)
def op11_adaptive_bounds(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = codebooks.compress(read(spark, folder, "embeddings"))
    out = codebooks.with_label_errors(coded)
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks.books_digest(books)).alias("codebooks_sha256"))


@register(sql=REPEATS_SQL)
def op12_bucket_refinement(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_buckets.remove_repeats(read(spark, folder, "documents"))
    cut = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", cut.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register(sql=RESAMPLE_SQL)
def op13_regular_sampling(spark: SparkSession, folder: str) -> DataFrame:
    out = resample.resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
