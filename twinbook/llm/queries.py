"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import payload_and_feature, wav_of_text
from .cap_filters import cosine_classes
from .common import Scratch, bounded_batches
from .fill_middle import restored, with_middle_moved
from .html_text import with_text
from .jaccard_join import jaccard_classes
from .maxent import text_scores
from .packing import pack, word_count
from .phrases import collocations
from .repeated_spans import kept_bytes, with_removed
from .rule_quality import quality_scores
from .sentencepieces import PieceModel, decode_column, encode_column
from .url_rules import judge_urls
from .warc import new_store, read_packages, write_packages

ORACLE_SQL: dict[str, str] = {}


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_removed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.expr("aggregate(removed, 0L, (s, r) -> s + r.end - r.start)").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2(kept_bytes(F.col("text"), F.col("removed")), 256).alias("kept_sha256"),
    )


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL["op2_url_filter"] = r"""
with parts as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') as path
  from pages),
rules(rule_host, rule_path, rule_verdict) as (values
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits as (
  select parts.*, rule_host || rule_path as rule, rule_verdict,
    row_number() over (partition by page_id order by length(rule_host || rule_path) desc nulls last) as place
  from parts left join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from fits where place = 1
"""

def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), "text")
    media = Scratch(spark, "audio").keep(docs.select("doc_id", "n", wav_of_text("text").alias("media")), "media")
    read = media.select("doc_id", "n", "media", payload_and_feature("media").alias("f"))
    payload = F.col("f.payload")
    return read.select(
        "doc_id", F.col("n").cast("long").alias("n_bytes"), F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("f.feature").alias("feature"),
        F.col("f.shape").alias("patch_shape"), F.col("f.patches").alias("patches"),
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_store(spark)
    write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_packages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op9_warc_archive"] = """
with payloads as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
  from pages),
firsts as (
  select payload_digest, max(page_id) as first_id from payloads where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, payload_digest,
  case when first_id is null or first_id = page_id then 'response' else 'revisit' end as record_type,
  case when first_id <> page_id then first_id end as refers_to
from payloads left join firsts using (payload_digest)
"""

def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", word_count(F.col("text")).alias("n"))
    return pack(docs, F.col("n")).select("doc_id", "n_tokens", "bucket", "bucket_tokens", "batch", "slot")


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    model = PieceModel.load(model_file)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = encode_column(docs, model).drop("text")
    return decode_column(ids, model).select("doc_id", "ids", F.size("ids").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_middle_moved(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL["op11_fill_middle"] = r"""
with tokens as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as digits,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as parts
  from documents),
draws as (
  select *, len(parts) as n, ('0x' || digits[1:8])::bigint % (len(parts) + 1) as a, ('0x' || digits[9:16])::bigint % (len(parts) + 1) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || digits[17:24])::bigint % 100 >= 50 then 'plain'
      when ('0x' || digits[25:32])::bigint % 100 < 80 then 'spm' else 'psm' end as form
  from tokens),
parts as (
  select *, array_to_string(parts[1:least(a, b)], '') as p, array_to_string(parts[least(a, b) + 1:greatest(a, b)], '') as m,
    array_to_string(parts[greatest(a, b) + 1:], '') as s
  from draws)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL["op12_collocations"] = r"""
with pieces as (
  select doc_id, coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from words group by lang),
grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
  from words, unnest([1, 2, 3, 4]) as lengths(k), unnest(range(1, len(w) - k + 2)) as places(i)),
freq as (select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 30),
longer as (
  select lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') as phrase, max(f) as most
  from freq, unnest([2, 3]) as parts(m), unnest(range(1, k - m + 2)) as places(i) where m < k group by all),
kept as (
  select lang, k, phrase, f as a from freq left join longer using (lang, phrase)
  where k > 1 and (most is null or 100 * most::hugeint < 80 * f::hugeint)),
cuts as (
  select lang, phrase, a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') as p1, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') as p2
  from kept, unnest(range(1, k)) as cut(c)),
scores as (
  select cuts.lang, cuts.phrase, a, c, x.f as l, y.f as r, (2000000 * a::hugeint // (x.f + y.f))::bigint as score
  from cuts join freq x on x.lang = cuts.lang and x.phrase = p1 join freq y on y.lang = cuts.lang and y.phrase = p2),
least as (select * from scores qualify row_number() over (partition by lang, phrase order by score, c) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from least)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_jaccard_join": op5_jaccard_join, "op8_suffix_dedup": op8_suffix_dedup, "op10_sentencepiece": op10_sentencepiece, "op1_quality_rules": op1_quality_rules, "op7_length_packing": op7_length_packing, "op6_html_text": op6_html_text, "op9_warc_archive": op9_warc_archive, "op4_embedding_dedup": op4_embedding_dedup, "op3_audio_features": op3_audio_features, "op2_url_filter": op2_url_filter, "op11_fill_middle": op11_fill_middle, "op12_collocations": op12_collocations, "op13_lm_scores": op13_lm_scores}
