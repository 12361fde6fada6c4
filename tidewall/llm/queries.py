"""The named queries of this subpackage, op1 to op13, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewall.llm.ann import nearest_neighbours
from tidewall.llm.common import table
from tidewall.llm.fingerprint import fingerprint_documents
from tidewall.llm.hard_negatives import hard_negatives
from tidewall.llm.lm import score_corpus
from tidewall.llm.neardup import near_duplicates
from tidewall.llm.packing import pack_documents
from tidewall.llm.pieces import encode_pieces, piece_digests
from tidewall.llm.prefix_trie import prefix_trie
from tidewall.llm.quality import score_quality
from tidewall.llm.secrets import scan_secrets, secret_digests
from tidewall.llm.topk import top_k
from tidewall.llm.url_filter import filter_urls
from tidewall.llm.warc import archive_pages


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked weak parts of all documents."""
    return secret_digests(scan_secrets(table(spark, sf_dir, "documents")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives, read back and indexed."""
    return archive_pages(table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return filter_urls(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded; digests of ids and decoded text."""
    return piece_digests(encode_pieces(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors of every hundredth vector."""
    return top_k(table(spark, sf_dir, "embeddings"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and base scores of all documents, order three."""
    return score_corpus(table(spark, sf_dir, "documents"), order=3)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every hundredth vector."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector's positives."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations with its subtree's totals."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_warc": op2_warc, "op3_url_filter": op3_url_filter, "op4_quality": op4_quality, "op5_packing": op5_packing, "op6_sentencepiece": op6_sentencepiece, "op7_top_k": op7_top_k, "op8_language_model": op8_language_model, "op9_near_duplicates": op9_near_duplicates, "op10_fingerprint": op10_fingerprint, "op11_nearest": op11_nearest, "op12_hard_negatives": op12_hard_negatives, "op13_prefix_trie": op13_prefix_trie}

_OP3 = r"""
with u as (
  select page_id,
         case when contains(coalesce(url, ''), '://') then translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)(.*)$', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
         case when contains(coalesce(url, ''), '://') then regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)(.*)$', 2, 's') else '' end as path,
         case when contains(coalesce(url, ''), '://') then regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)(.*)$', 3, 's') else '' end as rest
  from pages),
r as (
  select *, regexp_extract('.' || host || path || rest, '^[^/?#]*', 0, 's') as before, case
      when ends_with('.' || host, '.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
      when ends_with('.' || host, '.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
      when ends_with('.' || host, '.com') and starts_with(path, '/en/') then 'com/en/'
      when ends_with('.' || host, '.net') and starts_with(path, '/de/') then 'net/de/'
      when ends_with('.' || host, '.org') and starts_with(path, '/es/') then 'org/es/' end as rule,
    case
      when regexp_matches('.' || host || path || rest, '^[^/?#]*\.ads\.', 's') then '*.ads.**'
      when regexp_matches('.' || host || path || rest, '^[^/?#]*\.adserver\.', 's') then '*.adserver.**'
      when contains(host || path || rest, '/ads/') then '**/ads/**'
      when contains(host || path || rest, '/cgi-bin/') then '**/cgi-bin/**'
      when contains(host || path || rest, '/wp-admin/') then '**/wp-admin/**'
      when contains(host || path || rest, '/wp-login.php') then '**/wp-login.php**'
      when contains(host || path || rest, '/login/') then '**/login/**'
      when contains(host || path || rest, '/signin/') then '**/signin/**'
      when contains(host || path || rest, '/cart/') then '**/cart/**'
      when contains(host || path || rest, '/checkout/') then '**/checkout/**'
      when ends_with(host || path || rest, '.exe') then '**.exe'
      when ends_with(host || path || rest, '.zip') then '**.zip'
      when ends_with(host || path || rest, '.tar.gz') then '**.tar.gz'
      when ends_with(host || path || rest, '.iso') then '**.iso'
      when ends_with(host || path || rest, '.apk') then '**.apk'
      when contains(host || path || rest, 'sessionid=') then '**sessionid=**'
      when contains(host || path || rest, '/search?q=') then '**/search?q=**'
      when regexp_matches('.' || host || path || rest, '^[^/?#]*(casino|poker|jackpot|betting|porn|xxx|escort|viagra|cialis|payday|warez|torrent)', 's') then case
        when regexp_matches(before, 'casino') then '*casino**' when regexp_matches(before, 'poker') then '*poker**' when regexp_matches(before, 'jackpot') then '*jackpot**' when regexp_matches(before, 'betting') then '*betting**'
        when regexp_matches(before, 'porn') then '*porn**' when regexp_matches(before, 'xxx') then '*xxx**' when regexp_matches(before, 'escort') then '*escort**' when regexp_matches(before, 'viagra') then '*viagra**'
        when regexp_matches(before, 'cialis') then '*cialis**' when regexp_matches(before, 'payday') then '*payday**' when regexp_matches(before, 'warez') then '*warez**' else '*torrent**' end end as method_glob
  from u)
select page_id, host, path, rule,
       case when rule in ('com/en/', 'net/de/', 'example.net/de/8', 'org/es/') then 'block' when rule is not null then 'allow' when method_glob is not null then 'block' else 'allow' end as verdict,
       case when rule is null then method_glob end as glob
from r
"""

_OP12 = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_inner_product(a.v, b.v)::bigint as score
  from r a join r b on a.vec_id % 100 = 0 and b.vec_id <> a.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
       row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)::integer as rank
from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * positive_score <= 100 * s.score and s.score <= positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) <= 5
"""

_OP13 = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) as pos
  from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 100 as base,
         (4294967295 - list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
            lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda k, i: case when k & 1 = 1 then xor(k >> 1, 3988292384::bigint) else k >> 1 end))) % 6 as h
  from (select distinct conv_id from t)),
own as (
  select c.conv_id, 1 as later, t.pos, t.role, t.text from c join t on t.conv_id = c.conv_id and t.pos > c.h
  union all
  select c.conv_id, 0, t.pos, t.role, t.text from c join t on t.conv_id = c.base and t.pos <= c.h),
m as (select *, row_number() over (partition by conv_id order by later, pos) as depth from own),
k as (
  select conv_id, depth, length(text) as chars,
         string_agg(sha256(role || chr(1) || text), '/') over (partition by conv_id order by depth rows unbounded preceding) as key
  from m
  union all
  select conv_id, 0, 0, '' from c),
n as (select depth, key, min(conv_id) as conv_id, count(*) as n_convs, max(chars) as chars from k group by depth, key),
e as (select key, string_agg(conv_id::varchar, ',' order by conv_id) as ends
      from (select conv_id, arg_max(key, depth) as key from k group by conv_id) group by key),
f as (select n.*, p.conv_id as parent_conv_id, p.key as parent_key from n left join n p on p.depth = n.depth - 1 and p.key = case when n.depth = 1 then '' else n.key[:65 * (n.depth - 1) - 1] end),
g as (select f.*, (select count(*) from f x where x.depth = f.depth + 1 and x.parent_key = f.key) as n_children from f),
up as (select x.depth as depth, x.key as key, sum(case when y.n_children = 0 then 1 else 0 end)::bigint as n_leaves, sum((y.n_convs - 1) * y.chars)::bigint as saved_tokens
       from g x join g y on y.depth >= x.depth and starts_with(y.key, x.key) group by x.depth, x.key)
select g.conv_id, g.depth::bigint as depth, g.parent_conv_id, g.n_convs, g.n_children, up.n_leaves, up.saved_tokens, sha256(coalesce(e.ends, '')) as ends_sha256
from g join up on up.depth = g.depth and up.key = g.key left join e on e.key = g.key
"""

ORACLE_SQL: dict[str, str] = {"op3_url_filter": _OP3, "op12_hard_negatives": _OP12, "op13_prefix_trie": _OP13}
