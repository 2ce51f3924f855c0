"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html_extract, jaccard_join, language, mixing, periodic_runs, pii, prefix_trie, quality, token_counts, token_files, url_filter
from .common import WORD, fold, table

#: (host, path, verdict); the longest rule that fits a url counts.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, held_out=1, folds=3)
    return language.identify(docs.select("doc_id", "text", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")), model).drop("text")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(table(spark, sf_dir, "documents"), n=4, percent=85)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.fit(docs, table(spark, sf_dir, "labels"), held_out=0, folds=5)
    return quality.score(docs.select("doc_id", "text", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")), net).drop("text")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048).drop("text")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents whose id hashes to a multiple of ten repeat some of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    docs = docs.withColumn("words", F.when(h % 10 == 0, words))  # null for all others
    n = F.size("words")
    docs = docs.withColumns({"a": F.when(n > 0, (g % n).cast("int")), "n": n})
    docs = docs.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (g % 8 + 3)) + 1).cast("int"))
    at = lambda i: F.element_at("words", F.col("a") + i % F.col("p") + 1)
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), at)
    planted = F.array_join(F.concat(F.slice("words", 1, F.col("a")), tail), " ")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.detect(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.crc32(F.col("conv_id").cast("string")) % 6
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), head, block=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_url_filter, op3_pii, op4_ann, op5_language, op6_jaccard_join, op7_mixing, op8_quality, op9_token_files, op10_html_extract, op11_token_counts, op12_periodic_runs, op13_prefix_trie)
}

_LOWER = "translate(regexp_extract({}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES: dict[str, str] = {
    "op2_url_filter": f"""
with rules(rule_host, rule_path, verdict) as (values {", ".join(str(r) for r in URL_RULES)}),
urls as (select page_id, {_LOWER.format("coalesce(url, '')")} as host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages),
fitting as (
 select page_id, rule_host || rule_path as rule, verdict, row_number() over (partition by page_id order by length(rule_host) - length(replace(rule_host, '.', '')) desc, length(rule_path) desc) as n
 from urls join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select u.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from urls u left join fitting f on u.page_id = f.page_id and n = 1
""",
    "op7_mixing": r"""
with docs as (
 select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(coalesce(text, '')) as digest, md5('0:' || coalesce(cast(doc_id as varchar), 'null')) as h from documents),
sources as (
 select source, sum(size)::double as s, (case (row_number() over (order by source is null, encode(source)) - 1) % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end)::double as w from docs group by source),
levels as (
 select *, (1.5 * sum(s) over () - coalesce(sum(2.0 * s) over (order by 2.0 * s / w, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0.0))
  / sum(w) over (order by 2.0 * s / w, source is null, encode(source) rows between current row and unbounded following) as level from sources),
goals as (
 select source, cast(s as bigint) as source_size, case when 2.0 * s / w <= level then 2.0 * s else least(w * max(case when 2.0 * s / w > level then level end) over (), 2.0 * s) end as target,
  cast('0x' || substr(md5('offset 0:' || coalesce('s' || source, 'n')), 1, 8) as bigint) / 4294967296.0 as shift from levels),
ranked as (
 select *, row_number() over (partition by source order by lpad(cast(length(bin(size)) as varchar), 2, '0') || substr(bin(size), 1, 4), substr(h, 1, 2), h, doc_id, size, digest) as n from docs),
taken as (
 select doc_id, r.source, size, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate, shift, n from ranked r join goals g on r.source is not distinct from g.source)
select doc_id, source, size, source_size, target, cast(least(floor(shift + rate * n) - floor(shift + rate * (n - 1)), ceil(rate)) as bigint) * size as taken from taken
""",
    # crc32 bit by bit through a table of 256 entries, then the trie by lists of turns.
    "op13_prefix_trie": """
with bytes as (
 select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
convs as (
 select conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 6 as h
 from (select distinct conv_id from conversations where conv_id is not null), bytes),
told as (
 select conv_id, list([coalesce(role, ''), coalesce(text, '')] order by turn nulls first) as turns from conversations where conv_id is not null group by conv_id),
rebuilt as (
 select c.conv_id, list_concat(coalesce(b.turns[1:h], []), t.turns[h + 1:]) as turns
 from convs c join told t on c.conv_id = t.conv_id left join told b on b.conv_id = c.conv_id - c.conv_id % 100),
paths as (
 select conv_id, unnest(range(len(turns) + 1)) as depth, turns from rebuilt),
keyed as (
 select conv_id, depth, sha256(turns[1:depth]::varchar) || '/' || depth as node, case when depth > 0 then sha256(turns[1:depth - 1]::varchar) || '/' || (depth - 1) end as parent,
  depth = len(turns) as last, case when depth > 0 then length(turns[depth][2]) else 0 end as points from paths),
nodes as (
 select node, any_value(depth) as depth, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, max(points) as points,
  coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '') as ends from keyed group by node),
kids as (select parent as node, count(*) as n_children from nodes where parent is not null group by parent),
told_nodes as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join kids k on n.node = k.node),
sums as (
 select k.node, count(*) filter (n.n_children = 0) as n_leaves, cast(sum((n.n_convs - 1) * n.points) as bigint) as saved_tokens
 from told_nodes n join keyed k on k.conv_id = n.conv_id and k.depth <= n.depth group by k.node)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, sha256(n.ends) as ends_sha256
from told_nodes n join sums s on n.node = s.node left join nodes p on n.parent = p.node
""",
}
