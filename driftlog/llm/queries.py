"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), 1024)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.sentencepiece_codec import encode

    return encode(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), ids=False)


def op3_sentencepiece_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids read back: length and checksum of the text, and whether the libraries agree."""
    from pyspark.sql import functions as F

    from driftlog.llm.sentencepiece_codec import decode, encode
    from driftlog.llm.staging import staged

    docs, model = table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model")
    ids = staged(encode(docs, model).select("doc_id", "ids"), "piece-ids")
    return decode(ids, model).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "parity")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm import direct_codes as codes
    from driftlog.llm.staging import shared_folder

    path = _tokenizer("word_bpe_49k.json")
    files = codes.write(table(spark, sf_dir, "documents"), lambda: codes.word_encoder(path), 1, shared_folder(spark, "token-ids"))
    return codes.read(spark, files)


def _fold(n: int):
    from pyspark.sql import functions as F

    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from driftlog.llm import quality_classifier as quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(_fold(3) != 1))
    return quality.score(docs, model).withColumn("held_out", F.coalesce(_fold(3) == 1, F.lit(False))).select("doc_id", "held_out", "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm import quality_rules as rules

    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", *rules.BASE, "base_failed", "kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.decontamination import contained

    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm import personal_data as pii

    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op8_masked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm import masked_words as lm

    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.fit(docs))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from driftlog.llm import language_id as lang

    docs = table(spark, sf_dir, "documents")
    model = lang.fit(docs.where(F.coalesce(_fold(4) != 2, F.lit(True))))
    return lang.predict(docs, model).withColumn("held_out", F.coalesce(_fold(4) == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


def op11_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.setsketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.periodic_runs import periodic_runs, planted

    return periodic_runs(table(spark, sf_dir, "documents"), change=planted)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_sentencepiece": op3_sentencepiece,
    "op3_sentencepiece_decode": op3_sentencepiece_decode,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontamination": op6_decontamination,
    "op7_personal_data": op7_personal_data,
    "op8_masked_scores": op8_masked_scores,
    "op9_token_files": op9_token_files,
    "op10_language_id": op10_language_id,
    "op11_near_duplicates": op11_near_duplicates,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op2_jaccard_join": """
with recursive w as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select distinct r, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as g from w
), n as (select r, count(*) as n from s group by 1),
p as (
  select a.r as a, b.r as b, count(*) as c from s a join s b on a.g = b.g and a.r <> b.r group by 1, 2
), l as (
  select a, b from p join n x on x.r = a join n y on y.r = b where c * 1000 >= 800 * (x.n + y.n - c)
), reach(a, b) as (
  select r, r from w union select reach.a, l.b from reach join l on reach.b = l.a
), least as (select a, min(doc_id) as class_id from reach join w on w.r = reach.b group by 1),
links as (select a, count(*) as n_links from l group by 1)
select d.doc_id, class_id, coalesce(n_links, 0) as n_links from w d join least on least.a = d.r left join links on links.a = d.r
""",
    "op6_decontamination": """
with d as (
  select doc_id, string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') as w from documents where text is not null and doc_id is not null
), i as (
  select item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from benchmark where text is not null
), s as (
  select distinct item_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda j: array_to_string(w[j:j + least(len(w), 5) - 1], ' '))) as g from i where len(w) > 0
), t as (
  select distinct doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) as g from d, (select distinct least(len(w), 5) as k from i where len(w) > 0) where len(w) >= k
), n as (select item_id, count(*) as n from s group by 1)
select doc_id, item_id, count(*) as n_shared, max(n) as n_shingles, count(*) / max(n) as containment
from t join s using (g) join n using (item_id) group by 1, 2 having count(*) * 1000 >= max(n) * 800
""",
    "op11_near_duplicates": """
with recursive w as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), s as (
  select distinct r, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as g from w
), n as (select r, count(*) as n from s group by 1),
p as (
  select a.r as a, b.r as b, count(*) as c from s a join s b on a.g = b.g and a.r <> b.r group by 1, 2
), l as (
  select a, b from p join n x on x.r = a join n y on y.r = b where c * 100 >= 85 * (x.n + y.n - c)
), reach(a, b) as (
  select r, r from w union select reach.a, l.b from reach join l on reach.b = l.a
), least as (select a, min(doc_id) as component_id from reach join w on w.r = reach.b group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, coalesce(doc_id = component_id, false) as kept from w join least on least.a = w.r left join n using (r)
""",
    "op13_source_divergence": """
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), t as (select r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
k as (select lang, term from t group by all having count(distinct r) >= 10),
c as (select lang, source, term, count(*) as c from t join k using (lang, term) group by all),
v as (select lang, count(*) as v from k group by all),
n as (select lang, source, sum(c) as n from c group by all),
s as (select g.lang, g.source, coalesce(n, 0)::hugeint as n, coalesce(v, 0)::hugeint as v from (select distinct lang, source from d) g left join n using (lang, source) left join v using (lang)),
p as (select s.lang, s.source, k.term, coalesce(c, 0) as c, 1 + 1000000000::hugeint * (coalesce(c, 0) + 2) // (n + 2 * v) as p from s join k using (lang) left join c using (lang, source, term)),
l as (select lang, sum(n) as n, max(v) as v from s group by all),
q as (select lang, term, 1 + 1000000000::hugeint * (sum(c) + 2) // (max(l.n) + 2 * max(l.v)) as q from c join l using (lang) group by all),
f as (
  select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from p join q using (lang, term) where c > 0 and p > q
  union all
  select s.lang, s.source, 'pair', o.source, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) from s join s o on s.lang = o.lang and s.source <> o.source
    left join p x on x.lang = s.lang and x.source = s.source left join p y on y.lang = s.lang and y.source = o.source and y.term = x.term group by all
)
select lang, source, part, item, value::bigint as value, rank::int as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from f
) where part = 'pair' or rank <= 10
""",
}
