"""The queries of this subpackage, with SQL where DuckDB can express them."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.chat import digest_conversations, format_conversations
from lodestream.llm.clusters import ball_kmeans
from lodestream.llm.decontaminate import flag_leaks
from lodestream.llm.lexical import search
from lodestream.llm.licenses import scan_licenses
from lodestream.llm.lm_score import score_texts
from lodestream.llm.near_dedup import near_duplicates
from lodestream.llm.packing import cut_pieces, pack
from lodestream.llm.quality import POLICIES, RULES, ablations, ledger, mask, passes
from lodestream.llm.secrets import count_kind, find_secrets, span_text
from lodestream.llm.shared import materialise
from lodestream.llm.token_counts import count_tokens
from lodestream.llm.token_files import read_token_files, write_token_files
from lodestream.llm.toxicity import score_toxicity

#: A model's usual context, in tokens.
CONTEXT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded."""
    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > CONTEXT).alias("over_limit"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=85)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items, which are no documents, are given as text."""
    flags = flag_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return flags.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    failed = F.col("failure_bits").bitwiseAND(F.lit(3)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & passes()).alias("kept"), "failure_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per policy and rule, what the rule rejects and what it alone rejects."""
    return ablations(ledger(table(spark, sf_dir, "documents")).select("failure_bits"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return digest_conversations(materialise(format_conversations(rows.unionByName(probe)), "formatted"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, files)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=CONTEXT), CONTEXT)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return rows.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a source and a language stand for the directories of a document."""
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("-")), F.lit("/"), F.coalesce("lang", F.lit("-")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    return scan_licenses(table(spark, sf_dir, "documents"), path).select("doc_id", "path", "header_license", "header_cosine", "file_license", "file_cosine", "license", "origin")


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(table(spark, sf_dir, "embeddings")).drop("compared")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_near_dedup": op2_near_dedup,
    "op3_lm_score": op3_lm_score,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_token_files": op7_token_files,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_license_scan": op10_license_scan,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_lexical_search": op12_lexical_search,
    "op13_toxicity": op13_toxicity,
    "quality_ablations": quality_ablations,
}

_QUALITY = r"""
with w as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
e as (select r, unnest(list_transform(range(1, len(ws) - 3), lambda i: {'i': i, 'g': array_to_string(list_slice(ws, i, i + 4), ' ')})) as x from w where len(ws) >= 5),
d as (select r, x.i as i from e qualify count(*) over (partition by r, x.g) > 1),
p as (select r, count(distinct i + k) as n from d, (select unnest(range(5)) as k) group by r),
m as (
  select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
         len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(p.n, 0)::bigint as n_repeat_words, length(regexp_replace(text, '[^\pL]+', '', 'g'))::bigint as n_letters
  from w left join p on p.r = w.r),
b as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
         (n_words < 10)::bigint + 2 * (100 * n_repeat_words > 20 * n_words)::bigint + 4 * (100 * n_symbols > 20 * n_words)::bigint
         + 8 * (n_dup_lines >= 3 and 100 * n_dup_lines > 40 * n_lines)::bigint + 16 * (n_words > 0 and word_chars > 15 * n_words)::bigint
         + 32 * (2 * n_letters < word_chars)::bigint as failure_bits
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (failure_bits & 31) = 0 as kept, failure_bits from b
"""


def _kmeans_sql(k: int = 8, rounds: int = 10) -> str:
    """Plain k-means in integers: every round is a pair of tables over (vector, component) rows."""
    steps = [
        f"""
with kept as (
  select row_number() over () as r, vec_id, embedding from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
v as materialized (
  select r, vec_id, i, floor(1024 * (embedding[i])::double)::bigint as x from kept, (select unnest(range(1, 65)) as i)),
s as (select r, row_number() over (order by sha256('3:' || vec_id)) - 1 as c from kept qualify c < {k}),
c0 as materialized (select c, i, x from v join s using (r))"""
    ]
    for t in range(rounds + 1):
        steps.append(
            f"""a{t} as materialized (
  select r, arg_min(c, d * {k} + c) as c, min(d) as d from (
    select r, c, sum((v.x - m.x) * (v.x - m.x))::bigint as d from v join c{t} m using (i) group by r, c) group by r)"""
        )
        if t < rounds:
            steps.append(
                f"""n{t} as (
  select c, i, sum(x) as s, count(*) as n from v join a{t} using (r) group by c, i),
c{t + 1} as materialized (
  select m.c, m.i, coalesce((s - ((s % n) + n) % n) // n, m.x)::bigint as x from c{t} m left join n{t} using (c, i))"""
            )
    return (
        ",\n".join(steps)
        + f"""
select vec_id, a.c::integer as "cluster", d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, h as centroid_sha256
from a{rounds} a join kept using (r) join (select c, sha256(string_agg(x::varchar, ',' order by i)) as h from c{rounds} group by c) h on h.c = a.c"""
    )


_POLICIES = ", ".join(f"({v}, '{r}', {1 << RULES[r][0]}, {mask(rules)})" for v, rules in POLICIES.items() for r in rules)

_ABLATIONS = (
    _QUALITY.replace("select doc_id, n_words, word_chars", ", f as (select doc_id, n_words, word_chars")
    + f""")
select p.version::integer as version, p.rule, count(*) as documents, count(*) filter (failure_bits & p.mask = 0) as kept,
       count(*) filter (failure_bits & p.bit <> 0) as failing, count(*) filter (failure_bits & p.mask = p.bit) as only_this
from f, (values {_POLICIES}) p(version, rule, bit, mask) group by p.version, p.rule
"""
)

_SEARCH = r"""
with fold as (select doc_id, row_number() over () as d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
words as (select doc_id, d, unnest(regexp_extract_all(t, '[0-9a-z\x{80}-\x{10FFFF}]+')) as term from fold),
sizes as materialized (select d, count(*) as n from words group by d),
total as materialized (select count(*) as docs, sum(n)::bigint as terms from sizes),
asked as materialized (
  select distinct item_id, term from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) as term from benchmark)),
postings as materialized (select doc_id, d, term, count(*) as tf from words where term in (select term from asked) group by doc_id, d, term),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, total group by term, docs),
scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::bigint as score
  from asked join postings using (term) join weights using (term) join sizes using (d), total group by item_id, doc_id, d)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::integer as "rank", doc_id, score
from scores where score > 0 qualify "rank" <= 10
"""

ORACLES: dict[str, str] = {"op5_quality_rules": _QUALITY, "op11_ball_kmeans": _kmeans_sql(), "op12_lexical_search": _SEARCH, "quality_ablations": _ABLATIONS}
