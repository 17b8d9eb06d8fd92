"""Production queries of the operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, embedding_dedup, html_extract, importance, language_id, minhash, mixing, mpeg_audio, repeats, sentencepiece_codec, sharding, spelling, token_count

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.text_media_digest(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.Settings(words=3, percent=85))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(_table(spark, sf_dir, "documents"), repeats.Settings(width=400))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_embedding_near_dedup, op3_token_counts, op4_mpeg_audio, op5_sharding, op6_language_id, op7_sentencepiece, op8_source_mixing, op9_minhash_near_dedup, op10_suffix_array_dedup, op11_spelling_variants, op12_importance_resampling, op13_benchmark_decontamination)}


def _sharding_sql() -> str:
    """The lookup table as a list literal, indexed by the same MD5 bits."""
    table = ", ".join(map(str, sharding.lookup_table()))
    return f"""
        with placed as (
            select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 12) as bigint) % {sharding.SLOTS} as slot from documents
        ), lookup as (
            select unnest(range({sharding.SLOTS})) as slot, unnest([{table}]) as owner
        )
        select doc_id, placed.slot, 'shard-' || lpad(cast(owner as varchar), 3, '0') as shard
        from placed join lookup on placed.slot = lookup.slot
    """


def _crc_sql(text: str) -> str:
    """CRC-32 of a string expression's UTF-8, by its polynomial."""
    table = f"[{', '.join(map(str, importance.CRC))}]"
    return f"""xor(4294967295, list_reduce(
        list_transform(range(octet_length(encode({text}))), lambda k: cast('0x' || substr(hex(encode({text})), cast(2 * k + 1 as int), 2) as bigint)),
        lambda crc, b: xor(crc >> 8, {table}[cast(xor(crc, b) & 255 as int) + 1]), 4294967295::bigint))"""


LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = rf"regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SPELLING_SQL = rf"""
    with recursive runs as (
        select doc_id, unnest(regexp_extract_all({LOWER_SQL}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) as run from documents
    ), seen as (
        select run, doc_id, count(*) as n from runs where length(run) >= 6 group by all
    ), hashed as (
        select run, n, {_crc_sql("doc_id || ':' || run")} as h from seen
    ), words as (
        select case when h % 199 = 0 then substr(run, 1, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word, cast(sum(n) as bigint) as n
        from hashed group by 1 having length(word) >= 6 and sum(n) >= 5
    ), cut as (
        select distinct word, n, unnest(list_transform(range(length(word)), lambda i: cast(i as varchar) || ':' || substr(word, 1, cast(i as int)) || '?' || substr(word, cast(i as int) + 2))) as hole from words
    ), less as (
        select distinct word, n, substr(hole, position(':' in hole) + 1, position('?' in hole) - position(':' in hole) - 1) || substr(hole, position('?' in hole) + 1) as rest from cut
    ), near as (
        select a.word, b.word as other, b.n from cut a join cut b on a.hole = b.hole and a.word <> b.word
        union select l.word, w.word, w.n from less l join words w on l.rest = w.word
        union select w.word, l.word, l.n from less l join words w on l.rest = w.word
    ), best as (
        select word, count(*) as n_near, min({{'less': -n, 'word': other}}) as top from near group by word
    ), judged as (
        select w.word, w.n, coalesce(n_near, 0) as n_near, case when -top.less >= 5 * w.n then top.word end as form, case when -top.less >= 5 * w.n then -top.less end as form_n
        from words w left join best b on w.word = b.word
    ), chain as (
        select word, word as at, form as next from judged
        union all
        select c.word, j.word, j.form from chain c join judged j on c.next = j.word
    )
    select j.word, j.form, c.at as root, j.n, j.n_near, j.form_n from judged j join chain c on j.word = c.word and c.next is null
"""

IMPORTANCE_SQL = f"""
    with doc_words as (select doc_id, {WORDS_SQL} as words from documents), aim as (select unnest({WORDS_SQL}) as word from benchmark
    ), each as (select doc_id, unnest(words) as word from doc_words
    ), buckets as (
        select word, {_crc_sql("word")} % 10000 as bucket from (select word from each union select word from aim)
    ), counted as (
        select bucket, cast(sum(s) as double) as s, cast(sum(t) as double) as t from (select word, 1 as s, 0 as t from each union all select word, 0, 1 from aim) join buckets using (word) group by bucket
    ), gains as (
        select bucket, cast(floor(1000 * ln((t + 1) * ((select sum(s) from counted) + 10000) / ((s + 1) * ((select sum(t) from counted) + 10000)))) as bigint) as gain from counted
    ), weights as (
        select doc_id, count(*) as n_features, cast(sum(gain) as bigint) as total from each join buckets using (word) join gains using (bucket) group by doc_id
    ), scored as (
        select d.doc_id, coalesce(n_features, 0) as n_features, coalesce(case when total >= 0 then total // n_features else -((n_features - 1 - total) // n_features) end, 0) as weight,
               cast('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) as bigint) as h
        from documents d left join weights w on d.doc_id = w.doc_id
    ), noisy as (
        select doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from scored
    ), placed as (
        select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from noisy where n_features >= 20
    )
    select n.doc_id, n_features, weight, score, case when place <= 10 * n // 100 then place end as rank from noisy n left join placed p on n.doc_id = p.doc_id
"""

DECONTAMINATION_SQL = f"""
    with doc_words as (select doc_id, coalesce({WORDS_SQL}, []) as words from documents
    ), item_words as (
        select item_id, {WORDS_SQL} as words from benchmark where len({WORDS_SQL}) > 0
    ), windows as (
        select distinct cast(item_id as varchar) as item, least(len(words), 10) as n, unnest(list_transform(range(len(words) - least(len(words), 10) + 1), lambda i: array_to_string(words[i + 1 : i + least(len(words), 10)], ' '))) as win from item_words
    ), grams as (
        select doc_id, n, unnest(range(len(words) - n + 1)) as pos, unnest(list_transform(range(len(words) - n + 1), lambda i: array_to_string(words[i + 1 : i + n], ' '))) as win
        from doc_words, (select distinct n from windows) where len(words) >= n
    ), hits as (
        select doc_id, pos, grams.n, item from grams join windows using (win)
    ), covered as (
        select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(pos, pos + n)) as word from hits) group by doc_id
    ), listed as (
        select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id
    )
    select d.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from doc_words d left join covered c on d.doc_id = c.doc_id left join listed l on d.doc_id = l.doc_id
"""

ORACLES = {
    "op5_sharding": _sharding_sql(),
    "op11_spelling_variants": SPELLING_SQL,
    "op12_importance_resampling": IMPORTANCE_SQL,
    "op13_benchmark_decontamination": DECONTAMINATION_SQL,
}
