"""One query per operator over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from limpid.llm import dedup, fingerprint, language, lines, manifest, near_dup, packing, pieces, recurrent, resample, token_ids, url_rules, warc
from limpid.storage import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_warc_archive", """
    with p as (select page_id, coalesce(html, '') as body from pages),
    g as (select page_id, octet_length(encode(body)) as n, sha1(body) as d,
                 max(page_id) over (partition by body) as best from p)
    select page_id, n::bigint as payload_bytes, d as payload_digest,
           case when n >= 1000 and page_id <> best then 'revisit' else 'response' end as record_type,
           case when n >= 1000 and page_id <> best then best end as refers_to, true as intact
    from g""")
def warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Writes an archive of all pages and reads its records back."""
    path = scratch_path(spark, "archive")
    warc.write_archive(table(spark, folder, "pages"), path)
    records = warc.read_archive(spark, path)
    digest = F.sha1("payload")
    return records.select(F.col("key").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"),
                          "record_type", "refers_to", (digest == F.col("declared")).alias("intact"))


@query("op8_exact_dedup", """
    with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
    select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
    from d window w as (partition by t)""")
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, folder, "documents"))


@query("op10_token_ids")
def write_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    token_ids.write_ids(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_ids.read_ids(spark, path)


@query("op2_sentencepiece")
def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Encodes every document by Viterbi, and by merges, decodes the ids and says whether that gives the text again."""
    return pieces.round_trip(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_jaccard_join")
def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.jaccard_components(table(spark, folder, "documents"), links=True)


@query("op4_recurrent_lm")
def recurrent_lm(spark: SparkSession, folder: str) -> DataFrame:
    return recurrent.score(table(spark, folder, "documents"))


@query("op5_language_mixture")
def language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "languages")


#: Given rules of the query: address prefix and verdict.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query("op6_url_rules")
def judge_urls(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages"), URL_RULES)


@query("op7_best_fit")
def best_fit(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.pack(packing.sized(docs), docs.count())


@query("op9_fingerprint")
def fingerprint_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.with_neighbours(table(spark, folder, "documents"))


#: DuckDB has no CRC-32: its table, and the checksum of the bytes of a text.
CRC_TABLE = """crc as (select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as tab)"""


def crc_sql(value: str) -> str:
    each = f"list_transform(range(1, octet_length(encode({value})) + 1), lambda i: ('0x' || substr(hex(encode({value})), 2 * i - 1, 2))::bigint)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {each}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words_sql(table: str, key: str) -> str:
    return f"select {key}, unnest(regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as w from {table}"


@query("op11_importance_resampling", f"""
    with {CRC_TABLE}, dw as ({_words_sql('documents', 'doc_id')}), bw as ({_words_sql('benchmark', 'item_id')}),
    v as (select w, {crc_sql('w')} % 10000 as bucket from (select w from dw union select w from bw), crc),
    d as (select doc_id, bucket from dw join v using (w)),
    s as (select bucket, count(*) as s from d group by 1), t as (select bucket, count(*) as t from bw join v using (w) group by 1),
    g as (select s.bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select count(*) from dw) + 10000)::double)
        / ((s + 1)::double * ((select count(*) from bw) + 10000)::double)))::bigint as gain from s left join t using (bucket)),
    f as (select doc_id, count(*) as n, sum(gain)::bigint as weight from d join g using (bucket) group by 1),
    x as (select documents.doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0)
        + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
        from documents left join f using (doc_id)),
    r as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place,
        count(*) filter (n_features >= 20) over () as fit from x)
    select doc_id, n_features, weight, score, case when n_features >= 20 and place <= floor(10 * fit / 100) then place end as rank from r""")
def importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_line_dedup", f"""
    with e as (select row_number() over () as r, doc_id, unnest(string_split(coalesce(text, ''), e'\n')) as line,
            generate_subscripts(string_split(coalesce(text, ''), e'\n'), 1) as i from documents),
    k as (select *, translate(trim(line, e' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from e),
    f as (select key from k where key <> '' group by 1 having count(distinct doc_id) >= 10)
    select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
        sha256(coalesce(string_agg(line, e'\n' order by i) filter (f.key is null), '')) as kept_sha256
    from k left join f using (key) group by doc_id""")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.drop_repeated_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _field_sql(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::varchar)) || ':' || {column}::varchar, '-')"


def _levels_sql(name: str, rows: str) -> str:
    """Nodes of all levels over rows (grp, i, h); ``up`` numbers the node's parent."""
    return f"""{name}(grp, level, i, h, n) as (select grp, 0, i, h, count(*) over (partition by grp) from ({rows})
      union all select grp, level, i, h, count(*) over (partition by grp) from (select grp, level + 1 as level, i // 16 as i,
        sha256(string_agg(h, '' order by i)) as h from {name} where n > 1 group by grp, level, i // 16))"""


def _sides_sql(nodes: str) -> str:
    """Siblings of every node that has a parent."""
    return f"""select grp, level, i, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as l,
      coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as r
      from {nodes} where n > 1 window w as (partition by grp, level, i // 16 order by i)"""


@query("op13_merkle_manifest", f"""
    with recursive {CRC_TABLE}, d as (select doc_id, coalesce('=' || source, '') as grp, source, lang, n_chars, text,
      case when {crc_sql('doc_id::varchar')} % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as changed
      from documents, crc),
    v as (select doc_id, grp, row_number() over (partition by grp order by doc_id) - 1 as i,
      sha256({' || '.join(_field_sql(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))}) as leaf,
      sha256({' || '.join(_field_sql(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'changed'))}) as now from d),
    {_levels_sql('t', 'select grp, i, leaf as h from v')},
    tops as (select grp, h as subroot, row_number() over (order by grp) - 1 as j from t where n = 1),
    {_levels_sql('u', "select '' as grp, j as i, subroot as h from tops")},
    root as (select h as root from u where n = 1),
    ts as ({_sides_sql('t')}), us as ({_sides_sql('u')}),
    fold(doc_id, leaf, subroot, step, level, i, j, proof, h) as (
      select doc_id, leaf, subroot, 0, 0, v.i, j, '', now from v join tops using (grp)
      union all select f.doc_id, leaf, f.subroot, case when ts.l is null then 1 else 0 end, case when ts.l is null and step = 0 then 1 else f.level + 1 end,
        coalesce(ts.i, us.i) // 16, f.j, proof || coalesce(ts.l || ts.r, us.l || us.r), sha256(coalesce(ts.l, us.l) || f.h || coalesce(ts.r, us.r))
      from fold f join tops using (j) left join ts on step = 0 and ts.grp = tops.grp and ts.level = f.level and ts.i = f.i
        left join us on ts.l is null and us.level = case step when 0 then 0 else f.level end and us.i = case step when 0 then f.j else f.i end
      where ts.l is not null or us.l is not null),
    ends as (select doc_id, leaf, subroot, proof, h, row_number() over (partition by doc_id order by step desc, level desc) as last from fold)
    select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified from ends, root where last = 1""")
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    lowered = F.translate("text", dedup.UPPER, dedup.LOWER)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered).otherwise(F.col("text"))
    found = manifest.manifest(table(spark, folder, "documents"), changed={"text": tampered})
    proof = F.array_join(F.transform("proof", lambda p: F.concat(p["left"], p["right"])), "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", "verified")
