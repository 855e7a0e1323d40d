"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from concord.llm import bpe
from concord.llm.alignment import alignment_summary
from concord.llm.common import documents
from concord.llm.exact_dedup import exact_dedup
from concord.llm.language import identify
from concord.llm.lexical import ranked
from concord.llm.licenses import license_summary
from concord.llm.minhash import minhash_duplicates
from concord.llm.mixing import mixed_counts
from concord.llm.quality import quality_rules
from concord.llm.sharding import reshard_documents
from concord.llm.simhash import near_duplicates
from concord.llm.suffix_dedup import repeated_bytes
from concord.llm.warc import round_trip

#: Fixed value: a term of op12, A-Z being lower-cased before.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_counts(documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard_documents(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_summary(documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_summary(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_duplicates(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language": op3_language,
    "op4_mixing": op4_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality": op6_quality,
    "op7_sharding": op7_sharding,
    "op8_licenses": op8_licenses,
    "op9_warc": op9_warc,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_lexical": op12_lexical,
    "op13_minhash": op13_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": f"""
        with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as norm from documents),
        g as (select norm, max(doc_id) as keep_id, count(*) as group_size from t group by norm)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t.norm) as text_sha256
        from t join g on t.norm = g.norm""",
    "op6_quality": r"""
        with t as (select doc_id, coalesce(text, '') as text, coalesce('=' || source, '-') as host from documents),
        w as (select doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from t),
        win as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
                from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
        again as (select doc_id, unnest([i, i + 1, i + 2]) as i
                  from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
        rep as (select doc_id, count(distinct i) as n from again group by doc_id),
        l as (select doc_id, host, unnest(string_split(text, chr(10))) as line from w),
        lw as (select doc_id, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
                 translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm
               from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
        dup as (select doc_id, count(*) - count(distinct line) as n from lw group by doc_id),
        nl as (select doc_id, host, norm, sum(n) as n from lw group by 1, 2, 3),
        hosts as (select host, greatest(30.0, count(*) * 0.005) as lim from t group by host),
        freq as (select nl.host, norm from nl join hosts using (host) group by nl.host, norm, lim having count(*) > lim),
        gone as (select doc_id, sum(n) as n, count(*) as k from nl join freq using (host, norm) group by doc_id),
        f as (select w.doc_id, cast(len(ws) as bigint) as n_words,
                cast(length(array_to_string(ws, '')) as bigint) as word_chars,
                cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
                cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
                cast(coalesce(gone.k, 0) as bigint) as frequent_lines, cast(len(ws) - coalesce(gone.n, 0) as bigint) as words_left
              from w left join dup using (doc_id) left join rep using (doc_id) left join gone using (doc_id)),
        b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f)
        select *, not base_failed and words_left >= n_words * 0.5 as kept from b""",
    "op9_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select *, sha1(html) as h, min(page_id) over (partition by html) as first from p)
        select page_id, cast(strlen(html) as bigint) as payload_bytes,
          array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            cast((cast('0x' || substr(h, cast(5 * (i // 4) + 1 as bigint), 5) as integer) >> cast(15 - 5 * (i % 4) as integer)) & 31 as bigint) + 1, 1)), '') as payload_digest,
          case when first = page_id then 'response' else 'revisit' end as record_type,
          case when first = page_id then null else first end as refers_to
        from d""",
    "op12_lexical": rf"""
        with d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as ws from documents),
        s as (select doc_id, r, cast(len(ws) as bigint) as n from d where len(ws) > 0),
        g as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from s),
        i as (select item_id, row_number() over () as q, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as ws from benchmark),
        it as (select distinct q, item_id, unnest(ws) as term from i),
        p as (select r, term, count(*) as tf from (select r, unnest(ws) as term from d) where term in (select term from it) group by 1, 2),
        w as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w from p, g group by term, n_docs),
        sc as (select q, item_id, doc_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) as bigint) as score
               from it join w using (term) join p using (term) join s using (r), g group by 1, 2, 3, 4)
        select item_id, cast(row_number() over (partition by q order by score desc, doc_id asc nulls last) as int) as rank, doc_id, score
        from sc where score > 0 qualify row_number() over (partition by q order by score desc, doc_id asc nulls last) <= 10""",
    "op13_minhash": rf"""
        with recursive d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as ws from documents),
        sh as (select distinct r, unnest(case when len(ws) < 5 then [array_to_string(ws, ' ')]
                 else list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) end) as g from d where len(ws) > 0),
        n as (select r, count(*) as n from sh group by r),
        l as (select x.r as a, y.r as b from sh x join sh y on x.g = y.g and x.r <> y.r join n p on p.r = x.r join n q on q.r = y.r
              group by x.r, y.r, p.n, q.n having 100 * count(*) >= 80 * (p.n + q.n - count(*))),
        reach as (select r as a, r as b from d union select reach.a, l.b from reach join l on reach.b = l.a),
        c as (select a as r, min(doc_id) as component_id from reach join d on d.r = reach.b group by a)
        select doc_id, coalesce(n.n, 0) as n_shingles, component_id, doc_id is not distinct from component_id as kept
        from d join c using (r) left join n using (r)""",
}
