"""The operators of this folder on the supplied tables, with the expected result in SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact, fim, lines, merkle, near, ngram_join, packing, quality, spans, tokencount, warc
from .frames import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write(table(spark, folder, "pages"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    controls = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    vocabulary = str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    formatted = chat.format_conversations(turns.unionByName(controls), *vocabulary)
    return chat.digests(chat.read_turns(formatted, *vocabulary))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return spans.repeated_spans_removed(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.col("kept_text_sha256").alias("kept_sha256")
    )


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.token_counts(table(spark, folder, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.deduplicate(table(spark, folder, "documents"))


def op8_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_groups(table(spark, folder, "documents"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.shared_lines_removed(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.col("kept_text_sha256").alias("kept_sha256")
    )


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = merkle.leaf(*row, F.translate("text", upper, upper.lower()))
    leaves = docs.select(
        F.col("lang").alias("group"), "doc_id", merkle.leaf(*row, F.col("text")).alias("leaf"),
        F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, tampered).alias("changed"),
    )
    proof = F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256")
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return merkle.manifest(leaves).select("doc_id", "leaf", "subroot", "root", proof, "folded_root", verified)


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fim.restore(fim.rearrange(table(spark, folder, "documents")), with_text=False)


def op13_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked_groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


_OP7_SQL = r"""
with d as (
    select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as folded
    from documents),
k as (
    select *, first_value(doc_id) over (partition by folded order by n desc, doc_id) as keep_id,
           count(*) over (partition by folded) as group_size
    from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(folded) as text_sha256 from k"""

_OP9_SQL = r"""
with l as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as nth
    from documents),
k as (
    select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from l),
r as (
    select key, min(doc_id) as holder from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2)
select k.doc_id, count(*) as n_lines, count(*) filter (r.holder is not null and r.holder <> k.doc_id) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by nth) filter (r.holder is null or r.holder = k.doc_id), '')) as kept_sha256
from k left join r on r.key = k.key group by k.doc_id"""

_OP4_SQL = r"""
with d as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
w as (
    select doc_id, i, hash(words[i:i + 49]) as h, hash(list_reverse(words[i:i + 49])) as g
    from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from d where len(words) >= 50)),
f as (select h, g, min(doc_id) as holder from w group by h, g),
lost as (
    select doc_id, list(i) as starts from w join f using (h, g) where holder < doc_id group by doc_id),
covered as (
    select distinct doc_id, p from (select doc_id, unnest(starts) as s from lost), lateral (select unnest(range(s, s + 50)) as p)),
gone as (select doc_id, count(*) as n, list(p) as places from covered group by doc_id)
select d.doc_id, len(words) as n_words, coalesce(n, 0) as n_removed,
       sha256(array_to_string(case when n is null then words
              else list_filter(words, lambda x, i: not list_contains(places, i)) end, ' ')) as kept_sha256
from d left join gone on gone.doc_id = d.doc_id"""

_OP3_SQL = r"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
f as (
    select *, length(role) + 1 + length(regexp_replace(text, '([<\[])(\\*)(/?(s>|INST\]))', '\1\\\2\3', 'g'))
              + case when role = 'assistant' then 7 else 20 end as chars
    from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       length(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars
from f group by conv_id"""

_OP12_SQL = r"""
with d as (
    select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units
    from documents),
u as (
    select doc_id, text, units, len(units) as n, ('0x' || h[1:8])::ubigint as h1, ('0x' || h[9:16])::ubigint as h2,
           ('0x' || h[17:24])::ubigint as h3, ('0x' || h[25:32])::ubigint as h4
    from d),
p as (
    select doc_id, text, n, array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') as prefix,
           array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') as middle,
           array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') as suffix,
           case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50
                then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
    from u)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
       case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from p"""

# Levels are counted from the leaves; tree 0 has a group for each language, tree 1 has the subroots.
_OP11_SQL = r"""
with recursive f as (
    select doc_id, lang, text, coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') ||
           coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') ||
           coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head,
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
           list_transform(range(8 * strlen(cast(doc_id as varchar))),
                          lambda i: (ascii(cast(doc_id as varchar)[i // 8 + 1]) >> (i % 8)) & 1) as bits
    from documents),
l as (
    select doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
           sha256(head || coalesce(strlen(low) || ':' || low, '-')) as low_leaf,
           xor(4294967295, list_reduce(list_concat([4294967295::ubigint], list_transform(bits, lambda x: x::ubigint)),
               lambda c, b: xor(c >> 1, case when (c & 1) <> b then 3988292384::ubigint else 0::ubigint end))) % 3 = 0 as tampered
    from f),
p as (
    select *, dense_rank() over (order by lang nulls first) - 1 as grp,
           row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos,
           count(*) over (partition by lang) as total
    from l),
low as (
    select grp, 0 as level, pos, leaf as digest, total from p
    union all
    select grp, level + 1, pos // 8, sha256(string_agg(digest, '' order by pos)), cast(ceil(any_value(total) / 8) as bigint)
    from low where total > 1 group by grp, level, pos // 8),
sub as (select grp, max(level) as height, arg_max(digest, level) as subroot from low group by grp),
high as (
    select 0 as level, grp as pos, subroot as digest, count(*) over () as total from sub
    union all
    select level + 1, pos // 8, sha256(string_agg(digest, '' order by pos)), cast(ceil(any_value(total) / 8) as bigint)
    from high where total > 1 group by level, pos // 8),
top as (select arg_max(digest, level) as root from high),
beside as (
    select a.grp, 0 as tree, a.level, a.pos, coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos < a.pos), '') as l,
           coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos > a.pos), '') as r
    from low a join low b on a.grp = b.grp and a.level = b.level and a.pos // 8 = b.pos // 8
    where a.total > 1 group by a.grp, a.level, a.pos
    union all
    select -1, 1, a.level, a.pos, coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos < a.pos), ''),
           coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos > a.pos), '')
    from high a join high b on a.level = b.level and a.pos // 8 = b.pos // 8
    where a.total > 1 group by a.level, a.pos),
steps as (
    select p.grp, p.pos, b.level as nth, b.l, b.r from p join beside b
    on b.tree = 0 and b.grp = p.grp and b.pos = cast(floor(p.pos / pow(8, b.level)) as bigint)
    union all
    select p.grp, p.pos, s.height + b.level, b.l, b.r from p join sub s on s.grp = p.grp join beside b
    on b.tree = 1 and b.pos = cast(floor(p.grp / pow(8, b.level)) as bigint)),
proofs as (select grp, pos, sha256(string_agg(l || r, '' order by nth)) as proof_sha256 from steps group by grp, pos),
fold as (
    select grp, pos, 0 as nth, case when tampered then low_leaf else leaf end as digest from p
    union all
    select f.grp, f.pos, f.nth + 1, sha256(s.l || f.digest || s.r)
    from fold f join steps s on s.grp = f.grp and s.pos = f.pos and s.nth = f.nth),
ends as (select grp, pos, arg_max(digest, nth) as folded_root from fold group by grp, pos)
select p.doc_id, p.leaf, s.subroot, t.root, coalesce(o.proof_sha256, sha256('')) as proof_sha256, e.folded_root,
       e.folded_root = t.root as verified
from p join sub s on s.grp = p.grp join ends e on e.grp = p.grp and e.pos = p.pos
left join proofs o on o.grp = p.grp and o.pos = p.pos, top t"""

_QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_warc, op3_chat_formatting, op4_substring_dedup, op5_packing, op6_token_counts,
        op7_exact_dedup, op8_minhash_dedup, op9_line_dedup, op10_decontamination, op11_merkle_manifest, op12_fill_in_middle,
        op13_ngram_jaccard_join,
    )
}
_ORACLES: dict[str, str] = {
    "op3_chat_formatting": _OP3_SQL,
    "op4_substring_dedup": _OP4_SQL,
    "op7_exact_dedup": _OP7_SQL,
    "op9_line_dedup": _OP9_SQL,
    "op11_merkle_manifest": _OP11_SQL,
    "op12_fill_in_middle": _OP12_SQL,
}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
