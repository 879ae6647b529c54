"""The registered queries of the operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import (
    decontaminate, html_text, language, lines, merkle, minhash, pieces, quality, secret_scan, substring, token_store, vectors, whitening,
)

Plan = Callable[[SparkSession, str], DataFrame]
WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, shards = token_store.write(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return token_store.read(spark, folder, shards)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_table(spark, sf_dir, "documents"))


def op10_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_table(spark, sf_dir, "documents"), whole=True)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    rows = found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "x"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.expr("try_cast(deviation as bigint)").alias("deviation"),
        F.col("x.whitened").alias("whitened"), F.col("x.explained").alias("explained"), "identity_error",
    )


MANIFEST = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = merkle.leaf_hash([*map(F.col, MANIFEST[:-1]), F.translate("text", UPPER, LOWER)])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, changed)
    found = merkle.manifest(_table(spark, sf_dir, "documents"), MANIFEST, carry={"tampered": tampered})
    rows = found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256"),
        merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
    base = F.filter("spans", lambda x: x["kind"].isin(*secret_scan.BASE))
    return found.select(
        "doc_id", *(secret_scan.number(F.col("spans"), k).alias(f"n_{k}") for k in secret_scan.BASE),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"),
        secret_scan.number(F.col("spans"), "random").alias("n_random"),
    )


SUBSTRING_SQL = rf"""
with words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents
), windows as (
    select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) as h
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) as i from words)
), repeated as (
    select doc_id, i from windows where h in (select h from windows group by h having count(*) > 1)
), covered as (
    select distinct doc_id, unnest(range(i, i + 35)) as i from repeated
), kept as (
    select w.doc_id, w.i, w.x from (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from words) w
    anti join covered c on c.doc_id = w.doc_id and c.i = w.i
), joined as (
    select doc_id, count(*) as n, string_agg(x, ' ' order by i) as k from kept group by doc_id
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256
from words left join joined using (doc_id)
"""

MINHASH_SQL = rf"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w
    from documents
), shingles as (
    select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
    from (select doc_id, w, unnest(range(1, case when len(w) = 0 then 1 else greatest(len(w) - 3, 2) end)) as i from words)
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), links as (
    select p.a, p.b
    from (select x.doc_id as a, y.doc_id as b, count(*) as k from shingles x join shingles y using (s)
          where x.doc_id <> y.doc_id group by 1, 2) p
    join sizes m on m.doc_id = p.a join sizes n on n.doc_id = p.b
    where 100 * k >= 75 * (m.n + n.n - k)
), reach(a, b) as (
    select doc_id, doc_id from documents
    union
    select r.a, l.b from reach r join links l on l.a = r.b
), least as (
    select a as doc_id, min(b) as component_id from reach group by a
)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from least left join sizes using (doc_id)
"""

LINES_SQL = r"""
with lines as (
    select doc_id, source, i, string_split(text, chr(10))[i] as line
    from (select doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null)
), marked as (
    select *, trim(line) as t, len(regexp_extract_all(trim(line), '[^ \t\x0B\f\r]+')) >= 3 as fit from lines
), spread as (
    select t from marked where fit group by t having count(distinct source) >= 10
), decided as (
    select m.*, fit and t in (select t from spread) as gone from marked m
), docs as (
    select doc_id, count(*) as n_lines, count_if(gone) as n_gone,
        2 * sum(case when gone then 0 else length(t) end) < sum(length(t)) and count_if(gone) > 0 as mostly_shared
    from decided group by doc_id
), texts as (
    select d.doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where mostly_shared or not gone), '') as kept
    from decided d join docs using (doc_id) group by d.doc_id
)
select doc_id, n_lines::bigint as n_lines, (case when mostly_shared then 0 else n_gone end)::bigint as n_removed,
    mostly_shared, sha256(kept) as kept_sha256
from docs join texts using (doc_id)
union all
select doc_id, 0, 0, false, sha256('') from documents where text is null
"""

LINES_WHOLE_SQL = rf"""
with near as ({MINHASH_SQL}), lines as (
    select doc_id, source, i, string_split(text, chr(10))[i] as line
    from (select doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null)
), marked as (
    select *, trim(line) as t, len(regexp_extract_all(trim(line), '[^ \t\x0B\f\r]+')) >= 1 as fit from lines
), spread as (
    select t from marked where fit and doc_id in (select doc_id from near where kept) group by t having count(distinct source) >= 10
), decided as (
    select *, fit and t in (select t from spread) as gone from marked
)
select doc_id, count(*) as n_lines, count_if(gone) as n_removed,
    2 * sum(case when gone then 0 else length(t) end) < sum(length(t)) and count_if(gone) > 0 as mostly_shared,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from decided group by doc_id
union all
select doc_id, 0, 0, false, sha256('') from documents where text is null
"""

VECTOR_SQL = """
with recursive v as (
    select vec_id, label, embedding::double[] as x from embeddings
    where label is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda y: y is not null and isfinite(y)))
        and list_bool_or(list_transform(embedding, lambda y: y <> 0))
), links as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.x) = len(b.x) and a.vec_id <> b.vec_id
    where list_cosine_similarity(a.x, b.x) >= 0.98
), reach(a, b) as (
    select vec_id, vec_id from embeddings
    union
    select r.a, l.b from reach r join links l on l.a = r.b
), least as (
    select a as vec_id, min(b) as component_id from reach group by a
), counts as (
    select a as vec_id, count(*) as n from links group by a
)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from least left join counts using (vec_id)
"""


def manifest_sql(levels: int = 9) -> str:
    """Trees of up to 8^levels leaves, one CTE per level; crc32 bit by bit."""

    def tree(name: str, source: str) -> str:
        """``source``: (tree, name, node), ordered by ``name`` in each tree. Gives {name}_top and {name}_proofs."""
        parts = [
            f"{name}_0 as (select *, row_number() over (partition by tree order by {source}_order) - 1 as i, "
            f"count(*) over (partition by tree) as n from {source})"
        ]
        for k in range(1, levels + 1):
            parts.append(
                f"{name}_{k} as (select tree, i // 8 as i, any_value(n) as n, list(node order by i) as kids, "
                f"case when any_value(n) > {8 ** (k - 1)} then sha256(string_agg(node, '' order by i)) else any_value(node) end as node "
                f"from {name}_{k - 1} group by tree, i // 8)"
            )
        joins = " ".join(f"join {name}_{k} on {name}_{k}.tree is not distinct from l.tree and {name}_{k}.i = l.i // {8**k}" for k in range(1, levels + 1))
        pairs = ", ".join(
            f"struct_pack(deep := {name}_{k}.n > {8 ** (k - 1)}, kids := {name}_{k}.kids, at := (l.i // {8 ** (k - 1)}) % 8)" for k in range(1, levels + 1)
        )
        parts.append(f"{name}_proofs as (select l.*, {name}_{levels}.node as top, list_filter([{pairs}], lambda x: x.deep) as path from {name}_0 l {joins})")
        return ",\n".join(parts)

    def proof(path: str) -> str:
        return f"array_to_string(list_transform({path}, lambda x: array_to_string(x.kids[:x.at], '') || array_to_string(x.kids[x.at + 2:], '')), '')"

    def fold(leaf: str, path: str) -> str:
        steps = f"list_transform({path}, lambda x: [array_to_string(x.kids[:x.at], ''), array_to_string(x.kids[x.at + 2:], '')])"
        return f"list_reduce({steps}, lambda a, x: [sha256(x[1] || a[1] || x[2])], [{leaf}])[1]"

    def field(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}, '-')"

    first = " || ".join(field(c) for c in MANIFEST[:-1])
    bits = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce({bits}, lambda a, b: case when b >= 0 then xor(a, b) else xor(a >> 1, 3988292384 * (a & 1)) end, 4294967295::bigint), 4294967295)"
    return f"""
with leaves as (
    select doc_id, lang as tree, sha256({first} || {field('text')}) as node,
        case when {crc} % 3 = 0 then sha256({first} || {field(f"translate(text, '{UPPER}', '{LOWER}')")}) end as tampered
    from documents
), ordered as (select *, struct_pack(a := coalesce(doc_id, -9223372036854775808), b := node) as ordered_order from leaves),
{tree("low", "ordered")},
tops as (select 0 as tree, lang, node, coalesce('=' || lang, '') as tops_order from (select distinct tree as lang, top as node from low_proofs)),
{tree("high", "tops")},
joined as (
    select d.doc_id, d.node as leaf, coalesce(d.tampered, d.node) as shown, d.top as subroot, u.top as root, list_concat(d.path, u.path) as path
    from low_proofs d join high_proofs u on u.lang is not distinct from d.tree
), folded as (select *, {fold("shown", "path")} as folded_root from joined)
select doc_id, leaf, subroot, root, sha256({proof("path")}) as proof_sha256, folded_root, folded_root = root as verified from folded
"""


QUERIES: dict[str, Plan] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_token_store": op4_token_store,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_language_id": op8_language_id,
    "op9_html_extraction": op9_html_extraction,
    "op10_line_dedup": op10_line_dedup,
    "op10_line_dedup_whole": op10_line_dedup_whole,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_SQL,
    "op5_minhash_dedup": MINHASH_SQL,
    "op7_embedding_dedup": VECTOR_SQL,
    "op10_line_dedup": LINES_SQL,
    "op10_line_dedup_whole": LINES_WHOLE_SQL,
    "op12_merkle_manifest": manifest_sql(),
}
