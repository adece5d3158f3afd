"""Queries over the corpus tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from netloom.llm.html_text import extract_main_text
from netloom.llm.language import held_out, identify_language, train_prototypes
from netloom.llm.licenses import license_scan
from netloom.llm.merkle import folded, merkle_manifest, proof_digest
from netloom.llm.mixing import mix_sources, mixing_sql
from netloom.llm.packing import best_fit_packing
from netloom.llm.prefix_bpe import encode_and_decode
from netloom.llm.shingle_join import jaccard_components
from netloom.llm.suffix_dedup import remove_repeats
from netloom.llm.token_shards import token_id_output
from netloom.llm.vectors import exact_top_k, near_duplicate_vectors
from netloom.llm.whitening import whitened_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"), "html", ["page_id", "url"])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    prototypes = train_prototypes(docs.where(~held_out()).where("doc_id is not null"))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify_language(rows, prototypes, "text", ["doc_id", "held_out"])


def op4_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"), 5, 50, 256)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), 0.98)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_id_output(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, 1024)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # Decimal, so that one more than the largest number is no overflow.
    changes = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", changes, changed)
    rows = rows.withColumn("folded_root", folded(F.col("presented"), F.col("proof")))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_vectors(_table(spark, sf_dir, "embeddings"), 64, 1_000_000, 32)


def op13_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_html_extraction, op3_language_id, op4_voronoi_top_k, op5_embedding_near_dedup, op6_source_mixing, op7_token_ids, op8_best_fit_packing, op9_license_scan, op10_suffix_array_dedup, op11_merkle_manifest, op12_embedding_whitening, op13_bpe_encoding)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Links to every row that is reached from a row, ``edge (a, b)`` in both directions.
_REACH = "reach(id, other) as (select id, id from vertex union select r.id, e.b from reach r join edge e on r.other = e.a)"

SHINGLE_SQL = rf"""with recursive words as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
 sets as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
 vertex as (select doc_id as id, coalesce(len(s), 0) as n from sets), single as (select doc_id, unnest(s) as x from sets),
 pairs as (select a.doc_id as a, b.doc_id as b, count(*) as both_n from single a join single b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
 linked as (select a, b from pairs join vertex v on v.id = a join vertex u on u.id = b where 100 * both_n >= 80 * (v.n + u.n - both_n)),
 edge as (select a, b from linked union all select b as a, a as b from linked), {_REACH}
 select id as doc_id, cast(max(n) as bigint) as n_shingles, min(other) as component_id from reach join vertex using (id) group by id"""

_USABLE = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

TOP_SQL = f"""with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x from embeddings where {_USABLE}),
 s as (select q.vec_id as query_id, v.vec_id, cast(list_dot_product(q.x, v.x) as bigint) as score from v q join v on v.vec_id <> q.vec_id and len(q.x) = len(v.x) where q.vec_id % 50 = 0),
 r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s) select * from r where rank <= 5"""

NEAR_SQL = f"""with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as x from embeddings where label is not null and {_USABLE}),
 linked as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_dot_product(a.x, a.x) > 0 and list_dot_product(b.x, b.x) > 0 and list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98e0),
 vertex as (select vec_id as id from embeddings), edge as (select a, b from linked), {_REACH}, parts as (select id, min(other) as component_id from reach group by id), counts as (select a, count(*) as n from edge group by a)
 select id as vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, id = component_id as kept from parts left join counts on a = id"""

REPEATS_SQL = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents), b as (select doc_id, h, cast(length(h) / 2 as bigint) as n from d),
 c as (select doc_id, n, c, substr(h, 4000 * c + 1, 4198) as h from (select doc_id, n, h, unnest(range(0, (n + 1999) // 2000)) as c from b) q),
 w as (select doc_id, 2000 * c + t as s, md5(substr(h, 2 * t + 1, 200)) as k from (select doc_id, c, h, unnest(range(0, least(2000, n - 99 - 2000 * c))) as t from c where n - 99 > 2000 * c) q),
 f as (select k, min({'doc': doc_id, 's': s}) as first from w group by k having count(*) > 1), r as (select w.doc_id, w.s from w join f using (k) where w.doc_id <> f.first.doc or w.s <> f.first.s),
 g as (select *, sum(case when s <= before + 100 then 0 else 1 end) over (partition by doc_id order by s) as run from (select *, lag(s) over (partition by doc_id order by s) as before from r) q),
 i as (select doc_id, min(s) as a, max(s) + 100 as b from g group by doc_id, run), j as (select *, lag(b, 1, 0) over (partition by doc_id order by a) as start, row_number() over (partition by doc_id order by a desc) as from_end from i),
 p as (select j.doc_id, string_agg(substr(h, 2 * start + 1, 2 * (a - start)), '' order by a) || max(case when from_end = 1 then substr(h, 2 * j.b + 1) end) as kept, sum(j.b - a) as removed, count(*) as spans from j join b on b.doc_id = j.doc_id group by j.doc_id)
 select b.doc_id, b.n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from b left join p on p.doc_id = b.doc_id"""


def _levels_sql(name: str, key: str, start: str) -> str:
    """A tree as one list of digests for each level, the leaves at level 0."""
    rise = "list_transform(range(1, len(l) + 1, 2), lambda i: sha256(l[i] || coalesce(l[i + 1], '')))"
    return f"{name}({key}, level, l) as ({start} union all select {key}, level + 1, {rise} from {name} where len(l) > 1)"


def _siblings_sql(place: str) -> str:
    return f"list(coalesce(case when ({place} >> level) & 1 = 1 then 'l' else 'r' end || l[xor({place} >> level, 1) + 1], '') order by level)"


def _leaf_sql(n_chars: str) -> str:
    fields = ["cast(doc_id as varchar)", "source", "lang", f"cast({n_chars} as varchar)", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


MERKLE_SQL = f"""with recursive t as (select list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
 c as (select d.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1]))) as crc from documents d, t),
 h as (select doc_id, lang, {_leaf_sql("n_chars")} as leaf, case when crc % 7 = 0 then {_leaf_sql("(cast(n_chars as hugeint) + 1)")} end as other from c),
 p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place from h),
 {_levels_sql("tree", "lang", "select lang, 0, list(leaf order by place) from p group by lang")},
 subroots as (select lang, l[1] as subroot, row_number() over (order by lang nulls first) - 1 as place from tree where len(l) = 1),
 {_levels_sql("top", "one", "select 1, 0, list(subroot order by place) from subroots")},
 above as (select s.lang, s.subroot, (select l[1] from top where len(l) = 1) as root, {_siblings_sql("s.place")} filter (len(l) > 1) as path from subroots s, top group by s.lang, s.subroot, s.place),
 below as (select p.doc_id, p.leaf, p.other, p.lang, p.place, {_siblings_sql("p.place")} filter (len(l) > 1) as path from p join tree on p.lang is not distinct from tree.lang group by all),
 w as (select doc_id, leaf, coalesce(other, leaf) as shown, subroot, root, coalesce(below.path, []) || coalesce(above.path, []) as path from below join above on below.lang is not distinct from above.lang),
 f as (select *, list_reduce(list_prepend(shown, path), lambda h, s: sha256(case when s[1] = 'l' then s[2:] || h when s[1] = 'r' then h || s[2:] else h end)) as folded_root from w)
 select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified from f"""

#: Tokenizers, eigenvectors, profiles, densities and expressions are beyond SQL; tests hold those queries against plain Python.
ORACLE_SQL = {
    "op1_ngram_jaccard_join": SHINGLE_SQL,
    "op4_voronoi_top_k": TOP_SQL,
    "op5_embedding_near_dedup": NEAR_SQL,
    "op6_source_mixing": mixing_sql("documents"),
    "op10_suffix_array_dedup": REPEATS_SQL,
    "op11_merkle_manifest": MERKLE_SQL,
}
