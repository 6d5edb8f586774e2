"""The queries of the text operators, with their production parameters, and SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import decontam, langid, licenses, line_dedup, line_rules, packing, prefix_trie, quality_rank, resampling, simhash, suffix_lm, toxicity, warc
from tidegrid.llm.common import bound_batches, crc_fold, scratch, staged
from tidegrid.session import ship

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def held_out(folds: int, rest: int):
    """crc32(doc_id) modulo folds is rest; false without doc_id."""
    return F.coalesce(crc_fold(F.col("doc_id"), folds) == rest, F.lit(False)).alias("held_out")


def cleared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its result written, and all that it staged for itself deleted."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark) as clear:
            found = staged(query(spark, sf_dir), query.__name__)
            clear()
        return found

    return run


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rank.train(docs, table(spark, sf_dir, "labels"), fold=(4, 2))
    found = quality_rank.score_quality(docs.select("doc_id", "text"), model)
    score = F.col("quality_score")
    return found.select("doc_id", held_out(4, 2), score.alias("score"), (score >= quality_rank.CUT).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold=(5, 0))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(5, 0), "lang_pred", F.col("lang_score").alias("score"))


def op5_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@cleared
def op7_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score_documents(table(spark, sf_dir, "documents"), fold=(5, 1))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold=(5, 0))
    found = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    score = F.col("toxic_score")
    return found.select("doc_id", held_out(5, 0), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = line_rules.apply_rules(docs.select("doc_id", "text"), line_rules.train(docs))
    return found.select("doc_id", *line_rules.NAMES[:-1])


@cleared
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


@cleared
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@cleared
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@cleared
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_tree(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_best_fit_packing, op3_quality_ranking, op4_language_id, op5_warc_convert,
        op6_simhash_dedup, op7_suffix_tree_lm, op8_toxicity, op9_line_rules, op10_decontamination,
        op11_importance_resampling, op12_line_dedup, op13_prefix_trie,
    )
}

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

#: The CRC-32 of a text column, bit by bit over its bytes.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode({x})) + 1), lambda i: ('0x' || substr(hex(encode({x})), 2 * i - 1, 2))::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, k: xor(r >> 1, 3988292384::BIGINT * (r & 1)))), 4294967295::BIGINT)"
)

ORACLES = {
    "op5_warc_convert": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), d AS (
            SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p
        ), f AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first <> page_id THEN first END AS refers_to
        FROM f""",
    "op10_decontamination": f"""
        WITH b AS (
            SELECT item_id, {_WORDS} AS w FROM benchmark
        ), bw AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
        ), d AS (
            SELECT doc_id, text, {_WORDS} AS w FROM documents
        ), sizes AS (
            SELECT DISTINCT n FROM bw
        ), dw AS (
            SELECT doc_id, text, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
            FROM (SELECT doc_id, text, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)
        ), m AS (
            SELECT DISTINCT doc_id, text, item_id, s, dw.n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
        ), hit AS (
            SELECT doc_id, text, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, text, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id, text
        ), it AS (
            SELECT doc_id, text, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
            FROM (SELECT DISTINCT doc_id, text, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id, text
        ), dd AS (
            SELECT doc_id, text, w, count(*) AS copies, row_number() OVER () AS k FROM d GROUP BY doc_id, text, w
        ), dp AS (
            SELECT k, copies, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM dd
        ), fr AS (
            SELECT term, sum(copies) AS f FROM dp GROUP BY term
        ), bi AS (
            SELECT item_id, w, row_number() OVER () AS ik FROM (SELECT DISTINCT item_id, w FROM b WHERE len(w) > 0)
        ), bp AS (
            SELECT ik, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS ipos FROM bi
        ), win AS (
            SELECT ik, least(len(w), 10) AS n, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM bi
        ), rk AS (
            SELECT win.ik, s, n, ipos, bp.term, row_number() OVER (PARTITION BY win.ik, s ORDER BY coalesce(f, 0), ipos) AS r
            FROM win JOIN bp ON bp.ik = win.ik AND ipos BETWEEN s AND s + n - 1 LEFT JOIN fr ON fr.term = bp.term
        ), cand AS (
            SELECT DISTINCT k, ik, s, n, pos - ipos AS dg FROM rk JOIN dp ON dp.term = rk.term WHERE r <= CASE WHEN n = 10 THEN 2 ELSE 1 END
        ), nr AS (
            SELECT cand.k, cand.ik FROM cand JOIN bp ON bp.ik = cand.ik AND ipos BETWEEN s AND s + n - 1
                JOIN dp ON dp.k = cand.k AND dp.term = bp.term AND abs(dp.pos - ipos - dg) <= 3
            GROUP BY cand.k, cand.ik, s, n, dg HAVING count(DISTINCT ipos) >= n - CASE WHEN n = 10 THEN 1 ELSE 0 END
        ), ni AS (
            SELECT doc_id, text, count(*) AS n_near, string_agg(i, ',' ORDER BY i) AS near_items
            FROM (SELECT DISTINCT doc_id, text, CAST(item_id AS VARCHAR) AS i FROM nr JOIN bi ON bi.ik = nr.ik JOIN dd ON dd.k = nr.k) GROUP BY doc_id, text
        )
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
            CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(near_items, '') AS near_items
        FROM d LEFT JOIN hit ON hit.doc_id IS NOT DISTINCT FROM d.doc_id AND hit.text IS NOT DISTINCT FROM d.text
            LEFT JOIN it ON it.doc_id IS NOT DISTINCT FROM d.doc_id AND it.text IS NOT DISTINCT FROM d.text
            LEFT JOIN ni ON ni.doc_id IS NOT DISTINCT FROM d.doc_id AND ni.text IS NOT DISTINCT FROM d.text""",
    "op11_importance_resampling": f"""
        WITH tab AS (
            SELECT list(list_reduce(list_prepend(n, range(8)), lambda r, k: xor(r >> 1, 3988292384::BIGINT * (r & 1))) ORDER BY n) AS tab FROM range(256) AS t(n)
        ), d AS (
            SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents
        ), b AS (
            SELECT -row_number() OVER () AS row, {_WORDS} AS w FROM benchmark
        ), runs AS (
            SELECT row, array_to_string(w[s:s + n - 1], ' ') AS f
            FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT row, w FROM d UNION ALL SELECT row, w FROM b), range(1, 4) AS t(n) WHERE len(w) >= n)
        ), counts AS (
            SELECT row, f, count(*) AS n FROM runs GROUP BY row, f
        ), dict AS (
            SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
                lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
            FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counts)), tab
        ), own AS (
            SELECT row, bucket, sum(n) AS n FROM counts JOIN dict ON dict.f = counts.f GROUP BY row, bucket
        ), buckets AS (
            SELECT bucket, coalesce(sum(n) FILTER (WHERE row > 0), 0) AS s, coalesce(sum(n) FILTER (WHERE row < 0), 0) AS t FROM own GROUP BY bucket
        ), gain AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM buckets
        ), weights AS (
            SELECT row, sum(n) AS n_features, sum(n * g) AS weight FROM own JOIN gain ON gain.bucket = own.bucket WHERE row > 0 GROUP BY row
        ), scored AS (
            SELECT d.row, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM d LEFT JOIN weights ON weights.row = d.row
        ), ranked AS (
            SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER () AS able FROM scored WHERE n_words >= 20
        )
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN r <= 5 * able // 100 THEN r END AS rank
        FROM scored LEFT JOIN ranked ON ranked.row = scored.row""",
    "op12_line_dedup": """
        WITH r AS (
            SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), x AS (
            SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM r
        ), k AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x
        ), f AS (
            SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 2
        ), m AS (
            SELECT row, line, pos, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM first AS gone FROM k LEFT JOIN f ON f.key = k.key
        ), t AS (
            SELECT row, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY row
        )
        SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM r JOIN t ON t.row = r.row""",
    "op13_prefix_trie": f"""
        WITH c AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS r
            FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (
            SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC.format(x="conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM c)
        ), turns AS (
            SELECT ids.conv_id, 0 AS part, r, role, text FROM ids JOIN c ON c.conv_id = base AND r <= h
            UNION ALL SELECT ids.conv_id, 1, r, role, text FROM ids JOIN c ON c.conv_id = ids.conv_id AND r > h
        ), n AS (
            SELECT conv_id, text, length(role) || ':' || role || length(text) || ':' || text AS x, row_number() OVER (PARTITION BY conv_id ORDER BY part, r) AS d FROM turns
        ), p AS (
            SELECT conv_id, d, text, string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY d) AS p FROM n
            UNION ALL SELECT conv_id, 0, '', '' FROM ids
        ), node AS (
            SELECT d, p, min(conv_id) AS owner, count(*) AS n_convs, length(any_value(text)) AS cost FROM p GROUP BY d, p
        ), m AS (
            SELECT p.conv_id, p.d, owner, n_convs, cost FROM p JOIN node ON node.d = p.d AND node.p = p.p
        ), size AS (
            SELECT conv_id, max(d) AS length FROM p GROUP BY conv_id
        ), kin AS (
            SELECT b.owner AS po, b.d AS pd, count(DISTINCT a.owner) AS n_children FROM m a JOIN m b ON b.conv_id = a.conv_id AND b.d = a.d - 1 WHERE a.conv_id = a.owner GROUP BY 1, 2
        ), own AS (
            SELECT owner, d, n_convs, (n_convs - 1) * cost AS saved, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN kin ON po = owner AND pd = d WHERE m.conv_id = owner
        ), up AS (
            SELECT b.owner, b.d, sum(own.saved) AS saved_tokens, count(*) FILTER (WHERE own.n_children = 0) AS n_leaves
            FROM own JOIN m b ON b.conv_id = own.owner AND b.d <= own.d GROUP BY 1, 2
        ), e AS (
            SELECT m.owner, m.d, string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) AS ids FROM m JOIN size ON size.conv_id = m.conv_id AND length = m.d GROUP BY 1, 2
        ), par AS (
            SELECT a.owner, a.d, b.owner AS parent FROM m a JOIN m b ON b.conv_id = a.conv_id AND b.d = a.d - 1 WHERE a.conv_id = a.owner
        )
        SELECT own.owner AS conv_id, CAST(own.d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM own JOIN up ON up.owner = own.owner AND up.d = own.d LEFT JOIN e ON e.owner = own.owner AND e.d = own.d LEFT JOIN par ON par.owner = own.owner AND par.d = own.d""",
}
