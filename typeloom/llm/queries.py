"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, licences, media, mixing, packing, phrases, repair, sharding, simhash, substrings, tokens, toxicity, urls
from .shared import scratch_path, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    tokens.write_token_files(_table(spark, sf_dir, "documents"), folder)
    return tokens.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def _packed(docs: DataFrame) -> DataFrame:
    cut = packing.pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(_table(spark, sf_dir, "documents"))


def ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.shard_rows(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


#: (host, path, verdict) of the rules that op5 judges by.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicated(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = media.to_flac(_table(spark, sf_dir, "documents"))
    coded = coded.withColumns({"flac_bytes": F.octet_length("media").cast("long"), "flac_crc32": F.crc32("media")})
    kept = media.write_blocks(media.pcm_blocks(coded), scratch_path(spark, "pcm"))
    size, digest = F.octet_length("pcm").cast("long"), F.sha2("pcm", 256)
    out = media.streams(kept, "stream")
    # What is stored is the blocks of 8-bit samples, so the stored form's size and digest are theirs.
    return out.select(
        "doc_id",
        "n_bytes",
        size.alias("payload_bytes"),
        digest.alias("payload_sha256"),
        F.crc32(F.substring("pcm", -64, 64)).alias("tail_crc32"),
        size.alias("media_bytes"),
        digest.alias("media_sha256"),
        "feature",
        "n_blocks",
        "flac_bytes",
        "flac_crc32",
    )


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(mixing.sized(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "size"), "sizes")
    return mixing.mix(rows).select("doc_id", "size", "source_size", "target", "taken")


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audited(_table(spark, sf_dir, "conversations"))


def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.summary(licences.scan(_table(spark, sf_dir, "documents")))


def licence_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op12's result does not depend on labels of the method."""
    return licence_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def ring_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the law fixes of op4's result: how many rows each shard holds and their slots, and that all rows are there."""
    placed = written(ring_sharding(spark, sf_dir), "placed")
    whole = placed.agg(F.sum("size").alias("all_bytes"), F.countDistinct("doc_id").alias("all_docs")).first()
    by = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("docs"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    return by.withColumns({"all_bytes": F.lit(whole.all_bytes), "all_docs": F.lit(whole.all_docs)})


QUERIES = {
    "op1_token_files": token_files,
    "op2_nearest_neighbours": nearest_neighbours,
    "op3_best_fit_packing": best_fit_packing,
    "op4_ring_sharding": ring_sharding,
    "op5_url_filter": url_filter,
    "op6_substring_dedup": substring_dedup,
    "op7_simhash_groups": simhash_groups,
    "op8_flac_media": flac_media,
    "op9_toxicity": toxicity_scores,
    "op10_source_mix": source_mix,
    "op11_conversation_repair": conversation_repair,
    "op12_licence_scan": licence_scan,
    "op13_phrase_collocations": phrase_collocations,
    "ring_sharding_loads": ring_loads,
    "licence_scan_base": licence_base,
}

ORACLE_SQL = {
    # Which shard a row goes to is the ring's choice; what the law fixes is compared: sizes, texts, and how many rows shards hold.
    "ring_sharding_loads": """
        WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size FROM documents),
        n AS (SELECT count(*) AS n FROM d), s AS (SELECT unnest(range(8)) AS shard)
        SELECT shard::INT AS shard, (n // 8 + (shard < n % 8)::INT)::BIGINT AS docs, 0::BIGINT AS first_slot, (n // 8 + (shard < n % 8)::INT - 1)::BIGINT AS last_slot,
               (SELECT sum(size) FROM d)::BIGINT AS all_bytes, (SELECT count(DISTINCT doc_id) FROM d)::BIGINT AS all_docs
        FROM s, n
    """,
    "op5_url_filter": r"""
        WITH p AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages
        ), r AS (
            SELECT *, CASE WHEN host = 'org' OR suffix(host, '.org') THEN 1 ELSE 0 END AS org,
                   CASE WHEN host = 'com' OR suffix(host, '.com') THEN 1 ELSE 0 END AS com,
                   CASE WHEN host = 'example.org' OR suffix(host, '.example.org') THEN 1 ELSE 0 END AS ex
            FROM p
        ), s AS (
            SELECT page_id, host, path,
                   CASE WHEN ex = 1 AND prefix(path, '/en/1') THEN 'example.org/en/1'
                        WHEN ex = 1 AND prefix(path, '/es/') THEN 'example.org/es/'
                        WHEN com = 1 AND prefix(path, '/fr/') THEN 'com/fr/'
                        WHEN com = 1 AND prefix(path, '/de/') THEN 'com/de/'
                        WHEN org = 1 AND prefix(path, '/') THEN 'org/' END AS rule
            FROM r
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM s
    """,
    "op10_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
        ), k AS (
            SELECT *, ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size::VARCHAR), 1, 15))::BIGINT AS key FROM d
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 + 1 AS w
            FROM d GROUP BY source
        ), o AS (
            SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS weights,
                   coalesce(sum(3 * source_size) OVER before, 0) AS filled, coalesce(sum(w) OVER before, 0) AS used,
                   row_number() OVER (ORDER BY source_size / w, encode(source) ASC NULLS LAST) AS i
            FROM s WINDOW before AS (ORDER BY source_size / w, encode(source) ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), l AS (
            SELECT *, (total - filled)::DOUBLE / (weights - used)::DOUBLE AS level FROM o
        ), c AS (
            SELECT min(i) AS cut, arg_min(level, i) AS level FROM l WHERE w * level <= 3 * source_size
        ), t AS (
            SELECT source, source_size, CASE WHEN i < cut THEN (3 * source_size)::DOUBLE ELSE w * c.level END AS target FROM l, c
        ), g AS (
            SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM t
        ), h AS (
            SELECT source, key, sum(size) AS n, count(*) AS m FROM k GROUP BY source, key
        ), u AS (
            SELECT h.source, h.key, n, m, sum(n) OVER (PARTITION BY h.source ORDER BY key) - n AS before, target - whole * source_size AS part
            FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source
        ), v AS (
            SELECT source, key, CASE WHEN before + n < part THEN m WHEN before >= part THEN 0
                                     ELSE least(floor((part - before) / (n / m) + 0.5), m) END AS more
            FROM u
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY doc_id) AS i FROM k
        )
        SELECT r.doc_id, r.size, g.source_size, g.target, (r.size * (g.whole + (i <= v.more)::BIGINT))::BIGINT AS taken
        FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source
               JOIN v ON r.source IS NOT DISTINCT FROM v.source AND r.key = v.key
    """,
    "licence_scan_base": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM documents
        ), p AS (
            SELECT doc_id, len(ws)::BIGINT AS n_words,
                   list_filter(range(len(ws)), lambda i: ws[i + 1] = 'mit' AND ws[i + 2] = 'license') AS mit,
                   list_filter(range(len(ws)), lambda i: ws[i + 1] = 'apache' AND ws[i + 2] = 'license') AS apache,
                   list_filter(range(len(ws)), lambda i: ws[i + 1] = 'general' AND ws[i + 2] = 'public' AND ws[i + 3] = 'license') AS gpl
            FROM w
        ), q AS (SELECT *, list_concat(list_concat(mit, apache), gpl) AS places FROM p)
        SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
               concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
        FROM q
    """,
    "op13_phrase_collocations": r"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
            FROM documents
        ), p AS (SELECT lang, unnest(ps) AS p FROM d), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p),
        o AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
        g1 AS (SELECT lang, ws[i] AS w1, count(*) AS f FROM o GROUP BY ALL),
        g2 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f FROM o WHERE i + 1 <= len(ws) GROUP BY ALL),
        g3 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f FROM o WHERE i + 2 <= len(ws) GROUP BY ALL HAVING count(*) >= 10),
        t AS (SELECT lang, sum(f)::BIGINT AS n FROM g1 GROUP BY lang),
        x AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM g3 UNION ALL SELECT lang, w2, w3, f FROM g3) GROUP BY ALL),
        two AS (
            SELECT g2.lang, g2.w1 || ' ' || g2.w2 AS phrase, g2.f AS a, a.f AS l, b.f AS r, (1000000::HUGEINT * g2.f * g2.f) // (a.f::HUGEINT * b.f) AS score
            FROM g2 JOIN g1 a ON a.lang = g2.lang AND a.w1 = g2.w1 JOIN g1 b ON b.lang = g2.lang AND b.w1 = g2.w2
                 LEFT JOIN x ON x.lang = g2.lang AND x.w1 = g2.w1 AND x.w2 = g2.w2
            WHERE g2.f >= 10 AND (x.f IS NULL OR 100 * x.f < 50 * g2.f)
        ), cut AS (
            SELECT g3.lang, g3.w1 || ' ' || g3.w2 || ' ' || g3.w3 AS phrase, g3.f AS a, a.f AS l1, bc.f AS r1, ab.f AS l2, c.f AS r2,
                   (1000000::HUGEINT * g3.f * g3.f) // (a.f::HUGEINT * bc.f) AS s1, (1000000::HUGEINT * g3.f * g3.f) // (ab.f::HUGEINT * c.f) AS s2
            FROM g3 JOIN g1 a ON a.lang = g3.lang AND a.w1 = g3.w1 JOIN g1 c ON c.lang = g3.lang AND c.w1 = g3.w3
                 JOIN g2 ab ON ab.lang = g3.lang AND ab.w1 = g3.w1 AND ab.w2 = g3.w2 JOIN g2 bc ON bc.lang = g3.lang AND bc.w1 = g3.w2 AND bc.w2 = g3.w3
        ), every AS (
            SELECT * FROM two UNION ALL
            SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cut
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM every)
        SELECT ranked.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
        FROM ranked JOIN t ON t.lang = ranked.lang WHERE rank <= 2000
    """,
}
