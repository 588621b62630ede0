"""One query for each operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .chat import link_calls, turns_as_calls
from .collocations import collocations
from .decontaminate import find_leaks
from .jaccard import jaccard_components
from .language import fit, predict
from .lexical import ranked_search
from .mixing import mix_sources
from .quality import score_quality
from .secret_scan import BASE_KINDS, scan_secrets
from .sharding import shard_rows
from .suffix_dedup import remove_repeats
from .topk import exact_topk
from .url_filter import judge_urls

# The URL rules and the listed hosts.
URL_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
URL_BLOCKED = (
    "ads-track.example.com/", "spam-farm.example.org/", "casino-win.example.net/", "adult-x.example.com/",
    "cheap-pills.example.net/", "cheap-pills.example.com/", "free-bets.example.net/",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def secret_digest(documents: DataFrame) -> DataFrame:
    """Per document the number of base secrets of each kind, a digest of them, and all spans as text."""
    listed = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    base_text = F.array_join(F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return scan_secrets(documents).select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(base_text, 256).alias("base_sha256"), F.array_join(listed, ",").alias("spans"),
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def fold(id_col: str, folds: int):
    """CRC-32 of an id as text, modulo the number of folds; a null id is in no fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    scored = score_quality(table(spark, sf_dir, "documents"), learn)
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"))
    pieces = F.array_sort("pieces")
    listed = F.transform(pieces, lambda p: F.concat_ws(":", p["shard"], p["epoch"], p["word_from"], p["word_to"]))
    return mix.select(
        "doc_id", "source", "size", "source_size", "target", "taken",
        F.coalesce(F.array_join(listed, ","), F.lit("")).alias("slices"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents.where(fold("doc_id", 4) != 2).select("text", "lang"))
    return predict(documents.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, URL_BLOCKED)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# The tool that a user turn calls, and its arguments.
CHAT_SCHEMAS = {"respond": {"text": ("string", True), "turn": ("integer", True)}}


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(turns_as_calls(table(spark, sf_dir, "conversations")), CHAT_SCHEMAS)


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=100, top=2000)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents"), shards=24, grown=25)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_source_mixing": op4_source_mixing,
    "op5_secret_scans": op5_secret_scans,
    "op6_language_id": op6_language_id,
    "op7_url_filters": op7_url_filters,
    "op8_exact_topk": op8_exact_topk,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_ranked_lexical_search": op11_ranked_lexical_search,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_sharding": op13_sharding,
}


def _url_sql() -> str:
    def fits(rule: str) -> str:
        host, path = rule.split("/", 1)
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"

    longest = sorted(URL_RULES, key=lambda r: (-len(r[1]), -r[1].index("/")))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in longest)
    listed = " OR ".join(fits(r) for r in URL_BLOCKED)
    return f"""
WITH parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict
FROM parsed
"""


_TOPK_SQL = """
WITH parts AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_CHAT_SQL = """
WITH rows AS (
  SELECT conv_id, turn, role, text,
         CASE WHEN role = 'user' THEN conv_id || ':' || turn END AS call_id,
         CASE WHEN role = 'assistant' THEN conv_id || ':' || (turn - 1) END AS result_of
  FROM conversations),
first AS (
  SELECT conv_id, call_id, min(turn) AS call_turn FROM rows
  WHERE call_id IS NOT NULL AND conv_id IS NOT NULL GROUP BY ALL),
linked AS (
  SELECT r.*, f.call_id IS NOT NULL AS is_result, f.call_turn
  FROM rows r LEFT JOIN first f ON r.conv_id = f.conv_id AND r.result_of = f.call_id)
SELECT conv_id, turn,
       CASE WHEN call_id IS NOT NULL THEN 'call' WHEN is_result THEN 'result' ELSE 'message' END AS kind,
       coalesce(call_id, CASE WHEN is_result THEN result_of END) AS call_id,
       call_turn, CASE WHEN is_result THEN greatest(turn, call_turn) ELSE turn END AS order_turn,
       CASE WHEN is_result THEN 1 ELSE 0 END AS order_step,
       CASE WHEN call_id IS NOT NULL THEN text IS NOT NULL END AS valid,
       CASE WHEN call_id IS NOT NULL THEN '{"arguments":{' || coalesce('"text":' || to_json(text)::VARCHAR || ',', '')
                 || '"turn":' || turn || '},"id":"' || call_id || '","name":"respond","role":"user","turn":' || turn
                 || ',"valid":' || (text IS NOT NULL) || '}'
            ELSE '{' || coalesce('"content":' || to_json(text)::VARCHAR || ',', '')
                 || CASE WHEN is_result THEN '"result_of":"' || result_of || '",' ELSE '' END
                 || '"role":' || to_json(role)::VARCHAR || ',"turn":' || turn || '}' END AS json
FROM linked
"""

_LEAK_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark),
shingles AS (
  SELECT DISTINCT side, id, array_to_string(w[i:i + 4], ' ') AS s
  FROM words, unnest(range(1, greatest(1, len(w) - 4) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT id AS item_id, count(*) AS n FROM shingles WHERE side = 'i' GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS k
  FROM shingles d JOIN shingles i ON d.side = 'd' AND i.side = 'i' AND d.s = i.s GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS INT) AS n_shingles, CAST(k AS INT) AS n_shared, k / n AS containment
FROM shared JOIN sizes USING (item_id) WHERE 5 * k >= 4 * n
"""

_JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM words, unnest(range(1, greatest(1, len(w) - 2) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS other FROM words
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

_REPEATS_SQL = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS w FROM docs, unnest(range(0, n - 99)) t(p)),
later AS (
  SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1),
marked AS (
  SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM later),
runs AS (
  SELECT doc_id, min(p) AS b, max(p) + 100 AS e
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked) GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS g, b AS g_end FROM runs
  UNION ALL SELECT doc_id, max(e), NULL FROM runs GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * g + 1, 2 * (coalesce(g_end, n) - g)), '' ORDER BY g) AS k
  FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, sum(e - b) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

_LEXICAL_SQL = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS place, text FROM documents
  UNION ALL SELECT 'i', item_id, row_number() OVER (), text FROM benchmark),
terms AS (
  SELECT side, id, place, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM texts),
docs AS (SELECT id AS doc_id, place, len(w) AS n, w FROM terms WHERE side = 'd' AND len(w) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n) AS n_terms FROM docs),
asked AS (
  SELECT id AS item_id, place AS item, w, count(*) AS m
  FROM (SELECT id, place, unnest(w) AS w FROM terms WHERE side = 'i') GROUP BY ALL),
postings AS (
  SELECT doc_id, place, w, n, count(*) AS tf
  FROM (SELECT doc_id, place, n, unnest(w) AS w FROM docs) SEMI JOIN asked USING (w) GROUP BY ALL),
weights AS (
  SELECT w, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM postings, totals GROUP BY w, n_docs),
scored AS (
  SELECT item_id, item, doc_id, place, CAST(sum(m * weight
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (w) JOIN postings USING (w), totals GROUP BY item_id, item, doc_id, place),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INT) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

_COLLOCATION_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM docs),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM pieces, (VALUES (1), (2), (3), (4), (5)) ks(k), unnest(range(1, len(w) - k + 2)) t(i)),
f AS (SELECT lang, k, p, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, k, p, a, string_split(p, ' ') AS w FROM f WHERE k > 1),
cuts AS (
  SELECT c.lang, c.k, c.p, c.a, t.cut, l.a AS l, r.a AS r, totals.n,
         (CAST(1000 AS HUGEINT) * c.a * totals.n) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM candidates c, unnest(range(1, c.k)) t(cut), f l, f r, totals
  WHERE totals.lang = c.lang AND l.lang = c.lang AND l.p = array_to_string(c.w[1:t.cut], ' ')
    AND r.lang = c.lang AND r.p = array_to_string(c.w[t.cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
held AS (
  SELECT DISTINCT s.lang, s.p FROM candidates x, unnest(range(2, x.k)) a(m), unnest(range(1, x.k - a.m + 2)) b(i), candidates s
  WHERE s.lang = x.lang AND s.p = array_to_string(x.w[b.i:b.i + a.m - 1], ' ') AND 100 * x.a >= 100 * s.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(p)) AS rank
  FROM best ANTI JOIN held USING (lang, p))
SELECT lang, rank, p AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

_SHARD_SQL = """
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h
  FROM documents),
steps AS (
  SELECT list(CAST(c AS BIGINT) ORDER BY i) AS step FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) t(i))),
crc AS (
  SELECT r, 4294967295 AS c, 0 AS pos FROM texts
  UNION ALL
  SELECT r, list_reduce(
           [c] || list_transform(range(pos, least(pos + 4096, n)), lambda p: CAST('0x' || substr(h, 2 * p + 1, 2) AS BIGINT)),
           lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), pos + 4096
  FROM crc JOIN texts USING (r), steps WHERE pos < n),
sums AS (SELECT r, xor(arg_max(c, pos), 4294967295) AS text_crc32 FROM crc GROUP BY r),
jumps AS (
  SELECT r, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UHUGEINT) AS key, -1 AS shard, 0 AS next
  FROM texts
  UNION ALL
  SELECT r, k, next, CAST(floor((next + 1) * (2147483648.0::DOUBLE / CAST((k // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT r, next, (key * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS k FROM jumps WHERE next < 25)),
placed AS (
  SELECT r, CAST(max(shard) FILTER (shard < 24) AS INT) AS shard, CAST(max(shard) AS INT) AS grown_shard FROM jumps GROUP BY r)
SELECT doc_id, n + 8 AS size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, text_crc32, n) - 1 AS slot
FROM texts JOIN sums USING (r) JOIN placed USING (r)
"""

ORACLE_SQL = {
    "op1_decontamination": _LEAK_SQL,
    "op3_ngram_jaccard": _JACCARD_SQL,
    "op9_suffix_dedup": _REPEATS_SQL,
    "op10_chat_formatting": _CHAT_SQL,
    "op7_url_filters": _url_sql(),
    "op8_exact_topk": _TOPK_SQL,
    "op11_ranked_lexical_search": _LEXICAL_SQL,
    "op12_phrase_collocations": _COLLOCATION_SQL,
    "op13_sharding": _SHARD_SQL,
}
