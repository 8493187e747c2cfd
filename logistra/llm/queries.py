"""The queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logistra.llm import (
    byte_bpe,
    decontaminate,
    fingerprint,
    hard_negatives,
    language_id,
    licenses,
    lm_score,
    mixing,
    ngram_join,
    quality,
    ranked_search,
    secrets,
    url_filter,
)
from logistra.llm.frames import table


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.schedule(table(spark, folder, "documents"))


def op10_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.compare_with_edited(table(spark, folder, "documents"))


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    rule = ngram_join.Rule(k=3, num=90, den=100)
    return ngram_join.join_components(table(spark, folder, "documents"), rule)


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A page's outcome is the label of the document of the same number: low quality is bad."""
    outcomes = table(spark, folder, "labels").selectExpr("doc_id AS page_id", "1 - quality AS bad")
    judged = url_filter.verdicts(table(spark, folder, "pages"), outcomes)
    # The last bits of sums depend on the order of rows.
    return judged.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("bad_share", "low")})


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """The target is what is labelled to be of good quality."""
    good = table(spark, folder, "labels").where("quality = 1")
    return lm_score.score(table(spark, folder, "documents"), good)


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets.scan(docs, secrets.train(secrets.corpus_examples(docs)))


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = byte_bpe.Codec(path, public_tokenizers.PATTERN)
    encoded = byte_bpe.encode(table(spark, folder, "documents"), codec)
    return byte_bpe.decode(encoded, codec).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label"
    rows = table(spark, folder, "embeddings").selectExpr("vec_id", "embedding", label)
    return hard_negatives.mine(rows, anchors="vec_id % 100 = 0")


LLM_QUERIES = {
    "op12_hard_negatives": op12_hard_negatives,
    "op11_ranked_search": op11_ranked_search,
    "op13_byte_bpe": op13_byte_bpe,
    "op3_secrets": op3_secrets,
    "op9_lm_score": op9_lm_score,
    "op5_quality": op5_quality,
    "op4_language_id": op4_language_id,
    "op1_decontaminate": op1_decontaminate,
    "op6_licenses": op6_licenses,
    "op7_url_filter": op7_url_filter,
    "op2_ngram_join": op2_ngram_join,
    "op10_fingerprint": op10_fingerprint,
    "op8_mixing": op8_mixing,
}
LLM_ORACLES = {
    "op7_url_filter": r"""
WITH parts AS (
    SELECT page_id,
        CASE WHEN url LIKE '%://%' THEN lower(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*')) ELSE '' END AS host,
        CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM pages
), said AS (
    SELECT doc_id AS page_id, count(*) AS n, sum(1 - quality) AS bad
    FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), hosts AS (
    SELECT host, coalesce(sum(n), 0)::double AS n, coalesce(sum(bad), 0)::double AS bad,
        regexp_extract(host, '[^.]*$') AS suffix, regexp_extract(host, '[^.]*([.][^.]*)?$') AS domain
    FROM parts LEFT JOIN said USING (page_id) GROUP BY host
), domains AS (
    SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix, domain
), suffixes AS (
    SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix
), root AS (
    SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS mean FROM suffixes
), m1 AS (
    SELECT max(mean) AS prior, coalesce(sum(CASE WHEN n > 0 THEN n * pow(bad / n - mean, 2) ELSE 0 END), 0) AS scatter,
        max(mean) * (1 - max(mean)) AS spread, count(*) FILTER (n > 0) AS k, sum(n) AS total, sum(n * n) AS squares
    FROM suffixes CROSS JOIN root
), w1 AS (
    SELECT prior, CASE WHEN k > 1 AND spread > 0 AND scatter > k * spread AND total * total > squares
        THEN greatest(2, least(1000, spread * (total - squares / total) / (scatter - k * spread) - 1)) ELSE 1000 END AS weight
    FROM m1
), p1 AS (
    SELECT suffix, (bad + weight * prior) / (n + weight) AS mean FROM suffixes CROSS JOIN w1
), m2 AS (
    SELECT suffix, max(mean) AS prior, coalesce(sum(CASE WHEN n > 0 THEN n * pow(bad / n - mean, 2) ELSE 0 END), 0) AS scatter,
        max(mean) * (1 - max(mean)) AS spread, count(*) FILTER (n > 0) AS k, sum(n) AS total, sum(n * n) AS squares
    FROM domains JOIN p1 USING (suffix) GROUP BY suffix
), w2 AS (
    SELECT suffix, prior, CASE WHEN k > 1 AND spread > 0 AND scatter > k * spread AND total * total > squares
        THEN greatest(2, least(1000, spread * (total - squares / total) / (scatter - k * spread) - 1)) ELSE 1000 END AS weight
    FROM m2
), p2 AS (
    SELECT domain, (bad + weight * prior) / (n + weight) AS mean FROM domains JOIN w2 USING (suffix)
), m3 AS (
    SELECT domain, max(mean) AS prior, coalesce(sum(CASE WHEN n > 0 THEN n * pow(bad / n - mean, 2) ELSE 0 END), 0) AS scatter,
        max(mean) * (1 - max(mean)) AS spread, count(*) FILTER (n > 0) AS k, sum(n) AS total, sum(n * n) AS squares
    FROM hosts JOIN p2 USING (domain) GROUP BY domain
), w3 AS (
    SELECT domain, prior, CASE WHEN k > 1 AND spread > 0 AND scatter > k * spread AND total * total > squares
        THEN greatest(2, least(1000, spread * (total - squares / total) / (scatter - k * spread) - 1)) ELSE 1000 END AS weight
    FROM m3
), p3 AS (
    SELECT host, n, weight, (bad + weight * prior) / (n + weight) AS mean FROM hosts JOIN w3 USING (domain)
), judged AS (
    SELECT host, mean, mean - 1.645 * sqrt(mean * (1 - mean) / (n + weight + 1)) AS low FROM p3
), ruled AS (
    SELECT page_id, host, path, mean, low, CASE
        WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
    FROM parts JOIN judged USING (host)
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block' WHEN low > 0.25 THEN 'block' ELSE 'allow' END AS verdict,
    round(mean, 6) + 0.0 AS bad_share, round(low, 6) + 0.0 AS low
FROM ruled
""",
    "op8_mixing": r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(md5(CAST(doc_id AS varchar)), '') AS place, coalesce(md5(text), '') AS content,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
    FROM documents
), totals AS (
    SELECT source, CAST(sum(size) AS bigint) AS source_size FROM sized GROUP BY source
), ranked AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n,
        2 * CAST(source_size AS double) AS cap, 1.5::double * sum(source_size) OVER () AS words
    FROM totals
), weighted AS (
    SELECT *, CASE n % 3 WHEN 0 THEN 3::double WHEN 1 THEN 1::double ELSE 2::double END AS weight,
        CASE n % 3 WHEN 0 THEN 0.5::double WHEN 1 THEN 0::double ELSE -0.5::double END AS tilt
    FROM ranked
), stepped AS (
    SELECT *, row_number() OVER (ORDER BY cap / weight, n) AS step FROM weighted
), levelled AS (
    SELECT *,
        words - coalesce(sum(cap) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
        sum(weight) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
    FROM stepped
), level AS (
    SELECT arg_min(words_left / weight_left, step) AS level, min(step) AS first_step
    FROM levelled WHERE words_left / weight_left * weight < cap
), targets AS (
    SELECT source, source_size, tilt,
        CASE WHEN step < coalesce(first_step, step + 1) THEN cap ELSE weight * level END AS target
    FROM levelled CROSS JOIN level
), started AS (
    SELECT doc_id, size, source_size, target, tilt, CAST(floor(target) AS bigint) AS wanted,
        CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, content, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), parts AS (
    SELECT *, greatest(0, least(size, wanted - start)) AS once,
        greatest(0, least(size, wanted - start - source_size)) AS twice,
        start / target AS y1, (start + source_size) / target AS y2
    FROM started
)
SELECT doc_id, CAST(size AS bigint) AS size, source_size, target, CAST(once + twice AS bigint) AS taken,
    CASE WHEN once > 0 THEN 2 * y1 / (1 - tilt + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * y1)) END AS position,
    CASE WHEN twice > 0 THEN 2 * y2 / (1 - tilt + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * y2)) END AS second_position
FROM parts
""",
    "op11_ranked_search": r"""
WITH docs AS (
    SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), items AS (
    SELECT row_number() OVER () AS query, item_id, unnest(list_distinct(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
    FROM benchmark
), totals AS (
    SELECT count(*) FILTER (len(terms) > 0) AS documents, CAST(sum(len(terms)) AS bigint) AS words FROM docs
), found AS (
    SELECT place, doc_id, term, n, count(*) AS tf
    FROM (SELECT place, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM items) GROUP BY ALL
), weighted AS (
    SELECT term, CAST(floor(1000 * ln((2 * documents + 2)::double / (2 * count(*) + 1)::double)) AS bigint) AS weight
    FROM found CROSS JOIN totals GROUP BY term, documents
), impacts AS (
    SELECT place, doc_id, term,
        weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * documents) // words))) AS impact
    FROM found JOIN weighted USING (term) CROSS JOIN totals
), scored AS (
    SELECT query, item_id, place, doc_id, CAST(sum(impact) AS bigint) AS score
    FROM items JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS integer) AS rank, doc_id, score
FROM scored QUALIFY rank <= 50
""",
    "op12_hard_negatives": r"""
WITH vectors AS (
    SELECT row_number() OVER () AS place, vec_id,
        CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::double) for x in embedding] AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
    SELECT a.place AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.place AS place, b.vec_id AS vec_id,
        CAST(list_inner_product(a.v, b.v) AS bigint) AS score
    FROM vectors a JOIN vectors b ON a.place <> b.place
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor, anchor_id, place AS positive, vec_id AS positive_id, score AS positive_score
    FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, vec_id) AS integer) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n USING (anchor, anchor_id)
WHERE NOT n.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
""",
}
