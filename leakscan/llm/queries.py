"""The operators of this package as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leakscan.llm import (
    embedding_dedup, lm_scores, mixture, near_dedup, packing, periodic_runs, pseudonyms, quality, repeats, sentence_pieces, token_alignment,
    token_counts, warc_fixity,
)

VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
#: Stands for a secret that a deployment reads from its own store.
PSEUDONYM_KEY = "example-key-1"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_count_report(_read(spark, sf_dir, "documents"), vocabulary_path())


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary_path())


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_duplicates(_read(spark, sf_dir, "embeddings"))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drill: a replica with known damage, which the audit must find in full."""
    pages = _read(spark, sf_dir, "pages")
    return warc_fixity.fixity_report(pages, warc_fixity.damaged(pages))


def op5_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scores.backoff_scores(_read(spark, sf_dir, "documents"))
    return scores.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_score")})


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonym_report(_read(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_read(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_report(_read(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(_read(spark, sf_dir, "documents"))


def op10_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_report(_read(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; in a tenth of the documents, by a hash of the id, all words from one on repeat with a period."""
    hashed = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8"))
    planted = """
        transform(array(named_struct('w', w, 'a', _g % size(w), 'p', 1 + (size(w) - _g % size(w)) div (3 + _g % 8))),
                  v -> array_join(transform(sequence(0, size(v.w) - 1), i -> v.w[int(if(i < v.a, i, v.a + (i - v.a) % v.p))]), ' '))[0]"""
    split = r"filter(split(text, '[\\x20\\x09-\\x0D]+', -1), x -> x <> '')"
    text = F.expr(f"CASE WHEN _h % 10 = 0 THEN transform(array({split}), w -> if(size(w) > 0, {planted}, ''))[0] ELSE text END")
    return docs.select("doc_id", "text", hashed.alias("_h")).withColumn("_g", F.expr("_h div 10")).select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(periodic_runs.periodic_runs(with_planted_runs(_read(spark, sf_dir, "documents"))))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path(PIECE_MODEL)
    return sentence_pieces.round_trip_report(sentence_pieces.decode(sentence_pieces.encode(_read(spark, sf_dir, "documents"), path), path))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return token_alignment.alignment_report(token_alignment.align_tokens(documents, vocabulary_path(), vocabulary_path(PIECE_MODEL)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_counts, op2_best_fit_packing, op3_embedding_near_dedup, op4_warc_fixity, op5_backoff_scores, op6_pseudonyms, op7_quality_rules,
        op8_minhash_near_dedup, op9_repeated_passages, op10_source_mixture, op11_periodic_runs, op12_sentence_pieces, op13_token_alignment,
    )
    return {query.__name__: query for query in found}


_FIXITY_SQL = """
    WITH records AS (
        SELECT page_id, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS mark, html,
               CAST(octet_length(encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                   || 'WARC-Record-ID: <urn:md5:' || md5(page_id || '|' || url) || '>' || chr(13) || chr(10)
                   || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
                   || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10)
                   || html || chr(13) || chr(10) || chr(13) || chr(10))) AS BIGINT) AS length,
               CAST(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT)
                   % greatest(1, CAST(ceil((SELECT count(*) FROM pages) / 1024) AS BIGINT)) AS INTEGER) AS archive
        FROM pages),
    placed AS (SELECT *, CAST(sum(length) OVER (PARTITION BY archive ORDER BY page_id) - length AS BIGINT) AS "offset" FROM records)
    SELECT archive, page_id, CASE mark WHEN '00' THEN 'changed' ELSE 'missing' END AS kind, "offset", length,
           CAST(1 AS BIGINT) AS primary_copies, CAST(CASE mark WHEN '00' THEN 1 ELSE 0 END AS BIGINT) AS replica_copies
    FROM placed WHERE mark = '01' OR (mark = '00' AND html <> '#' || substr(html, 2))"""


_SCORES_SQL = r"""
    WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
    pairs AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM words),
    c1 AS (SELECT word, count(*) AS n FROM pairs GROUP BY 1),
    c2 AS (SELECT before, word, count(*) AS n FROM pairs WHERE before IS NOT NULL GROUP BY 1, 2),
    o1 AS (SELECT doc_id, word, count(*) AS own FROM pairs GROUP BY 1, 2),
    o2 AS (SELECT doc_id, before, word, count(*) AS own FROM pairs WHERE before IS NOT NULL GROUP BY 1, 2, 3),
    size AS (SELECT doc_id, len(w) AS n_words FROM split),
    total AS (SELECT sum(n_words) AS n FROM size),
    scored AS (
        SELECT p.doc_id, p.before, c1.n - o1.own AS k1, coalesce(c2.n - o2.own, 0) AS k2, h.n - ho.own AS kh, (SELECT n FROM total) - n_words AS rest
        FROM pairs p JOIN size USING (doc_id) JOIN c1 ON p.word = c1.word JOIN o1 ON p.doc_id = o1.doc_id AND p.word = o1.word
        LEFT JOIN c2 ON p.before = c2.before AND p.word = c2.word
        LEFT JOIN o2 ON p.doc_id = o2.doc_id AND p.before = o2.before AND p.word = o2.word
        LEFT JOIN c1 h ON p.before = h.word LEFT JOIN o1 ho ON p.doc_id = ho.doc_id AND p.before = ho.word),
    logs AS (
        SELECT *, ln(CASE WHEN k2 > 0 THEN k2 / CAST(kh AS DOUBLE)
                          ELSE CASE WHEN before IS NULL THEN 1.0 ELSE CAST(0.4 AS DOUBLE) END * CASE WHEN k1 > 0 THEN k1 / CAST(rest AS DOUBLE) ELSE 1 / CAST(rest + 1 AS DOUBLE) END
                     END) AS s FROM scored)
    SELECT size.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(count(*) FILTER (k2 > 0) AS BIGINT) AS n_full,
           CAST(count(*) FILTER (k1 = 0) AS BIGINT) AS n_unseen, round(coalesce(sum(s), 0), 6) AS log_score,
           round(sum(s) / nullif(n_words, 0), 6) AS mean_score
    FROM size LEFT JOIN logs USING (doc_id) GROUP BY size.doc_id, n_words"""


_METRICS = {"word_length": ("word_chars", "n_words", 4000), "symbol_rate": ("n_symbols", "word_chars", 200),
            "line_repeat_rate": ("n_dup_lines", "n_lines", 400), "word_repeat_rate": ("n_repeat_words", "n_words", 250)}
_RATES = ", ".join(f"CASE WHEN {b} = 0 THEN 0 ELSE {a} * 1000 // {b} END AS {m}" for m, (a, b, _) in _METRICS.items())
_ENTRIES = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS metric, {m} AS v, {least} AS least FROM rates" for m, (_, _, least) in _METRICS.items())


def _quartiles_sql(*keys: str) -> str:
    by, names = ", ".join([*keys, "metric"]), ", ".join(["metric", *keys])
    return f"""(SELECT {names}, min(low) FILTER (4 * upto >= size) AS q1, min(low) FILTER (4 * upto >= 3 * size) AS q3, max(size) AS size
        FROM (SELECT {names}, bucket, min(low) AS low, sum(count(*)) OVER (PARTITION BY {by} ORDER BY bucket) AS upto,
                     sum(count(*)) OVER (PARTITION BY {by}) AS size FROM entries GROUP BY {by}, bucket) GROUP BY {by})"""


_QUALITY_SQL = rf"""
    WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    words AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM texts),
    windows AS (SELECT doc_id, i, a, lead(a) OVER d AS b, lead(a, 2) OVER d AS c FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL),
    repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
    lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
    counts AS (
        SELECT t.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
               length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
               len(l) AS n_lines, coalesce(r.n, 0) AS n_repeat_words
        FROM texts t JOIN lines USING (doc_id) LEFT JOIN repeated r ON t.doc_id = r.doc_id),
    rates AS (SELECT *, {_RATES} FROM counts),
    entries AS (
        SELECT *, greatest(0, length(bin(v)) - 6) AS e, 32 * e + (v >> e) AS bucket, (v >> e) << e AS low FROM ({_ENTRIES})),
    fenced AS (
        SELECT x.*, CASE WHEN s.size >= 200 THEN s.q1 WHEN g.size >= 200 THEN g.q1 ELSE a.q1 END AS q1,
               CASE WHEN s.size >= 200 THEN s.q3 WHEN g.size >= 200 THEN g.q3 ELSE a.q3 END AS q3
        FROM entries x JOIN {_quartiles_sql("lang", "source")} s ON x.metric = s.metric AND x.lang IS NOT DISTINCT FROM s.lang AND x.source IS NOT DISTINCT FROM s.source
        JOIN {_quartiles_sql("lang")} g ON x.metric = g.metric AND x.lang IS NOT DISTINCT FROM g.lang JOIN {_quartiles_sql()} a ON x.metric = a.metric),
    verdicts AS (
        SELECT doc_id, bool_and(v <= q3 + greatest(3 * (q3 - q1), least) AND (metric <> 'word_length' OR v >= q1 - greatest(3 * (q3 - q1), least))) AS inside
        FROM fenced GROUP BY doc_id)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
           CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND inside AS kept
    FROM counts JOIN verdicts USING (doc_id)"""

_MIXTURE_SQL = r"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               -ln((CAST('0x' || substr(md5('42|' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
               / CASE WHEN length(text) > 0 THEN greatest(length(regexp_replace(text, '[0-9#*$%&|<>]', '', 'g')) / CAST(length(text) AS DOUBLE), 0.05) ELSE 1 END AS key
        FROM documents),
    sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    ranked AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS most FROM sums),
    leveled AS (
        SELECT *, (CAST((SELECT sum(source_size) FROM sums) AS DOUBLE) - coalesce(sum(most) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM ranked WINDOW r AS (ORDER BY most / weight, source NULLS LAST)),
    plan AS (
        SELECT source, source_size, CASE WHEN most / weight <= level THEN most
               ELSE least(weight * (SELECT max(level) FROM leveled WHERE most / weight > level), most) END AS target FROM leveled),
    part AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs, target - epochs * source_size AS rest FROM plan),
    drawn AS (
        SELECT s.*, source_size, target, epochs, rest, CAST(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest AS BIGINT) AS extra
        FROM sized s JOIN part p ON s.source IS NOT DISTINCT FROM p.source),
    gaps AS (SELECT *, rest - sum(extra * size) OVER (PARTITION BY source) AS gap FROM drawn),
    fills AS (
        SELECT *, extra = 0 AND size > 0 AND abs(size - gap) < gap AND row_number() OVER (
                      PARTITION BY source ORDER BY extra = 0 AND size > 0 AND abs(size - gap) < gap DESC, abs(size - gap), key, doc_id) = 1 AS fill FROM gaps)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(size * CASE WHEN epochs >= 3 THEN 3 ELSE epochs + CASE WHEN fill THEN 1 ELSE extra END END AS BIGINT) AS taken
    FROM fills"""


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": _QUALITY_SQL, "op10_source_mixture": _MIXTURE_SQL, "op5_backoff_scores": _SCORES_SQL, "op4_warc_fixity": _FIXITY_SQL}
