"""The queries of the text operators over the test tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.llm.common import table, whole_text

QUERIES = {}
ORACLES = {}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


@query()
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakestrata.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept", "n_copies", "n_links")


@query(
    f"""
    WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
    """
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakestrata.llm.exact_dedup import exact_dedup

    return exact_dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet")


WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    f"""
    WITH l AS (
        SELECT doc_id, i, line, translate(trim(line, {WHITE_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                     generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
    ),
    r AS (SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
    m AS (SELECT doc_id, i, line, holder IS NOT NULL AND doc_id <> holder AS lost FROM l LEFT JOIN r USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """
)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakestrata.llm.line_dedup import drop_repeated_lines

    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.col("line_count").alias("n_lines"),
        F.col("lines_dropped").alias("n_dropped"),
        F.sha2(whole_text().cast("binary"), 256).alias("kept_sha256"),
    )


VOCABULARY = "byte_bpe_50k.json"
MOST_TOKENS = 1024


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lakestrata.llm.token_counts import token_counts

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return counts.withColumn("over_limit", F.col("n_tokens") > MOST_TOKENS)


WORDS_SQL = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS_SQL} AS w FROM documents),
    b AS (SELECT item_id, w, least(len(w), 13) AS k FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS p
           FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
    dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
           FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b))),
    m AS (SELECT r, k, i, item_id FROM dw JOIN bw USING (k, p)),
    h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS x FROM m) GROUP BY r),
    t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
    """
)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakestrata.llm.decontaminate import decontaminate, is_contaminated

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


TOXIC = 0.7


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakestrata.llm.common import fold
    from lakestrata.llm.toxicity import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted")
    )


@query()
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakestrata.llm.common import fold
    from lakestrata.llm.quality import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


ESCAPED = "regexp_replace(coalesce({}, ''), '([\\\\<\\[\\]])', '\\\\\\1', 'g')"
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query(
    f"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(9 + length({ESCAPED.format('role')}) + length({ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id
    """
)
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakestrata.llm.chat import chat_tree, digests, read_back

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    stream, index = chat_tree(given.unionByName(spark.createDataFrame(more, given.schema)))
    return digests(read_back(stream, index))


@query()
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakestrata.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query()
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakestrata.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages"))


@query(
    f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    x AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
    t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM x GROUP BY lang),
    f AS (SELECT lang, k, phrase, count(*) AS f
          FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
                FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM x, range(1, 6) AS s(k) WHERE len(w) >= k))
          GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    u AS (SELECT lang, phrase, k, a, w, unnest(range(1, k)) AS j FROM c),
    s AS (SELECT u.lang, u.phrase, u.a, j, y.f AS l, z.f AS r, n,
                 CAST((1000::HUGEINT * u.a * n) // (y.f::HUGEINT * z.f) AS BIGINT) AS score
          FROM u JOIN t USING (lang)
          JOIN f AS y ON y.lang = u.lang AND y.phrase = array_to_string(w[:j], ' ')
          JOIN f AS z ON z.lang = u.lang AND z.phrase = array_to_string(w[j + 1:], ' ')),
    m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    i AS (SELECT lang, array_to_string(w[b:b + z - 1], ' ') AS phrase, max(a) AS longer
          FROM (SELECT lang, w, a, z, unnest(range(1, k - z + 2)) AS b FROM c, range(2, 5) AS q(z) WHERE z < k) GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM m LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
    QUALIFY rank <= 2000
    """
)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakestrata.llm.phrases import collocations

    found = collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def field_sql(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"


LEAF_SQL = " || ".join(map(field_sql, ("doc_id", "source", "lang", "n_chars")))
LOWER_OR_NULL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f"""
    WITH RECURSIVE crc AS (
        SELECT list(c ORDER BY b) AS t
        FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
              FROM range(256) AS r(b))
    ),
    d AS (
        SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                  lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 3 = 0 AS bad
        FROM documents, crc
    ),
    h AS (
        SELECT doc_id, lang, sha256({LEAF_SQL} || {field_sql('text')}) AS leaf,
               sha256({LEAF_SQL} || coalesce(strlen(x) || ':' || x, '-')) AS claimed
        FROM (SELECT *, CASE WHEN bad THEN {LOWER_OR_NULL} ELSE text END AS x FROM d)
    ),
    l AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM h
    ),
    t AS (
        SELECT lang, 0 AS level, pos, n, leaf AS d FROM l
        UNION ALL
        SELECT lang, level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, level, pos // 8
    ),
    s AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
    u AS (
        SELECT 0 AS level, pos, n, subroot AS d FROM s
        UNION ALL
        SELECT level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 8
    ),
    r AS (
        SELECT lang, level AS k, pos // 8 AS p, list(d ORDER BY pos) AS run FROM t WHERE n > 1 GROUP BY ALL
    ),
    q AS (SELECT level AS k, pos // 8 AS p, list(d ORDER BY pos) AS run FROM u WHERE n > 1 GROUP BY ALL),
    w AS (
        SELECT l.lang, l.pos, k, run, (l.pos >> (3 * k)) & 7 AS i FROM l JOIN r ON l.lang IS NOT DISTINCT FROM r.lang AND p = l.pos >> (3 * k + 3)
        UNION ALL
        SELECT l.lang, l.pos, 100 + k, run, (s.pos >> (3 * k)) & 7 AS i
        FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang JOIN q ON p = s.pos >> (3 * k + 3)
    ),
    v AS (
        SELECT lang, pos, list(array_to_string(run[1:i], '') || '|' || array_to_string(run[i + 2:], '') ORDER BY k) AS way FROM w GROUP BY lang, pos
    ),
    f AS (
        SELECT doc_id, leaf, subroot, (SELECT d FROM u WHERE n = 1) AS root,
               sha256(replace(array_to_string(coalesce(way, []), ''), '|', '')) AS proof_sha256,
               list_reduce(list_prepend(claimed, coalesce(way, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
        FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN v ON l.lang IS NOT DISTINCT FROM v.lang AND l.pos = v.pos
    )
    SELECT *, folded_root = root AS verified FROM f
    """
)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakestrata.llm.merkle import lower_cased, merkle_manifest, proofs

    return proofs(merkle_manifest(table(spark, sf_dir, "documents"), tampered=lower_cased()))


def license_sql() -> str:
    from lakestrata.llm.licenses import ANCHORS, LEAST_SHARE, TEMPLATES

    rows = ", ".join(f"({i}, '{x.label}', {x.base}, string_split('{x.text}', ' '), string_split('{x.key}', ' '), {x.key_place})" for i, x in enumerate(TEMPLATES))
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
    t(t, label, base, words, key, kp) AS (VALUES {rows}),
    v AS (SELECT DISTINCT unnest(words) AS word FROM t),
    c AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(w)) AS word FROM d) SEMI JOIN v USING (word) GROUP BY word),
    x AS (SELECT word, CAST(floor(1000 * ln(((SELECT count(*) FROM d) + 1.0::DOUBLE) / (coalesce(n, 0) + 1.0::DOUBLE))) AS BIGINT) + 1 AS weight
          FROM v LEFT JOIN c USING (word)),
    p AS (SELECT t, base, place, word, weight FROM (SELECT t, base, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM t) JOIN x USING (word)),
    a AS (SELECT *, sum(weight) OVER (PARTITION BY t) AS total
          FROM (SELECT * FROM p QUALIFY base OR row_number() OVER (PARTITION BY t ORDER BY weight DESC, place) <= {ANCHORS})),
    h AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
    m AS (SELECT r, t, i - place AS shift, CAST(1000000 * sum(weight) // any_value(total) AS BIGINT) AS share FROM h JOIN a USING (word) GROUP BY ALL),
    k AS (SELECT m.r, label, base, shift, share, shift + kp >= 0 AND w[shift + kp + 1:shift + kp + len(key)] = key AS whole
          FROM m JOIN t ON m.t = t.t JOIN d ON m.r = d.r),
    s AS (SELECT r, count(*) FILTER (base AND whole) AS n_base, min(shift) FILTER (base AND whole) AS first_word, max(shift) FILTER (base AND whole) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND whole) AS base_labels,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole AND (base OR share >= {round(1_000_000 * LEAST_SHARE)})) AS labels,
                 max(share) AS score
          FROM k GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, coalesce(score, 0) / 1000000.0::DOUBLE AS score
    FROM d LEFT JOIN s USING (r)
    """


@query(license_sql())
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakestrata.llm.licenses import license_scan

    found = license_scan(table(spark, sf_dir, "documents"))
    joined = [F.array_join(name, ",").alias(name) for name in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")
