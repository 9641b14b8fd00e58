"""The thirteen operators as queries over whole tables, and their SQL where there is one."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm.conversation_trie import conversation_trie
from strandline.llm.decontamination import contamination
from strandline.llm.html_text import extracted
from strandline.llm.importance import importance
from strandline.llm.language import languages
from strandline.llm.language_model import language_model
from strandline.llm.mixing import copies
from strandline.llm.near_duplicates import near_duplicates
from strandline.llm.quality import quality
from strandline.llm.suffix_dedup import removal
from strandline.llm.token_files import read_token_files, write_token_files
from strandline.llm.toxicity import toxicity
from strandline.llm.url_filter import judged
from strandline.plans.storage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark, sf_dir):
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLE["op1_decontamination"] = r"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents),
    items AS (
        SELECT item_id, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS size,
               array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS win
        FROM (SELECT *, unnest(range(len(w) - least(len(w), 10) + 1)) AS i
              FROM items WHERE len(w) > 0)),
    places AS (
        SELECT doc_id, size, i, array_to_string(w[i + 1:i + size], ' ') AS win
        FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i
              FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
    met AS (SELECT doc_id, item_id, p.size, i FROM places p JOIN windows USING (size, win)),
    hits AS (
        SELECT doc_id, count(DISTINCT place) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM met) GROUP BY doc_id),
    lists AS (
        SELECT doc_id, count(DISTINCT item_id) AS n_items,
               string_agg(DISTINCT CAST(item_id AS VARCHAR), ','
                          ORDER BY CAST(item_id AS VARCHAR)) AS ids
        FROM met GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
           CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN lists USING (doc_id)"""


@query
def op2_language(spark, sf_dir):
    return languages(_table(spark, sf_dir, "documents"))


@query
def op3_html_text(spark, sf_dir):
    return extracted(_table(spark, sf_dir, "pages"))


@query
def op4_near_duplicates(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
        "component_id",
    )


@query
def op5_mixing(spark, sf_dir):
    return copies(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


ORACLE["op5_mixing"] = r"""
    WITH sizes AS (
        SELECT doc_id, source,
               CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS BIGINT) AS size,
               md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS deal
        FROM documents),
    sources AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               CAST(CASE row_number() OVER (ORDER BY source NULLS LAST) % 3
                    WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS DOUBLE) AS weight
        FROM sizes GROUP BY source),
    -- the sources that reach twice their size come first, in this order
    ranked AS (
        SELECT *, source_size * 2.0::DOUBLE / weight AS full_at,
               sum(source_size * 2.0::DOUBLE) OVER w - source_size * 2.0::DOUBLE AS full_before,
               sum(weight) OVER () - sum(weight) OVER w + weight AS weight_left,
               sum(source_size) OVER () * 1.5::DOUBLE AS shared
        FROM sources WINDOW w AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST
                                  ROWS UNBOUNDED PRECEDING)),
    level AS (
        SELECT (shared - full_before) / weight_left AS level FROM ranked
        WHERE (shared - full_before) / weight_left < full_at
        ORDER BY full_at, source NULLS LAST LIMIT 1),
    targets AS (
        SELECT source, source_size, least(weight * level, source_size * 2.0::DOUBLE) AS target,
               CAST('0x' || substr(md5('offset/' || coalesce(source, '')), 1, 8) AS BIGINT)
                   / 4294967296.0::DOUBLE AS "offset"
        FROM sources, level),
    placed AS (
        SELECT s.*, source_size, target, "offset",
               CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
               row_number() OVER (
                   PARTITION BY s.source
                   ORDER BY floor(ln(size + 1.0::DOUBLE) * 17.0::DOUBLE),
                            CAST('0x' || substr(deal, 1, 8) AS BIGINT)
                                % (SELECT greatest(1, CAST(ceil(count(*) / 20000.0) AS BIGINT))
                                   FROM sizes),
                            size, doc_id NULLS FIRST) AS nth
        FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CAST((floor(rate * nth + "offset") - floor(rate * (nth - 1) + "offset")) * size AS BIGINT)
               AS taken
    FROM placed"""


@query
def op6_quality(spark, sf_dir):
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op7_suffix_dedup(spark, sf_dir):
    return removal(_table(spark, sf_dir, "documents"))


# Bytes as pairs of hex digits; texts are cut first, as a slice of a long one costs its length.
ORACLE["op7_suffix_dedup"] = """
    WITH docs AS (
        SELECT doc_id, hex(encode(coalesce(text, ''))) AS h,
               CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes
        FROM documents),
    pieces AS (
        SELECT doc_id, i * 1000 AS start,
               substr(h, CAST(i * 2000 + 1 AS INTEGER), 2098) AS piece
        FROM (SELECT *, unnest(range(CAST(ceil(n_bytes / 1000.0) AS BIGINT))) AS i FROM docs)),
    strings AS MATERIALIZED (
        SELECT doc_id, start + p AS place, substr(piece, CAST(2 * p + 1 AS INTEGER), 100) AS string
        FROM (SELECT *, unnest(range(least(1000, length(piece) // 2 - 49))) AS p FROM pieces
              WHERE length(piece) >= 100)),
    firsts AS (SELECT string, min(doc_id) AS least_id FROM strings
               GROUP BY string HAVING count(*) > 1),
    gone AS (SELECT doc_id, place FROM strings JOIN firsts USING (string) WHERE least_id < doc_id),
    marked AS (
        SELECT doc_id, place, coalesce(place > lag(place) OVER w + 50, true)::INTEGER AS new
        FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
    runs AS (
        SELECT doc_id, min(place) AS low, max(place) + 50 AS high
        FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY place
                                       ROWS UNBOUNDED PRECEDING) AS run FROM marked)
        GROUP BY doc_id, run),
    edges AS (
        SELECT doc_id, low, high,
               coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before
        FROM runs),
    kept AS (
        SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS last,
               string_agg(substr(h, CAST(2 * before + 1 AS INTEGER),
                                 CAST(2 * (low - before) AS INTEGER)), '' ORDER BY low) AS heads
        FROM edges JOIN docs USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
           CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
           sha256(unhex(coalesce(heads, '')
                        || substr(h, CAST(2 * coalesce(last, 0) + 1 AS INTEGER)))) AS kept_sha256
    FROM docs LEFT JOIN kept USING (doc_id)"""


@query
def op8_url_filter(spark, sf_dir):
    return judged(
        _table(spark, sf_dir, "pages"),
        allow=("org/", "com/fr/"),
        block=("example.org/es/", "example.org/en/1", "com/de/"),
    )


@query
def op9_token_files(spark, sf_dir):
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_token_files(
        _table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json")
    )
    return read_token_files(spark, path, digest=True)


@query
def op10_toxicity(spark, sf_dir):
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op11_importance(spark, sf_dir):
    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return importance(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB has no CRC-32: a table of the remainders of all bytes, and a fold over a text's bytes.
_CRC_TABLE = """
    crc_table AS (
        SELECT list(CAST(v AS BIGINT) ORDER BY n) AS t
        FROM (SELECT n, list_reduce(
                         list_prepend(n, range(8)),
                         lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384)
                                           ELSE a >> 1 END) AS v
              FROM (SELECT unnest(range(256)) AS n)))"""


def _crc_sql(text: str) -> str:
    code = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    return f"""xor(list_reduce(
        list_prepend(4294967295::BIGINT,
                     list_transform(range(octet_length(encode({text}))), lambda i: {code})),
        lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295)"""


ORACLE["op11_importance"] = rf"""
    WITH {_CRC_TABLE},
    words AS (
        SELECT place, doc_id, theirs, unnest(w) AS word
        FROM (SELECT row_number() OVER () AS place, doc_id, theirs, regexp_extract_all(
                         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                   'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
              FROM (SELECT doc_id, text, 0 AS theirs FROM documents
                    UNION ALL SELECT item_id, text, 1 FROM benchmark))),
    codes AS (
        SELECT word, {_crc_sql("word")} % 10000 AS bucket
        FROM (SELECT DISTINCT word FROM words), crc_table),
    sums AS (
        SELECT bucket, CAST(count(*) FILTER (WHERE theirs = 0) AS DOUBLE) AS s,
               CAST(count(*) FILTER (WHERE theirs = 1) AS DOUBLE) AS t
        FROM words JOIN codes USING (word) GROUP BY bucket),
    gains AS (
        SELECT bucket, CAST(floor(1000.0::DOUBLE * ln(
                   (t + 1) * ((SELECT sum(s) FROM sums) + 10000)
                   / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS BIGINT) AS gain
        FROM sums),
    weights AS (
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
        FROM words JOIN codes USING (word) JOIN gains USING (bucket)
        WHERE theirs = 0 GROUP BY place, doc_id
        UNION ALL
        SELECT doc_id, 0, 0 FROM documents
        WHERE NOT regexp_matches(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]')),
    scored AS (
        SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln(
                   (('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))
                        ::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
        FROM weights),
    ordered AS (
        SELECT *, row_number() OVER (PARTITION BY n_features >= 20
                                     ORDER BY score DESC, doc_id NULLS LAST) AS nth,
               10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS drawn
        FROM scored)
    SELECT doc_id, n_features, weight, score,
           CASE WHEN n_features >= 20 AND nth <= drawn THEN CAST(nth AS BIGINT) END AS rank
    FROM ordered"""


@query
def op12_conversation_trie(spark, sf_dir):
    return conversation_trie(_table(spark, sf_dir, "conversations"))


ORACLE["op12_conversation_trie"] = rf"""
    WITH {_CRC_TABLE},
    turns AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1
                  AS nth
        FROM (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn,
                     CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size,
                     sha256(octet_length(encode(coalesce(role, ''))) || ':'
                            || coalesce(role, '') || coalesce(text, '')) AS digest
              FROM conversations WHERE conv_id IS NOT NULL)),
    heads AS (
        SELECT conv_id, {_crc_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h
        FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
    rebuilt AS (
        SELECT c.conv_id, nth, digest, size
        FROM heads c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE nth < h
        UNION ALL
        SELECT conv_id, nth, digest, size FROM turns JOIN heads USING (conv_id) WHERE nth >= h),
    members AS (
        SELECT conv_id, CAST(row_number() OVER w AS BIGINT) AS depth, size,
               sha256(string_agg(digest, '') OVER w) AS key
        FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY nth ROWS UNBOUNDED PRECEDING)
        UNION ALL
        SELECT conv_id, 0, 0, '' FROM heads),
    linked AS (
        SELECT *, lag(key) OVER w AS above, lead(key) OVER w IS NULL AS ends
        FROM members WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
    nodes AS (
        SELECT key, depth, any_value(above) AS above, min(conv_id) AS conv_id,
               count(*) AS n_convs, CAST((count(*) - 1) * any_value(size) AS BIGINT) AS saved,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                               FILTER (WHERE ends), '')) AS ends_sha256
        FROM linked GROUP BY key, depth),
    kin AS (SELECT above AS key, count(*) AS n_children FROM nodes
            WHERE above IS NOT NULL GROUP BY above),
    full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children
                   FROM nodes LEFT JOIN kin USING (key)),
    below AS (
        SELECT m.key, count(*) FILTER (WHERE n.n_children = 0) AS n_leaves, sum(n.saved) AS saved
        FROM full_nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth
        GROUP BY m.key)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
           CAST(n.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
           CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM full_nodes n JOIN below b USING (key) LEFT JOIN nodes p ON p.key = n.above"""


@query
def op13_language_model(spark, sf_dir):
    return language_model(_table(spark, sf_dir, "documents"))
