"""One query per operator, with the parameters meant for use, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import chat, chunks, decontaminate, licences, lines, packing, passages, quality, resample, scoring, setjoin, shards, spelling
from faultline.llm.staging import shipped

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of all documents with its class and whether it is kept."""
    return lines.classes(table(spark, folder, "documents"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of all documents that other documents repeat."""
    return passages.repeats(table(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade and tail probability of all documents, and whether they are kept."""
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"), quality.GRADE, quality.GRADES)
    return quality.grade(docs, model).select("doc_id", "expected_grade", "tail", "kept")


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: A conversation whose texts hold the template's own marks.
FORGED = r"\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    forged = spark.createDataFrame(
        [(-7, 0, "user", FORGED), (-7, 1, "assistant", FORGED)], turns.schema
    )
    formatted = chat.format_conversations(turns.unionByName(forged), tokenizer_path())
    return chat.digests(formatted).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS etext,
         replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'),
                         ':', '\c'), chr(10), '\n') AS erole
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(erole) + length(etext) + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op6_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of the same mixture of sources."""
    return shards.shards(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP6_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
           [CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t
), d AS (
  SELECT doc_id, source, CAST(coalesce(octet_length(encode(text)), 0) + 16 AS BIGINT) AS size,
         hex(encode(coalesce(text, ''))) AS hx, coalesce('=' || source, '') AS stratum,
         md5('shards:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), c AS (
  SELECT doc_id, size, stratum, h,
         xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(hx) // 2),
             lambda k: CAST('0x' || hx[2 * k + 1:2 * k + 2] AS BIGINT))),
           lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) AS INTEGER) + 1]))) AS text_crc32
  FROM d CROSS JOIN crc
), r AS (
  SELECT *, (2.0::DOUBLE * row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, size, text_crc32) - 1)
            / (2 * count(*) OVER (PARTITION BY stratum)) AS f,
         row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, size, text_crc32) AS rk
  FROM c
), p AS (
  SELECT *, row_number() OVER (ORDER BY f, stratum, rk) - 1 AS pos, count(*) OVER () AS n FROM r
)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
       CAST(pos * 40 // n AS INTEGER) AS shard,
       CAST(pos - ((pos * 40 // n) * n + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack(table(spark, folder, "documents"), tokenizer_path()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the row that stays of its text."""
    return chunks.classes(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, text_sha256
FROM d
"""

def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Classes and links of all documents by the similarity of their five-word shingles."""
    return setjoin.join(table(spark, folder, "documents"))


def op10_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and templates in all documents."""
    return licences.scan(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op11_resample(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their weight towards the benchmark, and the ranks of the drawn."""
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank"
    )


#: ``crc32`` of the column ``hx``, a hexadecimal text, over the relation ``hexed``.
CRC_SQL = """
crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
           [CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t
), summed AS (
  SELECT hexed.*, CAST(xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(hx) // 2),
             lambda k: CAST('0x' || hx[2 * k + 1:2 * k + 2] AS BIGINT))),
           lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) AS INTEGER) + 1]))) AS BIGINT) AS crc32
  FROM hexed CROSS JOIN crc
)
"""

LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH texts AS (
  SELECT 'd' AS kind, rowid AS r, doc_id, text FROM (SELECT *, row_number() OVER () AS rowid FROM documents)
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), w AS (
  SELECT kind, r, doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")},
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
), f AS (
  SELECT kind, r, unnest(ws) AS f FROM w
  UNION ALL SELECT kind, r, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT kind, r, unnest(list_transform(range(1, len(ws) - 1),
                   lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w
), hexed AS (
  SELECT f, hex(encode(f)) AS hx FROM (SELECT DISTINCT f FROM f)
), {CRC_SQL.strip()}, b AS (
  SELECT kind, r, crc32 % {resample.BUCKETS} AS bucket, count(*) AS n FROM f JOIN summed USING (f) GROUP BY ALL
), c AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t
  FROM b GROUP BY bucket
), g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + {resample.BUCKETS} AS DOUBLE)
         / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + {resample.BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain FROM c
), d AS (
  SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM b JOIN g USING (bucket) WHERE kind = 'd' GROUP BY r
), s AS (
  SELECT doc_id, r, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8]
           AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS score
  FROM w LEFT JOIN d USING (r) WHERE kind = 'd'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, r) AS place,
         count(*) FILTER (n_words >= 20) OVER () AS allowed FROM s
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight,
       CAST(score AS BIGINT) AS score,
       CASE WHEN n_words >= 20 AND place <= 5 * allowed // 100 THEN place END AS rank
FROM o
"""


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """All words of the documents with their neighbours, forms and roots."""
    return spelling.variants(table(spark, folder, "documents"))


OP12_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(
         {LOWER_SQL.format("coalesce(text, '')")}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
), hexed AS (
  SELECT doc, run, count(*) AS times, hex(encode(doc || ':' || run)) AS hx FROM runs GROUP BY doc, run
), {CRC_SQL.strip()}, v AS (
  SELECT CASE WHEN crc32 % 199 = 0 THEN left(run, crc32 % length(run)) || substring(run, crc32 % length(run) + 2)
              ELSE run END AS word, CAST(sum(times) AS BIGINT) AS n
  FROM summed GROUP BY 1 HAVING length(word) >= 6 AND sum(times) >= 5
), parts AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v
), cuts AS (
  SELECT word, n, left(word, i - 1) || substring(word, i + 1) AS cut,
         left(word, i - 1) || '*' || substring(word, i + 1) AS hole FROM parts
), pairs AS (
  SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.hole = b.hole AND a.word != b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN v b ON a.cut = b.word
  UNION SELECT b.word, a.word FROM cuts a JOIN v b ON a.cut = b.word
), ranked AS (
  SELECT p.word, p.near, v.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
         row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, p.near) AS place
  FROM pairs p JOIN v ON v.word = p.near
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
         CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM v LEFT JOIN ranked r ON r.word = v.word AND place = 1
), walk AS (
  SELECT word, word AS reached, 0 AS steps FROM forms
  UNION ALL SELECT w.word, f.form, steps + 1 FROM walk w JOIN forms f ON f.word = w.reached WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(reached, steps) AS root FROM walk GROUP BY word
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN roots USING (word)
"""


def op13_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their probability under a model of the rows that are not held out."""
    return scoring.score(table(spark, folder, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_chat_format": op5_chat_format,
    "op6_shards": op6_shards,
    "op7_packing": op7_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_licences": op10_licences,
    "op11_resample": op11_resample,
    "op12_spelling": op12_spelling,
    "op13_lm_score": op13_lm_score,
}

SQL: dict[str, str] = {
    "op5_chat_format": OP5_SQL,
    "op6_shards": OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_resample": OP11_SQL,
    "op12_spelling": OP12_SQL,
}
