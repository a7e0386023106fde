"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sentria.llm import langid
from sentria.llm.ann import nearest
from sentria.llm.bpe import encode_decode
from sentria.llm.chat import format_turns, read_back
from sentria.llm.common import table
from sentria.llm.decontam import overlaps
from sentria.llm.linededup import repeated_units, without_repeats
from sentria.llm.pii import personal_data
from sentria.llm.quality import quality
from sentria.llm.resample import resample
from sentria.llm.simhash import near_duplicates
from sentria.llm.tokencount import token_counts
from sentria.llm.trie import conversation_trie
from sentria.llm.warc import archive_round_trip

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), TOKENIZER, limit=2048)


#: A conversation whose texts are control strings of other formats and of this one.
HOSTILE = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame([(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)], turns.schema)
    return read_back(format_turns(turns.unionByName(hostile)))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without what an earlier place has, and what went from where."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs, unit="line", min_words=1, spans_col="spans")


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9 that SQL can express: whole lines, here of 8 words or more."""
    return repeated_units(table(spark, sf_dir, "documents"), unit="line", min_words=8)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_codec,
        op2_decontamination,
        op3_warc,
        op4_neighbours,
        op5_language_id,
        op6_token_counts,
        op7_chat_format,
        op8_simhash,
        op9_line_dedup,
        repeated_lines,
        op10_quality,
        op11_personal_data,
        op12_conversation_trie,
        op13_resample,
    )
}

#: Lines by position, their code points, and the first of those that agree.
OP9_SQL = r"""
WITH cut AS (
  SELECT doc_id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS text_key, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), placed AS (
  SELECT doc_id, text_key, pos, line,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, text_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char,
         trim(regexp_replace(lower(line), '[ \t-\r]+', ' ', 'g')) AS clean
  FROM cut
), long AS (
  SELECT *, length(clean) - length(replace(clean, ' ', '')) + 1 AS words FROM placed
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS first_id, first_value(text_key) OVER w AS first_key, first_value(pos) OVER w AS first_pos,
         count(*) OVER (PARTITION BY clean) AS copies
  FROM long WHERE words >= 8
  WINDOW w AS (PARTITION BY clean ORDER BY doc_id, text_key, pos)
)
SELECT doc_id, text_key, pos::INT AS pos, start_char::BIGINT AS start_char, (start_char + length(line))::BIGINT AS end_char,
       words::INT AS words, first_id, first_pos::INT AS first_pos, copies
FROM ranked WHERE doc_id <> first_id OR text_key <> first_key OR pos <> first_pos
"""

#: SHA-1 in base32: each 5 hexadecimal digits are 4 letters.
OP3_SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
), fives AS (
  SELECT *, list_transform(range(0, 8), lambda k: list_reduce(list_transform(range(1, 6),
    lambda j: instr('0123456789abcdef', substr(hex, (5 * k + j)::INT, 1)) - 1), lambda a, b: a * 16 + b)) AS parts
  FROM hashed
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + ((parts[(i // 4 + 1)::INT] >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM fives
"""

#: Escaping adds one character for each control string, escaped or not.
OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(7 + CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 ELSE 7 + length(role) END + length(text)
           + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|ROLE=)')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

#: CRC-32 of a list of byte values, by its table of 256 entries.
CRC_SQL = """
crc_table AS MATERIALIZED (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) ORDER BY i) AS crc_entries
  FROM (SELECT unnest(range(0, 256)) AS i)
)"""


def crc_sql(text: str) -> str:
    """CRC-32 of a text's bytes, where crc_entries is in scope."""
    hexed = f"hex(encode({text}))"
    digit = lambda at: f"(instr('0123456789ABCDEF', substr({hexed}, ({at})::INT, 1)) - 1)"
    octets = f"list_transform(range(0, length({hexed}) // 2), lambda j: {digit('2 * j + 1')} * 16 + {digit('2 * j + 2')})"
    step = "lambda x, y: xor(crc_entries[(xor(x, y) % 256 + 1)::INT], x // 256)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), {step}), 4294967295::BIGINT)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "unnest(regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"
OP13_SQL = f"""
WITH {CRC_SQL}, doc_words AS (
  SELECT doc_id, word, count(*) AS times FROM (SELECT doc_id, {_WORDS} AS word FROM documents) GROUP BY ALL
), target_words AS (
  SELECT word, count(*) AS times FROM (SELECT {_WORDS} AS word FROM benchmark) GROUP BY ALL
), hashed AS (
  SELECT word, {crc_sql("word")} % 10000 AS bucket
  FROM (SELECT word FROM doc_words UNION SELECT word FROM target_words), crc_table
), raw AS (SELECT bucket, sum(times)::DOUBLE AS s FROM doc_words JOIN hashed USING (word) GROUP BY bucket),
target AS (SELECT bucket, sum(times)::DOUBLE AS t FROM target_words JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM raw) AS all_s, (SELECT coalesce(sum(t), 0) FROM target) AS all_t),
gained AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS gain
  FROM raw LEFT JOIN target USING (bucket), totals
), weighed AS (
  SELECT doc_id, coalesce(sum(times), 0)::BIGINT AS n_features, coalesce(sum(times * gain), 0)::BIGINT AS weight
  FROM documents LEFT JOIN (SELECT * FROM doc_words JOIN hashed USING (word) JOIN gained USING (bucket)) USING (doc_id) GROUP BY doc_id
), scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM weighed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FILTER (n_features >= 20) * 10 // 100 FROM scored) THEN place END AS rank
FROM ranked
"""

#: A node's ancestors are the nodes on the path of its smallest member.
OP12_SQL = f"""
WITH {CRC_SQL}, turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS host, {crc_sql("conv_id::VARCHAR")} % 6 AS taken
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, role, text
  FROM (SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.host AND t.pos <= c.taken
        UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.taken)
), whole AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY depth) AS turns, count(*) AS length FROM rebuilt GROUP BY conv_id
), members AS (
  SELECT conv_id, 0 AS depth, NULL AS node, 0 AS chars, coalesce(length, 0) AS length FROM convs LEFT JOIN whole USING (conv_id)
  UNION ALL
  SELECT conv_id, d, sha256(turns[:d]::VARCHAR), length(turns[d].text), length FROM (SELECT *, unnest(range(1, length + 1)) AS d FROM whole)
), nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM members GROUP BY depth, node
), named AS (
  SELECT m.conv_id AS member, m.depth, n.conv_id FROM members m JOIN nodes n ON n.depth = m.depth AND n.node IS NOT DISTINCT FROM m.node
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN named p ON p.member = n.conv_id AND p.depth = n.depth - 1
), counted AS (
  SELECT n.depth, n.conv_id, count(c.conv_id) AS n_children
  FROM nodes n LEFT JOIN linked c ON c.depth = n.depth + 1 AND c.parent_conv_id = n.conv_id GROUP BY ALL
), rolled AS (
  SELECT a.depth, a.conv_id, sum((c.n_children = 0)::INT) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM nodes n JOIN counted c USING (depth, conv_id) JOIN named a ON a.member = n.conv_id AND a.depth <= n.depth GROUP BY ALL
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM linked JOIN counted USING (depth, conv_id) JOIN rolled USING (depth, conv_id)
"""

ORACLES = {"op3_warc": OP3_SQL, "op7_chat_format": OP7_SQL, "repeated_lines": OP9_SQL, "op12_conversation_trie": OP12_SQL, "op13_resample": OP13_SQL}
