"""All queries of the completion engine by name, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.functions.scoring import best_match, extra_character_score, exact_score, insertion_deletion_penalty, missing_character_score, pair_score, partition_filter, patterns, substitution_penalty, substitution_score
from sentria.functions.text import PUNCTUATION, normalize_query, query_trigrams
from sentria.operators import index
from sentria.operators.complete import complete, complete_batch, complete_indexed, complete_stored, sessions
from sentria.service import CompletionService, initialize_corpus
from sentria.shared import new_path, written
from sentria.sources.corpus import dealt, from_table, from_text_tree, from_zip, to_text_tree, to_zip
from sentria.sources.zipsource import NAME, register, zip_sentences
from sentria.streaming.completions import stream_completions
from sentria.streaming.sessions import session_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Queries over the corpus of documents: common, rare, short, impossible.
COMMON, TYPO, LONG, SHORT, ONE, NONE = "And,  the", "the eratre the", "attion to thanedbl the", "thq", "a", "zzqx jjkw"
KEY = ("doc_id", "offset")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "documents", keep_id=True)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete(documents(spark, sf_dir), COMMON)


def query(name: str, sql: str):
    """Register a query (spark, sentences, sf_dir) with its SQL."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir)
        ORACLES[name] = sql
        return f

    return add


# --- SQL of the corpus -------------------------------------------------------

_PUNCT = PUNCTUATION.replace("'", "''")


def _clean(text: str) -> str:
    return f"trim(regexp_replace(translate(lower({text}), '{_PUNCT}', '{' ' * len(PUNCTUATION)}'), '\\s+', ' ', 'g'))"


def _corpus(table: str, id_col: str, text: str) -> str:
    cut = f"string_split_regex({text}, '\\r\\n|\\r|\\n')"
    return f"""lines AS (
  SELECT {id_col}, unnest({cut}) AS line, generate_subscripts({cut}, 1) AS pos FROM {table}
), s AS (
  SELECT {id_col}, line AS original_sentence, {_clean("line")} AS normalized_sentence,
         '{table}/' || {id_col} || '.txt' AS source_text, pos::INT AS "offset"
  FROM lines WHERE regexp_replace(line, '\\s+', '', 'g') <> ''
)"""


DOCS = _corpus("documents", "doc_id", "text")
GRAMS = """grams AS (
  SELECT DISTINCT doc_id, "offset", substr(normalized_sentence, i::INT, 3) AS trigram
  FROM (SELECT *, unnest(range(1, length(normalized_sentence) - 1)) AS i FROM s)
)"""


def _case(q: str, s: str = "normalized_sentence", kinds: tuple[str, ...] = ("exact", "missing", "substitution", "extra")) -> str:
    """The CASE of scores in SQL: one WHEN for every place of every edit."""
    whens = " ".join(f"WHEN {s} LIKE '{like}' THEN {score}" for score, likes in patterns(q, kinds).items() for like in likes)
    return f"(CASE WHEN {s} = '' THEN NULL {whens} END)::INT"


_FROM = "FROM s"
_FROM_FILES = "FROM (SELECT * REPLACE (doc_id || '.txt' AS source_text) FROM s)"


def _best(q: str, k: int = 5) -> str:
    return f"""WITH {DOCS} SELECT * FROM (
  SELECT original_sentence AS completed_sentence, source_text, "offset", {_case(q)} AS score {_FROM}
) WHERE score IS NOT NULL ORDER BY score DESC, completed_sentence, source_text, "offset" LIMIT {k}"""


#: Another form of the score: every window of the sentence of every length, compared
#: with the query by its common start and end.
def _windows(q: str) -> str:
    n = len(q)
    return f"""WITH {DOCS}, w AS (
  SELECT doc_id, "offset", substr(normalized_sentence, i::INT, m::INT) AS t, m
  FROM (SELECT *, unnest(range(1, length(normalized_sentence) + 1)) AS i FROM s), (SELECT unnest([{n - 1}, {n}, {n + 1}]) AS m)
  WHERE i + m - 1 <= length(normalized_sentence) AND m > 0
), windows AS (SELECT DISTINCT * FROM w), p AS (SELECT unnest(range(1, {n + 2})) AS p), scored AS (
  SELECT doc_id, "offset", CASE
    WHEN t = '{q}' THEN {2 * n}
    WHEN m = {n} AND p <= {n} AND left(t, (p - 1)::INT) = left('{q}', (p - 1)::INT) AND substr(t, (p + 1)::INT) = substr('{q}', (p + 1)::INT) THEN {2 * n - 2} - greatest(6 - p, 1)
    WHEN m = {n - 1} AND p <= {n} AND t = left('{q}', (p - 1)::INT) || substr('{q}', (p + 1)::INT) THEN {2 * n - 2} - greatest(12 - 2 * p, 2)
    WHEN m = {n + 1} AND left(t, (p - 1)::INT) || substr(t, (p + 1)::INT) = '{q}' THEN {2 * n} - greatest(12 - 2 * p, 2)
  END AS score FROM windows, p
)
SELECT doc_id, "offset", max(score)::INT AS score FROM scored WHERE score IS NOT NULL GROUP BY ALL"""


# --- corpus and index --------------------------------------------------------


@query("load_sentences", f'WITH {DOCS} SELECT doc_id, original_sentence, source_text, "offset" FROM s')
def _(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "original_sentence", "source_text", "offset")


@query("normalize_sentences", f'WITH {DOCS} SELECT doc_id, "offset", normalized_sentence FROM s')
def _(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "offset", "normalized_sentence")


@query("normalize_pages", f"SELECT page_id, {_clean('html')} AS normalized FROM pages")
def _(spark, sf_dir):
    from sentria.functions.text import normalize

    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", normalize("html").alias("normalized"))


@query("load_parts", f'WITH {_corpus("part", "p_partkey", "p_name")} SELECT original_sentence, normalized_sentence, source_text, "offset" FROM s')
def _(spark, sf_dir):
    return from_table(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", "p_name", "part")


@query("trigram_postings", f'WITH {DOCS}, {GRAMS} SELECT trigram, doc_id, "offset" FROM grams')
def _(spark, sf_dir):
    return index.postings(documents(spark, sf_dir), *KEY)


@query("posting_list_sizes", f"WITH {DOCS}, {GRAMS} SELECT trigram, count(*) AS postings FROM grams GROUP BY trigram")
def _(spark, sf_dir):
    return index.trigram_sizes(documents(spark, sf_dir)).where("trigram IS NOT NULL")


@query(
    "index_stats",
    f"""WITH {DOCS}, {GRAMS} SELECT (SELECT count(*) FROM s)::BIGINT AS record_count,
  (SELECT count(DISTINCT trigram) FROM grams)::BIGINT AS distinct_trigrams, (SELECT count(*) FROM grams)::BIGINT AS total_postings""",
)
def _(spark, sf_dir):
    return index.statistics(documents(spark, sf_dir))


def _candidates_sql(q: str) -> str:
    grams = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    if len(grams) <= index.DAMAGE:
        return f'WITH {DOCS} SELECT doc_id, "offset" FROM s'
    listed = ", ".join(f"'{g}'" for g in grams)
    return f'WITH {DOCS}, {GRAMS} SELECT doc_id, "offset" FROM grams WHERE trigram IN ({listed}) GROUP BY doc_id, "offset" HAVING count(*) >= {len(grams) - index.DAMAGE}'


def _candidates(name: str, q: str) -> None:
    @query(name, _candidates_sql(q))
    def _(spark, sf_dir):
        docs = documents(spark, sf_dir)
        return index.candidates(docs, index.postings(docs, *KEY), q, *KEY).select(*KEY)


_candidates("candidates_long", LONG)
_candidates("candidates_short", SHORT)
_candidates("candidates_impossible", NONE)

# --- scores ------------------------------------------------------------------


@query(
    "penalty_tables",
    """SELECT p::INT AS position, greatest(6 - p, 1)::INT AS substitution, greatest(12 - 2 * p, 2)::INT AS insertion_deletion
  FROM (SELECT unnest(range(1, 13)) AS p)""",
)
def _(spark, sf_dir):
    p = F.col("id").cast("int")
    return spark.range(1, 13).select(p.alias("position"), substitution_penalty(p).alias("substitution"), insertion_deletion_penalty(p).alias("insertion_deletion"))


@query(
    "score_tables",
    """SELECT n::INT AS length, p::INT AS position, (2 * n)::INT AS exact, (2 * n - 2 - greatest(6 - p, 1))::INT AS substitution,
  (2 * n - 2 - greatest(12 - 2 * p, 2))::INT AS extra, (2 * n - greatest(12 - 2 * p, 2))::INT AS missing
  FROM (SELECT unnest(range(1, 11)) AS n), (SELECT unnest(range(1, 11)) AS p)""",
)
def _(spark, sf_dir):
    lengths = spark.range(1, 11).select(F.col("id").cast("int").alias("length"))
    n, p = F.col("length"), F.col("position")
    both = lengths.select("length", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("position"))
    return both.select("length", "position", exact_score(n).alias("exact"), substitution_score(n, p).alias("substitution"), extra_character_score(n, p).alias("extra"), missing_character_score(n, p).alias("missing"))


for _kind in ("exact", "substitution", "extra", "missing"):

    @query(f"score_{_kind}", f'WITH {DOCS} SELECT * FROM (SELECT doc_id, "offset", {_case("and the", kinds=(_kind,))} AS score FROM s) WHERE score IS NOT NULL')
    def _(spark, sf_dir, kind=_kind):
        return documents(spark, sf_dir).select(*KEY, best_match("and the", kinds=(kind,)).alias("score")).where("score IS NOT NULL")


@query("best_match_scores", _windows("and the"))
def _(spark, sf_dir):
    return documents(spark, sf_dir).select(*KEY, best_match("and the").alias("score")).where("score IS NOT NULL")


@query("best_match_batched", _windows("the eratre the"))
def _(spark, sf_dir):
    """Sentences scored together, as batches of queries are."""
    scored = documents(spark, sf_dir).select(*KEY, pair_score()(F.lit("the eratre the"), "normalized_sentence").alias("score"))
    return scored.where("score IS NOT NULL")


@query("best_match_long", _windows("the eratre the"))
def _(spark, sf_dir):
    return documents(spark, sf_dir).select(*KEY, best_match("the eratre the").alias("score")).where("score IS NOT NULL")


_SPLITS = " AND ".join(f"(contains(normalized_sentence, '{TYPO[:k]}') OR contains(normalized_sentence, '{TYPO[k:]}'))" for k in range(1, len(TYPO)))


@query("partition_filter", f'WITH {DOCS} SELECT doc_id, "offset" FROM s WHERE {_SPLITS}')
def _(spark, sf_dir):
    return documents(spark, sf_dir).where(partition_filter(TYPO)).select(*KEY)


#: Queries on one sentence with their scores.
GOLDEN_SENTENCE = "to be or not to be that is the question"
GOLDEN = {"to be": 10, "or not": 12, "be that": 14, "2o be": 3, "to pe": 6, "or knot": 8, "or nt": 8, "not be": None}


@query(
    "golden_matches",
    "SELECT * FROM (VALUES " + ", ".join(f"('{q}', {'NULL::INT' if v is None else f'{v}::INT'})" for q, v in GOLDEN.items()) + ") AS t(query, score)",
)
def _(spark, sf_dir):
    from sentria.functions.scoring import best_match_columns

    asked = spark.createDataFrame([(q,) for q in GOLDEN], "query string")
    return asked.select("query", best_match_columns(F.col("query"), F.lit(GOLDEN_SENTENCE)).alias("score"))


# --- completions -------------------------------------------------------------

for _name, _prefix, _q in (
    ("complete_exact5", COMMON, "and the"),
    ("complete_fuzzy", TYPO, TYPO),
    ("complete_one_char", ONE, ONE),
    ("complete_short", SHORT, SHORT),
    ("complete_no_match", NONE, NONE),
):

    @query(_name, _best(_q))
    def _(spark, sf_dir, prefix=_prefix):
        return complete(documents(spark, sf_dir), prefix)


@query("complete_exact_first", _best("and the"))
def _(spark, sf_dir):
    return complete(documents(spark, sf_dir), COMMON, exact_first=True)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences as a table, for queries that read them several times."""
    return written(documents(spark, sf_dir), "sentences", compression="zstd")


def _grams(spark: SparkSession, prefixes) -> list[str]:
    return sorted({g for p in prefixes for g in query_trigrams(normalize_query(spark, p))})


@query("complete_indexed", _best(LONG))
def _(spark, sf_dir):
    docs = _stored(spark, sf_dir)
    return complete_indexed(docs, index.postings(docs, *KEY, only=_grams(spark, [LONG])), LONG, *KEY)


@query("complete_empty_query", "SELECT '' AS completed_sentence, '' AS source_text, 0::INT AS \"offset\", 0::INT AS score WHERE false")
def _(spark, sf_dir):
    return complete(documents(spark, sf_dir), " !? ")


#: A table of queries: long ones with and without a match, short ones, an empty one.
BATCH = {1: "and the", 2: "the eratre the", 3: "a", 4: "thq", 5: NONE, 6: "", 7: LONG, 8: "xy"}


@query(
    "complete_batch",
    f"WITH {DOCS}, scored AS ("
    + " UNION ALL ".join(f'SELECT {i}::BIGINT AS query_id, original_sentence AS completed_sentence, source_text, "offset", {_case(q)} AS score FROM s' for i, q in BATCH.items() if q)
    + """), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, completed_sentence, source_text, "offset")::INT AS rank FROM scored WHERE score IS NOT NULL)
SELECT query_id, rank, completed_sentence, source_text, "offset", score FROM ranked WHERE rank <= 5""",
)
def _(spark, sf_dir):
    docs = _stored(spark, sf_dir)
    asked = spark.createDataFrame([(i, q.upper()) for i, q in BATCH.items()], "query_id long, prefix string")
    return complete_batch(docs, index.postings(docs, *KEY, only=_grams(spark, BATCH.values())), asked, *KEY)


@query(
    "complete_conversations",
    f"""WITH {_corpus("conversations", "conv_id", "text")}, t AS (
  SELECT original_sentence AS completed_sentence, source_text, "offset", {_case("of the")} AS score FROM s)
SELECT completed_sentence, source_text, score, "offset", count(*) AS times FROM t WHERE score IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf_dir):
    turns = from_table(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "text", "conversations")
    scored = turns.select(F.col("original_sentence").alias("completed_sentence"), "source_text", "offset", best_match("of the").alias("score"))
    return scored.where("score IS NOT NULL").groupBy("completed_sentence", "source_text", "score", "offset").agg(F.count("*").alias("times"))


#: Every document's lines as a session: what is typed line by line.
_SESSIONS = f"""WITH {DOCS} SELECT doc_id, "offset", original_sentence AS line,
  sum(CASE WHEN contains(original_sentence, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "offset")::INT AS query_number,
  NOT contains(original_sentence, '#') AS searched, CASE WHEN contains(original_sentence, '#') THEN '' ELSE original_sentence END AS current_input FROM s"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "offset", F.col("original_sentence").alias("line"))


@query("cli_session", _SESSIONS)
def _(spark, sf_dir):
    return sessions(_lines(spark, sf_dir), "doc_id", "offset")


@query("session_stream", _SESSIONS)
def _(spark, sf_dir):
    """The same lines as a stream in three parts: the beginnings of all sessions, and so on.

    A part is as many files as the lines have partitions, and a session's lines of a
    part are in one of them: whatever files a batch takes by age, they come in order.
    """
    path = new_path(spark, "sessions")
    lines = written(_lines(spark, sf_dir).withColumn("part", F.least(F.floor(F.col("offset") / 4), F.lit(2))), "lines", compression="zstd")
    files = max(spark.sparkContext.defaultParallelism, lines.rdd.getNumPartitions())
    for part in range(3):  # files are read by age
        lines.where(F.col("part") == part).drop("part").repartition(files, "doc_id").write.mode("append").json(f"{path}/in")
    stream = spark.readStream.schema("doc_id long, offset int, line string").option("maxFilesPerTrigger", files).json(f"{path}/in")
    found = session_stream(stream, "doc_id", "offset").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress")
    found.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


# --- files, the stored index, streams ----------------------------------------


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts under file names."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")


def _archives(spark: SparkSession, sf_dir: str) -> str:
    """The documents as ZIP archives in the shared folder, one for each part of the table."""
    path = new_path(spark, "archives")
    to_zip(dealt(_texts(spark, sf_dir)), path, "name", "text")
    return f"{path}/*.zip"


_FILES = f"WITH {DOCS}, f AS (SELECT original_sentence, normalized_sentence, doc_id || '.txt' AS source_text, \"offset\" FROM s)"


@query("zip_sentences", f"{_FILES} SELECT * FROM f")
def _(spark, sf_dir):
    return from_zip(spark, _archives(spark, sf_dir))


@query("zip_source_sentences", f"{_FILES} SELECT * FROM f")
def _(spark, sf_dir):
    return zip_sentences(spark, _archives(spark, sf_dir))


@query("zip_source_members", "SELECT doc_id || '.txt' AS member, length(text)::INT AS size FROM documents WHERE text IS NOT NULL AND starts_with(doc_id::VARCHAR, '1')")
def _(spark, sf_dir):
    """Only the members with these names are inflated."""
    register(spark)
    found = spark.read.format(NAME).option("members", "1*").load(_archives(spark, sf_dir))
    return found.select("member", F.length("text").alias("size"))


@query("text_tree_sentences", f"{_FILES} SELECT * FROM f")
def _(spark, sf_dir):
    """A thousand documents a folder: no folder's list of files grows with the table."""
    path = new_path(spark, "texts")
    folder = F.floor(F.substring_index("name", ".", 1).cast("long") / 1000).cast("string")
    to_text_tree(_texts(spark, sf_dir).withColumn("name", F.concat(folder, F.lit("/"), "name")), path, "name", "text")
    found = from_text_tree(spark, path)
    return found.withColumn("source_text", F.substring_index("source_text", "/", -1))


@query(
    "stored_index_stats",
    f"""WITH {DOCS}, {GRAMS} SELECT (SELECT count(*) FROM s)::BIGINT AS record_count,
  (SELECT count(DISTINCT trigram) FROM grams)::BIGINT AS distinct_trigrams, (SELECT count(*) FROM grams)::BIGINT AS total_postings,
  true AS timed, true AS sized""",
)
def _(spark, sf_dir):
    stats = index.SentenceIndex.build(spark, documents(spark, sf_dir), new_path(spark, "index")).stats()
    return stats.select("record_count", "distinct_trigrams", "total_postings", (F.col("build_seconds") > 0).alias("timed"), (F.col("index_bytes") > 0).alias("sized"))


_PLACES = """JOIN s USING (doc_id, "offset")"""


@query("stored_postings", f'WITH {DOCS}, {GRAMS} SELECT trigram, source_text, "offset" FROM grams {_PLACES}')
def _(spark, sf_dir):
    """The packed postings, unpacked."""
    built = index.SentenceIndex.build(spark, documents(spark, sf_dir).drop("doc_id"), new_path(spark, "index"))
    return built.located("source_text", "offset")


@query("sentence_ids", f'WITH {DOCS} SELECT source_text, "offset", row_number() OVER (ORDER BY source_text, "offset") - 1 AS sentence_id FROM s')
def _(spark, sf_dir):
    built = index.SentenceIndex.build(spark, documents(spark, sf_dir).repartition(5), new_path(spark, "index"))
    return built.sentences.select("source_text", "offset", built.KEY)


for _name, _q in (("long", LONG), ("typo", TYPO), ("short", SHORT), ("impossible", NONE)):

    @query(f"stored_candidates_{_name}", _candidates_sql(_q))
    def _(spark, sf_dir, prefix=_q):
        built = index.SentenceIndex.build(spark, documents(spark, sf_dir), new_path(spark, "index"))
        return built.candidates(prefix).select(*KEY)


@query("stored_index_search", _best(LONG))
def _(spark, sf_dir):
    path = new_path(spark, "index")
    index.SentenceIndex.build(spark, documents(spark, sf_dir), path)
    opened = index.SentenceIndex.open(spark, path)
    return complete_stored(opened, LONG, share=1.0)


@query("initialized_corpus", _best(TYPO).replace(_FROM, _FROM_FILES))
def _(spark, sf_dir):
    service = CompletionService()
    service.configure(initialize_corpus(spark, _archives(spark, sf_dir), new_path(spark, "index")))
    found = [(c.completed_sentence, c.source_text, c.offset, c.score) for c in service.completions(TYPO)]
    return spark.createDataFrame(found, "completed_sentence string, source_text string, offset int, score int")


@query("stream_completions", ORACLES["complete_batch"])
def _(spark, sf_dir):
    """The batch's queries as a stream of two files."""
    path = new_path(spark, "stream")
    schema = "query_id long, prefix string"
    spark.createDataFrame(list(BATCH.items()), schema).repartition(2).write.json(f"{path}/in")
    stored = index.SentenceIndex.build(spark, documents(spark, sf_dir), f"{path}/index")
    asked = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{path}/in")
    stream_completions(asked, stored, f"{path}/out", f"{path}/progress", available_now=True).awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")
