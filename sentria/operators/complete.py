"""Completions: the best few sentences for a query, or for a table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentria.functions.scoring import best_match, pair_score, split_filter, split_filter_columns, substitution_score
from sentria.functions.text import normalize, normalize_query, query_trigrams, trigrams, windows
from sentria.operators.index import DAMAGE, LISTED_POSTINGS, NAMED_POSTINGS, SentenceIndex, merged, posting_sizes, probed, rarest
from sentria.session import ship_code
from sentria.shared import written

LIMIT = 5
#: The index serves a query whose rarest trigrams are in less than this share of the
#: sentences; for a commoner one a scan of the sentences, in order, costs less.
SHARE = 0.05
#: Queries, or trigrams of queries, that may be named in a plan; more are joined.
LISTED = 1000
#: Queries of a batch that are scored in one scan of the sentences, each by its own CASE.
SCANNED = 32
#: Best first; equal scores by the sentence as written, then by where it stands.
ORDER = (F.desc, "score"), (F.asc, "completed_sentence"), (F.asc, "source_text"), (F.asc, "offset")


def _order():
    return [f(c) for f, c in ORDER]


def _result(scored: DataFrame, *keep: str) -> DataFrame:
    return scored.where("score IS NOT NULL").select(*keep, F.col("original_sentence").alias("completed_sentence"), "source_text", "offset", "score")


def _best(scored: DataFrame, k: int) -> DataFrame:
    return _result(scored).orderBy(*_order()).limit(k)


def complete(sentences: DataFrame, prefix: str, k: int = LIMIT, exact_first: bool = True) -> DataFrame:
    """(completed_sentence, source_text, offset, score) of the ``k`` best sentences.

    Exact matches score highest, so they are looked for first: if there are ``k``
    the best of them are the answer, and a common query costs one scan for a plain
    substring. Otherwise, or without ``exact_first``, the cheap split test prunes,
    the CASE of scores follows, and a top-k that never sorts the corpus ends it. An
    empty query has no completions.
    """
    spark = sentences.sparkSession
    query = normalize_query(spark, prefix)
    if not query:
        return _best(sentences.where(F.lit(False)).withColumn("score", F.lit(None).cast("int")), k)
    if exact_first:
        exact = _best(sentences.withColumn("score", best_match(query, kinds=("exact",))), k)
        found = exact.collect()  # k rows
        if len(found) == k:
            return spark.createDataFrame(found, exact.schema)
    return _best(sentences.where(split_filter(query)).withColumn("score", best_match(query)), k)


def complete_indexed(sentences: DataFrame, posts: DataFrame, prefix: str, *key: str, k: int = LIMIT, sizes: DataFrame | None = None, share: float = SHARE) -> DataFrame:
    """The same through the trigram index; ``sizes`` are its posting sizes, if stored.

    An edit damages at most three trigrams, so a sentence that matches has one of the
    query's four rarest, and only those postings are read. A query with no more than
    three trigrams could match anywhere, and one whose rarest are common would meet
    much of the corpus by way of the join: both are scanned for instead.

    The score refers to how many of the postings a candidate has. Otherwise the
    optimizer would move ``score IS NOT NULL`` below the join and score every
    sentence.
    """
    query = normalize_query(sentences.sparkSession, prefix)
    if len(query_trigrams(query)) <= DAMAGE:
        return complete(sentences, prefix, k)
    probes = rarest(posting_sizes(posts) if sizes is None else sizes, query)
    if sum(probes.values()) >= share * sentences.count():
        return complete(sentences, prefix, k)
    hits = posts.where(F.col("trigram").isin(list(probes))).groupBy(*key).agg(F.count("*").alias("shared"))
    if sum(probes.values()) <= LISTED_POSTINGS:
        hits = F.broadcast(hits)
    score = F.when((F.col("shared") >= 1) & split_filter(query), best_match(query))
    return _best(sentences.join(hits, list(key)).withColumn("score", score), k)


def complete_stored(index: SentenceIndex, prefix: str, k: int = LIMIT, share: float = SHARE) -> DataFrame:
    """The same through a stored index.

    A query that has fewer than four trigrams which are rarer than ``share`` is
    scanned for without asking the index. Otherwise its four rarest lists name the
    sentences: if they are more than a plan may name, the longer lists are merged with
    them first, so that only sentences which share enough trigrams are read.
    """
    query = normalize_query(index.sentences.sparkSession, prefix)
    grams = query_trigrams(query)
    n, common = index.common(share)
    if len(grams) <= DAMAGE or sum(g not in common for g in grams) <= DAMAGE:
        return complete(index.sentences, prefix, k)
    sizes = index.sizes_of(grams)
    if sum(not size for size in sizes.values()) > DAMAGE:
        return complete(index.sentences, "", k)
    probes = sorted(sizes, key=lambda g: (sizes[g], g))[: DAMAGE + 1]
    met = sum(sizes[g] for g in probes)
    if met >= share * n:
        return complete(index.sentences, prefix, k)
    if met <= NAMED_POSTINGS:  # the score is only computed behind the test of the id
        named = index.sentences.where(F.col(index.KEY).isin(probed(index.blocks, probes))).where(split_filter(query))
        return _best(named.withColumn("score", best_match(query)), k)
    hits = merged(index.blocks, sizes, index.KEY)
    if met <= LISTED_POSTINGS:
        hits = F.broadcast(hits)
    score = F.when((F.col("shared") >= 1) & split_filter(query), best_match(query))
    return _best(index.sentences.join(hits, index.KEY).withColumn("score", score), k)


def top_k(results: DataFrame, *by: str, k: int = LIMIT) -> DataFrame:
    """The ``k`` best results of each query, with their rank from 1; every partition
    keeps ``k`` of a query before anything is shuffled."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*_order()))
    return results.withColumn("rank", rank).where(F.col("rank") <= k)


def complete_batch(sentences: DataFrame, posts: DataFrame, queries: DataFrame, *key: str, k: int = LIMIT, id_col: str = "query_id", text_col: str = "prefix", sizes: DataFrame | None = None, listed: int = LISTED) -> DataFrame:
    """(query_id, rank, completed_sentence, source_text, offset, score) of the ``k``
    best sentences of every query of a table.

    Each different text is answered once; of the texts no more than ``listed`` come
    to the driver, whatever their number. Exact matches come first: those of a query are
    among the postings of its rarest trigram, or for one or two characters among
    the sentences' own windows. Only queries with fewer than ``k`` of them are then
    matched with an edit: among the postings of their four rarest trigrams or, with
    no more than three, among the sentences that have one half of the query.
    """
    ship_code(sentences.sparkSession)
    asked = queries.select(F.col(id_col).alias("query_id"), normalize(text_col).alias("query")).where("query <> ''")
    texts = asked.select("query").distinct()
    probes = _probes(texts, posting_sizes(posts) if sizes is None else sizes)
    exact = written(top_k(_exact(sentences, posts, probes, texts, listed, *key), "query", k=k), "exact")
    done = exact.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query")
    rest = written(texts.join(done, "query", "left_anti"), "rest")
    found = exact.join(done, "query", "left_semi").unionByName(top_k(_edited(sentences, posts, probes, rest, k, listed, *key), "query", k=k))
    return asked.join(found, "query").select("query_id", "rank", "completed_sentence", "source_text", "offset", "score")


def _probes(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(query, trigram, postings, place, most): each query's rarest trigrams, rarest first,
    and the size of the longest list there is, which is no more than the sentences are."""
    grams = texts.select("query", F.explode(trigrams("query")).alias("trigram"))
    order = F.row_number().over(Window.partitionBy("query").orderBy("postings", "trigram"))
    sizes = written(sizes, "sizes")
    most = sizes.agg(F.coalesce(F.max("postings"), F.lit(0)).alias("most"))
    probes = grams.join(sizes, "trigram", "left").fillna(0, ["postings"]).withColumn("place", order).where(F.col("place") <= DAMAGE + 1)
    return written(probes.crossJoin(F.broadcast(most)), "probes")


def _split(texts: DataFrame, probes: DataFrame, n: int, listed: int) -> tuple[list[str], DataFrame]:
    """The texts whose ``n`` rarest trigrams are common, which are looked for in one pass over
    the sentences, and the probes of the others. Too many common ones are others too."""
    probes = probes.where(F.col("place") <= n).join(texts, "query", "left_semi")
    met = probes.groupBy("query").agg(F.sum("postings").alias("met"), F.first("most").alias("most"))
    common = [r.query for r in met.where(F.col("met") >= SHARE * F.col("most")).select("query").limit(min(listed, SCANNED) + 1).collect()]
    if len(common) > min(listed, SCANNED):
        return [], probes
    return common, probes.where(~F.col("query").isin(common))


def _scanned(sentences: DataFrame, queries: list[str], kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(query, sentence, score) of some queries, in one pass over the sentences."""
    if not queries:
        return sentences.where(F.lit(False)).select("*", F.lit("").alias("query"), F.lit(None).cast("int").alias("score"))
    score = lambda q: best_match(q, kinds=kinds) if kinds else F.when(split_filter(q), best_match(q))
    each = F.array(*(F.struct(F.lit(q).alias("query"), score(q).cast("int").alias("score")) for q in queries))
    met = sentences.withColumn("hit", F.explode(F.filter(each, lambda x: x["score"].isNotNull())))
    return met.select(*sentences.columns, "hit.query", "hit.score")


def _probed(sentences: DataFrame, posts: DataFrame, probes: DataFrame, listed: int, *key: str) -> DataFrame:
    """Each query beside the sentences among the postings of its rarest trigrams."""
    few = [r.trigram for r in probes.select("trigram").distinct().limit(listed + 1).collect()]
    if not few:
        return sentences.where(F.lit(False)).withColumn("query", F.lit(""))
    if len(few) <= listed:  # named in the scan, they are few row groups of the postings
        posts = posts.where(F.col("trigram").isin(few))
    # stored first: its size is known when the sentences are joined, and few hits are broadcast
    hits = written(F.broadcast(probes.select("query", "trigram")).join(posts, "trigram").select("query", *key).distinct(), "hits")
    return hits.join(sentences, list(key))


def _holding(sentences: DataFrame, texts: DataFrame, parts: Callable[[Column], Column], *key: str, listed: int = LISTED) -> DataFrame:
    """Each query beside the sentences that hold one of its parts, short as they are.

    A few queries are looked for in one pass over the sentences; many are joined to
    the windows of the sentences, of the lengths that parts have.
    """
    parted = texts.select("query", parts(F.col("query")).alias("parts"))
    few = parted.limit(listed + 1).collect()
    if not few:
        return sentences.where(F.lit(False)).withColumn("query", F.lit(""))
    if len(few) <= listed:
        held = F.array(*(F.struct(F.lit(r.query).alias("query"), F.array(*map(F.lit, r.parts)).alias("parts")) for r in few))
        hit = F.filter(held, lambda x: F.exists(x["parts"], lambda part: F.contains("normalized_sentence", part)))
        return sentences.withColumn("hit", F.explode(hit)).withColumn("query", F.col("hit.query")).drop("hit")
    parted = written(parted.select("query", F.explode("parts").alias("part")), "parts")
    lengths = [r[0] for r in parted.select(F.length("part")).distinct().collect()]  # of short queries: a few
    every = F.flatten(F.array(*(windows("normalized_sentence", m) for m in sorted(lengths))))
    asked = parted.select("part").distinct()
    held = sentences.select(F.explode(every).alias("part"), *key).join(asked, "part")
    return held.join(parted, "part").select("query", *key).distinct().join(sentences, list(key))


def _whole(query: Column) -> Column:
    return F.array(query)


def _halves(query: Column) -> Column:
    """One edit spares one half. Of a single character, which any other may replace, itself."""
    half = (F.length(query) / 2).cast("int")
    both = F.array(F.substring(query, F.lit(1), half), F.substring(query, half + 1, F.length(query)))
    return F.array_distinct(F.filter(both, lambda part: part != ""))


def _exact(sentences: DataFrame, posts: DataFrame, probes: DataFrame, texts: DataFrame, listed: int, *key: str) -> DataFrame:
    n = F.length("query")
    common, rare = _split(texts.where(n >= 3), probes, 1, listed)
    met = _probed(sentences, posts, rare, listed, *key).where(F.contains("normalized_sentence", "query"))
    met = met.unionByName(_holding(sentences, texts.where(n < 3), _whole, *key, listed=listed).select(*met.columns))
    found = _result(met.withColumn("score", (2 * n).cast("int")), "query")
    return found.unionByName(_result(_scanned(sentences, common, ("exact",)), "query"))


def _edited(sentences: DataFrame, posts: DataFrame, probes: DataFrame, texts: DataFrame, k: int, listed: int, *key: str) -> DataFrame:
    many = F.size(trigrams("query")) > DAMAGE
    common, rare = _split(texts.where(many), probes, DAMAGE + 1, listed)
    short = texts.where(~many)
    few = [r.query for r in short.where(F.length("query") > 1).limit(min(listed, SCANNED) + 1).collect()]
    if len(common) + len(few) <= min(listed, SCANNED):  # a half of a short query says little: most sentences have it
        common, short = common + few, short.where(F.length("query") == 1)
    met = _probed(sentences, posts, rare, listed, *key).where(split_filter_columns(F.col("query"), F.col("normalized_sentence")))
    met = met.unionByName(_holding(sentences, short, _halves, *key, listed=listed).select(*met.columns))
    scored = _result(met.withColumn("score", pair_score()("query", "normalized_sentence")), "query")
    scored = scored.unionByName(_result(_scanned(sentences, common), "query"))
    # a single character matches every other sentence by a change: its score is the
    # same for all, so the first k will do
    first = sentences.where("normalized_sentence <> ''").orderBy("original_sentence", "source_text", "offset")
    one = texts.where(F.length("query") == 1).withColumn("one", F.lit(1))
    changed = first.limit(2 * k).withColumn("one", F.lit(1)).join(one, "one").where(~F.contains("normalized_sentence", "query"))
    return scored.unionByName(_result(changed.withColumn("score", substitution_score(1, 1).cast("int")), "query"))


def sessions(lines: DataFrame, session: str, order: str, text: str = "line") -> DataFrame:
    """A recorded interactive session: what each line did.

    A line with ``#`` anywhere ends the current query and is not searched; any other
    replaces the current input. Adds ``query_number`` (resets so far), ``searched``
    and ``current_input`` (empty after a reset).
    """
    reset = F.col(text).contains("#")
    so_far = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        lines.withColumn("query_number", F.sum(reset.cast("int")).over(so_far).cast("int"))
        .withColumn("searched", ~reset)
        .withColumn("current_input", F.when(reset, F.lit("")).otherwise(F.col(text)))
    )
