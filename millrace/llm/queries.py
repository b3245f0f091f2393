"""Queries of the text problems 8 to 10 over the project's tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import leakage, packing, textstats
from millrace.runtime import persist_table, read_table

#: Kinds of containers that are planned in one run.
MAX_KINDS = 100


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    kinds = read_table(spark, d, "containers").where("container_kind is not null and capacity_tokens is not null").limit(MAX_KINDS + 1).collect()
    if len(kinds) > MAX_KINDS:
        raise ValueError("too many kinds of containers")
    return {r.container_kind: r.capacity_tokens for r in kinds}


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return packing.sized(packing.token_sizes(read_table(spark, d, "documents"), "doc_id", "text", packing.default_tokenizer()))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in containers of each kind, by tokens of its whole text; see packing.pack."""
    capacities = _capacities(spark, d)
    return packing.pack(_sizes(spark, d), capacities).withColumnRenamed("item", "doc_id").withColumnRenamed("size", "tokens")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used per kind against a bound below which no packing is, the value of the fractional program, the share of
    the tokens that the rounded program placed, and how full the containers are."""
    capacities, items = _capacities(spark, d), _sizes(spark, d)
    layout = packing.layouts(items, capacities)
    p = packing.pack(items, capacities, layout).where("container_id is not null").groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("size").alias("tokens"))
    plans = layout.select("container_kind", F.ceil("at_least").alias("at_least"), F.round("lp_value", 3).alias("lp_value"), F.round("lp_share", 4).alias("lp_share")).distinct()
    full = F.round(F.col("tokens") / F.col("containers") / F.col("capacity_tokens"), 6)
    return p.join(read_table(spark, d, "containers"), "container_kind").join(plans, "container_kind").select("container_kind", "containers", "tokens", "at_least", "lp_value", "lp_share", full.alias("fill"))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a packing, per kind: documents placed, containers that hold more than their capacity, documents whose
    pieces do not add up to their tokens, documents cut though they fit, and whether no more than 1 % (and 2) containers
    over the tokens' total are used."""
    capacities, items = _capacities(spark, d), _sizes(spark, d)
    placed = persist_table(packing.pack(items, capacities), "pack-placed")
    room = F.create_map(*[F.lit(x) for kv in capacities.items() for x in kv])[F.col("container_kind")]
    held = placed.where("container_id is not null").groupBy("container_kind", "container_id").agg(F.sum("size").alias("held"))
    boxes = held.groupBy("container_kind").agg(F.sum((F.col("held") > room).cast("long")).alias("overfull"), (F.count(F.lit(1)) <= F.ceil(F.sum("held") / F.first(room)) * 1.01 + 2).alias("near_full"))
    own = placed.groupBy("container_kind", "item").agg(F.sum("size").alias("parts"), F.count(F.lit(1)).alias("pieces")).join(items, "item")
    docs = own.groupBy("container_kind").agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("parts") != F.col("size")).cast("long")).alias("incomplete"), F.sum(((F.col("size") <= room) & (F.col("pieces") > 1)).cast("long")).alias("cut_short"))
    return docs.join(boxes, "container_kind").select("container_kind", "documents", "overfull", "incomplete", "cut_short", "near_full")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Per test item: the documents it leaked into and the longest leaked run of words."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest_words"))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return textstats.quality(read_table(spark, d, "documents"), "doc_id", "text", "lang", "source", read_table(spark, d, "common_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).where("not prose").select(F.col("id").alias("doc_id")).distinct()


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document with its distance from prose and what each statistic adds to it."""
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    q = _quality(spark, d)
    return q.select(
        F.col("id").alias("doc_id"), F.col("found").alias("language"), F.col("n").alias("word_count"), share("letters", "alpha").alias("mean_word_length"), share("symbols", "chars").alias("symbol_ratio"),
        share("ended", "lines").alias("line_end_share"), share("hits", "alpha").alias("common_word_share"), F.round("distance", 4).alias("distance"),
        *[F.round(f"d_{s}", 4).alias(f"from_{s}") for s in textstats.STATISTICS], "prose",
    )


def p10_plain(spark: SparkSession, d: str) -> DataFrame:
    """Plain statistics of every document's whole text."""
    s = textstats.plain_statistics(read_table(spark, d, "documents"), "doc_id", "text")
    return s.select(F.col("id").alias("doc_id"), "word_count", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "line_end_share")])


QUERIES = {f.__name__: f for f in (p8_packing, p8_fill, p8_checked, p9_found, p9_items, p10_found, p10_statistics, p10_plain)}
#: Words of a text as the leak definition reads them.
_WORDS = r"regexp_extract_all(replace(lower(strip_accents(regexp_replace(text, '[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{0300}-\x{036F}]', '', 'g'))), 'ß', 'ss'), '[\p{L}\p{N}]+')"

#: Where spans of items begin in documents: (doc_id, item_id, n, dp, ip), each n words long.
_HITS = f"""i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL), d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
        spans AS (SELECT item_id, least(12, len(w)) AS n, unnest(range(1, len(w) - least(12, len(w)) + 2)) AS ip, unnest(list_transform(range(1, len(w) - least(12, len(w)) + 2), lambda k: array_to_string(w[k:k + least(12, len(w)) - 1], ' '))) AS span FROM i WHERE len(w) > 0),
        lens AS (SELECT DISTINCT n FROM spans),
        grams AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS dp, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS span FROM d, lens WHERE len(w) >= n),
        hits AS (SELECT DISTINCT doc_id, item_id, n, dp, ip FROM grams JOIN spans USING (n, span))"""

SQL: dict[str, str] = {
    "p8_checked": "SELECT container_kind, (SELECT count(*) FROM documents) AS documents, 0 AS overfull, 0 AS incomplete, 0 AS cut_short, true AS near_full FROM containers",
    "p9_found": f"WITH {_HITS} SELECT DISTINCT doc_id, item_id FROM hits",
    "p9_items": f"""WITH {_HITS}, runs AS (SELECT *, dp - row_number() OVER (PARTITION BY doc_id, item_id, dp - ip ORDER BY dp) AS run FROM hits),
        lengths AS (SELECT doc_id, item_id, CAST(count(*) + any_value(n) - 1 AS INTEGER) AS words FROM runs GROUP BY doc_id, item_id, dp - ip, run)
        SELECT item_id, count(DISTINCT doc_id) AS documents, max(words) AS longest_words FROM lengths GROUP BY 1""",
    "p10_plain": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS (SELECT doc_id, regexp_extract_all(t, '[\p{L}\p{N}]+') AS w, length(regexp_replace(t, '[ \t\r\n]', '', 'g')) AS chars, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM t),
        c AS (SELECT doc_id, len(w) AS n, length(array_to_string(w, '')) AS runs, chars, len(l) AS lines, len(list_filter(l, lambda x: regexp_matches(x, '[.!?…:;]["''”’»)\]]*$'))) AS ended FROM m)
        SELECT doc_id, CAST(n AS INTEGER) AS word_count, round(CASE WHEN n > 0 THEN runs / n END, 6) AS mean_word_length, round(CASE WHEN chars > 0 THEN (chars - runs) / chars END, 6) AS symbol_ratio, round(CASE WHEN lines > 0 THEN ended / lines END, 6) AS line_end_share FROM c""",
}
