"""Queries of problems 7 to 9 and what SQL can say of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import mixing, sentences, tokenize


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def p7_ids(spark, d):
    return tokenize.token_ids(_docs(spark, d))


def p7_round_trip(spark, d):
    """The ids decoded again: the MD5 of what comes out is the MD5 of the text."""
    back = tokenize.texts(tokenize.token_ids(_docs(spark, d)))
    return back.select("doc_id", F.md5("text").alias("text_md5"))


def p7_sizes(spark, d):
    """Documents by source, and those without ids: null and empty texts."""
    docs = _docs(spark, d)
    sizes = tokenize.token_counts(docs.select(F.struct("doc_id", "source").alias("key"), "text"), "key")
    return sizes.groupBy(F.col("key.source").alias("source")).agg(F.count("*").alias("documents"), F.count_if(F.col("n_tokens") == 0).alias("without_ids"))


def _mix(spark, d):
    targets = mixing.targets_of(spark.read.parquet(f"{d}/mix_targets.parquet"))
    rows = mixing.sized(_docs(spark, d), targets)
    return rows, mixing.mix(rows, targets), targets


def p8_mix(spark, d):
    return _mix(spark, d)[1]


def p8_shares(spark, d):
    return mixing.shares(*_mix(spark, d))


def p8_bounds(spark, d):
    """Whether each source reaches its share to within 1 % of all tokens and keeps
    to its cap; shares of sources without documents go to the others."""
    s = mixing.shares(*_mix(spark, d))
    whole = F.sum(F.when(F.col("tokens_available") > 0, F.col("target_share")).otherwise(0.0)).over(Window.partitionBy())  # one row per target
    due = F.when(F.col("tokens_available") > 0, F.col("target_share") / whole).otherwise(0.0)
    return s.withColumn("due", due).select("source", F.round("due", 9).alias("due_share"), (F.abs(F.col("actual_share") - F.col("due")) <= 0.01).alias("reached"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"))


def p8_marginals(spark, d):
    """Shares of languages and topics in the corpus and in the raked weights."""
    targets = mixing.targets_of(spark.read.parquet(f"{d}/mix_targets.parquet"))
    return mixing.marginals(mixing.weights(mixing.sized(_docs(spark, d), targets), targets))


def p9_found(spark, d):
    return sentences.sentences(_docs(spark, d))


def p9_lengths(spark, d):
    """Units and their code points per document: nothing of a text is lost."""
    found = sentences.sentences(_docs(spark, d))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.min("sent_start").alias("first_start"), F.max("sent_end").alias("last_end"))


def p9_edges(spark, d):
    """First and last place of each document's units: the text without its outer
    white space."""
    return p9_lengths(spark, d).select("doc_id", "first_start", "last_end")


QUERIES = {f.__name__: f for f in (p7_ids, p7_round_trip, p7_sizes, p8_mix, p8_shares, p8_bounds, p8_marginals, p9_found, p9_lengths, p9_edges)}
_SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\p{Z}]"
#: Ids, samples and units themselves have no SQL (see tests/llm), but SQL can say
#: what must hold of them.
ORACLE: dict[str, str] = {
    "p7_round_trip": "select doc_id, md5(coalesce(text, '')) text_md5 from documents",
    "p7_sizes": "select source, count(*) documents, count(*) filter (coalesce(text, '') = '') without_ids from documents group by 1",
    "p8_bounds": """select t.source, round(case when n > 0 then target_share / sum(case when n > 0 then target_share else 0 end) over () else 0 end, 9) due_share, true reached, true within_cap
        from mix_targets t left join (select source, count(*) n from documents where text <> '' group by 1) d on d.source = t.source""",
    "p9_edges": f"""select doc_id, cast(length(regexp_extract(text, '^{_SPACE}*')) as integer) first_start, cast(length(regexp_replace(text, '{_SPACE}+$', '')) as integer) last_end
        from documents where regexp_replace(text, '{_SPACE}+', '', 'g') <> ''""",
}
