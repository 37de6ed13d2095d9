"""Per-source normalisers to one document schema, and the manifest of what was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textaxis.functions import text as X

#: The document schema: every normaliser gives these columns.
COLUMNS = ("document_id", "text", "source_name", "source_family", "language", "title", "date", "speaker_or_author", "raw_dataset", "metadata", "n_words")


def to_documents(rows: DataFrame, dataset: str, row: Column, text: Column, source: Column | None = None, family: str | None = None, language: Column | None = None,
                 title: Column | None = None, date: Column | None = None, author: Column | None = None, metadata: dict[str, Column] | None = None,
                 hashed: Column | None = None) -> DataFrame:
    """Rows of one source in the document schema; the id is the data set, the short hash of the text (or of ``hashed``)
    and the row number."""
    none = F.lit(None).cast("string")
    open_fields = F.to_json(F.struct(*[c.alias(k) for k, c in metadata.items()])) if metadata else none
    return rows.select(
        X.synthetic_id(dataset, text if hashed is None else hashed, row).alias("document_id"), X.normalize_whitespace(text).alias("text"), (F.lit(dataset) if source is None else X.coerce_text(source)).alias("source_name"),
        F.lit(family or dataset).alias("source_family"), (F.lit("en") if language is None else F.coalesce(language, F.lit("und"))).alias("language"), (none if title is None else X.coerce_text(title)).alias("title"),
        (none if date is None else X.iso_date(date)).alias("date"), (none if author is None else X.coerce_text(author)).alias("speaker_or_author"), F.lit(dataset).alias("raw_dataset"),
        open_fields.alias("metadata"), X.word_count(text).alias("n_words"))


def at_least_words(docs: DataFrame, limits: dict[str, int], default: int) -> DataFrame:
    """Documents with enough words for their source."""
    least = F.lit(default)
    for name, n in limits.items():
        least = F.when(F.col("source_name") == name, n).otherwise(least)
    return docs.where(F.col("n_words") >= least)


def normalize_documents(rows: DataFrame) -> DataFrame:
    return to_documents(rows, "documents", F.col("doc_id"), F.col("text"), F.col("source"), language=F.col("lang"))


def normalize_pages(rows: DataFrame) -> DataFrame:
    """Web pages: tags become blanks, the host is the source, the language comes from the path."""
    body = F.regexp_replace("html", "<[^>]*>", " ")
    host = F.regexp_extract("url", "//([^/]*)", 1)
    language = F.nullif(F.regexp_extract("url", r"example\.[a-z]+/([a-z][a-z])/", 1), F.lit(""))
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return to_documents(rows, "pages", F.col("page_id"), body, host, language=language, title=title, metadata={"url": F.col("url")}, hashed=F.col("html"))


def normalize_conversations(rows: DataFrame) -> DataFrame:
    return to_documents(rows, "conversations", F.col("conv_id") * 1000 + F.col("turn"), F.col("text"), F.col("role"), language=F.lit("und"), author=F.col("role"))


def normalize_csv_articles(rows: DataFrame) -> DataFrame:
    """Rated news articles: text, heading or title, tags as a list literal, rating, source."""
    return to_documents(rows.withColumn("__row", F.monotonically_increasing_id()), "articles", F.col("__row"), F.col("text"), F.col("source"),
                        title=F.coalesce("heading", "title"), metadata={"tags": X.tag_list(F.col("tags")), "bias_rating": F.col("bias_rating")})


def normalize_forum(rows: DataFrame) -> DataFrame:
    """Forum posts with epoch times."""
    return to_documents(rows.withColumn("__row", F.monotonically_increasing_id()), "forum", F.col("__row"), F.col("articles"), F.col("url_domain"),
                        date=X.epoch_date(F.col("created_utc")), metadata={"url": F.col("urls"), "flair": F.col("flair"), "num_upvotes": F.col("num_upvotes"), "num_comments": F.col("num_comments")})


def normalize_debates(rows: DataFrame) -> DataFrame:
    """Parliamentary speeches: date, speaker, party, agenda."""
    return to_documents(rows, "debates", F.col("speechnumber"), F.col("text"), F.col("parliament"), date=F.col("date"), author=F.col("speaker"), title=F.col("agenda"),
                        metadata={"party": F.col("party"), "chair": F.col("chair"), "terms": F.col("terms"), "iso3country": F.col("iso3country")})


def normalize_press(rows: DataFrame, dataset: str) -> DataFrame:
    """Press releases by id or by address; speeches among them are a family of their own."""
    got = to_documents(rows, dataset, F.col("row"), F.col("text"), title=F.coalesce("headline", "title"), date=F.col("date"), author=F.col("author"), metadata={"id": X.sanitize_key(F.coalesce("ipnum", "url"))})
    return got


def normalize_congress(speeches: DataFrame, speakers: DataFrame, least: int = 100, most: int = 800, phrases: tuple[str, ...] = X.PROCEDURAL_PHRASES) -> tuple[DataFrame, DataFrame]:
    """Speeches joined to their speakers, and the count of each reason for leaving one out.

    Reasons, in order: no_speaker, short, long, procedural. The speaker map keeps its last row per speech.
    """
    last = speakers.groupBy("speech_id").agg(F.max_by(F.struct(*[c for c in speakers.columns if c != "speech_id"]), "row").alias("s")).select("speech_id", "s.*")
    joined = speeches.join(last.drop("row"), "speech_id", "left")
    n = X.word_count(F.col("speech"))
    reason = (
        F.when(F.col("lastname").isNull(), "no_speaker").when(n < least, "short").when(n > most, "long").when(X.contains_any(F.col("speech"), phrases), "procedural").otherwise("ok"))
    marked = joined.withColumn("reason", reason)
    return marked.where("reason = 'ok'").drop("reason"), marked.groupBy("reason").agg(F.count("*").alias("n"))


def upsert_manifest(old: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """The manifest with the new rows in place of old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
