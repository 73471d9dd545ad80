"""Tables of lines, blocks, boxes, pairs and job events, made from the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(documents: DataFrame) -> DataFrame:
    """(doc, page, line_no, line): paragraphs; the document is the source, its pages are the rows."""
    return documents.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", T.squeeze(F.col("line")))


def visual_lines(documents: DataFrame, width: int = 80) -> DataFrame:
    """(page, line_no, line): texts wrapped at blanks after at most `width` signs."""
    found = F.regexp_extract_all("text", F.lit(rf"([^\n]{{1,{width}}}(?: |\n|$))"), 1)
    return documents.select(F.col("doc_id").alias("page"), F.posexplode(found).alias("line_no", "line")).withColumn("line", F.rtrim(F.regexp_replace("line", r"\n$", "")))


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page, kind, block_no, text): titles, headings, paragraphs, list items, navigation and footers of pages."""
    kinds = {"title": "title", "h1": "heading", "p": "paragraph", "li": "item", "nav": "navigation", "footer": "footer"}
    block = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("block_no"), x.alias("text"))
    each = [F.transform(F.regexp_extract_all("html", F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), 1), block(kind)) for tag, kind in kinds.items()]
    clean = lambda c: T.squeeze(F.regexp_replace(c, r"<[^>]*>", " "))
    return pages.select(F.col("page_id").alias("page"), F.inline(F.concat(*each))).withColumn("text", clean(F.col("text")))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, source_text, translated_text): a user's turn and the assistant's next one, if there is one."""
    user = conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source_text"))
    reply = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("translated_text"))
    return user.join(reply, ["conv_id", "turn"], "left")


def boxes(embeddings: DataFrame) -> DataFrame:
    """(page, box_id, x0, y0, x1, y1): rectangles from the first four values of each vector; the label is the page."""
    v = [F.col("embedding")[i].cast("double") for i in range(4)]
    edge = lambda f, a, b: G.rounded(f(v[a], v[b]) * 500 + 250, 2)
    return embeddings.select(F.col("label").alias("page"), F.col("vec_id").alias("box_id"), edge(F.least, 0, 2).alias("x0"), edge(F.least, 1, 3).alias("y0"), edge(F.greatest, 0, 2).alias("x1"), edge(F.greatest, 1, 3).alias("y1"))


def job_events(events: DataFrame) -> DataFrame:
    """(job_id, kind, event_id, ts, value)."""
    return events.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("kind"), "event_id", "ts", "value")
