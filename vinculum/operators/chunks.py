"""Fixed-size chunks with overlap, their context, text units and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_documents(docs: DataFrame, size: int = 4000, overlap: int = 200) -> DataFrame:
    """docs (document_id, text) to chunks; the last chunk is the first that reaches the end; empty texts give none."""
    if not 0 <= overlap < size:
        raise ValueError("chunk_documents: 0 <= overlap < size")
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    rows = docs.where("text is not null and text <> ''").select("document_id", "text", F.posexplode(starts).alias("chunk_index", "start_char"))
    end = F.least(F.col("start_char") + size, n)
    content = F.substring("text", F.col("start_char") + 1, F.lit(size))
    return rows.select(F.concat(F.col("document_id").cast("string"), F.lit("-chunk-"), F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id", "chunk_index", "start_char", end.alias("end_char"), content.alias("content"), F.floor(F.length(content) / 4).cast("int").alias("token_count"))


def neighbours(chunks: DataFrame) -> DataFrame:
    """Adds the chunks before and after within the document."""
    w = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    return chunks.withColumn("prev_chunk", F.lag("chunk_id").over(w)).withColumn("next_chunk", F.lead("chunk_id").over(w))


def contextualised(title: Column, year: Column, topic: Column) -> Column:
    return F.concat(F.lit("Document: "), title, F.lit(" ("), year, F.lit("). Context: "), topic)


def text_units(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """chunks (chunk_id, content, token_count), mentions (chunk_id, entity_id): a unit per chunk with its entities."""
    m = mentions.groupBy("chunk_id").agg(F.sort_array(F.collect_set("entity_id")).alias("entity_ids"))
    out = chunks.join(m, "chunk_id", "left")
    return out.select(F.concat(F.lit("tu_"), "chunk_id").alias("text_unit_id"), "chunk_id", F.col("token_count").alias("n_tokens"), F.coalesce("entity_ids", F.array().cast("array<string>")).alias("entity_ids"))
