"""Evidence contexts within a character budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words that say nothing about a question's subject.
GENERIC = ("which", "where", "there", "paper", "papers", "about", "using", "study", "studies", "first", "their", "these", "model", "models")


def focus(hits: DataFrame, per_parent: int = 2) -> DataFrame:
    """(query_id, parent_id, parent_rank, question, rank, text, ...) -> slot: the best hit, then hits by their rarer question words.

    Rarity is counted in the parent's own hits: a word found in n of them weighs 1 / (1 + n).
    """
    words = F.filter(F.regexp_extract_all(F.lower("question"), F.lit("[a-z][a-z0-9-]{4,}"), F.lit(0)), lambda w: ~w.isin(*GENERIC))
    prefix = hits.withColumn("p", F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 6))))
    found = prefix.withColumn("f", F.filter("p", lambda t: F.contains(F.lower("text"), t)))
    own = Window.partitionBy("query_id", "parent_id")
    pool = found.withColumn("all", F.flatten(F.collect_list("f").over(own)))
    weight = F.aggregate("f", F.lit(0.0), lambda s, t: s + 1.0 / (1 + F.size(F.filter("all", lambda x: x == t))))
    best = pool.withColumns({"weight": F.round(weight, 12), "at": F.row_number().over(own.orderBy("rank"))})
    order = own.orderBy(F.col("at") > 1, F.when(F.size("p") > 0, -F.col("weight")).otherwise(F.lit(0.0)), "at")
    return best.withColumn("slot", F.row_number().over(order).cast("long")).where(F.col("slot") <= per_parent).drop("p", "f", "all", "at")


def select_contexts(hits: DataFrame, max_chars: int = 12000, per_parent: int = 2, overhead: int = 200, most: int | None = None) -> DataFrame:
    """Round robin over parents (slot, then parent rank); an item that doesn't fit is skipped: number, text_sha256."""
    if max_chars < 500 or per_parent < 1:
        raise ValueError("max_chars must be at least 500 and per_parent at least 1")
    slots = focus(hits, per_parent).where(F.char_length("text") > 0)
    if most is not None:
        slots = slots.withColumn("text", F.substring("text", 1, most))
    one = F.struct("slot", "parent_rank", "parent_id", "chunk_id", "text")
    queue = slots.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("q"))
    fits = lambda acc, x: acc["used"] + F.char_length(x["text"]) + overhead <= max_chars
    kept = F.aggregate(
        "q",
        F.struct(F.lit(0).alias("used"), F.slice("q", 1, 0).alias("out")),
        lambda acc, x: F.struct(
            F.when(fits(acc, x), acc["used"] + F.char_length(x["text"]) + overhead).otherwise(acc["used"]).alias("used"),
            F.when(fits(acc, x), F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"),
        ),
    )["out"]
    rows = queue.select("query_id", F.posexplode(kept).alias("n", "x"))
    return rows.select("query_id", (F.col("n") + 1).cast("long").alias("number"), "x.parent_id", "x.chunk_id", "x.text", F.sha2("x.text", 256).alias("text_sha256"))


def full_contexts(parents: DataFrame, max_chars: int = 12000, overhead: int = 200) -> DataFrame:
    """Whole texts in parent order, numbered; a question whose texts don't fit together is an error.

    parents: query_id, parent_id, parent_rank, text.
    """
    if max_chars < 500:
        raise ValueError("max_chars must be at least 500")
    filled = parents.where(F.char_length("text") > 0)
    over = filled.groupBy("query_id").agg(F.sum(F.char_length("text") + overhead).alias("used")).where(F.col("used") > max_chars)
    if not over.isEmpty():
        raise ValueError(f"whole texts need more than {max_chars} characters")
    order = Window.partitionBy("query_id").orderBy("parent_rank")
    return filled.select("query_id", F.row_number().over(order).cast("long").alias("number"), "parent_id", F.lit(None).cast("string").alias("chunk_id"), "text", F.sha2("text", 256).alias("text_sha256"))


def prompt(contexts: DataFrame) -> DataFrame:
    """One prompt text a query: numbered blocks with a blank line between them."""
    block = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("parent_id"), F.lit("\n"), F.col("text"))
    return contexts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("prompt"))
