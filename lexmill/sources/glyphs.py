"""Lines of text from positioned glyph runs, as a relational plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, paragraph_no, line) of ``glyphs(doc_id, page, str, x, y, width, height)``.

    A run opens a line if it lies more than the larger of 2.5 and 0.35 of its height below the run before, down the page;
    runs of a line are ordered by x, with a blank where the gap exceeds 2.5 and no closing punctuation follows. A gap between
    lines of more than the larger of 1.45 of the height and 12 opens a paragraph. Null runs are left out."""
    g = glyphs.filter("str is not null and x is not null and y is not null")
    down = Window.partitionBy("doc_id", "page").orderBy(F.desc("y"), "x", "str")
    g = g.withColumn("prev_y", F.lag("y").over(down))
    opens = F.coalesce(F.abs(F.col("prev_y") - F.col("y")) > F.greatest(F.lit(2.5), F.col("height") * 0.35), F.lit(True))
    g = g.withColumn("line_no", F.sum(opens.cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    across = Window.partitionBy("doc_id", "page", "line_no").orderBy("x", "str")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(across)
    part = F.concat(F.when((gap > 2.5) & ~F.col("str").rlike(r"^[.,;:!?)\]]"), " ").otherwise(""), F.col("str"))
    made = g.withColumn("part", part).groupBy("doc_id", "page", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "str", "part"))), lambda v: v["part"]), "").alias("line"), F.max("y").alias("y"), F.max("height").alias("height"))
    order = Window.partitionBy("doc_id", "page").orderBy("line_no")
    breaks = F.coalesce(F.lag("y").over(order) - F.col("y") > F.greatest(F.col("height") * 1.45, F.lit(12.0)), F.lit(True))
    made = made.withColumn("b", breaks.cast("int")).withColumn("paragraph_no", F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return made.select("doc_id", "page", "line_no", "paragraph_no", F.trim("line").alias("line"))


def page_texts(made: DataFrame) -> DataFrame:
    """(doc_id, text): paragraphs parted by blank lines, words broken at a line's end joined, pages headed by a marker."""
    p = made.groupBy("doc_id", "page", "paragraph_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda v: v["line"]), "\n").alias("t"))
    p = p.withColumn("t", F.regexp_replace(F.regexp_replace("t", r"(?<=\p{L})-\n(?=\p{L})", ""), r"\n", " "))
    page = p.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_no", "t"))), lambda v: v["t"]), "\n\n").alias("t"))
    head = F.concat(F.lit("─── PAGE "), F.col("page").cast("string"), F.lit(" ───\n"), F.col("t"))
    return page.withColumn("t", head).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda v: v["t"]), "\n\n").alias("text"))
