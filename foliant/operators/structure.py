"""Equations, tables, figures and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import detect as D
from foliant.functions import text as T
from foliant.operators.pages import page_lines

CAPTION_GAP, TABLE_AROUND, FIGURE_GAP, FIGURE_AROUND = 60, 80, 80, 150
LINE_DRIFT, TITLE_SIZE, TITLE_GAP = 3.0, 0.85, 2.5
MIN_WIDTH, MIN_HEIGHT, MIN_AREA, MIN_BYTES = 400, 400, 200_000, 10_000


def equations(pages: DataFrame) -> DataFrame:
    """Lines of at least five signs with a label, mathematics or a known symbol; the first of each (page, label or beginning).

    A line gets its neighbours within its page's row, and only such lines leave it.
    """
    first = lambda k: F.greatest(k - D.CONTEXT, F.lit(0))
    around = lambda ls: lambda x, k: F.struct(k.alias("line_no"), T.strip(x).alias("s"), F.concat(F.slice(ls, first(k) + 1, k - first(k)), F.slice(ls, k + 2, D.CONTEXT)).alias("near"))
    rows = pages.select("document_id", "page_num", T.lines(F.col("text")).alias("ls")).select("document_id", "page_num", F.explode(F.transform("ls", around(F.col("ls")))).alias("x")).select("document_id", "page_num", "x.*")
    rows = rows.where(F.length("s") >= D.LINE_LEAST).withColumn("label", D.equation_label(F.col("s"))).where(F.col("label").isNotNull() | D.math_density(F.col("s")) | D.math_word(F.col("s")))
    near = F.filter(F.transform("near", T.strip), lambda y: (y != "") & (y != F.col("s")))
    least = Window.partitionBy("document_id", "page_num", F.coalesce("label", F.substring("s", 1, 40))).orderBy("line_no")
    return rows.withColumn("rn", F.row_number().over(least)).where("rn = 1").select("document_id", "page_num", "line_no", "label", F.col("s").alias("text"), F.substring(F.array_join(near, " | "), 1, 300).alias("surrounding_text"))


def keep_images(images: DataFrame) -> DataFrame:
    return images.where((F.col("width") >= MIN_WIDTH) & (F.col("height") >= MIN_HEIGHT) & (F.col("width") * F.col("height") >= MIN_AREA) & (F.col("bytes") >= MIN_BYTES))


def number_images(images: DataFrame) -> DataFrame:
    """Numbers over the document and on the page, and file names, of the kept images."""
    doc = Window.partitionBy("document_id").orderBy("page_num", "image_no")
    page = Window.partitionBy("document_id", "page_num").orderBy("image_no")
    k = keep_images(images).withColumn("image_index", F.row_number().over(doc)).withColumn("page_image", F.row_number().over(page))
    return k.withColumn("filename", T.figure_filename(F.col("page_num"), F.col("page_image"), F.col("label"), F.col("ext")))


def build_tables(raw: DataFrame) -> DataFrame:
    """Raw grids ``document_id, page_num, table_no, cells`` to headers, rows and text; grids without two rows or content are dropped."""
    cells = T.clean_table(F.col("cells"))
    kept = raw.where(F.size("cells") >= 2).withColumn("clean", cells).where(F.size("clean") > 0)
    heads = F.transform(F.get("clean", F.lit(0)), lambda c: F.coalesce(c, F.lit("")))
    body = F.slice("clean", 2, F.greatest(F.size("clean") - 1, F.lit(1)))
    return kept.select("document_id", "page_num", "table_no", heads.alias("headers"), F.when(F.size("clean") > 1, body).otherwise(F.array().cast("array<array<string>>")).alias("rows")).withColumn("markdown", T.markdown(F.col("headers"), F.col("rows")))


def words_to_lines(words: DataFrame) -> DataFrame:
    """Words ``document_id, page_num, top, x0, text`` to lines: a new one where the top is over three points off the line's first."""
    sorted_words = F.array_sort(F.collect_list(F.struct("top", "x0", "text")))
    start = F.struct(F.array().cast("array<struct<y:double,t:string>>").alias("done"), F.lit(None).cast("double").alias("y"), F.lit("").alias("t"))

    def step(a: Column, w: Column) -> Column:
        new = a["y"].isNull() | (F.abs(w["top"] - a["y"]) > LINE_DRIFT)
        flush = F.when(a["y"].isNotNull(), F.concat(a["done"], F.array(F.struct(a["y"].alias("y"), a["t"].alias("t"))))).otherwise(a["done"])
        return F.struct(F.when(new, flush).otherwise(a["done"]).alias("done"), F.when(new, w["top"].cast("double")).otherwise(a["y"]).alias("y"), F.when(new, w["text"]).otherwise(F.concat(a["t"], F.lit(" "), w["text"])).alias("t"))

    done = F.aggregate(sorted_words, start, step, lambda a: F.when(a["y"].isNotNull(), F.concat(a["done"], F.array(F.struct(a["y"].alias("y"), a["t"].alias("t"))))).otherwise(a["done"]))
    g = words.groupBy("document_id", "page_num").agg(done.alias("l"))
    return g.select("document_id", "page_num", F.posexplode("l").alias("line_no", "x")).select("document_id", "page_num", "line_no", F.col("x.y").alias("y"), F.col("x.t").alias("text"))


def table_captions(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """The first caption line (by height) in the zones above and below a table; else the page's first, anywhere.

    tables: document_id, page_num, table_no, top, bottom; lines: as ``words_to_lines``.
    """
    cap = T.collapse(D.found(F.col("text"), D.TABLE_CAPTION))
    l = lines.select("document_id", "page_num", "line_no", "y", cap.alias("caption")).where("caption is not null")  # noqa: E741
    j = tables.join(l, ["document_id", "page_num"], "left")
    zone = F.col("y").between(F.col("top") - CAPTION_GAP, F.col("top") + 5) | F.col("y").between(F.col("bottom") - 5, F.col("bottom") + CAPTION_GAP)
    g = j.groupBy("document_id", "page_num", "table_no").agg(F.min_by(F.when(zone, F.col("caption")), F.when(zone, F.struct("y", "line_no"))).alias("near"), F.min_by("caption", F.struct("y", "line_no")).alias("any"))
    out = g.withColumn("caption", F.coalesce("near", "any"))
    return out.select("document_id", "page_num", "table_no", "caption", T.strip(D.found(F.col("caption"), D.TABLE_LABEL)).alias("label"))


def table_context(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of at least 15 signs within 80 points of a table, its caption left out. tables: with ``caption``."""
    j = tables.join(lines, ["document_id", "page_num"])
    near = F.col("y").between(F.col("top") - TABLE_AROUND, F.col("top")) | F.col("y").between(F.col("bottom"), F.col("bottom") + TABLE_AROUND)
    own = F.coalesce(F.startswith(F.col("text"), F.substring("caption", 1, 30)), F.lit(False))
    rows = j.where(near & (F.length("text") >= 15) & ~own)
    g = rows.groupBy("document_id", "page_num", "table_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "line_no", "text"))), lambda x: x["text"]), " … ").alias("t"))
    return tables.join(g, ["document_id", "page_num", "table_no"], "left").select("document_id", "page_num", "table_no", F.substring(F.coalesce("t", F.lit("")), 1, 400).alias("surrounding_text"))


def figure_captions(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """The first block that begins like a caption and meets the zone below, else above, a figure.

    images: document_id, page_num, image_no, x0, y0, x1, y1; blocks: document_id, page_num, block_no, bx0, by0, bx1, by1, text.
    """
    j = images.join(blocks, ["document_id", "page_num"], "left")
    across = (F.col("bx1") >= F.col("x0") - 20) & (F.col("bx0") <= F.col("x1") + 20)
    below = across & (F.col("by1") >= F.col("y1")) & (F.col("by0") <= F.col("y1") + FIGURE_GAP)
    above = across & (F.col("by1") >= F.col("y0") - FIGURE_GAP) & (F.col("by0") <= F.col("y0"))
    label = T.strip(D.found(F.col("text"), D.FIG_LABEL))
    rank = F.when(label.isNotNull() & below, F.struct(F.lit(0).alias("z"), "block_no")).when(label.isNotNull() & above, F.struct(F.lit(1).alias("z"), "block_no"))
    g = j.groupBy("document_id", "page_num", "image_no").agg(F.min_by(F.when(rank.isNotNull(), F.struct(T.collapse(F.col("text")).alias("caption"), label.alias("label"))), rank).alias("c"))
    return g.select("document_id", "page_num", "image_no", "c.caption", "c.label")


def figure_context(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """Text blocks of at least 20 signs around a figure, captions left out."""
    j = images.join(blocks, ["document_id", "page_num"])
    near = (F.col("bx1") >= F.col("x0") - 30) & (F.col("bx0") <= F.col("x1") + 30) & (F.col("by1") >= F.col("y0") - FIGURE_AROUND) & (F.col("by0") <= F.col("y1") + FIGURE_AROUND)
    rows = j.where(near & (F.length(T.strip(F.col("text"))) >= 20) & ~F.col("text").rlike(D.FIG_LABEL))
    g = rows.groupBy("document_id", "page_num", "image_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: T.collapse(x["text"])), " … ").alias("t"))
    return images.join(g, ["document_id", "page_num", "image_no"], "left").select("document_id", "page_num", "image_no", F.substring(F.coalesce("t", F.lit("")), 1, 400).alias("surrounding_text"))


def titles(spans: DataFrame) -> DataFrame:
    """A title from a first page's spans ``document_id, span_no, y, size, text``: large ones from the top while the gaps stay small."""
    big = Window.partitionBy("document_id")
    s = spans.where((F.length(T.strip(F.col("text"))) > 3) & (F.col("size") > 0)).withColumn("most", F.max("size").over(big)).where(F.col("size") >= TITLE_SIZE * F.col("most"))
    w = Window.partitionBy("document_id").orderBy("y", "span_no")
    s = s.withColumn("gap", F.coalesce(F.col("y") - F.lag("y").over(w), F.lit(0.0))).withColumn("off", F.max((F.col("gap") > TITLE_GAP * F.col("most")).cast("int")).over(w))
    g = s.where("off = 0").groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "span_no", "text"))), lambda x: x["text"]), " ").alias("t"))
    t = T.collapse(F.col("t"))
    return g.select("document_id", F.when((F.length(t) >= 5) & ~t.rlike(r"^\d+$"), F.substring(t, 1, 400)).alias("title"))


def academic(docs: DataFrame, titles_of: DataFrame | None = None, n_pages: int = 3) -> DataFrame:
    """Bibliographic facts of each document ``document_id, pages`` from the text of its first pages."""
    text = docs.select("document_id", F.array_join(F.slice("pages", 1, n_pages), "\n").alias("t"), F.get("pages", F.lit(0)).alias("page1"))
    j = text.join(titles_of, "document_id", "left") if titles_of is not None else text.withColumn("title", F.lit(None).cast("string"))
    t = F.col("t")
    out = j.select("document_id", "title", D.front_authors(F.col("page1"), F.col("title")).alias("authors"), D.year(t).alias("year"), D.doi(t).alias("doi"), D.abstract(t).alias("abstract"), D.keywords(t).alias("keywords"), D.volume(t).alias("volume"), D.page_range(t).alias("pages"), F.lit(None).cast("string").alias("journal"))
    return out.withColumn("citation_key", D.citation_key(F.col("authors"), F.col("year"), F.col("title")))


def paired_boxes(grids: DataFrame, boxes: DataFrame) -> DataFrame:
    """Grids ``document_id, page_num, cells`` of a page with the page's boxes ``bbox``, by their order; null where a page has fewer boxes.

    Frames: ``document_id, page_num, grids array`` and ``document_id, page_num, boxes array``.
    """
    j = grids.join(boxes, ["document_id", "page_num"], "left").select("document_id", "page_num", F.posexplode("grids").alias("k", "cells"), "boxes")
    return j.select("document_id", "page_num", (F.col("k") + 1).alias("table_no"), "cells", F.get("boxes", F.col("k")).alias("bbox"))
