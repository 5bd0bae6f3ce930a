"""Readers: paged text, hOCR markup with word confidence, page numbers, corrections, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vernalex.functions.text import entity_decode

CORRECTION_SCHEMA = "page int, transcription array<string>, source string, transcribed int, entries array<struct<page:int,was:string,headword:string,name:string,family:string,occurrence:int,taxa:array<string>,drop:boolean,wasTaxa:array<string>,ocrConfidence:int>>"
PAGE_NUMBER_SCHEMA = "pages array<struct<leafNum:int,pageNumber:string>>"


def page_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page, line_no, line) from 1: pages at form feeds, carriage returns dropped, trailing blank pages left out.

    A blank page before a page with text stays, with its blank lines; null texts have no lines.
    """
    last = F.size(F.split(F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), r"[\s\f]+$", ""), "\f"))
    pages = texts.select(key, last.alias("_last"), F.posexplode(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\f")).alias("_p", "_page")).where(F.col("_p") < F.col("_last"))
    return pages.select(key, (F.col("_p") + 1).alias("page"), F.posexplode(F.split("_page", "\n")).alias("_l", "line")).select(key, "page", (F.col("_l") + 1).alias("line_no"), "line")


def read_pages_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, line_no, line) of text files, each read whole."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return page_lines(raw, "path", "value")


def extraction_signals(text: Column) -> list[Column]:
    """Undecodable characters and accents read as é: the two signs of a bad text layer."""
    return [F.regexp_count(text, F.lit("\ufffd")).alias("n_undecodable"), F.regexp_count(text, F.lit("é")).alias("n_e_acute")]


def read_pages_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page int, lines array<string>").json(path, multiLine=True)


def read_page_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(leaf, printed_page); leaves without a number are left out."""
    d = spark.read.schema(PAGE_NUMBER_SCHEMA).json(path, multiLine=True).select(F.explode("pages").alias("p"))
    return d.select(F.col("p.leafNum").alias("leaf"), F.col("p.pageNumber").alias("printed_page")).where(F.col("printed_page").isNotNull() & (F.col("printed_page") != ""))


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a folder of correction files in file order: file, pos, page and the entry's fields."""
    d = spark.read.schema(CORRECTION_SCHEMA).json(path, multiLine=True).select(F.col("_metadata.file_name").alias("file"), "source", F.posexplode("entries").alias("pos", "e"))
    return d.select("file", "source", "pos", "e.*")


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of transcripts; blank and `#` lines are comments."""
    d = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("line"))
    return d.where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))


def transcript_item(line: Column) -> Column:
    """struct(head, nth, rest, malformed) of `HEAD#n | rest`; `-` as the rest means drop."""
    parts = F.split(line, r"\|", 2)
    head = F.trim(F.get(parts, F.lit(0)))
    nth = F.regexp_extract(head, r"#(\d+)$", 1)
    bare = F.trim(F.regexp_replace(head, r"#\d+$", ""))
    rest = F.trim(F.get(parts, F.lit(1)))
    return F.struct(bare.alias("head"), F.when(nth != "", nth.cast("int")).alias("nth"), F.when(rest != "", rest).alias("rest"), (F.coalesce(bare, F.lit("")) == "").alias("malformed"))


def _tags(html: Column, classes: str) -> Column:
    return F.split(html, rf"class=[\"'](?:{classes})[\"']")


def hocr_words(docs: DataFrame, key: str, html: str) -> DataFrame:
    """(key, page, line, word_no, text, conf, x0, y0, x1, y1) from hOCR markup, all from 0 in document order; blank words are dropped.

    Markup without a page, line or word gives no rows.
    """
    pages = docs.select(key, F.posexplode(_tags(F.col(html), "ocr_page")).alias("_p", "_h")).where("_p > 0")
    lines = pages.select(key, (F.col("_p") - 1).alias("page"), F.posexplode(_tags(F.col("_h"), "ocr_line|ocr_header|ocr_caption|ocr_textfloat")).alias("_l", "_h")).where("_l > 0")
    word = r"""class=["']ocrx_word["'][^>]*?bbox\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)[^>]*?x_wconf\s+(\d+)[^>]*>(.*?)</span>"""
    cols = [F.regexp_extract_all("_h", F.lit(word), F.lit(i)) for i in range(1, 7)]
    zipped = F.arrays_zip(*[c.alias(f"c{i}") for i, c in enumerate(cols)])
    w = lines.select(key, "page", (F.col("_l") - 1).alias("line"), F.posexplode(zipped).alias("word_no", "w"))
    text = F.trim(entity_decode(F.regexp_replace(F.col("w.c5"), "<[^>]*>", "")))
    out = w.select(key, "page", "line", "word_no", text.alias("text"), F.col("w.c4").cast("int").alias("conf"), *[F.col(f"w.c{i}").cast("int").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    return out.where(F.col("text") != "")


def token_confidence(words: DataFrame, page: list[str]) -> DataFrame:
    """(page, token, conf, box): the least confident reading of each token of a page."""
    token = F.lower("text")
    return words.groupBy(*page, token.alias("token")).agg(F.min("conf").alias("conf"), F.min_by(F.array("x0", "y0", "x1", "y1"), F.struct("conf", "line", "word_no")).alias("box"))


def line_boxes(words: DataFrame, line: list[str]) -> DataFrame:
    """The union of the word boxes of each line."""
    return words.groupBy(*line).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


# How far a box is widened on each side, as fractions of the page.
PAD_X, PAD_Y = 0.008, 0.003


def normal_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """[x, y, w, h] as padded, clamped fractions of the page, three decimals, halves up."""
    def r(c: Column) -> Column:
        return F.floor(c * 1000 + 0.5) / 1000

    def clamp(c: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))

    left, top, right, bottom = clamp(x0 / width - PAD_X), clamp(y0 / height - PAD_Y), clamp(x1 / width + PAD_X), clamp(y1 / height + PAD_Y)
    return F.array(r(left), r(top), r(right - left), r(bottom - top))


def implausible_box(box: Column) -> Column:
    """A box [x, y, w, h] that can't be one entry: too narrow, too flat or over half the page high."""
    return (box[2] < 0.05) | (box[3] < 0.004) | (box[3] > 0.6)


def crop(box: Column, aspect: Column) -> Column:
    """Where an image lies so that its box fills a frame: the frame's aspect, and the image's width, left and top in per cent."""
    x, y, w, h = box[0], box[1], box[2], box[3]
    return F.struct((w / (h * aspect)).alias("frame_aspect"), (100 / w).alias("width"), (-100 * x / w).alias("left"), (-100 * y / h).alias("top"))
