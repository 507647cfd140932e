"""From spine documents to canonical books: noise and front matter go, titles are chosen, chapters and ids renumbered;
reading corpus JSON back; scopes of chapter pairs; places of paragraphs in their chapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What boilerplate contains, and language names that open a list of translations.
BOILERPLATE = ["tekst jest własnością publiczną", "text je vlastnictvim"]
INTERWIKI = ["беларуская", "polski", "čeština", "cestina"]
#: A chapter's heading in a div starts with a digit or one of these, or is in capitals.
CHAPTER_WORDS = ["Rozdział", "Rozdzial"]
HEADINGS = ["h1", "h2", "h3"]


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_noise(text: Column) -> Column:
    """Boilerplate, or nothing that makes a name."""
    return _any([F.contains(F.lower(text), F.lit(x)) for x in BOILERPLATE]) | (F.length(T.slugify(text)) <= 1)


def is_front_matter(href: Column, title: Column, book_title: Column, paragraphs: Column) -> Column:
    """paragraphs: array of texts. None at all, a lone paragraph under a title page, or a list of translations."""
    lone = F.size(paragraphs) <= 1
    first = F.lower(F.coalesce(F.try_element_at(paragraphs, F.lit(1)), F.lit("")))
    return (F.size(paragraphs) == 0) | (lone & (F.contains(F.lower(href), F.lit("c0_")) | (T.slugify(title) == T.slugify(book_title)))) | _any([F.contains(first, F.lit(x)) for x in INTERWIKI])


def chapter_title(headings: Column, fallback: Column, index: Column) -> Column:
    """headings: array of (tag, text) in page order. The first fit one of more than two characters, else the clean
    fallback, else a number."""

    def fits(h):
        text = T.clean_text(h["text"])
        capitals = (text == F.upper(text)) & (text != F.lower(text))
        telling = capitals | text.rlike(r"^\p{Nd}") | _any([F.startswith(text, F.lit(w)) for w in CHAPTER_WORDS])
        return (F.length(text) > 2) & (h["tag"].isin(*HEADINGS) | ((h["tag"] == "div") & (F.length(text) < 160) & telling))

    clean = T.clean_text(F.coalesce(fallback, F.lit("")))
    return F.coalesce(T.clean_text(F.try_element_at(F.filter(headings, fits), F.lit(1))["text"]), F.when(clean != "", clean), F.concat(F.lit("Chapter "), index.cast("string")))


def canonical(spine: DataFrame) -> DataFrame:
    """spine: book_id, book_title, spine_ordinal, href, title, headings, paragraphs (array) -> book_id, chapter_index (from
    1, without what is dropped), chapter_id, title, href, paragraph_id, paragraph_index, text.

    Chapters are numbered within their book (a spine's length, not the corpus's); paragraphs are arrays, so no other
    order is needed. Paragraphs that are noise go first; they count neither for front matter nor in numbers.
    """
    rows = spine.withColumn("paragraphs", F.filter("paragraphs", lambda t: ~is_noise(t)))
    rows = rows.where(~is_front_matter(F.col("href"), F.col("title"), F.col("book_title"), F.col("paragraphs")))
    rows = rows.withColumn("chapter_index", F.row_number().over(Window.partitionBy("book_id").orderBy("spine_ordinal")))
    rows = rows.withColumn("title", chapter_title(F.col("headings"), F.col("title"), F.col("chapter_index")))
    chapter = F.format_string("book-%s-c-%03d-%s", F.col("book_id").cast("string"), F.col("chapter_index"), T.slugify(F.col("title")))
    rows = rows.withColumn("chapter_id", chapter)
    each = rows.select("book_id", "chapter_index", "chapter_id", "title", "href", F.posexplode("paragraphs").alias("k", "text"))
    return each.select("book_id", "chapter_index", "chapter_id", "title", "href", F.format_string("%s-p-%04d", "chapter_id", F.col("k") + 1).alias("paragraph_id"), (F.col("k") + 1).alias("paragraph_index"), "text")


CHAPTER_JSON = "id string, index int, title string, paragraphs array<struct<id:string,index:int,text:string,sentences:array<string>>>"


def from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Corpus JSON, a chapter a row -> chapter_id, chapter_index, title, paragraph_id, paragraph_index, text, sentences.
    Text that is no such JSON, or a chapter without id, fails when it is read."""
    book = F.from_json(F.col(column), CHAPTER_JSON, {"mode": "FAILFAST"})
    known = rows.select(F.when(book["id"].isNull(), F.raise_error(F.lit("a chapter without id"))).otherwise(book).alias("c"))
    each = known.select(F.col("c.id").alias("chapter_id"), F.col("c.index").alias("chapter_index"), F.col("c.title").alias("title"), F.explode("c.paragraphs").alias("p"))
    return each.select("chapter_id", "chapter_index", "title", F.col("p.id").alias("paragraph_id"), F.col("p.index").alias("paragraph_index"), "p.text", "p.sentences")


def scoped_pairs(pairs: DataFrame, sizes: DataFrame, least: int = 29, tail: tuple[int, ...] = (27, 28, 29)) -> DataFrame:
    """Chapter pairs (book, source_index, target_index) with the tail's chapters set against each other one to one, in
    books whose both sides (sizes: book, source_chapters, target_chapters) have `least` chapters or more."""
    long = sizes.where((F.col("source_chapters") >= least) & (F.col("target_chapters") >= least)).select("book")
    forced = long.select("book", F.explode(F.array(*map(F.lit, tail))).alias("source_index")).withColumn("target_index", F.col("source_index"))
    known = pairs.join(long.withColumn("long", F.lit(True)), "book", "left")
    before = (F.col("source_index") < tail[0]) & (F.col("target_index") < tail[0])
    return known.where(F.col("long").isNull() | before).drop("long").select("book", "source_index", "target_index").unionByName(forced)


def cut_chapter(paragraphs: DataFrame, chapter: int = 29, last: int = 393) -> DataFrame:
    """chapter_index, paragraph_index, ... without what follows a chapter's last paragraph in scope."""
    return paragraphs.where((F.col("chapter_index") != chapter) | (F.col("paragraph_index") <= last))


def normalised_places(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph_index, and its place from 0 to 1 in the document."""
    rows = docs.select("doc_id", T.paragraphs(F.col("text")).alias("p"))
    each = rows.select("doc_id", F.size("p").alias("n"), F.posexplode("p").alias("k", "text"))
    return each.select("doc_id", (F.col("k") + 1).alias("paragraph_index"), (F.col("k") / F.greatest(F.col("n") - 1, F.lit(1))).alias("place"))
