"""Reading and writing corpora, items and results."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, filled, found, strip


def read_corpus_dir(spark: SparkSession, path: str) -> DataFrame:
    """Every *.txt below a folder, or one file: (filename, content)."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return text.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"))


def combine_corpus(docs: DataFrame, by: str, most: int) -> DataFrame:
    """Texts of a corpus in order under headers, up to the first one that would pass `most` characters.

    A part has five characters at least, so the first most / 5 rows of a corpus decide: lengths are ranked with that limit, which Spark applies before the
    shuffle, and only the texts that fit are fetched.
    """
    part = F.concat(F.lit("# "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), filled(F.col("text")), F.lit("\n\n"))
    order = Window.partitionBy(by).orderBy("doc_id", "digest")
    keyed = docs.select(by, "doc_id", part.alias("part"), F.md5(part).alias("digest"))
    sizes = keyed.select(by, "doc_id", "digest", F.length("part").alias("size")).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most // 5 + 1)
    running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    fit = sizes.withColumn("total", running).filter(F.col("total") < most).select(*[F.col(c).alias(f"_{c}") for c in (by, "doc_id", "digest")]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (by, "doc_id", "digest")]
    fits = keyed.join(fit, same[0] & same[1] & same[2], "left_semi").withColumn("size", F.length("part"))
    fits = fits.withColumn("nth", F.row_number().over(order)).withColumn("total", running).filter(F.col("total") < most)  # of rows equal throughout, as many as fit
    return fits.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "part"))), lambda x: x["part"]), "").alias("corpus"), F.count("*").alias("texts"))


# What uploads may be, and what they may not hold.
EXTENSIONS = ["txt", "md", "py", "js", "json", "csv", "html", "xml", "yml", "yaml", "cfg", "ini", "log"]
UNSAFE_FILE = r"<script[^>]*>.*?</script>|javascript:|data:.*base64|\\x[0-9a-fA-F]{2}"
UNSAFE_CALLS = r"eval\s*\(|exec\s*\("


def reject_reason(name: Column, text: Column, route: str = "file") -> Column:
    """Why an upload is rejected; null if it isn't. Files are first judged by name and size, then line by line; texts, and files after that, as a whole."""
    t = filled(text)
    by_file = [
        (~F.lower(filled(name)).rlike(rf"\.({'|'.join(EXTENSIONS)})$"), "extension"), (F.octet_length(t) > 10 * 1024 * 1024, "bytes"), (F.length(t) > 5 * 1024 * 1024, "characters"),
        (t.rlike(f"(?i){UNSAFE_FILE}"), "unsafe"),
    ]
    by_text = [(strip(t) == "", "empty"), (t.rlike(f"(?is){UNSAFE_FILE}"), "unsafe"), (t.rlike(f"(?is){UNSAFE_CALLS}"), "code")]
    return F.coalesce(*[F.when(c, r) for c, r in (by_file if route == "file" else []) + by_text])


def sanitize_name(c: Column, default: str = "Uploaded Corpus") -> Column:
    t = clean_text(F.regexp_replace(filled(c), r"(?U)[^\w\s\-_()]", ""))
    return F.when(F.length(t) < 3, default).otherwise(t)


def title_to_filename(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(F.regexp_replace(filled(c), r"(?U)[^\w\s-]", "")), r"\s+", "_"))


def extract_links(texts: DataFrame, column: str = "text") -> DataFrame:
    """Different links among the lines that begin with /wiki/, without what follows `#`, in order."""
    links = texts.select(F.explode(found(F.col(column), r"(?m)^/wiki/\S+")).alias("raw"))
    return links.select(F.split_part("raw", F.lit("#"), F.lit(1)).alias("link")).distinct().orderBy("link")


def anchor_lines(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> (page_id, text): one line /wiki/... for each anchor to a path of the same site."""
    paths = found(F.col("html"), 'href="/([^"]*)"', 1)
    return pages.select("page_id", F.array_join(F.transform(paths, lambda p: F.concat(F.lit("/wiki/"), p)), "\n").alias("text"))


def pending_links(links: DataFrame, done: DataFrame, missing: DataFrame) -> DataFrame:
    return links.join(done.select("link"), "link", "left_anti").join(missing.select("link"), "link", "left_anti")


class _Reader(HTMLParser):
    """Collects the text of kept blocks in document order; what lies in dropped ones is passed over.

    The outermost kept element takes in the kept ones within it. A div is only a border: text that stands in it outside other blocks is a block of its own. Ends that HTML lets
    writers leave out are filled in: a block ends an open paragraph, an item or term the one before it in its list.
    """

    keep = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "blockquote", "pre"}
    void = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}
    #: By tag: what it ends if that is open, and what shields it.
    ends = {tag: ({"p"}, {"td", "th", "table", "button"}) for tag in (*keep, "div", "table", "section", "article", "form")}
    ends |= {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}

    def __init__(self, tags: set[str], classes: set[str], parts: set[str], least: int, phrases: list[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.classes, self.parts, self.least, self.phrases = tags, classes, parts, least, phrases
        self.stack: list[tuple[str, bool]] = []
        self.outermost: int | None = None
        self.out: list[str] = []
        self.text: list[str] = []
        self.all: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.void:
            if tag == "br":
                self.handle_data("\n")
            return
        ended, shields = self.ends.get(tag, ((), ()))
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in ended:
                self.pop_to(at)
                break
            if self.stack[at][0] in shields:
                break
        named = dict(attrs).get("class") or ""
        dropped = bool(self.stack and self.stack[-1][1]) or tag in self.tags or bool(set(named.split()) & self.classes) or tag == "div" and any(p in named for p in self.parts)
        if self.outermost is None and not dropped and (tag in self.keep or tag == "div"):
            self.flush()
            if tag in self.keep:
                self.outermost = len(self.stack)
        self.stack.append((tag, dropped))

    def pop_to(self, at: int) -> None:
        """Closes the open elements from the innermost to that at `at`."""
        while len(self.stack) > at:
            tag, dropped = self.stack.pop()
            if self.outermost == len(self.stack):
                self.flush(tag)
                self.outermost = None
            elif tag == "div" and self.outermost is None and not dropped:
                self.flush()

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                return self.pop_to(at)

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][1]):
            self.text.append(data)
            self.all.append(data)

    def flush(self, tag: str = "") -> None:
        t = " ".join("".join(self.text).split())
        self.text = []
        if len(t) >= self.least and not any(p in t.lower() for p in self.phrases):
            self.out.append("#" * int(tag[1]) + " " + t if tag[:1] == "h" and tag[1:].isdigit() else t)

    def result(self) -> str:
        """The kept blocks; if there is none, all lines of more than five characters."""
        self.pop_to(0)
        self.flush()
        lines = (line.strip() for line in "\n".join(self.all).split("\n"))
        return "\n\n".join(self.out or [line for line in lines if len(line) > 5])


# Phrases of navigation.
NAVIGATION = ["coordinates:", "jump to:", "navigation menu", "edit]", "[edit]", "citation needed]", "redirected from", "article talk", "tools appearance hide"]
# Elements and classes that pages lose.
DROPPED_TAGS = ("nav", "script", "style", "footer", "header", "title", "figure", "figcaption")
DROPPED_CLASSES = ("ad", "infobox", "reference", "references", "reflist", "toc", "navbox", "navbox-container", "thumb", "thumbinner", "thumbcaption", "edit", "editsection", "hatnote", "metadata",
                   "noprint", "printfooter", "catlinks", "authority-control", "coordinates")
#: Of divs: parts of class names.
DROPPED_PARTS = ("navbox", "infobox", "thumbinner", "thumbcaption", "toc", "references", "reflist", "authority-control", "navbox-container", "metadata", "hatnote", "catlinks", "printfooter")


def html_to_text(pages: DataFrame, tags: tuple[str, ...] = DROPPED_TAGS, classes: tuple[str, ...] = DROPPED_CLASSES, parts: tuple[str, ...] = DROPPED_PARTS, least: int = 10, phrases: tuple[str, ...] = tuple(NAVIGATION)) -> DataFrame:
    """pages (page_id, html) -> (page_id, text): kept blocks joined by blank lines, headers marked by `#`. Null pages give an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for html in b["html"]:
                r = _Reader(set(tags), set(classes), set(parts), least, list(phrases))
                r.feed(html or "")
                r.close()
                texts.append(r.result())
            yield pd.DataFrame({"page_id": b["page_id"], "text": texts})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")


def read_articles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON objects title -> content, one for each file or, with lines, for each line: (title, content), without blank contents."""
    raw = spark.read.text(path, wholetext=not lines)
    rows = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("title", "content"))
    return rows.filter(strip(F.col("content")) != "")


def article_texts(articles: DataFrame) -> DataFrame:
    """articles (title, content) -> (filename, content): the text under its title as a header; blank contents are left out."""
    name = F.concat(title_to_filename(F.col("title")), F.lit(".txt"))
    text = F.concat(F.lit("# "), "title", F.lit("\n\n"), strip(F.col("content")))
    return articles.filter(strip(F.col("content")) != "").select(name.alias("filename"), text.alias("content"))


def write_articles(articles: DataFrame, path: str) -> None:
    """JSON lines, one object title -> content for each article."""
    articles.select(F.to_json(F.create_map("title", "content")).alias("value")).write.mode("overwrite").text(path)


ITEM = "item_id long, question string, answer string, context string, options array<string>, eval_type string, difficulty string, deterministic boolean, validation_score double"


def parse_items(texts: DataFrame, column: str = "value") -> DataFrame:
    """JSON documents, each {items: [...]}, {benchmark_items: [...]}, a list, or one item -> an item for each row, with defaults for what it lacks.

    The answer's type follows from options, or from its being a number in the JSON.
    """
    c = F.col(column)
    held = F.coalesce(F.get_json_object(c, "$.items"), F.get_json_object(c, "$.benchmark_items"), F.when(F.ltrim(c).startswith("["), c), F.concat(F.lit("["), c, F.lit("]")))
    rows = texts.select(F.explode(F.from_json(held, "array<string>")).alias("j")).select(F.from_json("j", ITEM).alias("x"), "j").select("x.*", "j")
    numeric = F.schema_of_variant(F.try_variant_get(F.try_parse_json("j"), "$.answer", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    kind = F.when(F.size("options") > 0, "multiple_choice").when(numeric, "numeric_exact").otherwise("free_text")
    return rows.select(
        "item_id", F.coalesce("question", F.lit("Sample question?")).alias("question"), F.coalesce("answer", F.lit("Sample answer")).alias("answer"), "context", "options",
        F.coalesce("eval_type", F.lit("domain_knowledge")).alias("eval_type"), F.coalesce("difficulty", F.lit("intermediate")).alias("difficulty"),
        F.coalesce("deterministic", F.lit(True)).alias("deterministic"), F.coalesce("validation_score", F.lit(0.8)).alias("validation_score"), kind.alias("answer_type"),
    )


def load_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON files of any of the shapes that parse_items takes, one document for each file."""
    return parse_items(spark.read.text(path, wholetext=True))


def task_lines(rows: DataFrame) -> DataFrame:
    """rows with a task -> (task, line): each row as one JSON object without the task and without nulls."""
    rest = [c for c in rows.columns if c != "task"]
    return rows.select("task", F.to_json(F.struct(*rest), {"ignoreNullFields": "true"}).alias("line"))


def write_task_datasets(rows: DataFrame, path: str) -> None:
    """One folder of JSON lines for each task."""
    rows.write.partitionBy("task").mode("overwrite").json(path)


def run_results(results: DataFrame, most: int = 200) -> DataFrame:
    """The first `most` rows of each run by item; the limit is applied in each task before the rows meet."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("item_id"))
    return results.withColumn("nth", rank).filter(F.col("nth") <= most).drop("nth")


def write_run_results(results: DataFrame, path: str, most: int = 200) -> None:
    run_results(results, most).write.partitionBy("run_id").mode("overwrite").json(path)


def write_finetune_files(items: DataFrame, path: str) -> None:
    """JSON lines {"text": ...} under split=train, valid, test; rows without question or answer under rejected."""
    lines, bad = finetune_lines(items)
    lines.write.partitionBy("split").mode("overwrite").json(f"{path}/lines")
    bad.write.mode("overwrite").json(f"{path}/rejected")


def finetune_lines(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines `Question: ... Answer: ...` by split, and the rows that have no question or no answer."""
    bad = (clean_text(F.col("question")) == "") | (clean_text(F.col("answer")) == "")
    text = F.concat(F.lit("Question: "), F.col("question"), F.lit("\nAnswer: "), F.col("answer"))
    return items.filter(~bad).select("split", text.alias("text")), items.filter(bad)
