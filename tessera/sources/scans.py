"""Scans: manifests, JSON, text, byte slices, tagged and separated document streams, XML, SQL dumps, HTML, archives.

Files are opened by Spark (its readers, or bytes from binaryFile), so any store that Spark reads will do."""

from __future__ import annotations

import gzip
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import sha


def csv_manifest(spark: SparkSession, path: str, fields: Sequence[str] | None = None) -> DataFrame:
    """Every column a string; quotes doubled inside quotes, line feeds allowed there."""
    read = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False)
    if fields:
        read = read.schema(T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    held = read.csv(path)
    return held.na.fill("", held.columns)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object to a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object to a line. Only the last line may be torn, and only without its line feed; it is left out.

    Lines are read by ranges of the files, so a file may be larger than memory."""
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n").text(path).select("value", meta["file_path"].alias("_path"), meta["file_size"].alias("_size"), meta["file_block_start"].alias("_start"))
    value = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # Beside a number that must not be made twice, the parsed value isn't made twice either.
    parsed = raw.select("_path", "_size", "_start", value.alias("_v"), F.octet_length("value").cast("long").alias("_len"), F.monotonically_increasing_id().alias("_at"))
    held = parsed.filter((F.col("_at") >= 0) & (F.col("_len") > 0) & F.col("_v._bad").isNull()).select("_v.*").drop("_bad")
    # By the sums of a file's ranges, a bad line is the file's last one (of the highest number in the last range with lines) and lacks its line
    # feed (the lines with a feed each are a byte longer than the file; the reader leaves out a byte order mark).
    bad = (F.col("_len") > 0) & F.col("_v._bad").isNotNull()
    ranges = parsed.withColumn("_wrong", bad.cast("long")).groupBy("_path", "_size", "_start").agg(F.sum("_wrong").alias("_n"), F.max(F.col("_at") * 2 + F.col("_wrong")).alias("_last"), F.sum(F.col("_len") + 1).alias("_bytes"))
    files = ranges.groupBy("_path", "_size").agg(F.sum("_n").alias("_n"), (F.max_by("_last", "_start") % 2 == 1).alias("_last"), F.sum("_bytes").alias("_bytes"))
    torn = (F.col("_n") == 1) & F.col("_last") & (F.col("_bytes") - F.col("_size")).isin(1, -2)
    verdict = files.filter(F.assert_true((F.col("_n") == 0) | torn, F.concat(F.lit("bad line in "), F.col("_path"))).isNotNull())
    return held.unionAll(verdict.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema]))


def hashed_json_lines(spark: SparkSession, path: str, schema: str, text: str, digest: str) -> DataFrame:
    """JSON lines whose text must have the digest that the record names."""
    held = json_lines(spark, path, schema)
    return held.filter(F.assert_true(sha(F.col(text)) == F.col(digest), F.lit("a text doesn't have its digest")).isNull())


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one file to a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def byte_slices(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """index with `text`: bytes [byte_start, byte_end) of its file, whose length and SHA-256 must fit.

    index: (file, byte_start, byte_end, sha256, ...); file is the last part of the path."""
    own = [c for c in index.columns if c != "file"]
    slices = index.groupBy("file").agg(F.collect_list(F.struct(*own)).alias("_slices"))
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", F.col("length").alias("_len"))
    # A file meets the list of its slices once; what goes on from there is the slices' own bytes.
    part = lambda s: F.substring(F.col("content"), s["byte_start"].cast("int") + 1, (s["byte_end"] - s["byte_start"]).cast("int"))
    cut = F.transform("_slices", lambda s: F.struct(s.alias("s"), part(s).alias("bytes"), (s["byte_end"] <= F.col("_len")).alias("inside")))
    held = slices.join(files, "file").select("file", F.explode(cut).alias("_x"))
    fits = F.col("_x.inside") & (F.sha2("_x.bytes", 256) == F.col("_x.s.sha256"))
    held = held.filter(F.assert_true(fits, F.concat(F.lit("bad slice of "), F.col("file"))).isNull())
    return held.select(*[F.col("file") if c == "file" else F.col(f"_x.s.{c}") for c in index.columns], F.decode("_x.bytes", "UTF-8").alias("text"))


OPEN = re.compile(r'<text id="([^"]*)" url="([^"]*)">')


def tagged_stream(lines: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    """(id, url, text) of a stream; a closing tag only counts before an opening tag or the end."""
    held: list[str] | None = None
    head: tuple[str, str] | None = None
    pending = False
    for line in lines:
        m = OPEN.fullmatch(line.strip())
        if m and (head is None or pending):
            if head is not None:
                yield (*head, "\n".join(held))
            head, held, pending = (m[1], m[2]), [], False
            continue
        if pending:
            held.append("</text>")
            pending = False
        if line.strip() == "</text>" and head is not None:
            pending = True
        elif head is not None:
            held.append(line.rstrip("\n"))
        elif line.strip():
            raise ValueError("text outside a document")
    if head is not None:
        if not pending:
            raise ValueError("the last document isn't closed")
        yield (*head, "\n".join(held))


def tagged_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, text) of gzip files of tagged documents; a file is one task, as gzip can't be split."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows: list = []
                with gzip.open(io.BytesIO(content), "rt", encoding="utf-8") as stream:
                    for row in tagged_stream(stream):
                        rows.append(row)
                        if len(rows) == 1_000:
                            yield pd.DataFrame(rows, columns=["id", "url", "text"])
                            rows = []
                yield pd.DataFrame(rows, columns=["id", "url", "text"])

    return files.mapInPandas(run, "id string, url string, text string")


def separated_documents(spark: SparkSession, path: str, separator: str = "<|endoftext|>") -> DataFrame:
    """(text): documents that end with the separator alone on a line; a tail without one is an error."""
    line = f"\n{separator}\n"
    tails = spark.read.text(path, wholetext=True).filter(~F.endswith("value", F.lit(line)) & (F.trim("value") != ""))
    if not tails.isEmpty():
        raise ValueError("a file doesn't end with the separator")
    return spark.read.option("lineSep", line).text(path).select(F.trim("value").alias("text")).filter("text <> ''")


def wiki_pages(spark: SparkSession, path: str, titles: DataFrame | None = None) -> DataFrame:
    """(title, ns, id, text) of a wiki's XML dump; titles: (title) of the pages wanted."""
    schema = "title string, ns int, id long, revision struct<id:long,timestamp:string,text:struct<_VALUE:string>>"
    held = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    held = held.select("title", "ns", "id", F.col("revision.timestamp").alias("timestamp"), F.col("revision.text._VALUE").alias("text"))
    return held if titles is None else held.join(titles, "title", "left_semi")


def sql_tuples(line: str, table: str) -> Iterator[list[str | None]]:
    """Values of the tuples of an INSERT line; null for NULL, escapes undone."""
    head = f"INSERT INTO `{table}` VALUES "
    if not line.startswith(head):
        return
    escapes = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "Z": "\x1a", "b": "\b"}
    i, n = len(head), len(line)
    while i < n and line[i] == "(":
        i += 1
        row: list[str | None] = []
        while True:
            if line[i] == "'":
                i += 1
                out = []
                while line[i] != "'" or line[i : i + 2] == "''":
                    if line[i] == "\\":
                        out.append(escapes.get(line[i + 1], line[i + 1]))
                        i += 2
                    elif line[i] == "'":
                        out.append("'")
                        i += 2
                    else:
                        out.append(line[i])
                        i += 1
                i += 1
                row.append("".join(out))
            else:
                j = i
                while line[j] not in ",)":
                    j += 1
                row.append(None if line[i:j] == "NULL" else line[i:j])
                i = j
            i += 1
            if line[i - 1] == ")":
                break
        yield row
        i += 1  # the comma or semicolon between tuples


def sql_dump(spark: SparkSession, path: str, table: str, fields: Sequence[str]) -> DataFrame:
    """The rows of a table in an SQL dump, all strings."""
    rows = spark.read.text(path).filter(F.startswith("value", F.lit(f"INSERT INTO `{table}` VALUES ")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for line in batch["value"]:
                yield pd.DataFrame(list(sql_tuples(line, table)), columns=list(fields), dtype=object)

    return rows.mapInPandas(run, ", ".join(f"`{f}` string" for f in fields))


class _Article(HTMLParser):
    """Text of a page: scripts, styles, navigation and tables are left out, only <br> and blocks break lines."""

    SKIP = frozenset({"nav", "script", "style", "table", "head", "aside", "footer"})
    BLOCK = frozenset({"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote"})
    VOID = frozenset({"br", "img", "hr", "meta", "link", "input", "col", "wbr", "area", "base", "embed", "source", "track"})

    def __init__(self, skip_classes: Sequence[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.skip_classes, self.parts, self.stack, self.hidden = frozenset(skip_classes), [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append("\n")
        if tag in self.VOID:
            return
        classes = (dict(attrs).get("class") or "").split()
        hides = tag in self.SKIP or bool(self.skip_classes & set(classes))
        self.stack.append((tag, hides))
        self.hidden += hides
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if all(t != tag for t, _ in self.stack):
            return
        while self.stack:
            t, hides = self.stack.pop()
            self.hidden -= hides
            if t == tag:
                break
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(re.sub(r"\s+", " ", data))


def page_text(html: str, skip_classes: Sequence[str] = ("ad", "numeroriga")) -> str:
    """The lines of an HTML page."""
    parser = _Article(skip_classes)
    parser.feed(html or "")
    parser.close()
    lines = [" ".join(x.split()) for x in "".join(parser.parts).split("\n")]
    return "\n".join(x for x in lines if x)


class _Links(HTMLParser):
    """Links with the nearest heading before them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.heading, self.inside, self.link, self.words, self.found = "", False, None, [], []

    def handle_starttag(self, tag, attrs):
        if re.fullmatch("h[1-6]", tag):
            self.inside, self.words = True, []
        elif tag == "a" and dict(attrs).get("href"):
            self.link, self.words = dict(attrs)["href"], []

    def handle_endtag(self, tag):
        if re.fullmatch("h[1-6]", tag) and self.inside:
            self.heading, self.inside = " ".join("".join(self.words).split()), False
        elif tag == "a" and self.link is not None:
            self.found.append({"url": self.link, "label": " ".join("".join(self.words).split()), "heading": self.heading})
            self.link = None

    def handle_data(self, data):
        self.words.append(data)


def page_links(html: str) -> list[dict]:
    """Links of a page with label and heading, the first of each URL."""
    parser = _Links()
    parser.feed(html or "")
    parser.close()
    return list({x["url"]: x for x in reversed(parser.found)}.values())[::-1]


def extract_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(page_text)

    return run(html)


def extract_links(html: Column) -> Column:
    @F.pandas_udf("array<struct<url:string,label:string,heading:string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([page_links(p) for p in pages], dtype=object)

    return run(html)


TEI = "{http://www.tei-c.org/ns/1.0}"


def tei_views(xml: str) -> dict:
    """Title, author, and the running text, verse lines, notes, headings and paragraphs of a TEI file."""
    root = ElementTree.fromstring(xml)
    name = lambda e: e.tag.rpartition("}")[2]

    def text(e, without=()) -> str:
        out = [e.text or ""]
        for child in e:
            if name(child) not in without:
                out.append(text(child, without))
            out.append(child.tail or "")
        return "".join(out)

    flat = lambda e, without=(): " ".join(text(e, without).split())
    every = [e for e in root.iter() if isinstance(e.tag, str)]
    of = lambda kind, without=(): [flat(e, without) for e in every if name(e) == kind]
    body = next((e for e in every if name(e) == "body"), root)
    return {
        "title": next(iter(of("title")), ""),
        "author": next(iter(of("author")), ""),
        "running": flat(body, ("note",)),
        "verse": of("l", ("note",)),
        "notes": of("note"),
        "headings": of("head"),
        "paragraphs": of("p", ("note",)),
    }


def tei_documents(xml: Column) -> Column:
    @F.pandas_udf("title string, author string, running string, verse array<string>, notes array<string>, headings array<string>, paragraphs array<string>")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tei_views(p) for p in pages])

    return run(xml)


def archive_members(content: bytes) -> list[dict]:
    """(name, text) of a ZIP (its .xml, .tei and .txt members), ODT (paragraphs) or EPUB (pages in name order)."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted(z.namelist())
        if "content.xml" in names:
            root = ElementTree.fromstring(z.read("content.xml"))
            held = ["".join(e.itertext()) for e in root.iter() if e.tag.endswith("}p") or e.tag.endswith("}h")]
            return [{"name": "content.xml", "text": "\n".join(x for x in held if x.strip())}]
        for n in names:
            low = n.lower()
            if low.endswith((".xhtml", ".html", ".htm")):
                out.append({"name": n, "text": page_text(z.read(n).decode("utf-8", "replace"))})
            elif low.endswith((".txt", ".xml", ".tei")):
                out.append({"name": n, "text": z.read(n).decode("utf-8", "replace")})
    return out


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text) of the members of archives."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    @F.pandas_udf("array<struct<name:string,text:string>>")
    def run(contents: pd.Series) -> pd.Series:
        return pd.Series([archive_members(c) for c in contents], dtype=object)

    return files.select("path", F.explode(run("content")).alias("m")).select("path", "m.*")


def largest_text_member(members: DataFrame) -> DataFrame:
    """(path, name, text): the longest .txt member of each archive."""
    held = members.filter(F.endswith(F.lower("name"), F.lit(".txt")))
    best = held.groupBy("path").agg(F.max_by(F.struct("name", "text"), F.struct(F.length("text"), F.col("name"))).alias("m"))
    return best.select("path", "m.*")


def catalog_records(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Records of an XML catalogue answer."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def solr_records(spark: SparkSession, path: str, schema: str = "id string, title array<string>, author array<string>, year array<string>") -> DataFrame:
    """Documents of JSON catalogue answers; fields with several values are arrays."""
    held = spark.read.option("multiLine", True).schema(f"response struct<docs:array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in schema.split(', '))}>>>").json(path)
    return held.select(F.explode("response.docs").alias("d")).select("d.*")


def token_file(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(path, tokens): little-endian unsigned 16-bit (width 2) or signed 32-bit (width 4) ids."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    @F.pandas_udf("array<int>")
    def run(contents: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(c, "<u2" if width == 2 else "<i4").astype(np.int32) for c in contents], dtype=object)

    return files.select("path", run("content").alias("tokens"))


def generations(spark: SparkSession, path: str, texts: DataFrame) -> DataFrame:
    """Generated files that metadata.json lists, joined to (file, text) by the last part of their path."""
    meta = spark.read.option("multiLine", True).schema("run string, generated_files array<string>").json(path)
    listed = meta.select("run", F.explode("generated_files").alias("listed")).withColumn("file", F.element_at(F.split("listed", "/"), -1))
    return listed.join(texts, "file", "left")


def upsert(base: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """base and new with the latest row of each key."""
    held = base.unionByName(new)
    best = held.groupBy(key).agg(F.max_by(F.struct(*[c for c in held.columns if c != key]), F.col(order)).alias("_r"))
    return best.select(key, "_r.*")


def json_strings(payload: Column) -> Column:
    """Every string in a JSON value, in reading order."""
    import json

    def walk(v) -> list[str]:
        if isinstance(v, str):
            return [v]
        if isinstance(v, dict):
            return [s for x in v.values() for s in walk(x)]
        return [s for x in v for s in walk(x)] if isinstance(v, list) else []

    @F.pandas_udf("array<string>")
    def run(cells: pd.Series) -> pd.Series:
        return pd.Series([walk(json.loads(c)) if c else [] for c in cells], dtype=object)

    return run(payload)
