"""Readers of strict JSON lines, archives, XML, HTML and fixed-width files, and manifests."""

from __future__ import annotations

import io
import warnings
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.plans.scratch import new_path
from corpusloom.registry import query


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines: a broken or blank line raises when the rows are read."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    blank = F.trim("value") == ""
    return lines.select(F.when(blank, F.raise_error(F.lit("a blank line"))).otherwise(parsed).alias("r")).select("r.*")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with broken ones, such as a half-written last line, kept in ``_corrupt_record``; blank lines go."""
    kind = T._parse_datatype_string(schema).add("_corrupt_record", "string")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def read_metrics_tail(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Whole metrics of files that are still written to, and one row: how many lines are broken or half-written."""
    rows = read_jsonl_tolerant(spark, path, schema)
    broken = F.col("_corrupt_record").isNotNull()
    return rows.where(~broken).drop("_corrupt_record"), rows.agg(F.count_if(broken).alias("n_broken"))


def unsafe_member(name: Column, mode: Column | None = None) -> Column:
    """Why an archive's member mustn't be extracted, or null."""
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    link = F.lit(False) if mode is None else F.shiftright(mode, 12) == 10
    return (
        F.when(name.startswith("/") | name.rlike("^[A-Za-z]:"), "absolute").when(F.array_contains(parts, ".."), "traversal").when(name.contains("\\"), "backslash").when(link, "link").when(F.trim(name) == "", "blank")
    )


def zip_members(files: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """(archive, member, n_bytes, text, problem) of ZIP files (path, content).

    Members that are unsafe, too large, or not UTF-8 are rows with a ``problem`` and no
    text; so is a file that isn't an archive. One archive is read at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        seen = set()
                        for info in archive.infolist():
                            name, problem, text = info.filename, None, None
                            if info.is_dir():
                                continue
                            if name.startswith("/") or ".." in name.split("/") or "\\" in name:
                                problem = "unsafe name"
                            elif name in seen:
                                problem = "duplicate name"
                            elif info.file_size > most_bytes:
                                problem = "too large"
                            else:
                                try:
                                    text = archive.read(info).decode()
                                except (UnicodeDecodeError, zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
                                    problem = type(e).__name__
                            seen.add(name)
                            rows.append((path, name, info.file_size, text, problem))
                except zipfile.BadZipFile:
                    rows.append((path, None, None, None, "not an archive"))
                yield pd.DataFrame(rows, columns=["archive", "member", "n_bytes", "text", "problem"])

    return files.select("path", "content").mapInPandas(run, "archive string, member string, n_bytes long, text string, problem string")


def read_zip_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON documents in ZIP files: arrays and objects that wrap a list give a row for each element."""
    members = zip_members(spark.read.format("binaryFile").load(path)).where("problem IS NULL")
    wrapped = F.from_json("text", f"array<struct<{schema}>>")
    return members.select("archive", "member", F.explode(wrapped).alias("r")).select("archive", "member", "r.*")


def read_xml_items(texts: DataFrame, column: str, path: list[str], schema: str) -> DataFrame:
    """A row for each element at ``path``, the tags below the root, of XML texts, with typed fields.

    The whole text is parsed, so attributes, CDATA and nesting are; a broken one gives no row.
    """
    kind = f"array<struct<{schema}>>"
    for tag in reversed(path[1:]):
        kind = f"struct<{tag}: {kind}>"
    parsed = texts.withColumn("_x", F.from_xml(column, f"{path[0]} {kind}"))
    rows = parsed.select(*[c for c in texts.columns if c != column], F.explode(F.col(".".join(["_x", *path]))).alias("_r"))
    return rows.select("*", "_r.*").drop("_r")


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
            self.open = True

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.open = False

    def handle_data(self, data):
        if self.open and self.rows and self.rows[-1]:
            self.rows[-1][-1] += data


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row, cells) of every table row with a cell in HTML texts."""

    @F.pandas_udf("array<struct<row:int,cells:array<string>>>")
    def cells(texts: pd.Series) -> pd.Series:
        def one(text):
            parser = _Cells()
            parser.feed(text or "")
            full = [[" ".join(c.split()) for c in r] for r in parser.rows if r]
            return [{"row": i, "cells": r} for i, r in enumerate(full)]

        return texts.map(one)

    return pages.select(key, F.explode(cells(F.col(html))).alias("r")).select(key, "r.*")


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, href) of every link with a quoted address."""
    found = F.regexp_extract_all(F.col(html), F.lit("""(?i)<a[^>]*?href=["']([^"']*)["']"""), F.lit(1))
    return pages.select(key, F.explode(found).alias("href"))


def delimited_lines(lines: DataFrame, column: str, form: str, names: list[str]) -> DataFrame:
    """Lines that match a pattern, its groups as columns; other lines are left out."""
    return lines.where(F.col(column).rlike(form)).select(*(F.regexp_extract(column, form, i + 1).alias(n) for i, n in enumerate(names)))


def missing_identities(found: DataFrame, keys: dict[str, list]) -> DataFrame:
    """Expected combinations of small key domains that a table lacks."""
    spark = found.sparkSession
    expected = None
    for name, values in keys.items():
        own = spark.createDataFrame([(v,) for v in values], [name])
        expected = own if expected is None else expected.crossJoin(own)
    return expected.join(found.select(*keys), list(keys), "left_anti")


def fixed_width(lines: DataFrame, column: str, fields: dict[str, tuple[int, int, str]]) -> DataFrame:
    """Typed columns from character places (first, length, type); blank fields are null."""
    return lines.select(*(F.nullif(F.trim(F.substring(column, a, n)), F.lit("")).try_cast(kind).alias(name) for name, (a, n, kind) in fields.items()))


def file_manifest(files: DataFrame) -> DataFrame:
    """(path, n_bytes, sha256, split) of files (path, content); the split is told by the path."""
    split = F.when(F.col("path").rlike("(?i)/valid"), "validation").when(F.col("path").rlike("(?i)/test"), "test").otherwise("train")
    return files.select("path", F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), split.alias("split"))


def verify_manifest(registered: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, problem): registered files that are missing or changed, and files that aren't registered."""
    both = registered.select("path", F.col("sha256").alias("want")).join(scanned.select("path", F.col("sha256").alias("have")), "path", "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unregistered").when(F.col("want") != F.col("have"), "changed")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def with_locator(df: DataFrame) -> DataFrame:
    """File rows with where they are: the file's path and the row's number in it."""
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))


def locators_at(df: DataFrame, *places: int) -> DataFrame:
    """The locators (file_path, row_index) of rows by their places, from 0, in the whole table: its files in the order of their paths.

    Only the files' numbers of rows are compared, one row for each file.
    """
    files = with_locator(df).groupBy("file_path").agg((F.max("row_index") + 1).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("file_path"))
    placed = files.withColumn("_end", upto).withColumn("_place", F.explode(F.array(*(F.lit(p).cast("long") for p in places))))
    own = F.col("_place") - F.col("_end") + F.col("_n")
    return placed.where((own >= 0) & (own < F.col("_n"))).select("file_path", own.alias("row_index"))


def fetch_rows(df: DataFrame, locators: DataFrame) -> DataFrame:
    """The rows at locators (file_path, row_index)."""
    return with_locator(df).join(locators.select("file_path", "row_index"), ["file_path", "row_index"], "left_semi")


@query("src_07_json_inventory", "SELECT 'k' AS key, 'number' AS kind, count(*) AS n FROM events")
def _(t):
    v = F.from_json("props", "map<string,string>")
    keys = t.events.select(F.explode(v).alias("key", "value"))
    kind = F.when(F.col("value").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number").otherwise("text")
    return keys.groupBy("key", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("src_08_zip_members", """
SELECT page_id, 'train/a.json' AS member, strlen(url) AS n_bytes, sha256(url) AS h, NULL AS problem FROM pages UNION ALL
SELECT page_id, '../b.json', strlen(url), NULL, 'unsafe name' FROM pages UNION ALL
SELECT page_id, 'train/a.json', strlen(html), NULL, 'duplicate name' FROM pages WHERE contains(url, '?') UNION ALL
SELECT page_id, 'train/c.bin', 2, NULL, 'UnicodeDecodeError' FROM pages WHERE NOT contains(url, '?')""")
def _(t):
    @F.pandas_udf("binary")
    def packed(urls: pd.Series, pages: pd.Series) -> pd.Series:
        def one(url, html):
            out = io.BytesIO()
            with warnings.catch_warnings(), zipfile.ZipFile(out, "w") as archive:
                warnings.simplefilter("ignore")  # of the duplicate name
                archive.writestr("train/a.json", url)
                archive.writestr("../b.json", url)
                archive.writestr(*("train/a.json", html) if "?" in url else ("train/c.bin", b"\xff\xfe"))
            return out.getvalue()

        return pd.Series([one(u, h) for u, h in zip(urls, pages)])

    files = t.pages.select(F.col("page_id").cast("string").alias("path"), packed("url", "html").alias("content"))
    return zip_members(files).select(F.col("archive").cast("long").alias("page_id"), "member", "n_bytes", F.sha2("text", 256).alias("h"), "problem")


@query("src_09_wrapped_records", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(t):
    document = F.concat(F.lit("["), F.col("props"), F.lit("]"))
    return t.events.select("event_id", F.explode(F.from_json(document, "array<struct<k:int>>")).alias("r")).select("event_id", "r.k")


@query("src_10_json_lines", "SELECT event_id, user_id FROM events")
def _(t):
    lines = t.events.select(F.to_json(F.struct("event_id", "user_id")).alias("value"))
    return lines.select(F.from_json("value", "event_id long, user_id long", {"mode": "FAILFAST"}).alias("r")).select("r.*")


@query("src_21_metrics_tail", """
SELECT step, loss, n_broken FROM (SELECT event_id AS step, value AS loss FROM events WHERE event_type <> 'error'), (SELECT count(*) FILTER (event_type = 'error') AS n_broken FROM events)""")
def _(t):
    """Lines of metrics, of which those of errors are cut off in the middle as a writer's last line may be."""
    path = new_path(t.spark, "metrics")
    line = F.to_json(F.struct(F.col("event_id").alias("step"), F.col("value").alias("loss")))
    t.events.select(F.when(F.col("event_type") == "error", F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line).alias("value")).write.text(path)
    whole, broken = read_metrics_tail(t.spark, path, "step long, loss double")
    return whole.crossJoin(broken)  # one row


@query("src_12_rule_document", "SELECT 'r' || n_nationkey AS rule, r_name AS effect FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    entry = F.struct(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("rule"), F.col("r_name").alias("effect"))
    document = joined.agg(F.to_json(F.struct(F.collect_list(entry).alias("rules"))).alias("d"))  # 25 rules
    return document.select(F.explode(F.from_json("d", "rules array<struct<rule:string,effect:string>>")["rules"]).alias("r")).select("r.*")


@query("src_13_xml_days", "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m FROM orders")
def _(t):
    page = F.format_string("<response a='1'><items n=\"1\"><!-- a day --><item><y>%d</y><m><![CDATA[%d]]></m></item></items></response>", F.year("o_orderdate"), F.month("o_orderdate"))
    return read_xml_items(t.orders.select("o_orderkey", page.alias("x")), "x", ["items", "item"], "y: int, m: int")


@query("src_14_xml_terms", "SELECT n_nationkey, n_name AS term FROM nation WHERE length(n_name) BETWEEN 5 AND 9")
def _(t):
    page = F.format_string("<r><item><term>%s</term></item></r>", "n_name")
    rows = read_xml_items(t.nation.select("n_nationkey", page.alias("x")), "x", ["item"], "term: string")
    return rows.where(F.length("term").between(5, 9))


@query("src_15_html_tables", """
SELECT page_id, 0 AS row, 'page|address' AS cells FROM pages UNION ALL SELECT page_id, 1, page_id || '|' || url FROM pages UNION ALL SELECT page_id, 2, 'links & parts|' || strlen(html) FROM pages""")
def _(t):
    """Every page with a table of itself at its end, as its own text has none."""
    address = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    table = F.concat(F.lit("<table class='x'><tr><th>page</th><th>address</th></tr>\n<tr><td>"), F.col("page_id").cast("string"), F.lit("</td><td>"), address, F.lit("</td></tr><tr><td>links &amp;\n parts<td><b>"), F.octet_length("html").cast("string"), F.lit("</b></table>"))
    pages = t.pages.select("page_id", F.concat("html", table).alias("html"))
    return html_tables(pages, "page_id", "html").select("page_id", "row", F.array_join("cells", "|").alias("cells"))


@query("src_15_html_links", """SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a[^>]*?href=["'']([^"'']*)["'']', 1)) AS href FROM pages""")
def _(t):
    return html_links(t.pages, "page_id", "html")


@query("src_16_delimited", "SELECT CAST(o_orderkey AS VARCHAR) AS key, strftime(o_orderdate, '%Y') AS y FROM orders WHERE o_orderkey % 3 = 0")
def _(t):
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise("# a comment")
    return delimited_lines(t.orders.select(line.alias("value")), "value", r"^([0-9]+)\t([0-9]{4})-", ["key", "y"])


@query("src_16_missing_identities", "SELECT r::INT AS r_regionkey, m::INT AS m FROM generate_series(0, 6) f(r), generate_series(1, 3) g(m) WHERE r NOT IN (SELECT r_regionkey FROM region)")
def _(t):
    found = t.region.select("r_regionkey", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("m"))
    return missing_identities(found, {"r_regionkey": list(range(7)), "m": [1, 2, 3]}).select(F.col("r_regionkey").cast("int").alias("r_regionkey"), F.col("m").cast("int").alias("m"))


@query("src_17_fixed_width", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def _(t):
    line = F.concat(F.lpad(F.col("c_custkey").cast("string"), 10, " "), F.lpad(F.col("c_nationkey").cast("string"), 4, " "), F.lpad(F.col("c_acctbal").cast("string"), 24, " "))
    return fixed_width(t.customer.select(line.alias("value")), "value", {"c_custkey": (1, 10, "long"), "c_nationkey": (11, 4, "int"), "c_acctbal": (15, 24, "double")})


@query("src_18_manifest", "SELECT url AS path, strlen(html)::INT AS n_bytes, sha256(html) AS sha256, 'train' AS split FROM pages WHERE NOT regexp_matches(url, '(?i)/(valid|test)')")
def _(t):
    return file_manifest(t.pages.select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))).where("split = 'train'")


@query("src_19_verify_manifest", "SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 10 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM pages WHERE page_id % 10 IN (0, 1)")
def _(t):
    files = file_manifest(t.pages.select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content")))
    number = F.col("path").cast("long") % 10
    return verify_manifest(files, files.where(number != 0).withColumn("sha256", F.when(number == 1, "x").otherwise(F.col("sha256"))))


@query("src_20_locators", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER () - 1 AS i FROM documents) WHERE i IN (0, 7, 100)")
def _(t):
    return fetch_rows(t.documents, locators_at(t.documents, 0, 7, 100)).select("doc_id")


@query("src_25_26_unsafe_members", "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'absolute' WHEN 1 THEN 'traversal' WHEN 2 THEN 'backslash' WHEN 3 THEN 'link' END AS problem FROM nation")
def _(t):
    k = F.col("n_nationkey") % 5
    name = F.when(k == 0, "/etc/x").when(k == 1, "a/../../x").when(k == 2, "a\\x").otherwise("a/x")
    mode = F.when(k == 3, 0o120777).otherwise(0o100644)
    return t.nation.select("n_nationkey", unsafe_member(name, mode).alias("problem"))
