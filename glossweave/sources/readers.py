"""Readers: raw records of corpus formats to document rows.

Document rows are source_corpus, raw_text, original_text, key, id, title, categories.  Records are read
whole (a record is a file, or an element of one), the rest is column expressions.
"""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.stem import stem_all, stems, unescape_html
from glossweave.functions.text import space_tokens

DOCUMENT = ["source_corpus", "raw_text", "original_text", "key", "id", "title", "categories"]


def _document(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    rest = {"categories": F.array().cast("array<string>"), "original_text": F.col("record"), "source_corpus": F.lit(source)} | columns
    return rows.select(*[rest[c].alias(c) for c in DOCUMENT])


def java_hash(text: Column) -> Column:
    """The 32-bit polynomial hash (base 31) of a string's UTF-16 code units, signed, as bigint."""
    units = F.encode(text, "UTF-16BE")
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(units), F.lit(2)) - 1, F.lit(2)), lambda k: F.coalesce(F.conv(F.hex(F.substring(units, k, F.lit(2))), 16, 10).cast("long"), F.lit(0)))
    whole = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(0xFFFFFFFF))
    return F.when(whole >= 1 << 31, whole - (1 << 32)).otherwise(whole)


# --- records ----------------------------------------------------------------------------------------------


def _elements(text: Column, tag: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)<{tag}[ >].*?</{tag}>"), 0)


def xml_files(spark: SparkSession, path: str, tag: str | None) -> DataFrame:
    """path, pos, record: elements ``tag`` of whole files, markup byte for byte; without a tag, whole files named by their base name."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    if not tag:
        return rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.lit(0).alias("pos"), F.col("text").alias("record"))
    return rows.select("path", F.posexplode(_elements(F.col("text"), tag)).alias("pos", "record"))


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Paths of a list file, one a line; a list is as long as the number of archives."""
    return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]


def gzip_xml_list(spark: SparkSession, list_path: str, tag: str) -> DataFrame:
    """path, pos, record from gzipped files named in a list; each is unpacked by the task that reads it."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [gzip.decompress(x).decode("utf-8", "replace") for x in pdf["content"]]})

    raw = spark.read.format("binaryFile").load(_listed(spark, list_path)).select("path", "content").mapInPandas(unpack, "path string, text string")
    return raw.select("path", F.posexplode(_elements(F.col("text"), tag)).alias("pos", "record"))


def tar_list(spark: SparkSession, list_path: str) -> DataFrame:
    """key (SHA-1 of the parent folder and the entry's name), name, record of the entries of gzipped tar files named in a list; folders are left out."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as archive:
                    for entry in archive:
                        if entry.isfile():
                            body = archive.extractfile(entry).read().decode("utf-8", "replace")
                            yield pd.DataFrame({"parent": [path.rsplit("/", 2)[-2]], "name": [entry.name], "record": [body]})

    rows = spark.read.format("binaryFile").load(_listed(spark, list_path)).select("path", "content").mapInPandas(unpack, "parent string, name string, record string")
    return rows.select(F.sha1(F.concat("parent", "name")).alias("key"), "name", "record")


def line_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1), value: lines numbered within their file."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("at", "value"))
    return rows.select("path", (F.col("at") + 1).cast("long").alias("line"), "value")


def headword_lines(spark: SparkSession, path: str) -> DataFrame:
    """header, start, end, text of ``header::start::end::text`` lines."""
    part = F.split("value", "::", 4)
    return spark.read.text(path).where(F.size(part) == 4).select(part[0].alias("header"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end"), part[3].alias("text"))


def sql_dump(spark: SparkSession, path: str, encoding: str = "iso-8859-1") -> DataFrame:
    """row (array of fields) of every tuple of the INSERT lines of a SQL dump; quoted fields lose quotes and backslashes."""
    lines = spark.read.option("encoding", encoding).csv(path, sep="\x01", quote="", schema="value string").where(F.col("value").startswith("INSERT INTO"))
    field = r"'(?:[^'\\]|\\.)*'|[^,()']+"
    tuples = F.regexp_extract_all("value", F.lit(rf"\((?:(?:{field}),)*(?:{field})\)"), 0)
    rows = lines.select(F.explode(tuples).alias("t"))
    fields = F.regexp_extract_all(F.expr("substring(t, 2, length(t) - 2)"), F.lit(rf"({field})(?:,|$)"), 1)
    plain = F.transform(fields, lambda x: F.when(x.startswith("'"), F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")).otherwise(x))
    return rows.select(plain.alias("row"))


def conll_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, sent, tok, word, lemma, pos, head, rel of tab-separated dependency files whose sentences end with an empty line."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.filter(F.split("value", r"\n[ \t]*\n"), lambda s: F.trim(s) != "")).alias("sent", "block"))
    lines = rows.select("path", "sent", F.posexplode(F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")).alias("tok", "line")).withColumn("f", F.split("line", "\t"))
    return lines.select("path", "sent", "tok", F.col("f")[1].alias("word"), F.col("f")[2].alias("lemma"), F.col("f")[4].alias("pos"), F.col("f")[6].cast("int").alias("head"), F.col("f")[7].alias("rel"))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word, vector of semantic-space files: ``word|v v v`` lines after a line of sizes; lines without numbers are left out."""
    parts = F.split("value", r"\|", 2)
    rows = spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("word"), F.transform(F.split(F.trim(parts[1]), r"[\s,]+"), lambda x: x.try_cast("double")).alias("vector"))
    return rows.where(~F.exists("vector", lambda x: x.isNull()))


# --- documents --------------------------------------------------------------------------------------------


def ukwac(rows: DataFrame, source: str = "ukwac") -> DataFrame:
    """One token a line, its first column the word; sentence marks are left out, entities decoded; key and title from the first line's id."""
    lines = F.split("record", "\n")
    key = F.regexp_extract(lines[0], r'id="(.*)">', 1)
    body = F.filter(F.slice(lines, 2, 1 << 30), lambda x: (F.trim(x) != "") & ~F.rtrim(x).endswith("s>") & ~x.startswith("</text"))
    text = unescape_html(F.array_join(F.transform(body, lambda x: F.split(x, r"\s+")[0]), " "))
    return _document(rows, source, raw_text=text, key=key, id=java_hash(key), title=key)


def wackypedia(rows: DataFrame) -> DataFrame:
    return ukwac(rows, "wackypedia")


def pubmed(rows: DataFrame) -> DataFrame:
    """Title, abstract without its copyright notice, PMID and MeSH descriptors of citation records."""
    text = F.trim(F.array_join(F.expr("xpath(record, '//Abstract//text()[not(ancestor::CopyrightInformation)]')"), ""))
    key = F.expr("xpath_string(record, '//PMID')")
    tags = F.array_distinct(F.expr("xpath(record, '//MeshHeading/DescriptorName/text()')"))
    return _document(rows, "pubmed", raw_text=text, key=key, id=key.cast("long"), title=F.expr("xpath_string(record, '//ArticleTitle')"), categories=tags)


def _last_place(words: Column, keyword: Column) -> Column:
    return F.array_max(F.transform(stem_all(words), lambda w, i: F.when(w == keyword, i).otherwise(-1))).cast("long")


def semeval2010(rows: DataFrame, part: str) -> DataFrame:
    """Records inside one tag that names the key; id is the place of the last token with the key word's stem, or -1."""
    key = F.regexp_extract("record", r"<([^ >/]+)[ >]", 1)
    text = F.trim(F.regexp_replace("record", r"<[^>]+>", ""))
    named = rows.withColumn("_key", key).withColumn("_text", text).withColumn("_stem", stems(F.regexp_extract("_key", r"^([^.]*)", 1))).withColumn("_place", _last_place(space_tokens(F.col("_text")), F.col("_stem")))
    return _document(named, f"semeval2010_{part}", raw_text=F.col("_text"), key=F.col("_key"), id=F.col("_place"), title=F.col("_key"))


def senseeval2007(rows: DataFrame) -> DataFrame:
    """Instances with a marked head: key from the id, title its part before the dot, id the number of tokens before the head; malformed records are left out."""
    shape = r'(?s)id="(.*?)" corpus.*?>(.*?)<head>(.*?)</head>(.*?)</instance>'
    part = [F.regexp_extract("record", shape, k) for k in range(1, 5)]
    good = rows.where(F.col("record").rlike(shape))
    text = F.array_join(F.filter(F.array(*[F.regexp_replace(x, r"^\s+|\s+$", "") for x in part[1:]]), lambda x: x != ""), " ")
    return _document(good, "senseeval2007", raw_text=text, key=part[0], id=F.size(space_tokens(part[1])).cast("long"), title=F.regexp_extract(part[0], r"^([^.]*)", 1))


# Tokens that all-words texts write otherwise.
REWRITES = {"'s": "is", "'m": "am", "%": "percent", "ft.": "ft"}


def all_words(rows: DataFrame) -> DataFrame:
    """doc, sent, tok, word, id of all-words texts: one token a line, ``<head id>`` targets, ``<sat id>`` words joined to their head by ``_`` in the order of ids.

    Sentences end at a full stop; tokens that begin with ``0`` or ``*`` are left out.
    """
    import re

    head = re.compile(r'<head id="([^"]+)"(?: sats="([^"]*)")?>\s*(.*?)\s*</head>')
    sat = re.compile(r'<sat id="([^"]+)">\s*(.*?)\s*</sat>')

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, record in zip(pdf["doc"], pdf["record"]):
                sats = {m[1]: m[2] for m in sat.finditer(record)}
                sent = tok = 0
                for line in record.split("\n"):
                    line = line.strip()
                    if not line or sat.search(line) or line.startswith("<") and not head.search(line):
                        continue
                    ident, word = "", line
                    if m := head.search(line):
                        ident = m[1]
                        parts = {m[1]: m[3]} | {s: sats[s] for s in (m[2] or "").split() if s in sats}
                        word = "_".join(parts[k] for k in sorted(parts))
                    if word[:1] in "0*":
                        continue
                    out.append((doc, sent, tok, REWRITES.get(word, word), ident))
                    tok += 1
                    if word == ".":
                        sent, tok = sent + 1, 0
            yield pd.DataFrame(out, columns=["doc", "sent", "tok", "word", "id"])

    return rows.select("doc", "record").mapInPandas(run, "doc string, sent int, tok int, word string, id string")


def tagged_words(rows: DataFrame) -> DataFrame:
    """doc, sent, tok, word, id, pos of ``<s>`` sentences of ``<w>`` words and ``<h id pos>`` targets."""
    sents = rows.select("doc", F.posexplode(_elements(F.col("record"), "s")).alias("sent", "s"))
    words = sents.select("doc", "sent", F.posexplode(F.regexp_extract_all("s", F.lit(r"<[wh](?: [^>]*)?>[^<]*</[wh]>"), 0)).alias("tok", "w"))
    return words.select("doc", "sent", "tok", F.trim(F.regexp_extract("w", r">([^<]*)<", 1)).alias("word"), F.regexp_extract("w", r'\bid="([^"]*)"', 1).alias("id"), F.regexp_extract("w", r'\bpos="([^"]*)"', 1).alias("pos"))


def semcor(rows: DataFrame) -> DataFrame:
    """doc, sent, tok, lemma, lexsn, pos of the word elements of ``<s>`` sentences."""
    sents = rows.select("doc", F.posexplode(_elements(F.col("record"), "s")).alias("sent", "s"))
    words = sents.select("doc", "sent", F.posexplode(F.regexp_extract_all("s", F.lit(r"<wf [^>]*>"), 0)).alias("tok", "w"))
    return words.select("doc", "sent", "tok", *[F.regexp_extract("w", rf'\b{a}="?([^" >]*)', 1).alias(a) for a in ("lemma", "lexsn", "pos")])


# Where the news format keeps its fields.
NEWS = {
    "guid": "//doc-id/@id-string", "alternate_url": "//meta[@name='alternate_url']/@content", "url": "//pubdata/@ex-ref", "headline": "//hedline/hl1", "online_headline": "//hedline/hl2[@class='online_headline']",
    "byline": "//byline[@class='print_byline']", "dateline": "//dateline", "lead": "//block[@class='lead_paragraph']", "abstract": "//abstract", "section": "//meta[@name='online_sections']/@content", "desk": "//meta[@name='dsk']/@content",
    "page": "//meta[@name='print_page_number']/@content", "print_section": "//meta[@name='print_section']/@content", "column": "//meta[@name='print_column']/@content", "feature": "//meta[@name='feature_page']/@content", "series": "//series/@series.name",
    "year": "//meta[@name='publication_year']/@content", "month": "//meta[@name='publication_month']/@content", "day": "//meta[@name='publication_day_of_month']/@content", "weekday": "//meta[@name='publication_day_of_week']/@content",
    "published": "//pubdata/@date.publication", "words": "//pubdata/@item-length", "kicker": "//kicker", "author_info": "//tagline", "correction": "//correction_text", "correction_date": "//correction_date", "banner": "//meta[@name='banner']/@content", "credit": "//series/@credit",
}
NEWS_LISTS = {"classifiers": "//classifier[@type='taxonomic_classifier']/text()", "descriptors": "//classifier[@class='indexing_service' and @type='descriptor']/text()", "online_descriptors": "//classifier[@class='online_producer' and @type='descriptor']/text()", "general_descriptors": "//classifier[@type='general_descriptor']/text()", "types": "//classifier[@type='types_of_material']/text()", "people": "//identified-content/person/text()", "organizations": "//identified-content/org/text()", "places": "//identified-content/location/text()", "titles": "//identified-content/object.title/text()", "body": "//block[@class='full_text']//p/text()"}


def news_fields(rows: DataFrame) -> DataFrame:
    """The fields of news records; absent ones are null or empty lists, the publication time is a timestamp."""
    one = [F.expr(f"""nullif(xpath_string(record, "{path}"), '')""").alias(name) for name, path in NEWS.items()]
    many = [F.expr(f'xpath(record, "{path}")').alias(name) for name, path in NEWS_LISTS.items()]
    got = rows.select("record", *one, *many)
    return got.withColumn("published", F.try_to_timestamp("published", F.lit("yyyyMMdd'T'HHmmss")))


def news(rows: DataFrame) -> DataFrame:
    """Key from the alternate address, else the address; id the guid, categories the taxonomic classifiers."""
    got = news_fields(rows)
    return _document(got, "nyt", raw_text=F.array_join("body", "\n"), key=F.coalesce("alternate_url", "url"), id=F.col("guid").cast("long"), title=F.col("headline"), categories=F.array_distinct("classifiers"))
