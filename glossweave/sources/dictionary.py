"""Lexical-database dictionary files: readers to tables, writer with byte offsets, feature files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossweave.plans.scratch import checkpointed


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a dictionary file without its licence, whose lines begin with spaces."""
    return spark.read.text(path).where(~F.col("value").startswith(" ") & (F.col("value") != ""))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """lemma, pos, number, offset of an index file: a lemma's senses in order."""
    part = F.split(F.rtrim("value"), " ")
    n, skip = part[2].cast("int"), part[3].cast("int")
    rows = _lines(spark, path).select(part[0].alias("lemma"), part[1].alias("pos"), F.slice(part, skip + 7, n).alias("offsets"))
    return rows.select("lemma", "pos", F.posexplode("offsets").alias("k", "offset")).select("lemma", "pos", (F.col("k") + 1).cast("long").alias("number"), F.col("offset").cast("long").alias("offset"))


def read_data(spark: SparkSession, path: str) -> DataFrame:
    """offset, lexfile, pos, lemmas (lemma, marker, lex_id), pointers (rel, offset, pos, source, target), frames (frame, lemma), definition, examples of a data file."""
    split = F.split("value", r" ?\| ", 2)
    part = F.split(F.rtrim(split[0]), " ")
    rows = _lines(spark, path).select(part.alias("p"), F.trim(F.coalesce(F.get(split, F.lit(1)), F.lit(""))).alias("gloss"))
    n = F.conv(F.col("p")[3], 16, 10).cast("int")
    rows = rows.withColumn("n", n).withColumn("m", F.get("p", 4 + 2 * F.col("n")).cast("int"))
    at = 5 + 2 * F.col("n")

    def lemma(k):
        word = F.get("p", 4 + 2 * k)
        return F.struct(F.regexp_extract(word, r"^([^(]*)", 1).alias("lemma"), F.regexp_extract(word, r"\(([^)]*)\)", 1).alias("marker"), F.conv(F.get("p", 5 + 2 * k), 16, 10).cast("int").alias("lex_id"))

    def pointer(k):
        ends = F.get("p", at + 4 * k + 3)
        return F.struct(F.get("p", at + 4 * k).alias("rel"), F.get("p", at + 4 * k + 1).cast("long").alias("offset"), F.get("p", at + 4 * k + 2).alias("pos"), F.conv(F.substring(ends, 1, 2), 16, 10).cast("int").alias("source"), F.conv(F.substring(ends, 3, 2), 16, 10).cast("int").alias("target"))

    count = F.coalesce(F.get("p", at + 4 * F.col("m")).cast("int"), F.lit(0))

    def frame(k):
        begin = at + 4 * F.col("m") + 1 + 3 * k
        return F.struct(F.get("p", begin + 1).cast("int").alias("frame"), F.conv(F.get("p", begin + 2), 16, 10).cast("int").alias("lemma"))

    def upto(size, make):
        return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), make)).otherwise(F.expr("array()"))

    parts = F.transform(F.split("gloss", "; "), lambda x: F.trim(x))
    return rows.select(
        F.col("p")[0].cast("long").alias("offset"), F.col("p")[1].cast("int").alias("lexfile"), F.col("p")[2].alias("pos"),
        F.transform(F.sequence(F.lit(0), F.col("n") - 1), lemma).alias("lemmas"), F.when(F.col("m") > 0, F.transform(F.sequence(F.lit(0), F.col("m") - 1), pointer)).alias("pointers"), F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), frame)).alias("frames"),
        F.array_join(F.filter(parts, lambda x: ~x.startswith('"')), "; ").alias("definition"), F.transform(F.filter(parts, lambda x: x.startswith('"')), lambda x: F.regexp_replace(x, '^"|"$', "")).alias("examples"),
    )


def read_exceptions(spark: SparkSession, path: str, pos: str) -> DataFrame:
    """inflected, pos, base: the first base form of each exception line."""
    part = F.split("value", " ")
    return spark.read.text(path).where(F.size(part) > 1).select(part[0].alias("inflected"), F.lit(pos).alias("pos"), part[1].alias("base"))


def read_sense_index(spark: SparkSession, path: str) -> DataFrame:
    """key, lemma, pos_number, offset, number, count of a sense index."""
    part = F.split("value", " ")
    return spark.read.text(path).where(F.size(part) >= 4).select(part[0].alias("key"), F.regexp_extract(part[0], r"^([^%]*)%", 1).alias("lemma"), F.regexp_extract(part[0], r"%(\d)", 1).cast("int").alias("pos_number"), part[1].cast("long").alias("offset"), part[2].cast("long").alias("number"), part[3].cast("long").alias("count"))


def read_content(spark: SparkSession, path: str) -> DataFrame:
    """offset, pos, count of an information-content file; its header line has no such entry."""
    line = F.trim("value")
    return spark.read.text(path).where(line.rlike(r"^\d+[a-z] +[-\d.]+")).select(F.regexp_extract(line, r"^(\d+)", 1).cast("long").alias("offset"), F.regexp_extract(line, r"^\d+([a-z])", 1).alias("pos"), F.regexp_extract(line, r" +([-\d.eE]+)", 1).cast("double").alias("count"))


def read_merged_senses(spark: SparkSession, path: str) -> DataFrame:
    """a, b: pairs of different synset names that share a line."""
    names = F.array_distinct(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != ""))
    rows = spark.read.text(path).select(names.alias("n")).where(F.size("n") > 1).select(F.explode("n").alias("a"), "n")
    return rows.select("a", F.explode("n").alias("b")).where("a <> b").distinct()


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """term, parent, score of space-separated lines."""
    part = F.split("value", r"\s+")
    return spark.read.text(path).where(F.size(part) >= 3).select(part[0].alias("term"), part[1].alias("parent"), part[2].cast("double").alias("score"))


def read_tag_pairs(spark: SparkSession, path: str) -> DataFrame:
    """left, right: the two tag lists of ``a;b;|c;d;`` lines."""
    side = F.split("value", r"\|")

    def tags(k: int):
        return F.filter(F.split(side[k], ";"), lambda x: x != "")

    return spark.read.text(path).where(F.size(side) == 2).select(tags(0).alias("left"), tags(1).alias("right"))


def data_lines(synset: DataFrame, relation: DataFrame) -> DataFrame:
    """pos, offset, line of a data file's synsets (id, pos, lemmas, definition) with their relations, in the order of ids.

    A column ``place`` of ``synset``, such as breadth_first() gives, orders them instead.  Offsets count bytes from the file's start; their width is the smallest that holds every file's size, and the
    size depends on the width, so widths are tried from one digit up.
    """
    n = F.lpad(F.lower(F.hex(F.size("lemmas"))), 2, "0")
    place = "place" if "place" in synset.columns else "id"
    words = F.array_join(F.transform("lemmas", lambda x: F.concat(x, F.lit(" 0"))), " ")
    links = relation.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rel", "dst"))).alias("links"))
    rows = synset.join(links, "id", "left").withColumn("links", F.coalesce("links", F.expr("array()").cast("array<struct<rel:string,dst:string>>")))
    rows = rows.select("id", "pos", "links", F.col(place).alias("_place"), F.concat_ws(" ", F.lit("00"), "pos", n, words, F.lpad(F.size("links").cast("string"), 3, "0")).alias("head"), F.concat(F.lit(" | "), F.coalesce("definition", F.lit(""))).alias("tail"))
    fixed = F.octet_length("head") + F.octet_length("tail") + 2 + F.aggregate("links", F.lit(0), lambda s, x: s + F.octet_length(x["rel"]) + 9)
    rows = rows.withColumn("fixed", fixed).withColumn("offsets", F.size("links") + 1)
    totals = rows.groupBy("pos").agg(F.sum("fixed").alias("f"), F.sum("offsets").alias("o")).collect()  # one row for each part of speech
    width = next(w for w in range(1, 20) if all(r.f + w * r.o < 10**w for r in totals))
    before = F.sum(F.col("fixed") + width * F.col("offsets")).over(Window.partitionBy("pos").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))
    ends = placed.select(F.col("id").alias("dst"), F.col("offset").alias("at"), F.col("pos").alias("p"))
    pointers = placed.select("id", F.posexplode("links").alias("k", "l")).select("id", "k", "l.rel", "l.dst").join(ends, "dst")
    text = pointers.select("id", "k", F.concat(F.lit(" "), "rel", F.lit(" "), F.lpad(F.col("at").cast("string"), width, "0"), F.lit(" "), "p", F.lit(" 0000")).alias("t"))
    joined = text.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "").alias("ptr"))
    return placed.join(joined, "id", "left").select("pos", "offset", F.concat(F.lpad(F.col("offset").cast("string"), width, "0"), F.lit(" "), "head", F.coalesce("ptr", F.lit("")), "tail").alias("line"))


def index_lines(senses: DataFrame, offsets: DataFrame) -> DataFrame:
    """pos, line of index files from senses (lemma, pos, id, number) and offsets (id, offset)."""
    rows = senses.join(offsets, "id").groupBy("lemma", "pos").agg(F.sort_array(F.collect_list(F.struct("number", "offset"))).alias("s"))
    n = F.size("s").cast("string")
    return rows.select("pos", F.concat_ws(" ", "lemma", "pos", n, F.lit("0"), n, F.lit("0"), F.array_join(F.transform("s", lambda x: x["offset"].cast("string")), " ")).alias("line"))


def sense_index_lines(senses: DataFrame, offsets: DataFrame) -> DataFrame:
    """line of a sense index, in byte order."""
    place = F.array_position(F.array(*[F.lit(p) for p in "nvars"]), F.col("pos"))
    key = F.concat("lemma", F.lit("%"), place.cast("string"), F.lit(":00:00::"))
    return senses.join(offsets, "id").select(F.concat_ws(" ", key, F.col("offset").cast("string"), F.col("number").cast("string"), F.lit("0")).alias("line")).orderBy("line")


def sense_map_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """pos, line of sense maps between two versions of an ontology (lemma, pos, id, number, offset): ``key old new`` offsets of senses of nouns and verbs that both have."""
    a = old.select("lemma", "pos", "id", F.col("number").alias("n1"), F.col("offset").alias("o1"))
    b = new.select("lemma", "pos", "id", F.col("number").alias("n2"), F.col("offset").alias("o2"))
    rows = a.join(b, ["lemma", "pos", "id"]).where(F.col("pos").isin("n", "v"))
    place = F.array_position(F.array(*[F.lit(p) for p in "nvars"]), F.col("pos")).cast("string")

    def side(n: str, o: str):
        return F.concat("lemma", F.lit("%"), place, F.lit(":00:00::;"), F.col(n).cast("string"), F.lit(";"), F.col(o).cast("string"))

    return rows.select("pos", F.concat_ws(" ", side("n1", "o1"), side("n2", "o2")).alias("line"))


def breadth_first(synset: DataFrame, relation: DataFrame, depth: int = 64) -> DataFrame:
    """id, place: synsets level by level from those without a parent (``@``), within a level by id; what no root leads to comes last."""
    up = relation.where("rel = '@'").select(F.col("src").alias("id"), F.col("dst").alias("parent"))
    links = checkpointed(up)
    now = checkpointed(synset.select("id").join(links.select("id").distinct(), "id", "left_anti"))
    done = now.withColumn("level", F.lit(0))
    for level in range(1, depth):
        now = checkpointed(links.join(now.select(F.col("id").alias("parent")), "parent").select("id").distinct().join(done.select("id"), "id", "left_anti"))
        if now.isEmpty():
            break
        done = checkpointed(done.unionByName(now.withColumn("level", F.lit(level))))
    rows = synset.select("id").join(done, "id", "left")
    return rows.select("id", F.row_number().over(Window.orderBy(F.asc_nulls_last("level"), "id")).cast("long").alias("place"))  # one row a synset of the ontology


def save_basis(basis: DataFrame, path: str) -> None:
    """Write a basis (key, dim) as Parquet; it is small and read whole."""
    basis.coalesce(1).write.mode("overwrite").parquet(path)


def read_basis(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def arff_lines(features: DataFrame, relation: str, columns: list[str], label: str) -> DataFrame:
    """k, line of an ARFF file: header lines first, then a row for each feature row; k orders header lines."""
    spark = features.sparkSession
    head = [f"@relation {relation}", *[f"@attribute {c} numeric" for c in columns], f"@attribute {label} {{0,1}}", "@data"]
    top = spark.createDataFrame(list(enumerate(head)), "k long, line string")
    return top.unionByName(features.select(F.lit(len(head)).cast("long").alias("k"), F.concat_ws(",", *[F.col(c).cast("string") for c in [*columns, label]]).alias("line")))
