"""FASTA and GenBank flat files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_fasta(spark: SparkSession, path: str, keep_gaps: bool = True) -> DataFrame:
    """(id, seq, file) of each record; sequences are joined to one line. Records are cut by the reader, so files split."""
    chunks = spark.read.text(path, lineSep="\n>").select("value", F.col("_metadata.file_name").alias("file"))
    body = F.regexp_replace("value", r"^>", "")
    out = chunks.select("file", body.alias("v")).where(F.trim("v") != "")
    head = F.regexp_extract("v", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("v", r"^[^\r\n]*[\r\n]*", ""), r"\s" if keep_gaps else r"[\s-]", "")
    return out.select(F.trim(head).alias("id"), seq.alias("seq"), "file")


def write_fasta(df: DataFrame, path: str, id_col: str = "id", seq_col: str = "seq", by: str | None = None) -> None:
    """One record a row; ``by`` makes a folder per value."""
    text = F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), F.col(seq_col)).alias("value")
    out = df.select(text, *([by] if by else []))
    (out.write.partitionBy(by) if by else out.write).text(path)


GENBANK = "replicon string, organism string, length int, circular boolean, ftype string, locus_tag string, gene string, product string, note string, function string, translation string, db_xref array<string>, strand int, parts array<struct<s:int,e:int>>, seq string"


def parse_location(text: str) -> tuple[int, list[tuple[int, int]]]:
    """Strand and (start, end) parts of a feature location."""
    parts = [(int(a), int(b or a)) for a, b in re.findall(r"<?(\d+)(?:\.\.>?(\d+))?", text)]
    return (-1 if "complement" in text else 1), parts


def parse_genbank(text: str):
    """Features of one record in the order of GENBANK's columns; the record itself is a feature of type source."""
    head = re.search(r"^LOCUS\s+(\S+)\s+(\d+) bp(.*)$", text, re.M)
    if not head:
        return
    version = re.search(r"^(?:VERSION|ACCESSION)\s+(\S+)", text, re.M)
    replicon = (version[1] if version else head[1]).split(".")[0]
    organism = re.search(r"^\s+ORGANISM\s+(.*)$", text, re.M)
    origin = text.rpartition("\nORIGIN")[2] if "\nORIGIN" in text else ""
    seq = re.sub(r"[^a-zA-Z]", "", origin.partition("\n")[2].partition("//")[0])
    table = re.search(r"^FEATURES.*?\n(.*?)(?=^ORIGIN|^CONTIG|^//|\Z)", text, re.S | re.M)
    for m in re.finditer(r"^ {5}(\S+)\s+(.*?)(?=^ {5}\S|\Z)", table[1] if table else "", re.S | re.M):
        location, *rest = re.split(r"\n\s+/", m[2].rstrip())
        tags: dict[str, list[str]] = {}
        for tag in rest:
            name, _, value = tag.partition("=")
            value = re.sub(r"\n\s+", "" if name == "translation" else " ", value).strip().strip('"')
            tags.setdefault(name.strip(), []).append(value)
        strand, parts = parse_location(re.sub(r"\s", "", location))
        one = lambda k: tags.get(k, [None])[0]  # noqa: E731, B023
        yield (
            replicon, organism[1].strip() if organism else None, int(head[2]), "circular" in head[3], m[1], one("locus_tag"), one("gene"), one("product"),
            one("note"), one("function"), one("translation"), tags.get("db_xref", []), strand, [{"s": a, "e": b} for a, b in parts], seq if m[1] == "source" else None,
        )


#: Records of a batch that goes to Python.
RECORDS = 500


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """Features of all records of GenBank files, with CONTIG lines left out; each file is read by one task, whole records at a time.

    The session's Arrow batches are lowered to RECORDS rows where they are larger, so that a worker holds that many records at most."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= RECORDS:
        spark.conf.set(batch, str(RECORDS))
    files = spark.read.text(path, lineSep="\n//").where(F.trim("value") != "")
    schema = GENBANK

    def parse(batches):
        import pandas as pd

        names = [c.split()[0] for c in re.split(r", (?=\w+ )", schema)]
        for pdf in batches:
            rows = [r for text in pdf["value"] for r in parse_genbank(text.lstrip("/\n"))]
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(parse, schema)


def complete_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, complete): whether one of a file's last two lines is //."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.rtrim("value").alias("v"))
    return whole.select("file", F.regexp_like(F.regexp_replace("v", r"\s+$", ""), F.lit(r"(?s).*\n//(\n[^\n]*)?$")).alias("complete"))


class FastaSource(DataSource):
    """``spark.read.format("fasta_records").load(path)``: local FASTA files, one task a file."""

    @classmethod
    def name(cls) -> str:
        return "fasta_records"

    def schema(self) -> str:
        return "id string, seq string"

    def reader(self, schema):
        return FastaReader(self.options)


class FastaReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        from glob import glob

        return [InputPartition(p) for p in sorted(glob(self.path))]

    def read(self, partition):
        name, seq = None, []
        with open(partition.value) as f:
            for line in f:
                line = line.rstrip()
                if line.startswith(">"):
                    if name is not None:
                        yield (name, "".join(seq))
                    name, seq = line[1:].strip(), []
                elif name is not None:
                    seq.append("".join(line.split()))
        if name is not None:
            yield (name, "".join(seq))
