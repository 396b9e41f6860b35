"""Tables of the engine's kinds, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcell import storage
from loomcell.functions import alphabet
from loomcell.sources import sinks

BC_LEN, UMI_LEN = 8, 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, umi, bc), not yet distinct: codes of two bits a letter, with a one-letter error in every 13th order."""
    true = "((l_suppkey % 40) * 2654435761) % 65536"
    wrong = f"({true}) ^ shiftleft(1 + (l_orderkey % 3), cast(2 * (l_orderkey % 8) as int))"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey % 200 as gene", "(l_orderkey * 7919 + l_linenumber * 104729) % 4096 as umi", f"case when l_orderkey % 13 = 0 then {wrong} else {true} end as bc"
    )


def sequences(spark: SparkSession, sf_dir: str, name: str, id_col: str) -> DataFrame:
    """(id, seq): the A, C, G and T among a text's ASCII letters, in upper case."""
    return table(spark, sf_dir, name).select(F.col(id_col).alias("id"), bases().alias("seq"))


def bases():
    return F.upper(F.regexp_replace("text", "[^ACGTacgt]+", ""))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq): all ASCII letters of a document, for the string functions."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "[^A-Za-z]+", "").alias("seq"))


def interval_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Intervals of ten minutes from each 50th event, queries of one minute from the others; microseconds."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 2).alias("strand"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    ivs = e.filter("event_id % 50 = 0").select(F.col("event_id").alias("gid"), "strand", F.col("t").alias("s"), (F.col("t") + 600_000_000).alias("e"))
    qs = e.filter("event_id % 50 <> 0").select(F.col("event_id").alias("qid"), "strand", F.col("t").alias("qs"), (F.col("t") + 60_000_000).alias("qe"))
    return ivs, qs


# --- files of the engine's kinds, written from the driver's tables ----------------------

#: Pairs of files; a document's reads lie in that of its id's remainder.
LANES = 2
CELLS, READS, READ = 12, 3, 98


def write_file(df: DataFrame, order: list[str], label: str, packed: bool = False) -> str:
    """One text file of the column ``line`` in order, in the shared folder: what a sequencer or an annotator delivers."""
    path = f"{storage.scratch(df.sparkSession, label)}/{label}.txt{'.gz' * packed}"
    return sinks.write_lines(df, order, path, packed=packed)


def contigs(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    """(id, seq, lang), and more columns of documents: those that have letters of A, C, G and T."""
    own = table(spark, sf_dir, "documents").filter(F.col("text").rlike("[ACGTacgt]"))
    return own.select(F.col("doc_id").alias("id"), bases().alias("seq"), F.coalesce("lang", F.lit("xx")).alias("lang"), *more)


def fastq_lanes(spark: SparkSession, sf_dir: str) -> list[str]:
    own = storage.materialise(contigs(spark, sf_dir), "contigs")
    record = F.concat(F.lit("@r"), F.col("id"), F.lit("/1 lang="), F.col("lang"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.expr("repeat('I', length(seq))"))
    out = [write_file(own.filter(F.col("id") % LANES == lane).select("id", record.alias("line")), ["id"], f"lane{lane}") for lane in range(LANES)]
    storage.discard(own)
    return out


def tagged_pairs(spark: SparkSession, sf_dir: str) -> tuple[list[str], list[str]]:
    """Packed two-line FASTA files: 26 letters of each document, N for others than A, C, G and T, and all its A, C, G and T."""
    tag = alphabet.normalise(F.substring(F.regexp_replace("text", "[^A-Za-z]+", ""), 1, 26)).alias("tag")
    own = storage.materialise(contigs(spark, sf_dir, tag).filter("length(tag) = 26"), "contigs")
    out = []
    for mate, column in ((1, "tag"), (2, "seq")):
        record = F.concat(F.lit(">r"), F.col("id"), F.lit(f"/{mate}\tx\n"), F.col(column))
        out.append([write_file(own.filter(F.col("id") % LANES == lane).select("id", record.alias("line")), ["id"], f"pair{mate}-{lane}", True) for lane in range(LANES)])
    storage.discard(own)
    return out[0], out[1]


def genome_file(spark: SparkSession, sf_dir: str) -> str:
    """A contig of each document, in lines of 60."""
    own = storage.materialise(contigs(spark, sf_dir), "contigs")
    wrapped = F.regexp_replace(F.regexp_replace("seq", "(.{60})", "$1\n"), "\n$", "")
    out = write_file(own.select("id", F.concat(F.lit(">d"), F.col("id"), F.lit(" of "), F.col("lang"), F.lit("\n"), wrapped).alias("line")), ["id"], "genome")
    storage.discard(own)
    return out


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, part, line): a gene, its transcript and exons on each contig of 120 letters or more, with missing attributes, repeated genes, lines of other kinds and unknown contigs."""
    own = storage.materialise(contigs(spark, sf_dir).filter("length(seq) >= 120").select("id", F.length("seq").alias("n")), "lengths")
    strand = F.when(F.col("id") % 2 == 1, "-").otherwise("+")

    def line(kind: str, beg, end, attributes, chrom="d"):
        return F.concat_ws("\t", F.concat(F.lit(chrom), F.col("id")), F.lit("own"), F.lit(kind), beg.cast("string"), end.cast("string"), F.lit("."), strand, F.lit("."), attributes)

    said = lambda key, mark: F.concat(F.lit(f'{key} "{mark}'), F.col("id"), F.lit('";'))
    one, n = F.lit(1), F.col("n")
    named = F.concat(said("gene_id", "G"), F.when(F.col("id") % 3 != 0, F.concat(F.lit(' gene_name "N'), F.col("id") % 50, F.lit('";'))).otherwise(F.lit("")))
    exon = own.select("id", "n", F.explode(F.expr("sequence(0, cast((n - 50) div 60 as int))")).alias("k"))
    beg = F.col("k") * 60 + 1
    end = F.col("k") * 60 + 30 + F.col("id") % 20
    of = F.when(F.col("k") % 3 == 1, F.lit("note 1;")).otherwise(said("transcript_id", "T"))
    parts = [
        own.select("id", F.lit(0).alias("part"), line("gene", one, n, named).alias("line")),
        own.filter("id % 7 = 0").select("id", F.lit(1).alias("part"), line("gene", one, n, F.concat(said("gene_id", "G"), F.lit(' gene_name "again";'))).alias("line")),
        own.select("id", F.lit(2).alias("part"), line("transcript", one, n, F.concat(F.when(F.col("id") % 5 != 0, said("gene_id", "G")).otherwise(F.lit("")), said("transcript_id", "T"))).alias("line")),
        own.select("id", F.lit(3).alias("part"), line("CDS", one, n, said("transcript_id", "T")).alias("line")),
        exon.select("id", (F.col("k") + 4).alias("part"), line("exon", beg, end, of).alias("line")),
        own.filter("id % 11 = 0").select("id", F.lit(1 << 30).alias("part"), line("gene", one, n, said("gene_id", "U"), "u").alias("line")),
        spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(-1).alias("part"), F.lit("#!made of documents\n").alias("line")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gtf_file(spark: SparkSession, sf_dir: str) -> str:
    return write_file(annotation(spark, sf_dir), ["id", "part"], "genes")


def cell_reads(spark: SparkSession, transcripts: DataFrame) -> tuple[list[str], list[str]]:
    """Pairs of a barcode with tag and a read of each transcript: up to ``READS`` of ``READ`` letters, of one of ``CELLS`` cells, a wrong letter in the barcode of each 13th."""
    own = transcripts.filter(F.length("seq") >= READ).withColumn("id", F.expr("cast(substring(tran_id, 2) as long)"))
    own = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(READS - 1)))).filter(F.expr(f"13 * j + {READ} <= length(seq)"))
    cell = F.expr(f"((id % {CELLS}) * 2654435761) % 4294967296")
    bc = alphabet.decode(F.when(F.col("id") % 13 == 0, cell.bitwiseXOR(F.lit(1 << 10))).otherwise(cell), 16, 4)
    umi = alphabet.decode(F.expr("(id * 7919 + j * 104729) % 1048576"), 10, 4)
    own = own.select("id", "j", bc.alias("bc"), umi.alias("umi"), F.expr(f"substring(seq, 13 * j + 1, {READ})").alias("seq"))
    own = storage.materialise(own, "reads")
    out = []
    for mate, body in ((1, F.concat("bc", "umi")), (2, F.col("seq"))):
        record = F.concat(F.lit("@q"), F.col("id"), F.lit("_"), F.col("j"), F.lit(f"/{mate}\n"), body, F.lit("\n+\n"), F.expr("repeat('I', length(body))"))
        lines = own.withColumn("body", body).select("id", "j", record.alias("line"))
        out.append([write_file(lines.filter(F.col("id") % LANES == lane), ["id", "j"], f"reads{mate}-{lane}") for lane in range(LANES)])
    storage.discard(own)
    return out[0], out[1]
