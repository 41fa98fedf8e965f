"""FASTA scan and sink, reverse complement, assembly, and the homology literal.

Short records are rows. Sequences of any length are pieces (start, letters) or chunks
(chunk, letters) of a fixed number of letters: these are scanned, turned, joined and
written without a whole sequence in any row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genoweave.operators.ordered import max_before, running_sum, running_sums
from genoweave.plans.durable import write_table

#: Complements, the IUPAC codes included; header of a simulated gene.
BASES, COMPLEMENTS = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv", "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"
HEADER = r"^(G\d+_SE\d+), sequence type: (.*), locus: (-?\d+)$"


def in_genome_order(files: DataFrame, name: str) -> DataFrame:
    """Adds ``genome``, the number after SE in each file's name, and ``place``, from 0, in order of it and then the name's.

    A name without such a number raises.
    """
    number = F.regexp_extract(name, r"SE(\d+)", 1)
    checked = F.when(number != "", number).otherwise(F.raise_error(F.concat(F.lit("no genome number in "), F.col(name))))
    out = running_sum(files.withColumn("genome", checked.cast("bigint")), F.lit(1), ["genome", name], "place")
    return out.withColumn("place", F.col("place") - 1)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, header, seq); a record begins at '>' at the start of a line."""
    records = spark.read.text(path, lineSep="\n>").select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^>", "").alias("r"))
    header = F.substring_index("r", "\n", 1)
    body = F.regexp_replace(F.expr("substr(r, length(substring_index(r, '\\n', 1)) + 1)"), r"\s", "")
    return records.where("r <> ''").select("file", F.rtrim(header).alias("header"), body.alias("seq"))


def gene_headers(records: DataFrame) -> DataFrame:
    """id, sequence type and signed locus of simulated genes; a header of another form raises."""
    ok = F.regexp_like("header", F.lit(HEADER))
    checked = F.when(ok, F.col("header")).otherwise(F.raise_error(F.concat(F.lit("not a gene header: "), F.col("header"))))
    return records.select("*", F.regexp_extract(checked, HEADER, 1).alias("id"), F.regexp_extract(checked, HEADER, 2).alias("seq_type"), F.regexp_extract(checked, HEADER, 3).cast("int").alias("locus"))


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), BASES, COMPLEMENTS)


#: Letters of a chunk, and of a line of text; the first a multiple of the second.
CHUNK_LETTERS = 60 << 14
LINE_LETTERS = 60


def chunked(pieces: DataFrame, keys: list[str], size: int = CHUNK_LETTERS) -> DataFrame:
    """``keys``, chunk, letters: pieces (``keys``, start, letters) cut at multiples of ``size`` and joined within them."""
    end = F.col("start") + F.length("letters")
    spans = F.sequence(F.floor(F.col("start") / size), F.floor((end - 1) / size))

    def part(k: Column) -> Column:
        low, high = F.greatest(k * size, F.col("start")), F.least((k + 1) * size, end)
        return F.struct(k.cast("bigint").alias("chunk"), low.cast("bigint").alias("at"), F.substr("letters", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("letters"))

    each = pieces.where(F.length("letters") > 0).select(*keys, F.explode(F.transform(spans, part)).alias("p"))
    listed = F.sort_array(F.collect_list(F.struct("p.at", "p.letters")))
    return each.groupBy(*keys, F.col("p.chunk").alias("chunk")).agg(F.array_join(F.transform(listed, lambda x: x["letters"]), "").alias("letters"))


def turned(pieces: DataFrame, length: str) -> DataFrame:
    """Pieces (start, letters, ...) of the reverse complements of sequences of ``length`` letters."""
    start = F.col(length) - F.col("start") - F.length("letters")
    return pieces.withColumn("start", start).withColumn("letters", reverse_complement(F.col("letters")))


def assemble(genes: DataFrame, by: str, size: int = CHUNK_LETTERS) -> DataFrame:
    """``by`` (a number), chunk, letters: genes (locus, seq) of each group joined in order of |locus|, those of negative locus reverse-complemented.

    Where a gene begins is a running sum over all groups less what is before its group,
    so that a group of very many genes is no task's. Genes of one |locus| follow each
    other by their letters.
    """
    order = F.col(by).cast("bigint") * (1 << 40) + F.abs("locus")
    rows = write_table(genes.select(by, "locus", "seq", order.alias("__at"), F.xxhash64("seq").alias("__tie")), "genes")
    placed = running_sum(rows.select(by, "__at", "__tie", F.length("seq").alias("n")), F.col("n"), ["__at", "__tie"], "__end")
    placed = placed.groupBy(by, "__at", "__tie").agg((F.min("__end") - F.min_by("n", "__end")).alias("__start"), F.max("n").alias("n"))
    first = placed.groupBy(by).agg(F.min("__start").alias("__first"))
    # equal genes at one locus stand side by side
    same = rows.withColumn("__k", F.row_number().over(W.partitionBy("__at", "__tie").orderBy("seq")) - 1)
    at = same.join(placed, [by, "__at", "__tie"]).join(first, by)
    letters = F.when(F.col("locus") < 0, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return chunked(at.select(by, (F.col("__start") - F.col("__first") + F.col("__k") * F.col("n")).alias("start"), letters.alias("letters")), [by], size)


def scan_sequences(spark: SparkSession, path: str, size: int = CHUNK_LETTERS, one: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records (file, record, header) and chunks (file, record, chunk, letters) of FASTA files, read by byte ranges.

    Lines are counted within each range of a file, and what earlier ranges hand on, a row
    each, is added. ``record`` counts from 1 in each file; white space in sequences and
    what stands before the first '>' is passed over. ``one`` says that the folder's files
    are parts of one, in order of their names, as ``write_sequences`` leaves them.
    """
    name = F.col("_metadata.file_path")
    text = spark.read.text(path).select((F.lit(path) if one else name).alias("file"), F.struct(name.alias("name"), "_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    head = F.col("value").startswith(">")
    lines = text.select("file", "split", "id", head.alias("head"), F.when(head, F.rtrim(F.substr("value", F.lit(2)))).alias("header"), F.when(~head, F.regexp_replace("value", r"\s", "")).otherwise("").alias("letters"))
    w = W.partitionBy("file", "split").orderBy("id")
    counted = lines.withColumn("upto", F.sum(F.length("letters")).over(w)).withColumn("heads", F.sum(F.col("head").cast("bigint")).over(w))
    counted = write_table(counted.withColumn("since", F.max(F.when(F.col("head"), F.col("upto"))).over(w)), "lines")
    ranges = counted.groupBy("file", "split").agg(F.max("heads").alias("heads"), (F.max("upto") - F.coalesce(F.max("since"), F.lit(0))).alias("tail"))
    by = W.partitionBy("file").orderBy("split")
    ranges = ranges.withColumn("group", F.sum((F.col("heads") > 0).cast("int")).over(by))
    ranges = ranges.withColumn("open", F.sum("tail").over(W.partitionBy("file", "group").orderBy("split")))
    before = F.coalesce(F.sum("heads").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("file", "split", before.alias("before"), F.coalesce(F.lag("open").over(by), F.lit(0)).alias("carried"))
    placed = counted.join(ranges, ["file", "split"]).withColumn("record", F.col("heads") + F.col("before"))
    start = F.col("upto") - F.length("letters") - F.coalesce(F.col("since"), -F.col("carried"))
    found = placed.where("record > 0")
    return found.where("head").select("file", "record", "header"), chunked(found.where("not head").select("file", "record", start.alias("start"), "letters"), ["file", "record"], size)


def write_sequences(chunks: DataFrame, path: str, width: int = LINE_LETTERS) -> None:
    """Chunks (place, header, chunk, letters) as FASTA text in order of place; the parts in order of their names are one file.

    Chunks must hold a multiple of ``width`` letters, all but a sequence's last.
    """
    lines = F.concat(F.when(F.col("chunk") == 0, F.array(F.concat(F.lit(">"), "header"))).otherwise(F.array()), F.regexp_extract_all("letters", F.lit(f".{{1,{width}}}"), F.lit(0)))
    rows = chunks.repartitionByRange("place", "chunk").sortWithinPartitions("place", "chunk")
    rows.select(F.explode(lines).alias("value")).write.text(path)


def write_fasta(records: DataFrame, path: str) -> None:
    """One text record per row (header, seq)."""
    records.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("seq")).alias("value")).write.text(path)


def in_file_order(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Rows (n, value) of the text between separators, n from 1 in order of files' names and of places in them, read by byte ranges."""
    text = spark.read.text(path, lineSep=separator)
    text = text.select(F.struct(F.col("_metadata.file_path").alias("name"), "_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    counted = write_table(text.withColumn("k", F.row_number().over(W.partitionBy("split").orderBy("id"))), "rows")
    sizes = counted.groupBy("split").agg(F.max("k").cast("bigint").alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy(F.lit(1)).orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    return counted.join(sizes.select("split", before.alias("before")), "split").select((F.col("k") + F.col("before")).alias("n"), "value")


#: Pieces of the text that one task takes at a time. Their numbers leave none out, so that a chunk of them is full.
PIECES = 1 << 16


def read_homology(spark: SparkSession, path: str) -> DataFrame:
    """Rows (g1, g2, gene, others) of the nested list on the second line of a homology file, others 1-based as written.

    The text is cut at closing brackets, so that each piece ends one list. How deep that
    is, and how many lists of each depth have ended, are running sums over the pieces;
    the line is never held whole.
    """
    rows = in_file_order(spark, path, "]")
    lines = running_sum(rows, F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit(""))), ["n"], "newlines", PIECES)
    own = F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit("")))
    lines = lines.where((F.col("newlines") >= 1) & (F.col("newlines") - own <= 1))
    begins = (F.col("newlines") - own == 0) & (own > 0)  # the second line begins in this piece
    text = F.when(begins, F.expr("substr(value, instr(value, '\n') + 1)")).otherwise(F.col("value"))
    lines = write_table(lines.select("n", F.substring_index(text, "\n", 1).alias("value")), "lines")
    opened = F.length("value") - F.length(F.replace("value", F.lit("["), F.lit("")))
    deep = running_sum(lines, opened - 1, ["n"], "after", PIECES).withColumn("depth", F.col("after") + 1)
    deep = write_table(running_sums(deep, {f"ended{d}": (F.col("depth") == d).cast("int") for d in (4, 3, 2)}, ["n"], PIECES), "ended")
    # lists of a depth that ended before the list around them began: those at the end of the last list of that depth
    for d in (4, 3):
        deep = max_before(deep.withColumn("__e", F.when(F.col("depth") == d - 1, F.col(f"ended{d}"))), "__e", ["n"], f"past{d}", PIECES).drop("__e")
    deep = write_table(deep, "lists").where("depth = 4")
    inner = F.substring_index("value", "[", -1)
    return deep.select(
        F.col("ended2").cast("int").alias("g1"),
        (F.col("ended3") - F.coalesce("past3", F.lit(0))).cast("int").alias("g2"),
        (F.col("ended4") - 1 - F.coalesce("past4", F.lit(0))).cast("int").alias("gene"),
        F.transform(F.regexp_extract_all(inner, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int")).alias("others"),
    )


def write_homology(rows: DataFrame, path: str) -> None:
    """Rows (g1, g2, gene, others) as a homology file: for all genomes and genes up to the greatest a list, empty where there is no row."""
    most = rows.agg(F.max(F.greatest("g1", "g2")).alias("g"), F.max("gene").alias("x"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c)))
    cells = most.withColumn("g1", each("g")).withColumn("g2", each("g")).withColumn("gene", each("x")).join(rows, ["g1", "g2", "gene"], "left")
    first = F.col("gene") == 0
    ahead = F.when(first & (F.col("g1") == 0) & (F.col("g2") == 0), "VPs\nVPs := [[[").when(first & (F.col("g2") == 0), ", [[").when(first, ", [").otherwise(", ")
    listed = F.array_join(F.transform(F.coalesce("others", F.array()), lambda x: x.cast("string")), ", ")
    behind = F.when(F.col("gene") == F.col("x"), F.when(F.col("g2") == F.col("g"), F.when(F.col("g1") == F.col("g"), "]]]").otherwise("]]")).otherwise("]")).otherwise("")
    text = F.concat(ahead, F.lit("["), listed, behind)  # each row's last bracket is its end
    cells.select("g1", "g2", "gene", text.alias("value")).repartitionByRange("g1", "g2", "gene").sortWithinPartitions("g1", "g2", "gene").select("value").write.text(path, lineSep="]")


def sequence_flags(records: DataFrame) -> DataFrame:
    """1 for records whose header begins with 'marker', else 2."""
    return records.select("header", F.when(F.col("header").startswith("marker"), 1).otherwise(2).alias("flag"))


def parameter_file(flags: DataFrame, order: str, template: str) -> DataFrame:
    """One row: ``template`` with its %s replaced by the flags in order, comma-separated."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("flag").alias("f"))))
    joined = F.array_join(F.transform(listed, lambda x: x["f"].cast("string")), ",")
    return flags.agg(F.format_string(template, joined).alias("value"))
