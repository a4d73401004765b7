"""Text formats as DataFrames: readers are lazy scans, writers are Spark text output.

Spark decides about gzip by the extension. Where a format needs its lines in order
(a header that holds for the lines below), lines are numbered by file and place, so
that a large file is read by many tasks. Tables are written by many tasks, too: each
of their files begins with the header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import numbered, ranges


def _data() -> Column:
    """Lines that are neither blank nor a comment, nor a track or browser line."""
    return (F.trim("value") != "") & ~F.col("value").rlike("^(#|track|browser)")


def _fields(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    lines = numbered(spark.read.text(path).where(_data()))
    return lines.select("row_id", F.split(F.trim("value"), separator).alias("f"), "value")


def _f(i: int, kind: str = "string") -> Column:
    return F.get("f", F.lit(i)).cast(kind)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, file_no, n, line: lines numbered from 0 within their file, and row_id over all files."""
    return numbered(spark.read.text(path), lines=True).withColumnRenamed("value", "line")


def _names(spark: SparkSession, path: str) -> list[str]:
    """The column names in a table's first line; a scan begins with the first line of a file, and all files have the header."""
    head = spark.read.text(path).first()
    return head[0].split() if head else []


def read_bed(spark: SparkSession, path: str, columns: int = 6) -> DataFrame:
    """BED3, BED6 or BED9."""
    if columns not in (3, 6, 9):
        raise ValueError("BED files have 3, 6 or 9 columns")
    rows = _fields(spark, path)
    rows = rows.where(F.when(F.size("f") >= columns, True).otherwise(F.raise_error(F.lit(f"a line has fewer than {columns} columns")).cast("boolean")))
    out = rows.select("row_id", _f(0).alias("seqname"), _f(1, "long").alias("from"), _f(2, "long").alias("to"), "f")
    if columns == 3:
        return ranges(out.drop("f"))
    strand = F.when(_f(5) == ".", "*").otherwise(F.substring(_f(5), 1, 1))
    out = out.withColumns({"strand": strand, "name": _f(3), "score": _f(4, "long")})
    if columns == 9:
        out = out.withColumns({"thickStart": _f(6, "long"), "thickEnd": _f(7, "long"), "itemRgb": _f(8)})
    return ranges(out.drop("f"))


def headed(line: Column, head: str, has_one: Column | None = None) -> Column:
    """The lines with a header above each partition's first, which so begins each file that a writer makes of them.

    has_one: where a line is a header itself.
    """
    first = F.monotonically_increasing_id() % (1 << 33) == 0  # counts in every row, so it comes first
    if has_one is not None:
        first = first & ~has_one
    return F.when(first, F.concat(F.lit(head + "\n"), line)).otherwise(line)


def _text(df: DataFrame, line: Column, path: str, compress: bool, one_file: bool = False, order: list | None = None) -> None:
    out = df.orderBy(*order) if order else df
    out = out.select(line.alias("value"))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").text(path, compression="gzip" if compress else "none")


def _or(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name).cast("string"), default.cast("string")) if name in df.columns else default.cast("string")


def bed_line(df: DataFrame, columns: int = 6) -> Column:
    """The line of each row."""
    parts = [F.col("seqname"), F.col("from").cast("string"), F.col("to").cast("string")]
    if columns >= 6:
        parts += [_or(df, "name", F.lit(".")), _or(df, "score", F.lit(0)), F.when(F.col("strand") == "*", ".").otherwise(F.col("strand"))]
    if columns == 9:
        parts += [_or(df, "thickStart", F.col("from")), _or(df, "thickEnd", F.col("to")), _or(df, "itemRgb", F.lit("0,0,0"))]
    return F.concat_ws("\t", *parts)


def write_bed(df: DataFrame, path: str, columns: int = 6, compress: bool = False) -> None:
    _text(df, bed_line(df, columns), path, compress)


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """Ranges with ``values``."""
    rows = _fields(spark, path).where(F.when(F.size("f") == 4, True).otherwise(F.raise_error(F.lit("bedGraph lines have 4 columns")).cast("boolean")))
    return ranges(rows.select("row_id", _f(0).alias("seqname"), _f(1, "long").alias("from"), _f(2, "long").alias("to"), _f(3, "double").alias("values")))


def read_bedgraph_track(spark: SparkSession, path: str, genome: DataFrame, bin_size: int) -> DataFrame:
    """Track from bedGraph: header line skipped, ends at a blank line, the last line to name a bin counts."""
    lines = _lines(spark, path).where("n > 0")
    blank = lines.where(F.trim("line") == "").groupBy("file").agg(F.min("n").alias("stop"))
    rows = lines.join(blank, "file", "left").where("stop is null or n < stop").withColumn("f", F.split(F.trim("line"), r"\s+"))
    rows = rows.select("n", _f(0).alias("seqname"), _f(1, "long").alias("from"), _f(2, "long").alias("to"), _f(3, "double").alias("value")).join(genome.select("seqname", "length"), "seqname")
    inside = rows.where(f"`from` < length and `to` <= length and `to` div {bin_size} > `from` div {bin_size}")
    cells = inside.select("n", "seqname", F.explode(F.expr(f"sequence(`from` div {bin_size}, `to` div {bin_size} - 1)")).alias("bin"), "value")
    return cells.groupBy("seqname", "bin").agg(F.max_by("value", "n").alias("value"))


def write_bedgraph(df: DataFrame, path: str, compress: bool = False) -> None:
    _text(df, F.concat_ws("\t", "seqname", F.col("from").cast("string"), F.col("to").cast("string"), F.col("values").cast("string")), path, compress)


def read_wig(spark: SparkSession, path: str, bin_size: int) -> DataFrame:
    """Track from fixedStep and variableStep blocks."""
    lines = _lines(spark, path).where(F.trim("line") != "").where(~F.col("line").rlike("^(track|browser|#)"))
    is_head = F.col("line").rlike("^(fixedStep|variableStep)")
    attr = lambda k: F.regexp_extract("line", rf"\b{k}=(\S+)", 1)
    above = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(is_head, F.struct(F.col("n").alias("at"), F.col("line").startswith("fixed").alias("fixed"), attr("chrom").alias("seqname"), attr("start").alias("start"), attr("step").alias("step"), attr("span").alias("span"))), ignorenulls=True).over(above)
    rows = lines.withColumn("h", head).withColumn("is_head", is_head)
    step = F.when(F.col("h.step") == "", F.lit(1)).otherwise(F.col("h.step").cast("long"))
    span = F.when(F.col("h.span") == "", F.lit(1)).otherwise(F.col("h.span").cast("long"))
    given = F.when(F.col("h.fixed"), step).otherwise(span)
    data = rows.where("not is_head").where(F.when(given == bin_size, True).otherwise(F.raise_error(F.lit("the step is not the bin size")).cast("boolean")))
    f = F.split(F.trim("line"), r"\s+")
    at = F.when(F.col("h.fixed"), (F.col("h.start").cast("long") - 1) + (F.col("n") - F.col("h.at") - 1) * bin_size).otherwise(f[0].cast("long") - 1)
    value = F.when(F.col("h.fixed"), f[0]).otherwise(F.get(f, F.lit(1))).cast("double")
    return data.select(F.col("h.seqname").alias("seqname"), (at / bin_size).cast("long").alias("bin"), value.alias("value"))


def write_wig(track: DataFrame, path: str, bin_size: int, name: str = "track", compress: bool = False) -> None:
    """NaN is left out; fixedStep blocks restart after gaps, variableStep where half of a sequence is NaN or 0."""
    w = Window.partitionBy("seqname").orderBy("bin")
    share = track.groupBy("seqname").agg((2 * F.count_if(F.isnan("value") | (F.col("value") == 0)) >= F.count("*")).alias("variable"))
    rows = track.where(~F.isnan("value")).withColumn("gap", F.coalesce(F.col("bin") != F.lag("bin").over(w) + 1, F.lit(True))).join(share, "seqname")
    first = F.row_number().over(w) == 1
    start = F.col("bin") * bin_size + 1
    fixed = F.concat(F.when(F.col("gap"), F.format_string(f"fixedStep chrom=%s start=%d step={bin_size} span={bin_size}\n", "seqname", start)).otherwise(""), F.format_string("%f", "value"))
    variable = F.concat(F.when(first, F.format_string(f"variableStep chrom=%s span={bin_size}\n", "seqname")).otherwise(""), F.format_string("%d %f", start, F.col("value")))
    body = rows.select("seqname", "bin", F.when(F.col("variable"), variable).otherwise(fixed).alias("line"))
    head = track.sparkSession.createDataFrame([("", -1, f'track type=wiggle_0 name="{name}"')], "seqname string, bin long, line string")
    _text(head.unionByName(body), F.col("line"), path, compress, one_file=True, order=["seqname", "bin"])


def read_gtf(spark: SparkSession, path: str, attributes: dict[str, str] | None = None, defaults: dict[str, object] | None = None, one_based: bool = False) -> DataFrame:
    """GTF: source, feature, score, frame and the asked attributes by type; coordinates verbatim unless one_based."""
    lines = numbered(spark.read.text(path).where(_data()))
    # separators count outside double quotes only; where the last of nine columns alone has quotes, in pairs, all of them do
    fields = F.regexp_extract_all("value", F.lit(r'(?:^|\t)((?:"[^"]*"|[^\t"])*)'), F.lit(1))
    cut = F.split("value", "\t")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    plain = (F.size(cut) == 9) & (F.instr(F.substring_index("value", "\t", 8), '"') == 0) & (quotes % 2 == 0) & ~F.col("value").startswith("\t")
    rows = lines.select("row_id", F.when(plain, cut).otherwise(fields).alias("f"))
    rows = rows.where(F.when(F.size("f") >= 9, True).otherwise(F.raise_error(F.lit("a GTF line has 9 columns")).cast("boolean")))
    start = _f(3, "long") - (1 if one_based else 0)
    out = rows.select("row_id", _f(0).alias("seqname"), start.alias("from"), _f(4, "long").alias("to"), F.when(_f(6) == ".", "*").otherwise(_f(6)).alias("strand"), _f(1).alias("source"), _f(2).alias("feature"), F.when(_f(5) == ".", "0").otherwise(_f(5)).cast("double").alias("score"), F.when(_f(7) == ".", "-1").otherwise(_f(7)).cast("int").alias("frame"), _f(8).alias("_a"))
    for name, kind in (attributes or {}).items():
        found = F.regexp_extract("_a", rf'(?:^|[;\s]){name}\s+"?([^";]*)"?', 1)
        missing = F.lit((defaults or {})[name]) if name in (defaults or {}) else F.raise_error(F.lit(f"attribute {name} is missing"))
        out = out.withColumn(name, F.when(found != "", found.cast(kind)).otherwise(missing.cast(kind)))
    return ranges(out.drop("_a"))


def write_gtf(df: DataFrame, path: str, compress: bool = False) -> None:
    pick = lambda *names, default=".": next((F.col(n).cast("string") for n in names if n in df.columns), F.lit(default))
    fixed = {"row_id", "seqname", "from", "to", "strand", "source", "sources", "feature", "features", "score", "scores", "frame", "frames"}
    extra = F.concat_ws(" ", *[F.format_string('%s "%s";', F.lit(c), F.col(f"`{c}`").cast("string")) for c in df.columns if c not in fixed])
    frame = pick("frames", "frame")
    _text(df, F.concat_ws("\t", "seqname", pick("sources", "source"), pick("features", "feature"), F.col("from").cast("string"), F.col("to").cast("string"), pick("scores", "score"), F.when(F.col("strand") == "*", ".").otherwise(F.col("strand")), F.when(frame == "-1", ".").otherwise(frame), extra), path, compress)


_KINDS = {"[]string": "string", "[]int": "long", "[]float64": "double", "[][]string": "array<string>", "[][]int": "array<long>", "[][]float64": "array<double>"}


def _cell(value: Column, kind: str) -> Column:
    kind = _KINDS.get(kind, kind)
    if kind.startswith("array"):
        inner = kind[6:-1]
        return F.when(value == "nil", F.array().cast(kind)).otherwise(F.transform(F.split(value, ","), lambda x: x.cast(inner)))
    return F.when(value.isin("NA", "NaN"), "NaN").otherwise(value).cast(kind) if kind == "double" else value.cast(kind)


def _row() -> Column:
    """Position of a table's row: over all files, without their headers."""
    return (F.col("row_id") - F.col("file_no") - 1).alias("row_id")


def read_table(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """A range table with a header line; metadata by declared types, or all as strings."""
    lines = _lines(spark, path).where(F.trim("line") != "")
    names = _names(spark, path)
    at = {n: i for i, n in enumerate(names)}
    rename = {"seqnames": "seqname", "start": "from", "end": "to"}
    keys = {rename.get(n, n): i for n, i in at.items() if rename.get(n, n) in ("seqname", "from", "to", "strand")}
    rows = lines.where("n > 0").withColumn("f", F.split(F.trim("line"), r"\s+"))
    meta = {n: (types or {}).get(n, "string") for n in names if rename.get(n, n) not in keys and (types is None or n in types)}
    cols = [_row(), *[_f(i, "string" if k in ("seqname", "strand") else "long").alias(k) for k, i in keys.items()], *[_cell(_f(at[n]), kind).alias(n) for n, kind in meta.items()]]
    return ranges(rows.select(*cols)) if {"seqname", "from", "to"} <= set(keys) else rows.select(*cols)


def table_lines(df: DataFrame, header: bool = True, strand: bool = True, scientific: bool = False) -> DataFrame:
    """row_id, line: right-aligned columns seqnames, from, to, strand, metadata; list cells by comma, empty lists as nil.

    scientific: floating point cells as d.ddddddE+dd.
    """
    body, top = _table(df, strand, scientific)
    return _with_head(body, top) if header else body


def _with_head(body: DataFrame, top: str) -> DataFrame:
    return body.unionByName(body.sparkSession.createDataFrame([(-1, top)], "row_id long, line string"))


def _table(df: DataFrame, strand: bool, scientific: bool = False) -> tuple[DataFrame, str]:
    """The lines and the header."""
    def shown(c: Column, kind: str) -> Column:
        return F.format_string("%e", c) if scientific and kind in ("double", "float") else c.cast("string")

    cells = {"seqnames": F.col("seqname"), "from": F.col("from").cast("string"), "to": F.col("to").cast("string")}
    if strand:
        cells["strand"] = F.col("strand")
    for name, kind in df.dtypes:
        if name not in ("row_id", "seqname", "from", "to", "strand"):
            c = F.col(f"`{name}`")
            if kind.startswith("array"):
                inner = F.transform(c, lambda x: shown(x, kind[6:-1]))  # noqa: B023
                cells[name] = F.when(F.size(c) == 0, "nil").otherwise(F.array_join(inner, ","))
            else:
                cells[name] = shown(c, kind)
    body = df.select("row_id", *[v.alias(f"c{i}") for i, v in enumerate(cells.values())])
    widest = body.agg(*[F.coalesce(F.max(F.length(f"c{i}")), F.lit(0)) for i in range(len(cells))]).first()
    width = [max(len(n), w) for n, w in zip(cells, widest, strict=True)]
    line = F.concat_ws(" ", *[F.lpad(F.coalesce(F.col(f"c{i}"), F.lit("")), w, " ") for i, w in enumerate(width)])
    return body.select("row_id", line.alias("line")), " ".join(n.rjust(w) for n, w in zip(cells, width, strict=True))


def write_table(df: DataFrame, path: str, header: bool = True, strand: bool = True, compress: bool = False) -> None:
    """The lines of ``table_lines`` in the rows' order, over as many files as tasks write them; each begins with the header."""
    lines, top = _table(df, strand)
    line = F.col("line")
    if header:
        lines, line = _with_head(lines, top), headed(line, top, F.col("row_id") == -1)
    _text(lines, line, path, compress, order=["row_id"])


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).withColumn("f", F.split(F.trim("line"), r"\s+")).where(F.size("f") >= 2)
    return rows.select(F.col("n").cast("int").alias("idx"), _f(0).alias("seqname"), _f(1, "long").alias("length"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """idx, seqname, sequence: one entry a record, cut at the > by the reader itself."""
    # a record begins at a > that begins a line: a reader's cut elsewhere, as within a header, would split it
    entries = spark.read.text(path, lineSep="\n>").withColumn("value", F.regexp_replace("value", r"^>", "")).where(F.trim("value") != "")
    parts = F.split("value", r"\r?\n", 2)
    name = F.split(parts[0], r"[ |]")[0]
    named = F.when(F.trim(name) != "", name).otherwise(F.raise_error(F.lit("an entry has no name")))
    return numbered(entries).select(F.col("row_id").alias("idx"), named.alias("seqname"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s+", "").alias("sequence"))


def write_fasta(df: DataFrame, path: str, compress: bool = False) -> None:
    body = F.regexp_replace("sequence", "(.{80})(?=.)", "$1\n")
    _text(df, F.concat(F.lit(">"), "seqname", F.lit("\n"), body), path, compress)


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """Genes: name, sequence, strand, transcription and coding ranges."""
    rows = _fields(spark, path).where(F.when(F.size("f") >= 7, True).otherwise(F.raise_error(F.lit("gene lines have 7 columns")).cast("boolean")))
    return ranges(rows.select("row_id", _f(1).alias("seqname"), _f(3, "long").alias("from"), _f(4, "long").alias("to"), _f(2).alias("strand"), _f(0).alias("names"), F.struct(_f(5, "long").alias("from"), _f(6, "long").alias("to")).alias("cds")))


def write_genes(df: DataFrame, path: str, compress: bool = False) -> None:
    """The file that read_genes reads: name, sequence, strand, transcription and coding ranges."""
    _text(df, F.concat_ws("\t", "names", "seqname", "strand", F.col("from").cast("string"), F.col("to").cast("string"), F.col("cds.from").cast("string"), F.col("cds.to").cast("string")), path, compress)


def read_genes_jdbc(spark: SparkSession, url: str, table: str) -> DataFrame:
    """Genes from a database table by JDBC (its driver must be on the class path)."""
    rows = spark.read.format("jdbc").option("url", url).option("query", f"SELECT name, chrom, strand, txStart, txEnd, cdsStart, cdsEnd FROM {table}").load()
    return ranges(rows.select(F.col("chrom").alias("seqname"), F.col("txStart").alias("from"), F.col("txEnd").alias("to"), "strand", F.col("name").alias("names"), F.struct(F.col("cdsStart").alias("from"), F.col("cdsEnd").alias("to")).alias("cds")))


#: Columns of the CpG island table and their types; fixed values.
CPG_TYPES = {"length": "[]int", "cpgNum": "[]int", "gcNum": "[]int", "perCpg": "[]float64", "perGc": "[]float64", "obsExp": "[]float64"}


def read_cpg_islands(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, CPG_TYPES)


def read_cpg_islands_jdbc(spark: SparkSession, url: str) -> DataFrame:
    rows = spark.read.format("jdbc").option("url", url).option("dbtable", "cpgIslandExt").load()
    return ranges(rows.select(F.col("chrom").alias("seqname"), F.col("chromStart").alias("from"), F.col("chromEnd").alias("to"), *CPG_TYPES))


#: Columns of a peak caller's table; fixed values.
PEAK_COLUMNS = ["chr", "start", "end", "length", "abs_summit", "pileup", "-log10(pvalue)", "fold_enrichment", "-log10(qvalue)", "name"]


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Peaks: the end is inclusive, so to = end + 1; length and name are dropped."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    split = lambda df: df.withColumn("f", F.split(F.trim("value"), r"\s+"))
    head = split(lines).where(_f(1) == "start").select("f").first()  # the files' header lines are alike
    if head is None or list(head[0]) != PEAK_COLUMNS:
        raise ValueError("a peak table has the header " + " ".join(PEAK_COLUMNS))
    rows = split(numbered(lines.where(~F.col("value").rlike(r"^\s*chr\s+start\s"))))
    rows = rows.where(F.when(F.size("f") == len(PEAK_COLUMNS), True).otherwise(F.raise_error(F.lit("a peak has 10 columns")).cast("boolean")))
    return ranges(rows.select("row_id", _f(0).alias("seqname"), _f(1, "long").alias("from"), (_f(2, "long") + 1).alias("to"), *[_f(i, "double").alias(PEAK_COLUMNS[i]) for i in (4, 5, 6, 7, 8)]))


def read_gene_expression(spark: SparkSession, path: str, genes: DataFrame, id_attribute: str, value_attribute: str) -> DataFrame:
    """genes with ``expr``: the sum of an attribute over a GTF's rows of the gene, 0 if there are none."""
    rows = read_gtf(spark, path, {id_attribute: "string", value_attribute: "double"}, {id_attribute: "", value_attribute: 0.0})
    sums = rows.groupBy(F.col(id_attribute).alias("names")).agg(F.sum(value_attribute).alias("expr"))
    return genes.join(sums, "names", "left").withColumn("expr", F.coalesce("expr", F.lit(0.0)))


def read_fpkm(spark: SparkSession, path: str, genes: DataFrame) -> DataFrame:
    """genes with ``expr`` from a 13-column expression table: rows of status OK, summed by gene."""
    rows = spark.read.csv(path, sep="\t", header=True)
    if len(rows.columns) != 13 or rows.columns[9] not in ("FPKM", "RPKM"):
        raise ValueError("an expression table has 13 columns with FPKM or RPKM")
    sums = rows.where(F.col(rows.columns[12]) == "OK").groupBy(F.col(rows.columns[3]).alias("names")).agg(F.sum(F.col(rows.columns[9]).cast("double")).alias("expr"))
    return genes.join(sums, "names", "left").withColumn("expr", F.coalesce("expr", F.lit(0.0)))


def read_chromatin_states(spark: SparkSession, path: str | list[str], column: str | None = None) -> DataFrame:
    """Track from tables with a row a bin: the first line names cell and sequence, the second the columns.

    column: the column to take; by default the first.
    """
    lines = _lines(spark, path).where(F.trim("line") != "").withColumn("f", F.split(F.trim("line"), r"\s+"))
    heads = lines.where("n = 0").select("file", _f(1).alias("seqname"))
    place = F.array_position("f", F.lit(column)) if column else F.lit(1).cast("long")
    found = F.when(place > 0, place).otherwise(F.raise_error(F.lit(f"no column {column}")).cast("long"))
    columns = lines.where("n = 1").select("file", found.cast("int").alias("at"))
    rows = lines.where("n > 1").join(F.broadcast(heads), "file").join(F.broadcast(columns), "file")  # a row a file
    return rows.select("seqname", (F.col("n") - 2).cast("long").alias("bin"), F.element_at("f", F.col("at")).cast("double").alias("value"))


def read_meta(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """A table without ranges: row_id and the named columns by their types; a column that is missing is an error."""
    lines = _lines(spark, path).where(F.trim("line") != "")
    names = _names(spark, path)
    missing = [n for n in types if n not in names]
    if missing:
        raise ValueError(f"the table has no column {missing[0]}")
    rows = lines.where("n > 0").withColumn("f", F.split(F.trim("line"), r"\s+"))
    rows = rows.where(F.when(F.size("f") == len(names), True).otherwise(F.raise_error(F.lit("a row has not as many columns as the header")).cast("boolean")))
    return rows.select(_row(), *[_cell(_f(names.index(n)), kind).alias(n) for n, kind in types.items()])


def write_segmentation(df: DataFrame, path: str, colours: dict[str, str], compress: bool = False) -> None:
    """BED9 of named segments; those without a colour are dropped."""
    table = df.sparkSession.createDataFrame(list(colours.items()), "name string, itemRgb string")
    write_bed(df.drop("itemRgb").join(table, "name"), path, 9, compress)


def palette(n: int) -> list[str]:
    """n colours around the wheel, as r,g,b."""
    import colorsys

    return [",".join(str(round(255 * x)) for x in colorsys.hsv_to_rgb(i / max(1, n), 0.7, 0.9)) for i in range(n)]
