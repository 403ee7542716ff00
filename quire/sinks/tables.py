"""Table writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire.sinks.files import write_text_file


def write_tsv(df: DataFrame, path: str, header: bool = False, coalesce: bool = False, mode: str = "overwrite") -> None:
    """Tab-separated text, gzipped, no quoting: values must not hold tabs. coalesce: one file."""
    rows = df.coalesce(1) if coalesce else df
    rows.write.mode(mode).option("delimiter", "\t").option("quote", "").option("header", header).option("compression", "gzip").csv(path)


def write_json(df: DataFrame, path: str, coalesce: bool = False) -> None:
    """Gzipped JSON lines; an existing path is an error."""
    (df.coalesce(1) if coalesce else df).write.option("compression", "gzip").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").parquet(path)


WRITERS = {"parquet": write_parquet, "csv": write_tsv}


def write_table(df: DataFrame, path: str, output_format: str) -> None:
    if output_format not in WRITERS:
        raise ValueError(f"output format {output_format!r}; known are {', '.join(WRITERS)}")
    WRITERS[output_format](df, path)


#: The columns a bulk graph import expects of each table.
IMPORT_HEADERS = {
    "page": ("id:ID(Page)", "title", "isRedirect:boolean", "isNew:boolean"),
    "pagelinks": (":START_ID(Page)", ":END_ID(Page)"),
    "categorylinks": (":START_ID(Page)", "title", ":END_ID(Page)", "ctype"),
}


def write_import_headers(df: DataFrame, base: str) -> None:
    """One header file for each table of the bulk import, under base."""
    for name, columns in IMPORT_HEADERS.items():
        write_text_file(df.sparkSession, f"{base}/{name}_header", "\t".join(columns) + "\n")


def import_command(data: str, headers: str, database: str) -> str:
    """The shell command of the bulk import, for the tables and headers under these folders.

    Fixed values: the tool's options, its table kinds, and Spark's names of part files.
    """
    part = r"part-\d{5}-.*.csv.gz"
    tables = (("nodes:Page", "page", "page/normal_pages"), ("nodes:Page:Category", "page", "page/category_pages"), ("relationships:LINKS_TO", "pagelinks", "pagelinks"), ("relationships:BELONGS_TO", "categorylinks", "categorylinks"))
    options = [f"--database={database}", r'--delimiter="\t"', "--id-type=INTEGER", *[f'--{kind} {headers}/{name}_header,"{data}/{folder}/{part}"' for kind, name, folder in tables], "--ignore-missing-nodes"]
    return " \\\n    ".join(["neo4j-admin import", *options])
