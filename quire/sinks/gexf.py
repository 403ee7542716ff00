"""GEXF documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.graph import gexf_elements
from quire.scratch import scratch_dir

#: What stands around the elements.
_HEAD = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">', ' <graph mode="static" defaultedgetype="directed">']
_NODES, _MIDDLE, _END = [" <nodes>"], ["      </nodes>", "      <edges>"], ["        </edges>", " </graph>", "</gexf>"]


def gexf_lines(vertices: DataFrame, edges: DataFrame, weighted: bool = True) -> DataFrame:
    """(part, a, b, line) of a whole document; in order of part, a, b it is the file."""
    spark = vertices.sparkSession
    fixed = [(part, n, line) for part, lines in ((-2, _HEAD + _NODES), (0.5, _MIDDLE), (2, _END)) for n, line in enumerate(lines)]
    frame = spark.createDataFrame([(float(p), n, 0, line) for p, n, line in fixed], "part double, a long, b long, line string")
    return frame.unionByName(gexf_elements(vertices, edges, weighted).withColumn("part", F.col("part").cast("double")))


def write_gexf(vertices: DataFrame, edges: DataFrame, path: str, weighted: bool = True) -> None:
    """Write the document as one file at path, in any file system Spark knows.

    The lines are sorted and written in parallel; their parts are then copied one
    after another into the file, as bytes, so that the driver holds a buffer of them.
    """
    spark = vertices.sparkSession
    lines = gexf_lines(vertices, edges, weighted).orderBy("part", "a", "b").select("line")
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    parts, target = f"{scratch_dir(spark)}/gexf-{uuid.uuid4().hex}", hadoop.fs.Path(path)
    lines.write.text(parts)
    source, to = hadoop.fs.Path(parts), target.getFileSystem(conf)
    fs = source.getFileSystem(conf)
    out = to.create(target, True)
    try:
        for name in sorted(x.getPath().getName() for x in fs.listStatus(source)):
            if name.startswith("part-"):
                some = fs.open(hadoop.fs.Path(f"{parts}/{name}"))
                try:
                    hadoop.io.IOUtils.copyBytes(some, out, 1 << 20, False)
                finally:
                    some.close()
    finally:
        out.close()
        fs.delete(source, True)


def gexf_text(vertices: DataFrame, edges: DataFrame, weighted: bool = True) -> str:
    """The document as one string: for graphs that fit the driver, such as a final component."""
    rows = gexf_lines(vertices, edges, weighted).orderBy("part", "a", "b").select("line").toLocalIterator()
    return "\n".join(r["line"] for r in rows)
