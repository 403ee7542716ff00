import glob
import gzip
import random
import re
import xml.dom.minidom
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire.operators import graph as G
from quire.operators import peaks as P
from quire.plans import config, page_graph, peak_graph
from quire.sinks import tables as K
from quire.sinks.files import write_text_file
from quire.sinks.gexf import gexf_text, write_gexf
from quire.sinks.visits import ParquetVisitStore, save


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, weight double")


def vertices(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, title string")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_undirected(spark):
    e = edges(spark, (1, 2, 3), (2, 1, 4), (3, 3, 1))
    assert got(G.undirected(e)) == [(1, 2, 7.0), (3, 3, 1.0)]
    assert got(G.undirected(e, F.max)) == [(1, 2, 4.0), (3, 3, 1.0)]


def test_prune_is_strict_and_ignores_nan(spark):
    e = edges(spark, (1, 2, 1), (2, 3, 1.5), (3, 4, float("nan")))
    assert got(G.prune_edges(e, 1.0)) == [(2, 3, 1.5)]


def test_singletons_and_triplets(spark):
    v, e = vertices(spark, 1, 2, 9), edges(spark, (1, 2, 1))
    assert got(G.without_singletons(v, e).select("id")) == [(1,), (2,)]
    assert got(G.triplets(v, e, "title").select("src", "dst", "src_title", "dst_title")) == [(1, 2, "t1", "t2")]
    assert got(G.with_attributes(v, spark.createDataFrame([(1, 5)], "page_id long, n int"), "page_id").select("id", "n")) == [(1, 5), (2, None), (9, None)]


def components(spark, ids, pairs):
    return dict(got(G.connected_components(vertices(spark, *ids), edges(spark, *[(a, b, 1) for a, b in pairs]))))


def test_components(spark):
    assert components(spark, range(1, 61), [(i, i + 1) for i in range(1, 60)]) == dict.fromkeys(range(1, 61), 1)  # a long path
    assert components(spark, [1, 2, 3, 4, 5], [(4, 5), (5, 4), (2, 2)]) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
    assert G.connected_components(vertices(spark, 1).limit(0), edges(spark, (1, 2, 1)).limit(0)).count() == 0


def test_components_at_random(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    root = list(range(80))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert components(spark, range(80), pairs) == {i: find(i) for i in range(80)}


def test_largest_component(spark):
    v, e = vertices(spark, 1, 2, 3, 4, 5), edges(spark, (3, 4, 1), (1, 2, 1))
    assert got(G.largest_component_graph(v, e)[0].select("id")) == [(1,), (2,)]  # of equal ones the lowest
    assert G.largest_component_graph(v.limit(0), e.limit(0))[0].count() == 0


def test_active_subgraph(spark):
    pages = spark.createDataFrame([(1, 0, 'A & "B"'), (2, 0, "<C>"), (3, 14, "D"), (4, 0, "E")], "id long, namespace int, title string")
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "`from` long, dest long")
    active = spark.createDataFrame([(1,), (2,), (3,)], "page_id long")
    v, e = G.active_subgraph(pages, links, active)
    assert got(v) == [(1, "A &amp; &quot;B&quot;"), (2, "&lt;C&gt;")] and got(e) == [(1, 2, 1.0)]
    more = spark.createDataFrame([(2, 3)], "`from` long, id long")
    v, e = G.active_subgraph(pages, links, active, more, include_categories=True)
    assert v.count() == 3 and got(e) == [(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)]


def test_gexf(spark, tmp_path):
    v, e = vertices(spark, 2, 1), edges(spark, (1, 2, 2.5))
    text = gexf_text(v, e)
    doc = xml.dom.minidom.parseString(text)
    assert [n.getAttribute("id") for n in doc.getElementsByTagName("node")] == ["1", "2"]
    (edge,) = doc.getElementsByTagName("edge")
    assert edge.getAttribute("weight") == edge.getAttribute("label") == "2.5"
    assert "weight" not in gexf_text(v, e, weighted=False)
    write_gexf(v, e, str(tmp_path / "g.gexf"))
    assert (tmp_path / "g.gexf").read_text() == text + "\n"  # one file
    many = spark.range(3000).select(F.col("id"), F.lit("t").alias("title"))
    write_gexf(many.repartition(7), many.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight")), f"file://{tmp_path}/many.gexf")
    doc = xml.dom.minidom.parse(str(tmp_path / "many.gexf"))
    assert [int(n.getAttribute("id")) for n in doc.getElementsByTagName("node")] == list(range(3000)) and len(doc.getElementsByTagName("edge")) == 3000


def test_similarity_of_edges(spark):
    up, down = [float(i % 24 + i / 10) for i in range(96)], [float(i % 24 - i / 10) for i in range(96)]
    series = spark.createDataFrame([(1, up), (2, up), (3, down), (5, [1.0] * 96)], "page_id long, values array<double>")
    v, e = vertices(spark, 1, 2, 3, 4, 5), edges(spark, (1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 5, 1))
    w = {r.dst: r.weight for r in P.edge_similarity(v, e, series, 96).collect()}
    assert w[2] == pytest.approx(96) and w[3] == 0 and w[4] == 0 and w[5] == 0
    w = {r.dst: r.weight for r in P.edge_similarity(v, e, series, 96, correlation=False).collect()}
    assert w[2] > 80 and w[4] == 0


def test_peak_job(spark, tmp_path):
    start, end = date(2020, 1, 5), date(2020, 1, 8)
    rows = []
    for page in (1, 2, 3, 4):
        for h in range(24 * 7):
            t = datetime(2020, 1, 2) + timedelta(hours=h)
            rows.append(("en", page, t, 300 if page != 4 and 100 <= h < 106 else 2 + h % 3))
    visits = spark.createDataFrame(rows, "languageCode string, page_id long, visit_time timestamp, count int")
    store = ParquetVisitStore(spark, str(tmp_path / "store"))
    save(store, visits, date(2020, 1, 2), end)
    pages = spark.createDataFrame([(i, 0, f"P{i}") for i in (1, 2, 3, 4)], "id long, namespace int, title string")
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 4), (3, 3)], "`from` long, dest long")
    cfg = config.parse('peaks {\n burstRate = 2\n burstCount = 3\n pearsonCorrelation = true # trends\n minEdgeWeight = 1.0\n dailyMinThreshold = 100\n}\n')
    v, e = peak_graph.find(store, pages, links, start, end, "en", cfg)
    assert got(v.select("id")) == [(1,), (2,)]
    assert [(r.src, r.dst) for r in e.collect()] == [(1, 2)]
    assert peak_graph.graph_name(start, end) == "peaks_graph_20200105_20200108.gexf"
    with pytest.raises(ValueError):
        peak_graph.find(store, pages, links, end, start, "en", cfg)


def test_config():
    assert config.load(None)["peaks.minEdgeWeight"] == 1.0
    cfg = config.parse('views {\n  minDailyVisits = 5\n  keepRedirects = true\n}\nstore.keyspace = "x"')
    assert (cfg["views.minDailyVisits"], cfg["views.keepRedirects"], cfg["store.keyspace"], cfg["peaks.burstCount"]) == (5, True, "x", 3)
    for wrong in ("views {", "}", "a = 1", "peaks.burstrate = 2", "views.minDailyVisits =", "views.minDailyVisits = ${peaks.none}", "= 3"):
        with pytest.raises(ValueError):
            config.parse(wrong)


def test_config_notation(tmp_path):
    (tmp_path / "more.conf").write_text('store { host = "a#b:c" // an address\n port = 9042 }')
    (tmp_path / "main.conf").write_text("""
        include "more.conf"
        pagecountProcessor { keepRedirects = true, minDailyVisits: 7 }
        peakfinder {
            startDate = "2018-08-01" # a comment
            endDate = ${peaks.startDate}
            zscore { lag = 24 }
            zscore.threshold = 2.5
        }
        cassandra { db { keyspace = x, tableVisits = [a, "b", 3] } }
    """)
    cfg = config.load(str(tmp_path / "main.conf"))
    assert (cfg["store.host"], cfg["store.port"], cfg["views.keepRedirects"], cfg["views.minDailyVisits"]) == ("a#b:c", 9042, True, 7)
    assert (cfg["peaks.endDate"], cfg["peaks.zscore.lag"], cfg["peaks.zscore.threshold"], cfg["store.keyspace"], cfg["store.tableVisits"]) == ("2018-08-01", 24, 2.5, "x", ["a", "b", 3])
    assert config.connection(cfg) == {"spark.cassandra.connection.host": "a#b:c", "spark.cassandra.connection.port": "9042"} and config.connection(config.load(None)) == {}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b" \\c'), (2, "d")], "id int, title string")
    K.write_table(df, str(tmp_path / "t"), "csv")
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
    assert lines == ['1\ta "b" \\c', "2\td"] and all(p.name.endswith(".gz") for p in (tmp_path / "t").glob("part*"))
    K.write_table(df, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pytest.raises(ValueError):
        K.write_table(df, str(tmp_path / "x"), "xlsx")
    K.write_json(df, str(tmp_path / "j"), coalesce=True)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        K.write_json(df, str(tmp_path / "j"))


def test_page_graph_job(spark, tmp_path):
    dumps = {
        "page": "(1,0,'A','',0,0,0.5,'20200101000000',NULL,1,1,'t',NULL),(2,0,'R','',1,0,0.5,'20200101000000',NULL,1,1,'t',NULL),(3,0,'B','',0,0,0.5,'20200101000000',NULL,1,1,'t',NULL),(4,14,'C','',0,0,0.5,'20200101000000',NULL,1,1,'t',NULL)",
        "pagelinks": "(1,0,'R',0),(3,0,'A',0),(3,0,'none',0)",
        "redirect": "(2,0,'B','','')",
        "categorylinks": "(1,'C','S','2014-10-26 04:50:23','','u','page')",
    }
    files = []
    for name, tuples in dumps.items():
        files.append(str(tmp_path / f"xxwiki-20200101-{name}.sql"))
        with open(files[-1], "w") as f:
            f.write(f"INSERT INTO `{name}` VALUES {tuples};\n")
    page_graph.run(spark, files[0], files[1], files[2], files[3], str(tmp_path / "out"))
    lines = lambda p: sorted(r.value for r in spark.read.text(str(tmp_path / "out" / p)).collect())
    assert lines("pagelinks") == ["1\t3", "3\t1"]
    assert lines("page/normal_pages") == ["1\tA\tfalse\tfalse", "3\tB\tfalse\tfalse"]
    assert lines("categorylinks") == ["1\tC\t4\tpage"]
    # The import names files, and they are files.
    command = (tmp_path / "out" / "import.sh").read_text()
    for kind, name, folder in re.findall(r'--(\S+) (\S+_header),"(\S+)/part-', command):
        with open(name, encoding="utf-8") as f:
            header = f.read().rstrip("\n").split("\t")
        (part,) = {len(x.split("\t")) for p in glob.glob(f"{folder}/part-*.csv.gz") for x in gzip.open(p, "rt")} or {len(header)}
        assert part == len(header) and any(":" in x for x in header) and kind.startswith(("nodes", "relationships"))
    assert command.count("_header") == 4 and command.startswith("neo4j-admin import")
    page_graph.run(spark, files[0], files[1], files[2], files[3], str(tmp_path / "out"))  # once more over what is there
    with pytest.raises(ValueError, match="folder"):
        write_text_file(spark, str(tmp_path / "out"), "x")
