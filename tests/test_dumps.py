import bz2
import gzip

import pytest
from pyspark.sql import functions as F

from quire import schemas as S
from quire.sources import dumps as D


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


PAGE = "INSERT INTO `page` VALUES (1,0,'Alpha','',0,1,0.5,'20200102030405','20200102030406',7,100,'text',NULL),(2,14,'Beta_(b)','',1,0,0.25,'20200102030405',NULL,8,90,'text', NULL),(3,1,'Talk','',0,0,0.5,'20200102030405',NULL,9,80,'text',NULL);"


def test_payload_and_other_lines(spark):
    rows = D.insert_payload(lines(spark, PAGE, "-- a comment", "INSERT INTO `pagelinks` VALUES (1,0,'x',0);"), "page").collect()
    assert len(rows) == 1 and rows[0].payload.startswith("(1,0,")
    assert rows[0].payload.endswith("NULL);")


def test_page_rows_and_schema(spark):
    df = D.parse_lines(lines(spark, PAGE), "page")
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in S.PAGE]
    rows = {r.id: r for r in df.collect()}
    assert set(rows) == {1, 2}  # namespace 1 goes
    assert rows[1].isNew and not rows[1].isRedirect and rows[2].isRedirect
    assert rows[1].touched.isoformat() == "2020-01-02T03:04:05" and rows[1].random == 0.5
    assert rows[1].linksUpdated == "'20200102030406'" and rows[2].linksUpdated == "NULL"  # as written


def test_links_redirects_categories(spark):
    links = D.parse_lines(lines(spark, "INSERT INTO `pagelinks` VALUES (5,0,'A',0),(5,2,'B',0),(5,0,'C',3),(6,14,'D,d',14);"), "pagelinks").collect()
    assert [(r["from"], r.title) for r in links] == [(5, "A"), (6, "D,d")]
    found = D.parse_lines(lines(spark, "INSERT INTO `redirect` VALUES (1,0,'A','',''),(2,4,'B',NULL,NULL),(3,0,'C','','x)y');"), "redirect").collect()
    assert [(r["from"], r.title) for r in found] == [(1, "A"), (3, "C")]
    assert found[1].fragment == "'x"  # a bracket ends the fragment, not the row
    cats = D.parse_lines(lines(spark, "INSERT INTO `category` VALUES (1,'A,_b',3,2,1),(2,'C',0,0,0);"), "category").collect()
    assert [tuple(r) for r in cats] == [(1, "A,_b", 3, 2, 1), (2, "C", 0, 0, 0)]
    (link,) = D.parse_lines(lines(spark, "INSERT INTO `categorylinks` VALUES (10,'Cat','SORT','2014-10-26 04:50:23','','uca','page');"), "categorylinks").collect()
    assert (link["from"], link.to, link.sortkeyPrefix, link.ctype, str(link.timestamp)) == (10, "Cat", "", "page", "2014-10-26 04:50:23")


def test_langlinks_filter(spark):
    df = lines(spark, "INSERT INTO `langlinks` VALUES (1,'fr','Un titre'),(2,'es','Otro'),(3,'fr','');")
    assert {r.title for r in D.parse_lines(df, "langlinks").collect()} == {"Un_titre", "Otro"}
    assert [r.title for r in D.parse_lines(df, "langlinks", element_filter=D.language_filter(["fr"])).collect()] == ["Un_titre"]
    assert D.language_filter([]) is None


def test_escapes_loose_and_strict(spark):
    df = lines(spark, r"INSERT INTO `category` VALUES (1,'O\'Brien',1,0,0),(2,'A',-1,0,0),(3,'B',1,0,0);")
    loose = D.parse_lines(df, "category").collect()
    assert [r.title for r in loose] == [r"O\'Brien", "A',-1,0,0),(3,'B"]
    strict = D.parse_lines(df, "category", strict=True).collect()
    assert [(r.id, r.title, r.pages) for r in strict] == [(1, "O'Brien", 1), (2, "A", -1), (3, "B", 1)]
    page = lines(spark, "INSERT INTO `page` VALUES (1,0,'A','',1,0,1e-05,'20200102030405',NULL,7,100,'t',NULL),(2,0,'B','',0,0,0.5,'20200102030405',NULL,7,100,'t',NULL);")
    assert [r.title for r in D.parse_lines(page, "page").collect()] != ["A", "B"]
    assert [(r.title, r.random) for r in D.parse_lines(page, "page", strict=True).collect()] == [("A", 1e-05), ("B", 0.5)]


def test_numbers_that_do_not_fit_are_rejected(spark):
    payload = D.insert_payload(lines(spark, "INSERT INTO `category` VALUES (99999999999,'A',1,0,0),(2,'B',1,0,0);"), "category")
    assert [r.title for r in D.parse_payload(payload, "category").collect()] == ["B"]
    assert D.parse_payload(payload, "category", with_rejects=True).count() == 1


def test_file_names(spark):
    assert D.dump_info("/x/enwiki-20180801-langlinks.sql.bz2") == ("en", "20180801", "langlinks")
    assert D.dump_info("frwiki-20190901-page.small.sql.bz2") == ("fr", "20190901", "page")
    with pytest.raises(ValueError):
        D.dump_info("notes.txt")
    row = spark.range(1).select(*D.dump_info_columns(F.lit("frwiki-20190901-page.small.sql.bz2"))).first()
    assert tuple(row) == ("fr", "20190901", "page")


def test_read_compressed_files_with_language(spark, tmp_path):
    with bz2.open(tmp_path / "enwiki-20180801-page.sql.bz2", "wt") as f:
        f.write(PAGE)
    with gzip.open(tmp_path / "frwiki-20180801-page.sql.gz", "wt") as f:
        f.write(PAGE)
    df = D.read_dump(spark, [str(tmp_path / "enwiki-20180801-page.sql.bz2"), str(tmp_path / "frwiki-20180801-page.sql.gz")], "page", with_language=True)
    assert sorted((r.languageCode, r.id) for r in df.collect()) == [("en", 1), ("en", 2), ("fr", 1), ("fr", 2)]
    pages = D.read_pages(spark, str(tmp_path / "enwiki-20180801-page.sql.bz2"))
    pages.write.parquet(str(tmp_path / "pages"))
    assert D.read_pages(spark, str(tmp_path / "pages")).columns == S.PAGE_LANG.fieldNames()


def test_empty_input(spark):
    for table in D.TABLES:
        assert D.parse_lines(lines(spark, "", "x"), table).count() == 0


def test_a_gzipped_dump_is_parsed_by_several_tasks(spark, tmp_path):
    inserts = [f"INSERT INTO `category` VALUES ({i},'Title_{i}',1,2,3),({i + 100000},'x',99999999999,0,0);" for i in range(800)]
    text = "-- head\n" + "\n".join(inserts) + "\nINSERT INTO `page` VALUES (1);\n"
    plain, packed = tmp_path / "xxwiki-20200101-category.sql", tmp_path / "frwiki-20200101-category.sql.gz"
    plain.write_text(text)
    with gzip.open(packed, "wt") as f:
        f.write(text)
    size = packed.stat().st_size

    def read(path, **options):
        return D.read_dump(spark, str(path), "category", with_language=True, **options)

    def tasks(df):
        return df.select(F.spark_partition_id().alias("n")).distinct().count()

    rows = lambda df: sorted(tuple(r)[:5] for r in df.collect())
    dealt = read(packed, deal_bytes=size // 6)
    assert tasks(read(packed)) == 1 and tasks(dealt) >= 6
    assert rows(dealt) == rows(read(packed)) == rows(read(plain)) and dealt.count() == 800
    assert {r.languageCode for r in dealt.collect()} == {"fr"}
    rejects = lambda df: sorted(r.tuple for r in df.collect())
    assert rejects(read(packed, deal_bytes=size // 6, with_rejects=True)) == rejects(read(plain, with_rejects=True)) and read(plain, with_rejects=True).count() == 800
    # Both kinds together: the plain file's lines stay where they are read.
    both = D.read_dump(spark, str(tmp_path), "category", with_language=True, deal_bytes=size // 6)
    assert both.count() == 1600 and {(r.languageCode, r.n) for r in both.groupBy("languageCode").agg(F.count("*").alias("n")).collect()} == {("fr", 800), ("xx", 800)}
    assert "RoundRobin" not in both._jdf.queryExecution().toString()
