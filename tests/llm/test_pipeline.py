"""The pipeline's stages on the smallest tables, and what they decide."""

import os

import brute
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def steps(spark):
    import corpus_pipeline as C

    docs = C.table(spark, SF, "documents")
    out = [docs]
    for name, stage in C.STAGES:
        out.append(C.written(stage(spark, out[-1], SF), name))
    return out


def test_columns(steps):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["quality_rules", "minhash_dedup", "personal_data", "source_mix", "sentencepiece"]
    assert all(s.columns == steps[0].columns for s in steps[:5])


def test_quality_keeps_whole_documents(steps):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in steps[:2])
    assert 0.5 * len(before) < len(after) < len(before) and all(before[i] == t for i, t in after.items())
    assert all(brute.quality(t)[0] >= 50 for t in after.values())


def test_one_of_each_group(steps):
    before = [(r.doc_id, r.text) for r in steps[1].collect()]
    ids, texts = [i for i, _ in before], [t for _, t in before]
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(set(brute.near(texts, ids, 5)[1]))


def test_no_personal_data_is_left(steps):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in steps[2:4])
    assert set(before) == set(after)
    assert sum(len(brute.spans(t)) for t in before.values()) > 0 and not any(brute.spans(t) for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not brute.spans(t))


def test_mix_and_encoding(spark, steps):
    import public_tokenizers
    import sentencepiece

    sizes = sum(len(r.text.encode().split()) for r in steps[3].collect())
    mixed = steps[4].collect()
    assert sum(len(r.text.encode().split()) for r in mixed) <= 1.5 * sizes + 1
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r.doc_id, [*lib.encode(r.text), lib.eos_id()]) for r in mixed)
    assert sorted((r.doc_id, r.ids) for r in steps[5].collect()) == want
    assert all(r.n_tokens == len(r.ids) for r in steps[5].collect())


def test_odd_rows_go_through_all_stages(spark):
    """Null ids and texts, empty and long texts, repeated rows and ids, and further columns with the operators' own names."""
    import corpus_pipeline as C
    from pyspark.sql import functions as F

    docs = C.table(spark, SF, "documents")
    good = next(r for r in docs.orderBy("doc_id").collect() if r.text and 200 < len(r.text.split()) < 400 and not brute.spans(r.text))
    other = " ".join(f"word{i * i % 977} and" for i in range(300)) + " end."
    odd = [(None, None), (None, good.text), (900001, None), (900002, ""), (900003, good.text), (900003, good.text), (900004, other + " mail jane.doe@example.com"), (900004, good.text), (900005, (good.text + " ") * 40), (900006, " \n\t ")]
    more = spark.createDataFrame([(i, t, "en", "odd", None if t is None else len(t)) for i, t in odd], docs.schema)
    whole = docs.unionByName(more)
    for c in ("key", "mark", "value", "size", "id", "row", "group", "text_", "a.dotted `name`"):
        whole = whole.withColumn(c, F.lit("x"))
    out = [whole]
    for name, stage in C.STAGES:
        out.append(C.written(stage(spark, out[-1], SF), name))
    assert all(s.columns == whole.columns for s in out[:5])
    assert all(set(r[5:]) == {"x"} for s in out[1:5] for r in s.limit(50).collect())
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in out]
    assert not {900001, 900002, 900006} & set(ids[1])  # no words, no quality
    assert ids[2].count(900003) <= 1 and ids[2].count(None) == ids[1].count(None)  # nothing is held against a null id
    assert not any(brute.spans(r.text) for r in out[3].select("text").collect())
    assert set(ids[5]) <= set(ids[4]) <= set(ids[3]) == set(ids[2])
    assert out[5].where("n_tokens <> size(ids) OR n_tokens < 1").count() == 0


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as C

    for name in ("documents", "labels"):
        C.table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_queries(spark):
    import duckdb

    from quire.llm import queries as Q

    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
    for name, sql in Q.ORACLE_SQL.items():
        df = Q.QUERIES[name](spark, SF)
        c = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = c.sql(sql)
        order = [df.columns.index(x) for x in want.columns]
        assert sorted((tuple(r[k] for k in order) for r in df.collect()), key=str) == sorted(want.fetchall(), key=str)
