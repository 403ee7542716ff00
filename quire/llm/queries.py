"""The corpus queries: one opN_<name> for each operator, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, find_pii

    return digest(find_pii(table(spark, sf_dir, "documents")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import fit, scan

    return scan(table(spark, sf_dir, "documents"), fit())


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepieces import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    per, _ = mix(table(spark, sf_dir, "documents"))
    return per.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


#: Fixed value: the rules that the query judges by.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


#: The outside list has every domain that two of these words name, whatever the corpus holds.
LIST_FIRST = ("ads", "adult", "best", "buy", "casino", "cheap", "free", "hot", "loan", "poker", "spam", "win")
LIST_SECOND = ("bets", "bonus", "cash", "deal", "farm", "loans", "pills", "porn", "track", "win", "x", "xxx")
LIST_DOMAINS = ("example.com", "example.net", "example.org")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge_urls

    listed = spark.createDataFrame([(f"{a}-{b}.{d}/",) for a in LIST_FIRST for b in LIST_SECOND for d in LIST_DOMAINS], "key string")
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, listed)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import link_components

    return link_components(table(spark, sf_dir, "documents"), words=2)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_store import store_and_read

    return store_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_chain, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit_chain(docs, table(spark, sf_dir, "labels")))


def op11_backtrack_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .backtrack_bpe import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import digest, fill_in_middle

    return digest(fill_in_middle(table(spark, sf_dir, "documents")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_license_scan": op2_license_scan,
    "op3_repeated_bytes": op3_repeated_bytes,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_source_mix": op5_source_mix,
    "op6_url_filter": op6_url_filter,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_token_store": op9_token_store,
    "op10_quality_rules": op10_quality_rules,
    "op11_backtrack_bpe": op11_backtrack_bpe,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL = {
    "op3_repeated_bytes": r"""
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        starts AS (SELECT r, unnest(range(0, greatest(length(h) // 2 - 399, 0))) AS i FROM texts),
        strings AS (SELECT r, i, sha256(substr(h, 2 * i + 1, 800)) AS s FROM starts JOIN texts USING (r)),
        again AS (SELECT r, i FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)),
        marked AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM again),
        numbered AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
        runs AS (SELECT r, run, min(i) AS lo, max(i) + 400 AS hi FROM numbered GROUP BY r, run),
        before AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since FROM runs),
        kept AS (SELECT r, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS head, max(hi) AS last_end, sum(hi - lo) AS n_removed, count(*) AS n_spans
                 FROM before JOIN texts USING (r) GROUP BY r)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last_end, 0) + 1))) AS kept_sha256
        FROM texts LEFT JOIN kept USING (r)""",
    "op8_minhash_dedup": r"""
        WITH RECURSIVE split AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (SELECT r, doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM split),
        shingles AS (SELECT r, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (SELECT a.r AS a, b.r AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.r <> b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
                  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach(r, other) AS (SELECT r, r FROM sets UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other),
        parts AS (SELECT reach.r, min(sets.doc_id) AS component_id FROM reach JOIN sets ON sets.r = reach.other GROUP BY reach.r)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept FROM sets JOIN parts USING (r)""",
    "op5_source_mix": r"""
        WITH RECURSIVE sized AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
            row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS nth FROM documents),
        sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM sized GROUP BY source),
        alloc(round, no, size, w, target, rest) AS (
            SELECT 0, no, size, [5.0::DOUBLE, 2.0, 1.0][no % 3 + 1], CASE WHEN size = 0 THEN 0.0::DOUBLE END, 1.5::DOUBLE * sum(size) OVER () FROM sources
            UNION ALL SELECT round + 1, no, size, w, CASE WHEN target IS NOT NULL THEN target WHEN part > 2 * size THEN 2.0::DOUBLE * size WHEN stopped = 0 THEN part END, rest - stopped
            FROM (SELECT *, coalesce(sum(CASE WHEN target IS NULL AND part > 2 * size THEN 2.0::DOUBLE * size END) OVER (), 0) AS stopped
                FROM (SELECT *, rest * w / sum(CASE WHEN target IS NULL THEN w END) OVER () AS part, count(*) FILTER (target IS NULL) OVER () AS free FROM alloc) WHERE free > 0)),
        goals AS (SELECT no, source, sources.size AS source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM alloc JOIN sources USING (no) WHERE round = (SELECT max(round) FROM alloc)),
        quotas AS (SELECT *, (goal + 255) // 256 AS quota, CAST(sum((goal + 255) // 256) OVER (ORDER BY no) AS BIGINT) AS hi, CAST(sum((goal + 255) // 256) OVER () AS BIGINT) AS blocks FROM goals),
        slots AS (SELECT k, CAST((((k + 1)::HUGEINT * 2850178704830799621) % 4611686018427387904) * blocks // 4611686018427387904 AS BIGINT) AS place
            FROM (SELECT DISTINCT blocks, unnest(range(2 * blocks + 64)) AS k FROM quotas)),
        ranked AS (SELECT no, k, quota, row_number() OVER (PARTITION BY no ORDER BY k) - 1 AS rank FROM slots JOIN quotas ON place >= hi - quota AND place < hi),
        passes AS (SELECT sized.*, no, goal, unnest(CASE WHEN goal > source_size THEN [0, 1] ELSE [0] END) AS pass FROM sized JOIN quotas ON sized.source IS NOT DISTINCT FROM quotas.source WHERE size > 0),
        stream AS (SELECT doc_id, nth, size, source, no, goal, pass, sum(size) OVER (PARTITION BY no ORDER BY pass, CAST('0x' || substr(md5(concat_ws(':', pass, doc_id, size, nth)), 1, 15) AS BIGINT)) - size AS spot FROM passes),
        parts AS (SELECT *, least(spot + size, goal) - spot AS words FROM stream WHERE spot < goal),
        taken AS (SELECT doc_id, source, nth, size, CAST(sum(words) AS BIGINT) AS taken FROM parts GROUP BY ALL),
        firsts AS (SELECT doc_id, parts.source, nth, size, min(k) AS first_slot FROM parts JOIN ranked ON ranked.no = parts.no AND rank BETWEEN spot // 256 AND (spot + words - 1) // 256 AND rank < quota GROUP BY ALL)
        SELECT sized.doc_id, CAST(sized.size AS BIGINT) AS size, source_size, target, coalesce(taken, 0) AS taken, first_slot FROM sized
        JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source
        LEFT JOIN taken ON taken.doc_id = sized.doc_id AND taken.source IS NOT DISTINCT FROM sized.source AND taken.nth = sized.nth AND taken.size = sized.size
        LEFT JOIN firsts ON firsts.doc_id = sized.doc_id AND firsts.source IS NOT DISTINCT FROM sized.source AND firsts.nth = sized.nth AND firsts.size = sized.size""",
    "op6_url_filter": r"""
        WITH parts AS (
            SELECT page_id, coalesce(lower(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1)), '') AS host,
                   coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages),
        rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
            ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        met AS (
            SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(rules.verdict, length(h || p)) AS verdict
            FROM parts JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id),
        listed AS (SELECT a || '-' || b || '.' || d AS name FROM
            (SELECT unnest(['ads', 'adult', 'best', 'buy', 'casino', 'cheap', 'free', 'hot', 'loan', 'poker', 'spam', 'win']) AS a),
            (SELECT unnest(['bets', 'bonus', 'cash', 'deal', 'farm', 'loans', 'pills', 'porn', 'track', 'win', 'x', 'xxx']) AS b),
            (SELECT unnest(['example.com', 'example.net', 'example.org']) AS d)),
        blocked AS (SELECT DISTINCT page_id FROM parts JOIN listed ON host = name OR host LIKE '%.' || name WHERE path <> '')
        SELECT parts.page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM parts LEFT JOIN met ON parts.page_id = met.page_id LEFT JOIN blocked ON parts.page_id = blocked.page_id""",
    "op7_embedding_dedup": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
        parts AS (SELECT id, min(other) AS component FROM reach GROUP BY id),
        degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN parts ON id = vec_id LEFT JOIN degrees ON a = vec_id""",
    "op12_fill_in_middle": r"""
        WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        numbers AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
            CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                 WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
        parts AS (SELECT *, least(c1, c2) AS lo, greatest(c1, c2) AS hi, substr(text, 1, least(c1, c2)) AS prefix,
            substr(text, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS middle, substr(text, greatest(c1, c2) + 1) AS suffix FROM numbers)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
            sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
            sha256(text) AS restored_sha256 FROM parts""",
}
