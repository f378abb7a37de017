"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsieve.llm import bloomlm, langid, licenses, merkle, packing, pieces, quality, sharding, simhash, spelling, syncmers, topk, vectorgraph
from flowsieve.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_packing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(documents(spark, sf), tokenizer_file("word_bpe_49k.json"))


@query("op2_langid")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(documents(spark, sf))


@query("op3_pieces")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.segment(documents(spark, sf), tokenizer_file("piece_bpe_32k.model"), 4)


@query("op4_licenses")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(documents(spark, sf))


@query("op5_quality")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return quality.resample(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query("op6_sharding")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf), 24)


@query("op7_vectorgraph")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return vectorgraph.near_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query("op8_syncmers")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return syncmers.fingerprint_documents(documents(spark, sf))


@query("op9_bloomlm")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return bloomlm.score_documents(documents(spark, sf))


@query("op10_simhash")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    groups = simhash.simhash_groups(documents(spark, sf), words=4, distance=4)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op11_topk", """
    WITH v AS (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
        FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
    ), ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM scored
    )
    SELECT * FROM ranked WHERE rank <= 5
""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


# crc32 of a list of bytes, for SQL without such a function
CRC_TABLE = """
    crc AS (
        SELECT list(v ORDER BY n) AS t FROM (
            SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
            FROM (SELECT unnest(range(256)) AS n))
    )"""
CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
ASCII_BYTES = "list_transform(string_split({text}, ''), lambda x: CAST(unicode(x) AS BIGINT))"
LATIN_BYTES = "flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(x) - 64 AS BIGINT)] END))"


@query("op12_spelling", f"""
    WITH RECURSIVE {CRC_TABLE}, runs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[{spelling.LETTERS}]{{7,}}')) AS run FROM documents
    ), hashed AS (
        SELECT run, k, {CRC.format(bytes=LATIN_BYTES.format(text="concat(doc_id, ':', run)"))} AS h
        FROM (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL), crc
    ), words AS (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed
    ), vocabulary AS (
        SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
    ), cut AS (
        SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
    ), near AS (
        SELECT DISTINCT c.word, c.n, v.word AS other, v.n AS other_n FROM cut c JOIN vocabulary v ON v.word = c.a || c.b
        UNION SELECT DISTINCT v.word, v.n, c.word, c.n FROM cut c JOIN vocabulary v ON v.word = c.a || c.b
        UNION SELECT x.word, x.n, y.word, y.n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    ), best AS (
        SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) FILTER (WHERE other_n >= 10 * n) AS form FROM near GROUP BY word
    ), steps AS (
        SELECT word, word AS at FROM vocabulary UNION SELECT s.word, b.form FROM steps s JOIN best b ON b.word = s.at WHERE b.form IS NOT NULL
    ), ends AS (
        SELECT s.word, s.at AS root FROM steps s LEFT JOIN best b ON b.word = s.at WHERE b.form IS NULL
    )
    SELECT v.word, v.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near, b.form, f.n AS form_n, e.root
    FROM vocabulary v LEFT JOIN best b ON b.word = v.word LEFT JOIN vocabulary f ON f.word = b.form JOIN ends e ON e.word = v.word
""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf))


def _leaf(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)]
    return f"sha256({' || '.join(parts)})"


@query("op13_merkle", f"""
    WITH RECURSIVE {CRC_TABLE}, leaves AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce('+' || lang, '') AS g, {_leaf("text")} AS leaf,
               CASE WHEN {CRC.format(bytes=ASCII_BYTES.format(text="CAST(doc_id AS VARCHAR)"))} % 3 = 0
                    THEN {_leaf(f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')")} END AS other
        FROM documents, crc
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
    ), nodes AS (
        SELECT 0 AS lvl, g, pos, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM numbered
        UNION ALL
        SELECT lvl + 1, g, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) - 1) // 8 + 1 FROM nodes WHERE n > 1 GROUP BY lvl, g, pos // 8
    ), tops AS (
        SELECT 0 AS lvl, g, row_number() OVER (ORDER BY g) - 1 AS pos, d, count(*) OVER () AS n FROM nodes WHERE n = 1
        UNION ALL
        SELECT lvl + 1, '', pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) - 1) // 8 + 1 FROM tops WHERE n > 1 GROUP BY lvl, pos // 8
    ), steps AS (
        SELECT l.r, s.lvl, coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (WHERE s.pos < l.pos // (8 ** s.lvl)::BIGINT), '') AS a,
               coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (WHERE s.pos > l.pos // (8 ** s.lvl)::BIGINT), '') AS b
        FROM numbered l JOIN nodes s ON s.g = l.g AND s.n > 1 AND s.pos // 8 = l.pos // (8 ** (s.lvl + 1))::BIGINT GROUP BY l.r, s.lvl
        UNION ALL
        SELECT l.r, 100 + s.lvl, coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (WHERE s.pos < t.pos // (8 ** s.lvl)::BIGINT), ''),
               coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (WHERE s.pos > t.pos // (8 ** s.lvl)::BIGINT), '')
        FROM numbered l JOIN tops t ON t.lvl = 0 AND t.g = l.g JOIN tops s ON s.n > 1 AND s.pos // 8 = t.pos // (8 ** (s.lvl + 1))::BIGINT GROUP BY l.r, s.lvl
    ), ordered AS (
        SELECT r, a, b, row_number() OVER (PARTITION BY r ORDER BY lvl) AS k, count(*) OVER (PARTITION BY r) AS steps FROM steps
    ), folded AS (
        SELECT r, 0 AS k, coalesce(other, leaf) AS d FROM leaves
        UNION ALL
        SELECT f.r, f.k + 1, sha256(o.a || f.d || o.b) FROM folded f JOIN ordered o ON o.r = f.r AND o.k = f.k + 1
    ), last AS (
        SELECT r, arg_max(d, k) AS folded_root FROM folded GROUP BY r
    ), proofs AS (
        SELECT r, sha256(string_agg(a || b, '' ORDER BY k)) AS proof FROM ordered GROUP BY r
    )
    SELECT l.doc_id, l.leaf, sub.d AS subroot, top.d AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = top.d AS verified
    FROM leaves l JOIN (SELECT * FROM nodes WHERE n = 1) sub ON sub.g = l.g CROSS JOIN (SELECT * FROM tops WHERE n = 1) top
    JOIN last f ON f.r = l.r LEFT JOIN proofs p ON p.r = l.r
""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf))
