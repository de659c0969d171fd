"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitra.llm import bytebpe, circulant, crf, divergence, fertility, fuzzylines, hmm, manifest, mixing, ordinal, packing, repair, voronoi
from remitra.llm.common import table
from remitra.session import shared_dir


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/staged/llm-ids-{uuid.uuid4().hex}"
    repair.write_ids(table(spark, sf_dir, "documents"), folder)
    return repair.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vectors = table(spark, sf_dir, "embeddings").filter(finite).select("vec_id", voronoi.quantised(F.col("embedding")).alias("vec"))
    return voronoi.top_k(vectors, F.col("vec_id") % 20 == 0, 20)


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"))


#: Shares of tokens by domain.
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}


def domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled documents."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), TARGETS)


def op7_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return ordinal.severity(table(spark, sf_dir, "documents"), labels)


def _remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    model = crf.fit(docs.filter(~held_out))
    return crf.label(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fuzzylines.drop_repeated_lines(docs).select("doc_id", "text", "n_lines", "n_dropped")


def op10_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), _remainder(7) == 2)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=30, top=50)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's checksum 7 divides claim one character more than they have."""
    claimed = F.when(_remainder(7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = manifest.proofs(table(spark, sf_dir, "documents"), {"n_chars": claimed})
    siblings = F.array_join(F.transform("path", lambda at: F.concat(at["left"], at["right"])), "")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bytebpe.decode(bytebpe.encode(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pack, op2_token_files, op3_near_duplicates, op4_top_k, op5_fertility, op6_mixing, op7_severity, op8_language, op9_fuzzy_lines,
        op10_likelihood, op11_divergence, op12_manifest, op13_byte_bpe,
    )
}

ORACLES: dict[str, str] = {
    "op3_near_duplicates": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
            FROM words),
        classes AS (
            SELECT list_sort(s) AS s, min(doc_id) AS node, list(doc_id) AS ids FROM sets GROUP BY 1),
        items AS (SELECT node, len(s) AS n, unnest(s) AS x FROM classes),
        links AS (
            SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.x = b.x AND a.node <> b.node
            WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach(node, root) AS (
            SELECT node, node FROM classes UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.root = l.a),
        roots AS (SELECT node, min(root) AS root FROM reach GROUP BY 1),
        named AS (
            SELECT unnest(ids) AS doc_id, root, len(s) AS n FROM classes JOIN roots USING (node))
        SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE root END AS component_id,
            n = 0 OR doc_id = root AS kept
        FROM named
    """,
    "op4_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
        ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM pairs)
        SELECT * FROM ranked WHERE rank <= 20
    """,
    "op11_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        tokens AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
        kept AS (SELECT lang, term FROM tokens GROUP BY ALL HAVING count(DISTINCT id) >= 30),
        sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY ALL),
        grid AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v
            FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k USING (lang) JOIN sizes USING (lang)
            LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        shares AS (
            SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (CAST(total AS HUGEINT) + 5 * v) AS p FROM grid),
        whole AS (
            SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (CAST(total AS HUGEINT) + 5 * v) AS q
            FROM (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM counts GROUP BY lang, term)
            JOIN sizes USING (lang)),
        pairs AS (
            SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0) AS value
            FROM (SELECT DISTINCT lang, source FROM docs) g
            JOIN (SELECT DISTINCT lang, source FROM docs) h ON h.lang = g.lang AND h.source <> g.source
            LEFT JOIN (
                SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
                FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
            ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
        apart AS (SELECT lang, source, term AS item, p - q AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (
            SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
            UNION ALL
            SELECT 'term', *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM apart)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
    "op12_manifest": r"""
        WITH RECURSIVE rows_in AS (
            SELECT doc_id, lang, n_chars,
                coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                    || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                coalesce(strlen(text) || ':' || text, '-') AS tail,
                xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
                    lambda i: [ord(CAST(doc_id AS VARCHAR)[i]), 0, 0, 0, 0, 0, 0, 0]))),
                    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 7 = 0 AS tampered
            FROM documents),
        leaves AS (
            SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
                CASE WHEN tampered THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS other
            FROM rows_in),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
                dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
            FROM leaves),
        levels(tree, lvl, pos, n, h) AS (
            SELECT tree, 0, pos, n, leaf FROM placed
            UNION ALL
            SELECT tree, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM levels WHERE n > 1 GROUP BY tree, lvl, pos // 2, n),
        subroots AS (SELECT tree, lvl AS height, h FROM levels WHERE n = 1),
        tops(lvl, pos, n, h) AS (
            SELECT 0, tree, (SELECT count(*) FROM subroots), h FROM subroots
            UNION ALL
            SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 2, n),
        nodes AS (
            SELECT tree, lvl, pos, h FROM levels WHERE n > 1
            UNION ALL
            SELECT s.tree, s.height + t.lvl, t.pos, t.h FROM subroots s, tops t WHERE t.n > 1),
        path(tree, leaf_pos, lvl, pos, siblings, folded) AS (
            SELECT tree, pos, 0, pos, '', coalesce(other, leaf) FROM placed
            UNION ALL
            SELECT p.tree, p.leaf_pos, p.lvl + 1, CASE WHEN p.lvl + 1 = s.height THEN p.tree ELSE here // 2 END,
                siblings || coalesce(b.h, ''), sha256(CASE WHEN here % 2 = 0 THEN folded || coalesce(b.h, '') ELSE b.h || folded END)
            FROM (SELECT p.*, CASE WHEN p.lvl = s.height THEN p.tree ELSE p.pos END AS here FROM path p JOIN subroots s USING (tree)) p
            JOIN subroots s ON s.tree = p.tree
            JOIN nodes a ON a.tree = p.tree AND a.lvl = p.lvl AND a.pos = here
            LEFT JOIN nodes b ON b.tree = p.tree AND b.lvl = p.lvl AND b.pos = xor(here, 1)),
        ends AS (
            SELECT tree, leaf_pos, siblings, folded FROM path
            QUALIFY row_number() OVER (PARTITION BY tree, leaf_pos ORDER BY lvl DESC) = 1)
        SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
        FROM placed p JOIN subroots s USING (tree) JOIN ends e ON e.tree = p.tree AND e.leaf_pos = p.pos
        CROSS JOIN (SELECT h FROM tops WHERE n = 1) r
    """,
}
