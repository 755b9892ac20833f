"""Queries of the corpus operators, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm.alignment import aligned
from tarn.llm.common import table
from tarn.llm.conversations import repaired
from tarn.llm.exact_dedup import exact_groups
from tarn.llm.knn import top_k
from tarn.llm.language import identified
from tarn.llm.mixing import mix
from tarn.llm.near_dedup import near_groups
from tarn.llm.packing import pack
from tarn.llm.quality import scored as quality_scored
from tarn.llm.sharding import shard
from tarn.llm.substring_dedup import repeated_passages
from tarn.llm.toxicity import scored
from tarn.llm.url_filter import judged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), window=1024)


@query("op3_minhash_near_dedup")
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate component."""
    return near_groups(table(spark, sf_dir, "documents"), width=5, percent=75)


@query(
    "op4_exact_dedup",
    r"""
    WITH bare AS (
        SELECT doc_id, length(coalesce(text, '')) AS n_chars,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
        FROM documents),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY body ORDER BY n_chars DESC, doc_id NULLS FIRST) AS place,
               count(*) OVER (PARTITION BY body) AS group_size
        FROM bare),
    best AS (SELECT body, doc_id AS keep_id FROM ranked WHERE place = 1)
    SELECT r.doc_id, b.keep_id, r.group_size, r.doc_id IS NOT DISTINCT FROM b.keep_id AS kept,
           sha256(r.body) AS text_sha256, r.n_chars
    FROM ranked r JOIN best b ON r.body = b.body
    """,
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the row that stays for their text."""
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op5_pareto_mixing")
def op5_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), percent=150, most=2)


@query("op9_vector_sharding")
def op9_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return shard(table(spark, sf_dir, "documents"), shards=16)


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of documents that repeat in another document."""
    return repeated_passages(table(spark, sf_dir, "documents"), least_words=25, chunk_words=20)


@query(
    "op7_kdtree_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
    """,
)
def op7_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for every fiftieth one."""
    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


@query("op10_url_trust")
def op10_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with the rule or the trust that judges them."""
    return judged(table(spark, sf_dir, "pages"))


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their predicted language."""
    return identified(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their toxicity, learned from the labels."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_quality")
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their quality, voted on by labelled neighbours."""
    return quality_scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op12_conversation_repair",
    r"""
    WITH RECURSIVE steps(k, value) AS (
        SELECT 0, CAST(range AS BIGINT) FROM range(256)),
    shifted AS (
        SELECT value, list_reduce(list_prepend(value, [CAST(x AS BIGINT) for x in range(8)]),
            lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS entry
        FROM steps),
    crc AS (SELECT list(entry ORDER BY value) AS entries FROM shifted),
    spelled AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS mark
        FROM conversations),
    harmed AS (
        SELECT s.*, xor(4294967295, list_reduce(
                   list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) for x in string_split(mark, '')]),
                   lambda c, b: xor(c // 256, entries[CAST(xor(c % 256, b) AS INTEGER) + 1]))) % 20 AS harm
        FROM spelled s, crc),
    hurt AS (
        SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
               CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE harm WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM harmed),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
               rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
        FROM hurt),
    faulty AS (
        SELECT *, left(role, 1) AS initial,
               CASE WHEN body = '' THEN 1
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
                    WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
               concat(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos), left(role, 1)) AS pair
        FROM placed),
    arcs(state, role, target) AS (
        VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
    ends AS (
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n FROM faulty GROUP BY conv_id),
    inserts AS (
        SELECT 0 AS state, 0 AS k, 0 AS target, CAST([] AS VARCHAR[]) AS lines UNION ALL SELECT 1, 0, 1, []
        UNION ALL SELECT 2, 0, 2, [] UNION ALL SELECT 3, 0, 3, []
        UNION ALL SELECT state, 1, target, [role || ':'] FROM arcs
        UNION ALL SELECT x.state, 2, y.target, [x.role || ':', y.role || ':'] FROM arcs x JOIN arcs y ON x.target = y.state),
    edits AS (
        SELECT f.conv_id, f.pos, 'D' AS letter, q.state, q.state AS target, 3 AS cost, CAST([] AS VARCHAR[]) AS lines
        FROM faulty f, (SELECT DISTINCT state FROM arcs) q
        UNION ALL
        SELECT f.conv_id, f.pos, 'K', k.state, k.target, CASE fault WHEN 3 THEN 1 ELSE 0 END, [f.role || ':' || f.text]
        FROM faulty f JOIN (SELECT state, left(role, 1) AS initial, target FROM arcs UNION ALL SELECT 0, 's', 1) k
            ON f.initial = k.initial WHERE fault IN (0, 3)
        UNION ALL
        SELECT f.conv_id, f.pos, 'R', a.state, a.target, CASE fault WHEN 3 THEN 3 ELSE 2 END, [a.role || ':' || f.text]
        FROM faulty f, arcs a WHERE fault IN (0, 3)),
    back AS (
        SELECT e.conv_id, e.n AS pos, i.state,
               min({'cost': 2 * i.k, 'audit': repeat('I', i.k), 'lines': i.lines}) AS best
        FROM ends e, inserts i WHERE i.target IN (0, 3) GROUP BY e.conv_id, e.n, i.state
        UNION ALL
        SELECT conv_id, pos, state, best FROM (
            SELECT b.conv_id, b.pos - 1 AS pos, i.state,
                   {'cost': 2 * i.k + e.cost + b.best.cost, 'audit': repeat('I', i.k) || e.letter || b.best.audit,
                    'lines': list_concat(i.lines, e.lines, b.best.lines)} AS best,
                   row_number() OVER (PARTITION BY b.conv_id, i.state ORDER BY
                       2 * i.k + e.cost + b.best.cost, repeat('I', i.k) || e.letter || b.best.audit) AS place
            FROM back b JOIN edits e ON b.conv_id IS NOT DISTINCT FROM e.conv_id AND e.pos = b.pos AND e.target = b.state
            JOIN inserts i ON i.target = e.state)
        WHERE place = 1),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
               count(*) FILTER (fault = 3) AS truncated,
               count(*) FILTER (pos > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM faulty GROUP BY conv_id),
    whole AS (
        SELECT c.*, b.best.cost AS cost, b.best.audit AS audit, sha256(array_to_string(b.best.lines, chr(10))) AS repaired_sha256
        FROM counts c JOIN back b ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.pos = 0 AND b.state = 0)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
           coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN whole w ON o.conv_id IS NOT DISTINCT FROM w.conv_id
    """,
)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with their faults and cheapest edits after damage."""
    return repaired(table(spark, sf_dir, "conversations"))


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the alignment of their tokens by two vocabularies."""
    return aligned(table(spark, sf_dir, "documents"))
