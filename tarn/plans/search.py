"""Analog search, vector search and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions.text import display_name, first_number, without_accents
from tarn.functions.vectors import parsed
from tarn.operators import catalog
from tarn.operators.spatial import nearest
from tarn.operators.trajectories import all_analogs, analogs, centred, nearest_to_each, nearest_vectors
from tarn.plans.base import query, rounded

_PAIR = {
    "cosine": "CASE WHEN list_inner_product(c.e, c.e) = 0 OR list_inner_product(q.e, q.e) = 0 THEN 1.0 ELSE list_cosine_similarity(c.e, q.e) END",
    "euclidean": "1 / (1 + list_distance(c.e, q.e))",
    "knn": "(list_inner_product(c.e, q.e) + 1) / 2",
}


def analog_ctes(method: str, site: int, anchor: int, view: str = "v_embed") -> str:
    """CTEs ending in ``analog`` (lake_id, start_year, end_year, raw, shown, place)."""
    shown = "greatest(0.0, least(1.0, raw))" if method == "euclidean" else "greatest(0.0, least(1.0, (raw - 0.5) / 0.5))"
    return f"""
    ev AS (SELECT lake_id, year, CAST(embedding AS DOUBLE[]) AS e FROM {view}),
    q AS (SELECT e, row_number() OVER (ORDER BY year) AS k, count(*) OVER () AS n FROM (
            SELECT * FROM ev WHERE lake_id = {site} AND year <= {anchor} ORDER BY year DESC LIMIT 5) t
          WHERE EXISTS (SELECT 1 FROM ev WHERE lake_id = {site} AND year = {anchor})),
    c AS (SELECT *, row_number() OVER (PARTITION BY lake_id ORDER BY year) AS pos FROM ev WHERE lake_id <> {site}),
    span AS (SELECT a.lake_id, a.pos AS st, a.year AS start_year, b.year AS end_year
             FROM c a JOIN c b ON a.lake_id = b.lake_id AND b.pos = a.pos + 4),
    pair AS (SELECT c.lake_id, c.pos - q.k + 1 AS st, q.n, {_PAIR[method]} AS s FROM c CROSS JOIN q),
    win AS (SELECT span.lake_id, span.start_year, span.end_year, CASE WHEN min(n) = 5 THEN avg(s) ELSE 0.0 END AS raw
            FROM span JOIN pair ON span.lake_id = pair.lake_id AND span.st = pair.st
            GROUP BY span.lake_id, span.start_year, span.end_year),
    best AS (SELECT *, row_number() OVER (PARTITION BY lake_id ORDER BY raw DESC, start_year) AS rn FROM win),
    ranked AS (SELECT lake_id, start_year, end_year, raw, {shown} AS shown FROM best WHERE rn = 1),
    analog AS (SELECT *, row_number() OVER (ORDER BY shown DESC, lake_id) AS place FROM ranked)"""


def _search_sql(method: str, site: int, anchor: int, k: int) -> str:
    return f"""
    SELECT * FROM (WITH {analog_ctes(method, site, anchor)}
    SELECT lake_id, start_year, end_year, round(raw, 6) + 0.0 AS raw_score, round(shown, 6) + 0.0 AS similarity_score
    FROM analog WHERE place <= {k}) t"""


@query(_search_sql("cosine", 0, 2025, 10), "v_embed")
def analog_search_cosine(spark, records):
    return rounded(analogs(records, 0, 2025, "cosine"))


@query(_search_sql("euclidean", 0, 2025, 10), "v_embed")
def analog_search_euclidean(spark, records):
    return rounded(analogs(records, 0, 2025, "euclidean"))


@query(_search_sql("knn", 0, 2024, 20), "v_embed")
def analog_search_knn(spark, records):
    return rounded(analogs(records, 0, 2024, "knn", 20))


@query(
    """
    SELECT lake_id, CAST(min(year) AS int) AS start_year, CAST(min(year) + 4 AS int) AS end_year, CAST(0 AS double) AS raw_score, CAST(0 AS double) AS similarity_score
    FROM v_embed WHERE lake_id <> 0 GROUP BY lake_id HAVING count(*) >= 5 ORDER BY lake_id LIMIT 10""",
    "v_embed",
)
def analog_search_short_query(spark, records):
    """Three records only: score 0, first windows, sites in order."""
    return rounded(analogs(records, 0, 2018, "cosine"))


@query("SELECT lake_id, year AS start_year, year AS end_year, 0.0 AS raw_score, 0.0 AS similarity_score FROM v_embed WHERE false", "v_embed")
def analog_search_missing_anchor(spark, records):
    """An anchor year without a record finds nothing."""
    return rounded(analogs(records, 0, 2030, "cosine"))


_ALL = """
    WITH ev AS (SELECT lake_id, year, CAST(embedding AS DOUBLE[]) AS e FROM v_embed),
    q AS (SELECT lake_id AS query_id, e, row_number() OVER (PARTITION BY lake_id ORDER BY year) AS k FROM ev WHERE year BETWEEN 2021 AND 2025),
    c AS (SELECT *, row_number() OVER (PARTITION BY lake_id ORDER BY year) AS pos FROM ev),
    win AS (SELECT query_id, lake_id, pos - k AS st, CAST(min(year) AS int) AS start_year, CAST(max(year) AS int) AS end_year,
                   avg(1 / (1 + list_distance(c.e, q.e))) AS raw
            FROM c JOIN q ON lake_id <> query_id GROUP BY query_id, lake_id, pos - k HAVING count(*) = 5),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id, lake_id ORDER BY raw DESC, start_year) AS rn FROM win),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, lake_id) AS place FROM best WHERE rn = 1)
    SELECT query_id, CAST(place AS int) AS rank, lake_id, start_year, end_year, round(raw, 6) AS raw_score, round(raw, 6) AS similarity_score
    FROM ranked WHERE place <= 5"""


@query(f"SELECT * FROM ({_ALL}) t", "v_embed")
def analog_search_all_sites(spark, records):
    """Five analogs of every site in one pass."""
    return rounded(all_analogs(records, 2025, "euclidean", 5))


@query(
    """
    SELECT * FROM (WITH m AS (SELECT axis, avg(x) AS m FROM (
        SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS axis FROM v_embed) u GROUP BY axis),
    x AS (SELECT lake_id, year, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS axis FROM v_embed),
    v_mean AS (SELECT lake_id, year, list(x.x - m.m ORDER BY x.axis) AS embedding FROM x JOIN m ON x.axis = m.axis GROUP BY lake_id, year),"""
    + analog_ctes("knn", 3, 2025, "v_mean")
    + """
    SELECT lake_id, start_year, end_year, round(raw, 6) AS raw_score, round(shown, 6) AS similarity_score FROM analog WHERE place <= 10) t""",
    "v_embed",
)
def mean_centred_search(spark, records):
    return rounded(analogs(centred(records), 3, 2025, "knn"))


def _topk(score: str) -> str:
    return f"""
    SELECT query_id, CAST(rank AS int) AS rank, vec_id, round(score, 6) + 0.0 AS score FROM (
        SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM (
            SELECT q.vec_id AS query_id, c.vec_id, {score} AS score
            FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) c
            JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0) q ON c.vec_id <> q.vec_id) p) t
    WHERE rank <= 10"""


def _topk_query(method: str, score: str) -> None:
    def run(spark, vectors):
        """Every hundredth vector against all."""
        return rounded(nearest_to_each(vectors, vectors.where("vec_id % 100 = 0"), method, 10))

    run.__name__ = f"vector_topk_{method}"
    query(_topk(score), "embeddings")(run)


_topk_query("cosine", "list_cosine_similarity(c.e, q.e)")
_topk_query("l2", "1 / (1 + list_distance(c.e, q.e))")
_topk_query("ip", "list_inner_product(c.e, q.e)")


@query(
    """
    SELECT lake_id, round(list_cosine_similarity(e, one), 6) AS score FROM (
        SELECT lake_id, CAST(embedding AS DOUBLE[]) AS e FROM v_embed WHERE year = 2020 AND lake_id <> 3) c,
        (SELECT CAST(embedding AS DOUBLE[]) AS one FROM v_embed WHERE year = 2021 AND lake_id = 3) q
    ORDER BY score DESC, lake_id LIMIT 10""",
    "v_embed",
)
def vector_topk_in_year(spark, records):
    """One site's vector against all other sites' of another year."""
    one = records.where("lake_id = 3 AND year = 2021").first()["embedding"]
    return rounded(nearest_vectors(records, [float(x) for x in one], "cosine", 10, exclude=3, year=2020, id_col="lake_id"))


@query(
    """
    SELECT lake_id, year, CAST(len(embedding) AS int) AS width, true AS same
    FROM v_embed WHERE lake_id = 3 ORDER BY year""",
    "v_embed",
)
def embedding_timeline(spark, records):
    """A site's vectors as text, and read back."""
    text = catalog.timeline(records, 3)
    back = text.withColumn("back", parsed(F.col("vector"))).join(records.select("lake_id", "year", "embedding"), ["lake_id", "year"])
    near = F.forall(F.zip_with("back", "embedding", lambda a, b: F.abs(a - b) < 1e-6), lambda x: x)
    return back.select("lake_id", "year", "width", near.alias("same"))


@query(
    """
    SELECT lake_id, year, country, state FROM (
        SELECT *, row_number() OVER (PARTITION BY lake_id ORDER BY year DESC) AS back FROM v_embed) e
    JOIN v_lakes USING (lake_id) WHERE back = 1""",
    "v_embed",
    "v_lakes",
)
def latest_region_per_lake(spark, records, sites):
    return catalog.latest_per_site(records, sites).select("lake_id", "year", "country", "state")


@query(
    "SELECT lake_id, count(*) AS n, max(year) AS last_year, min(year) AS first_year FROM v_embed GROUP BY lake_id",
    "v_embed",
)
def site_histories(spark, records):
    return catalog.histories(records).select(
        "lake_id", F.size("records").cast("long").alias("n"), "last_year", F.get("records", F.lit(0))["year"].alias("first_year")
    )


@query(
    """
    SELECT lake_id, round(6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h)), 3) AS distance_km FROM (
        SELECT *, pow(sin(radians(center_lat - 20) / 2), 2)
                  + cos(radians(20)) * cos(radians(center_lat)) * pow(sin(radians(center_lon - 77) / 2), 2) AS h
        FROM v_lakes WHERE center_lat IS NOT NULL) t
    ORDER BY (center_lat - 20) * (center_lat - 20) + (center_lon - 77) * (center_lon - 77), lake_id LIMIT 1""",
    "v_lakes",
)
def nearest_lake(spark, sites):
    return nearest(sites.where("center_lat IS NOT NULL"), 20.0, 77.0).select("lake_id", "distance_km")


@query("SELECT count(*) AS total, count(*) FILTER (is_active) AS active FROM v_lakes WHERE country ILIKE 'asia'", "v_lakes")
def lake_catalog_count(spark, sites):
    return catalog.site_count(sites, "asia")


@query("SELECT DISTINCT state FROM v_lakes WHERE country ILIKE 'Europe' AND trim(state) <> '' ORDER BY state", "v_lakes")
def lake_catalog_states(spark, sites):
    return catalog.states(sites, "EUROPE")


_NAME = """CASE WHEN lake_name IS NOT NULL AND trim(lake_name) <> '' AND trim(lake_name) <> CAST(lake_id AS varchar) THEN lake_name
                WHEN state IS NOT NULL THEN concat('Unnamed Lake #', lake_id, ' (', state, ')') ELSE concat('Unnamed Lake #', lake_id) END"""


def named(sites):
    return sites.withColumn("display_name", display_name(F.col("lake_name"), F.col("lake_id"), F.col("state")))


@query(f"SELECT lake_id, {_NAME} AS display_name FROM v_lakes", "v_lakes")
def display_names(spark, sites):
    return named(sites).select("lake_id", "display_name")


@query(
    f"SELECT lake_id, display_name FROM (SELECT lake_id, {_NAME} AS display_name FROM v_lakes) t "
    "WHERE display_name ILIKE '%lake #1%' ORDER BY display_name, lake_id LIMIT 20",
    "v_lakes",
)
def lake_catalog_search(spark, sites):
    return catalog.search(named(sites), " Lake #1 ", 20).select("lake_id", "display_name")


@query(
    f"""SELECT lake_id, {_NAME} AS display_name, coalesce(center_lat, pour_lat) AS lat, coalesce(center_lon, pour_lon) AS lon
        FROM v_lakes WHERE is_active AND coalesce(center_lat, pour_lat) IS NOT NULL""",
    "v_lakes",
)
def lake_catalog_markers(spark, sites):
    return catalog.markers(named(sites))


@query("SELECT lake_id, area_sqkm >= 2 AS is_active FROM v_lakes", "v_lakes")
def activation_rule(spark, sites):
    return catalog.activated(sites).select("lake_id", "is_active")


@query("SELECT y AS year FROM (VALUES (2014), (2015), (2026)) v(y)", "v_embed")
def missing_years(spark, records):
    return catalog.missing_years(records, [2014, 2015, 2016, 2020, 2025, 2026])


@query("SELECT count(DISTINCT lake_id) AS lakes, count(DISTINCT year) AS years, count(*) AS records FROM v_embed", "v_embed")
def library_size(spark, records):
    return catalog.library_size(records)


@query(
    """SELECT s_suppkey AS lake_id, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal WHEN s_nationkey <> 0 THEN CAST(s_nationkey AS double) ELSE 0.0 END AS area
       FROM supplier""",
    "supplier",
)
def numeric_fallbacks(spark, supplier):
    """The first attribute that is a number other than 0; else 0."""
    text = F.when(F.col("s_suppkey") % 4 == 0, F.col("s_acctbal").cast("string")).when(F.col("s_suppkey") % 4 == 1, "").when(
        F.col("s_suppkey") % 4 == 2, "0"
    ).otherwise("n/a")
    return supplier.select(
        F.col("s_suppkey").alias("lake_id"), first_number(text, F.col("s_nationkey").cast("string")).alias("area")
    )


@query("SELECT n_nationkey, n_name AS plain FROM nation", "nation")
def accents_stripped(spark, nation):
    """Marks put on letters come off again."""
    marked = F.regexp_replace("n_name", "([AEIOU])", "$1́")
    return nation.select("n_nationkey", without_accents(marked).alias("plain"))
