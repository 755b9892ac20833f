"""Token fractions, pooling, blending and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.constants import INPUT_BANDS, INPUT_MEAN, INPUT_STD
from tarn.functions.vectors import dot
from tarn.operators import pooling, runs, windows
from tarn.plans.base import query, rounded


@query(
    """
    SELECT * FROM (
        SELECT CAST(o_custkey % 5 AS bigint) AS lake_id, CAST(year(o_orderdate) AS int) AS year, CAST(floor((o_orderkey % 500) / 224) AS bigint) AS window_r,
               CAST(floor((o_custkey % 300) / 224) AS bigint) AS window_c,
               CAST(floor((o_orderkey % 500) % 224 / 16) * 14 + floor((o_custkey % 300) % 224 / 16) AS bigint) AS token_id,
               round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS lake_frac,
               round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END), 6) AS shore_frac,
               round(avg(CASE WHEN o_totalprice > 1000 THEN 1.0 ELSE 0.0 END), 6) AS valid_frac
        FROM orders GROUP BY 1, 2, 3, 4, 5) t WHERE lake_frac + shore_frac > 0""",
    "orders",
)
def token_fractions(spark, orders):
    pixels = orders.select(
        (F.col("o_custkey") % 5).alias("lake_id"), F.year("o_orderdate").alias("year"),
        (F.col("o_orderkey") % 500).alias("r"), (F.col("o_custkey") % 300).alias("c"),
        (F.col("o_orderstatus") == "F").alias("in_lake"), (F.col("o_orderstatus") == "O").alias("in_shore"),
        (F.col("o_totalprice") > 1000).alias("valid"),
    )
    return rounded(pooling.token_fractions(pixels))


_POOL = """
    x AS (SELECT lake_id, year, lake_frac * valid_frac AS lw, shore_frac * valid_frac AS sw,
                 unnest(CAST(vec AS DOUBLE[])) AS x, unnest(range(len(vec))) AS axis FROM v_tokens),
    p AS (SELECT lake_id, year, axis, CASE WHEN sum(lw) > 0 THEN sum(lw * x) / sum(lw) END AS l,
                 CASE WHEN sum(sw) > 0 THEN sum(sw * x) / sum(sw) END AS s, sum(lw) AS lw, sum(sw) AS sw, count(*) AS n
          FROM x GROUP BY lake_id, year, axis),
    n AS (SELECT lake_id, year, sqrt(sum(l * l)) AS ln, sqrt(sum(s * s)) AS sn FROM p GROUP BY lake_id, year),
    u AS (SELECT p.*, CASE WHEN ln > 1e-12 THEN l / ln END AS ul, CASE WHEN sn > 1e-12 THEN s / sn END AS us
          FROM p JOIN n ON p.lake_id = n.lake_id AND p.year = n.year)"""


@query(
    f"""SELECT * FROM (WITH {_POOL} SELECT lake_id, year, CAST(axis AS int) AS axis, round(ul, 4) + 0.0 AS lake, round(us, 4) + 0.0 AS shore,
               round(lw, 6) AS lake_token_weight, round(sw, 6) AS shore_token_weight, n AS tokens_encoded FROM u) t""",
    "v_tokens",
)
def pooled_embedding(spark, tokens):
    """Unit vectors, place by place, to four digits of single precision."""
    p = pooling.pooled(tokens)
    shore = F.coalesce("shore_embedding", F.transform("lake_embedding", lambda _: F.lit(None).cast("float")))
    both = F.arrays_zip("lake_embedding", shore.alias("shore_embedding"))
    out = p.select("lake_id", "year", "lake_token_weight", "shore_token_weight", "tokens_encoded", F.posexplode(both).alias("axis", "v"))
    four = lambda c: (F.round(F.col(c).cast("double"), 4) + 0.0)
    return out.select(
        "lake_id", "year", "axis", four("v.lake_embedding").alias("lake"), four("v.shore_embedding").alias("shore"),
        F.round("lake_token_weight", 6).alias("lake_token_weight"), F.round("shore_token_weight", 6).alias("shore_token_weight"), "tokens_encoded",
    )


@query(
    f"""SELECT * FROM (WITH {_POOL},
        b AS (SELECT lake_id, year, axis, CASE WHEN us IS NULL THEN ul ELSE 0.7 * ul + 0.3 * us END AS b, us IS NULL AS alone FROM u),
        m AS (SELECT lake_id, year, sqrt(sum(b * b)) AS m FROM b GROUP BY lake_id, year)
        SELECT b.lake_id, b.year, round(sum(b / m * (axis + 1)), 3) + 0.0 AS mark, CASE WHEN bool_or(alone) THEN CAST(1 AS double) ELSE CAST(0.7 AS double) END AS lake_weight, true AS is_unit
        FROM b JOIN m ON b.lake_id = m.lake_id AND b.year = m.year WHERE b IS NOT NULL GROUP BY b.lake_id, b.year) t""",
    "v_tokens",
)
def blended_embedding(spark, tokens):
    """Lake and shore blended; a weighted sum of the places stands for the vector."""
    b = pooling.blended(pooling.pooled(tokens)).where("embedding IS NOT NULL")
    mark = F.aggregate(
        F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x
    )
    length = dot(F.col("embedding"), F.col("embedding"))
    return b.select(
        "lake_id", "year", (F.round(mark, 3) + 0.0).alias("mark"), F.col("lake_weight").cast("double").alias("lake_weight"),
        (F.abs(length - 1) < 1e-5).alias("is_unit"),
    )


@query(
    """SELECT outcome, round(w, 3) AS lake_weight, count(*) AS n FROM (
           SELECT CASE WHEN ok THEN 'updated' ELSE 'skipped' END AS outcome,
                  CAST(CASE WHEN ok THEN CASE WHEN shore_embedding IS NULL THEN 1.0 ELSE 0.55 END ELSE lake_weight END AS double) AS w
           FROM (SELECT *, status = 'completed' AND embedding_version = 2 AND lake_embedding IS NOT NULL AND year IN (1999, 2000) AS ok FROM v_regions) r) t
       GROUP BY 1, 2""",
    "v_regions",
)
def reblend_counts(spark, regions):
    done = pooling.reblended(regions, 0.55, [1999, 2000])
    weight = F.round(F.col("lake_weight").cast("double"), 3).alias("lake_weight")
    return done.groupBy("outcome", weight).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CASE WHEN shore_embedding IS NULL THEN 'lake_only' ELSE 'blended' END AS kind, round(CAST(lake_weight AS double), 3) AS weight, count(*) AS n
       FROM v_regions GROUP BY 1, 2""",
    "v_regions",
)
def weight_summary(spark, regions):
    return pooling.weight_summary(regions.withColumn("lake_weight", F.col("lake_weight").cast("double")))


@query(
    """SELECT CAST(lake_weight AS double) AS lake_weight FROM v_regions WHERE shore_embedding IS NOT NULL
       GROUP BY lake_weight ORDER BY count(*) DESC, min(year * 100000 + lake_id) LIMIT 1""",
    "v_regions",
)
def current_weight(spark, regions):
    return pooling.current_weight(regions.withColumn("lake_weight", F.col("lake_weight").cast("double")))


@query("SELECT DISTINCT year FROM v_regions WHERE status = 'completed' AND embedding IS NOT NULL ORDER BY year", "v_regions")
def available_years(spark, regions):
    return pooling.available_years(regions)


@query(
    """SELECT lake_id, year, CASE WHEN s > 0 THEN lake_frac / s ELSE 1.0 / n END AS w FROM (
           SELECT lake_id, year, sum(lake_frac) OVER w AS s, count(*) OVER w AS n, lake_frac FROM v_tokens WINDOW w AS (PARTITION BY lake_id, year)) t"""
    .replace("CASE WHEN s", "round(CASE WHEN s").replace("END AS w", "END, 6) AS w"),
    "v_tokens",
)
def group_shares(spark, tokens):
    return rounded(tokens.select("lake_id", "year", pooling.share_of_group("lake_frac", "lake_id", "year").alias("w")))


@query(
    """SELECT count(*) FILTER (status = 'completed' AND shore_embedding IS NOT NULL AND year NOT IN (1996, 1997) AND abs(lake_weight - 0.6) > 1e-6) > 0 AS mixed
       FROM v_regions""",
    "v_regions",
)
def mixed_weights(spark, regions):
    """Whether years that are not blended anew keep weights of their own."""
    return pooling.mixed_after(regions, [1996, 1997], 0.6)


@query(
    f"""SELECT * FROM (WITH {_POOL},
        i AS (SELECT *, year + 21 AS y FROM v_images WHERE status = 'merged'),
        o AS (SELECT *, year + 21 AS y FROM v_results),
        todo AS (SELECT lake_id, y FROM i WHERE NOT EXISTS (
            SELECT 1 FROM o WHERE o.lake_id = i.lake_id AND o.y = i.y AND o.status = 'completed' AND o.feature_version = 2 AND o.updated_at >= i.updated_at)),
        b AS (SELECT lake_id, year, axis, CASE WHEN us IS NULL THEN ul ELSE 0.7 * ul + 0.3 * us END AS b, us IS NULL AS alone FROM u WHERE ul IS NOT NULL),
        m AS (SELECT lake_id, year, sqrt(sum(b * b)) AS m FROM b GROUP BY lake_id, year),
        v AS (SELECT b.lake_id, b.year, round(sum(b / m * (axis + 1)), 3) + 0.0 AS mark, CASE WHEN bool_or(alone) THEN 1.0 ELSE 0.7 END AS w
              FROM b JOIN m ON b.lake_id = m.lake_id AND b.year = m.year GROUP BY b.lake_id, b.year)
        SELECT lake_id, CAST(coalesce(t.y, o.y) AS int) AS year,
               CASE WHEN t.y IS NULL THEN o.status WHEN mark IS NULL THEN 'failed' ELSE 'completed' END AS status,
               CAST(CASE WHEN t.y IS NULL THEN o.feature_version ELSE 2 END AS int) AS embedding_version,
               CASE WHEN t.y IS NOT NULL THEN mark END AS mark, CAST(CASE WHEN t.y IS NOT NULL THEN w END AS double) AS lake_weight
        FROM o FULL JOIN todo t USING (lake_id, y) LEFT JOIN v ON v.lake_id = t.lake_id AND v.year = t.y) z""",
    "v_images",
    "v_results",
    "v_tokens",
)
def embedding_run(spark, images, results, tokens):
    """A whole run: work list, pooling, blending and the merge; a weighted sum stands for the vector."""
    later = lambda df: df.withColumn("year", (F.col("year") + 21).cast("int"))
    regions = later(results).withColumnRenamed("feature_version", "embedding_version")
    out = runs.embedding_run(later(images), regions, tokens)
    mark = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return out.select(
        "lake_id", "year", "status", "embedding_version", (F.round(mark, 3) + 0.0).alias("mark"), F.col("lake_weight").cast("double").alias("lake_weight")
    )


_SPREAD = """
    px AS (SELECT lake_id, year + 21 AS year, r * 5 AS r, c * 5 AS c, (r + c) % 3 = 0 AS lake, (r + c) % 3 = 1 AS shore, valid, {bands} FROM v_bands),
    ext AS (SELECT lake_id, year, floor(min(r) / 16) * 16 AS r0, ceil((max(r) + 1) / 16) * 16 AS r1, floor(min(c) / 16) * 16 AS c0, ceil((max(c) + 1) / 16) * 16 AS c1
            FROM px WHERE lake OR shore GROUP BY lake_id, year),
    blk AS (SELECT lake_id, year, r0 - floor((224 - (r1 - r0)) / 32) * 16 AS r0, c0 - floor((224 - (c1 - c0)) / 32) * 16 AS c0 FROM ext),
    tok AS (SELECT lake_id, year, CAST(floor((r - r0) / 16) * 14 + floor((c - c0) / 16) AS bigint) AS token_id, px.* EXCLUDE (lake_id, year)
            FROM px JOIN blk USING (lake_id, year)),
    fr AS (SELECT lake_id, year, token_id, count(*) FILTER (lake AND valid) / 256.0 AS lf, count(*) FILTER (shore AND valid) / 256.0 AS sf, count(*) FILTER (valid) / 256.0 AS vf,
                  {sums} FROM tok GROUP BY lake_id, year, token_id),
    kept AS (SELECT * FROM fr WHERE lf + sf > 0)""".format(
    bands=", ".join(f"CASE WHEN valid THEN (b{x} - {m}) / {s} END AS b{x}" for x, m, s in zip([b[1:] for b in INPUT_BANDS], INPUT_MEAN, INPUT_STD)),
    sums=", ".join(f"coalesce(sum({b}), 0) / 256.0 AS v{i}" for i, b in enumerate(INPUT_BANDS)),
)


def spread(pixels):
    """Pixels five apart, of lake, shore and neither by their place, some years later."""
    place = (F.col("r") + F.col("c")) % 3
    masks = {"in_lake": place == 0, "in_shore": place == 1, "year": (F.col("year") + 21).cast("int"), "r": F.col("r") * 5, "c": F.col("c") * 5}
    return pixels.withColumns(masks)


@query(
    f"""SELECT * FROM (WITH {_SPREAD}
        SELECT lake_id, CAST(year AS int) AS year, token_id, round(CAST(lf AS double), 6) AS lake_frac, round(CAST(sf AS double), 6) AS shore_frac, round(CAST(vf AS double), 6) AS valid_frac,
               round({" + ".join(f"v{i} * {i + 1}" for i in range(len(INPUT_BANDS)))}, 3) + 0.0 AS mark FROM kept) z""",
    "v_bands",
)
def dense_windows(spark, pixels):
    """Tokens of full, centred windows, with a sum over the means of their bands."""
    out = windows.dense_tokens(spread(pixels), windows.band_means)
    mark = F.aggregate(F.transform("vec", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    cols = [F.round(c, 6).alias(c) for c in windows.SHARES]
    return out.select("lake_id", "year", F.col("token_id").cast("long").alias("token_id"), *cols, (F.round(mark, 3) + 0.0).alias("mark"))


_SIX = range(len(INPUT_BANDS))


@query(
    f"""SELECT * FROM (WITH {_SPREAD},
        i AS (SELECT *, year + 21 AS y FROM v_images WHERE status = 'merged'),
        o AS (SELECT *, year + 21 AS y FROM v_results),
        todo AS (SELECT lake_id, y FROM i WHERE NOT EXISTS (
            SELECT 1 FROM o WHERE o.lake_id = i.lake_id AND o.y = i.y AND o.status = 'completed' AND o.feature_version = 2 AND o.updated_at >= i.updated_at)),
        enough AS (SELECT lake_id, year FROM px WHERE lake AND valid GROUP BY lake_id, year HAVING count(*) >= 8),
        su AS (SELECT lake_id, year, sum(lf) AS lw, sum(sf) AS sw, {", ".join(f"sum(lf * v{k}) AS l{k}, sum(sf * v{k}) AS s{k}" for k in _SIX)} FROM kept JOIN enough USING (lake_id, year) GROUP BY lake_id, year),
        un AS (SELECT *, sqrt({" + ".join(f"l{k} * l{k}" for k in _SIX)}) AS ln, sqrt({" + ".join(f"s{k} * s{k}" for k in _SIX)}) AS sn FROM su WHERE lw > 0),
        bl AS (SELECT lake_id, year, sw > 0 AS both_, {", ".join(f"CASE WHEN sw > 0 THEN 0.7 * l{k} / ln + 0.3 * s{k} / sn ELSE l{k} / ln END AS e{k}" for k in _SIX)} FROM un),
        v AS (SELECT lake_id, year, both_, round(({" + ".join(f"e{k} * {k + 1}" for k in _SIX)}) / sqrt({" + ".join(f"e{k} * e{k}" for k in _SIX)}), 3) + 0.0 AS mark FROM bl)
        SELECT lake_id, CAST(coalesce(t.y, o.y) AS int) AS year,
               CASE WHEN t.y IS NULL THEN o.status WHEN mark IS NULL THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN t.y IS NOT NULL THEN mark END AS mark,
               CAST(CASE WHEN t.y IS NOT NULL AND mark IS NOT NULL THEN CASE WHEN both_ THEN 0.7 ELSE 1.0 END END AS double) AS lake_weight
        FROM o FULL JOIN todo t USING (lake_id, y) LEFT JOIN v ON v.lake_id = t.lake_id AND v.year = t.y) z""",
    "v_images",
    "v_results",
    "v_bands",
)
def embedding_run_from_pixels(spark, images, results, pixels):
    """A whole run from pixels: work list, windows, encoder, pooling, blending and the merge."""
    later = lambda df: df.withColumn("year", (F.col("year") + 21).cast("int"))
    regions = later(results).withColumnRenamed("feature_version", "embedding_version")
    out = windows.embedding_run_from_pixels(later(images), regions, spread(pixels), windows.band_means, least=8)
    mark = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return out.select("lake_id", "year", "status", (F.round(mark, 3) + 0.0).alias("mark"), F.col("lake_weight").cast("double").alias("lake_weight"))
