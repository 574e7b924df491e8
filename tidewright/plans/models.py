"""Queries: weighted tag vectors and genre discrimination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import weights as w
from ..operators import relational as r
from ..operators import vectors as v
from ..sources.readers import Bed
from . import prelude as p

#: Parameters of the registered queries: entities and genres of the test bed.
ACTOR, USER, GENRE, OTHER, BRAND = 7, 7, "PROMO", "ECONOMY", "Brand#1"


def out(c: str) -> Column:
    return F.round(c, 6).alias(c)


def _actor_tf(bed: Bed, actor: int) -> DataFrame:
    own = v.ranked(bed.cast(), w.rank_linear).filter(F.col("actorid") == actor)
    rows = v.timed(own.join(bed.movie_tags(), "movieid"), w.time_continuous)
    return v.term_frequency(rows, w.even4(F.col("rw") + F.col("tw")), "tagid")


def actor_tf(spark: SparkSession, sf: str, actor: int = ACTOR) -> DataFrame:
    return _actor_tf(Bed(spark, sf), actor).select("tagid", out("tf"))


_ACTOR_TF = [
    p.RANKS,
    f"own AS (SELECT r.*, t.tagid, t.us FROM ranks r JOIN mltags t USING (movieid) WHERE actorid = {ACTOR})",
    p.timed("ot", "own", p.tsw_c),
    f"ow AS (SELECT tagid, sum({p.even4(p.rw1('rank', 'lo', 'hi') + ' + tw')}) AS w FROM ot GROUP BY 1)",
    "tf AS (SELECT tagid, w / (SELECT sum(w) FROM ow) AS tf FROM ow)",
]


def actor_tfidf(spark: SparkSession, sf: str, actor: int = ACTOR) -> DataFrame:
    bed = Bed(spark, sf)
    df = v.document_frequency(bed.cast().join(bed.movie_tags().select("movieid", "tagid").distinct(), "movieid"), "tagid", "actorid")
    return v.weighted(_actor_tf(bed, actor), v.inverse(df, bed.actors().agg(F.count("*"))), "tagid").select("tagid", out("tfidf"))


def _genre_rows(bed: Bed, genre: str) -> DataFrame:
    return bed.movie_tags().join(bed.movies().filter(r.genre_is(genre)).select("movieid"), "movieid", "left_semi")


def _genre_tf(bed: Bed, genre: str) -> DataFrame:
    return v.term_frequency(v.timed(_genre_rows(bed, genre), w.time_continuous), F.col("tw"), "tagid")


def genre_tf(spark: SparkSession, sf: str, genre: str = GENRE) -> DataFrame:
    return _genre_tf(Bed(spark, sf), genre).select("tagid", out("tf"))


_GENRE_TF = [
    f"own AS (SELECT * FROM mltags WHERE movieid IN (SELECT movieid FROM mlmovies WHERE contains(genres, '{GENRE}')))",
    p.timed("ot", "own", p.tsw_c),
    "ow AS (SELECT tagid, sum(tw) AS w FROM ot GROUP BY 1)",
    "tf AS (SELECT tagid, w / (SELECT sum(w) FROM ow) AS tf FROM ow)",
]


def genre_tfidf(spark: SparkSession, sf: str, genre: str = GENRE) -> DataFrame:
    bed = Bed(spark, sf)
    each = r.genres(bed.movies())
    df = v.document_frequency(bed.movie_tags().select("movieid", "tagid").distinct().join(each, "movieid"), "tagid", "genre")
    return v.weighted(_genre_tf(bed, genre), v.inverse(df, each.agg(F.countDistinct("genre"))), "tagid").select("tagid", out("tfidf"))


def _user_tf(bed: Bed, user: int) -> DataFrame:
    """Repeated ratings of a movie count its tags again, as the join makes them."""
    rated = bed.ratings().filter(F.col("userid") == user).select("movieid")
    return v.term_frequency(v.timed(rated.join(bed.movie_tags(), "movieid"), w.time_continuous), F.col("tw"), "tagid")


def user_tf(spark: SparkSession, sf: str, user: int = USER) -> DataFrame:
    return _user_tf(Bed(spark, sf), user).select("tagid", out("tf"))


_USER_TF = [
    f"own AS (SELECT t.* FROM mltags t JOIN mlratings r USING (movieid) WHERE r.userid = {USER})",
    p.timed("ot", "own", p.tsw_c),
    "ow AS (SELECT tagid, sum(tw) AS w FROM ot GROUP BY 1)",
    "tf AS (SELECT tagid, w / (SELECT sum(w) FROM ow) AS tf FROM ow)",
]


def user_tfidf(spark: SparkSession, sf: str, user: int = USER) -> DataFrame:
    bed = Bed(spark, sf)
    raters = bed.ratings().select("movieid", "userid").distinct().join(bed.movie_tags().select("movieid", "tagid").distinct(), "movieid")
    return v.weighted(_user_tf(bed, user), v.inverse(v.document_frequency(raters, "tagid", "userid"), bed.users().agg(F.count("*"))), "tagid").select("tagid", out("tfidf"))


def tfidf_diff(spark: SparkSession, sf: str, genre: str = GENRE, other: str = OTHER) -> DataFrame:
    bed = Bed(spark, sf)
    both = bed.movies().filter(r.genre_is_any(genre, other)).select("movieid")
    df = v.document_frequency(bed.movie_tags().join(both, "movieid", "left_semi"), "tagid", "movieid")
    return v.weighted(_genre_tf(bed, genre), v.inverse(df, both.agg(F.count("*"))), "tagid").select("tagid", out("tfidf"))


def _counts(bed: Bed, genre: str, other: str, r_of: str, by_first: bool) -> DataFrame:
    """tagid, r, all_r, m, all_m: movies of the genre `r_of`, and of either genre, with the tag and in all."""
    tags = bed.movie_tags().select("movieid", "tagid").distinct()
    kinds = bed.movies().select("movieid", r.genre_is(genre).alias("g1"), r.genre_is_any(genre, other).alias("either"), r.genre_is(r_of).alias("r_of")).filter("either")
    one = lambda c: F.sum(F.col(c).cast("long"))
    per = tags.join(kinds, "movieid").groupBy("tagid").agg(one("r_of").alias("r"), F.count("*").alias("m"), one("g1").alias("first"))
    total = kinds.agg(one("r_of").alias("all_r"), F.count("*").alias("all_m"))
    return (per.filter("first > 0") if by_first else per).crossJoin(F.broadcast(total))


def _c(name: str) -> Column:
    return F.col(name)


def p_diff1(spark: SparkSession, sf: str, genre: str = GENRE, other: str = OTHER) -> DataFrame:
    found = _counts(Bed(spark, sf), genre, other, genre, True)
    return found.withColumn("weight", w.p_diff1(_c("r"), _c("all_r"), _c("m"), _c("all_m"))).select("tagid", out("weight"))


def p_diff2(spark: SparkSession, sf: str, genre: str = GENRE, other: str = OTHER) -> DataFrame:
    found = _counts(Bed(spark, sf), genre, other, other, True)
    return found.withColumn("weight", w.p_diff2(_c("r"), _c("all_r"), _c("m"), _c("all_m"))).select("tagid", out("weight"))


def p_diff1_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    """Genres whose movies overlap."""
    return p_diff1(spark, sf, GENRE, BRAND)


def _pdiff_sql(genre: str, other: str, r_of: str, weight: str) -> str:
    g1, either, rof = f"contains(genres, '{genre}')", f"(contains(genres, '{genre}') OR contains(genres, '{other}'))", f"contains(genres, '{r_of}')"
    return p.sql(
        f"k AS (SELECT movieid, {g1} AS g1, {rof} AS rof FROM mlmovies WHERE {either})",
        "t AS (SELECT DISTINCT movieid, tagid FROM mltags)",
        "c AS (SELECT tagid, count(*) FILTER (rof)::DOUBLE AS r, count(*)::DOUBLE AS m, count(*) FILTER (g1) AS f, (SELECT count(*) FILTER (rof) FROM k)::DOUBLE AS br, (SELECT count(*) FROM k)::DOUBLE AS bm FROM t JOIN k USING (movieid) GROUP BY 1)",
        weight,
        final="SELECT tagid, round(CASE WHEN x * (1 - y) > 0 AND y * (1 - x) > 0 THEN val END, 6) AS weight FROM z",
        use=("mltags", "mlmovies"),
    )


_LN = "ln(CASE WHEN x * (1 - y) > 0 AND y * (1 - x) > 0 THEN x * (1 - y) / (y * (1 - x)) END)"
_XY1 = "xy AS (SELECT tagid, (r + m / bm) / (br + 1) AS x, (m - r + m / bm) / (bm - br + 1) AS y FROM c WHERE f > 0), z AS (SELECT *, " + _LN + " * (x - y) AS val FROM xy)"
_XY2 = "xy AS (SELECT tagid, (br - r) / (br + 1) AS x, ((bm - m) - (br - r)) / (bm - br + 1) AS y FROM c WHERE f > 0), z AS (SELECT *, " + _LN + " AS val FROM xy)"
_XYP = "xy AS (SELECT tagid, (r + m / bm) / (br + 1) AS x, (m - r + m / bm) / (bm - br + 1) AS y FROM c), z AS (SELECT *, CASE WHEN x <> y AND x * (1 - y) > 0 AND y * (1 - x) > 0 THEN ln(x * (1 - y) / (y * (1 - x)) * abs(x - y)) END AS val FROM xy)"


def p_diff_product(spark: SparkSession, sf: str, genre: str = GENRE, other: str = OTHER) -> DataFrame:
    found = _counts(Bed(spark, sf), genre, other, genre, False)
    return found.withColumn("weight", w.p_diff_product(_c("r"), _c("all_r"), _c("m"), _c("all_m"))).select("tagid", out("weight"))


def p_diff2_product(spark: SparkSession, sf: str, genre: str = GENRE, other: str = OTHER) -> DataFrame:
    """Of the second genre's movies, those with some other tag count as r."""
    bed = Bed(spark, sf)
    kinds = bed.movies().select("movieid", r.genre_is(other).alias("g2"), r.genre_is_any(genre, other).alias("either")).filter("either")
    tags = bed.movie_tags().select("movieid", "tagid").distinct().join(kinds, "movieid")
    several = tags.groupBy("movieid").agg(F.count("*").alias("n"))
    per = tags.join(several, "movieid").groupBy("tagid").agg(F.count("*").alias("m"), F.sum((F.col("g2") & (F.col("n") == 1)).cast("long")).alias("only"))
    tagged = F.broadcast(tags.filter("g2").agg(F.countDistinct("movieid").alias("g2_tagged")))
    total = F.broadcast(kinds.agg(F.sum(F.col("g2").cast("long")).alias("all_r"), F.count("*").alias("all_m")))
    found = per.crossJoin(tagged).crossJoin(total).withColumn("r", F.col("g2_tagged") - F.col("only"))
    return found.withColumn("weight", w.p_diff_product(_c("r"), _c("all_r"), _c("m"), _c("all_m"))).select("tagid", out("weight"))


_PDIFF2_PRODUCT = p.sql(
    f"k AS (SELECT movieid, contains(genres, '{OTHER}') AS g2 FROM mlmovies WHERE contains(genres, '{GENRE}') OR contains(genres, '{OTHER}'))",
    "t AS (SELECT DISTINCT movieid, tagid, g2 FROM mltags JOIN k USING (movieid))",
    "c AS (SELECT a.tagid, (SELECT count(DISTINCT b.movieid) FROM t b WHERE b.g2 AND b.tagid <> a.tagid)::DOUBLE AS r, count(*)::DOUBLE AS m, (SELECT count(*) FILTER (g2) FROM k)::DOUBLE AS br, (SELECT count(*) FROM k)::DOUBLE AS bm FROM t a GROUP BY 1)",
    _XYP, final="SELECT tagid, round(val, 6) AS weight FROM z", use=("mltags", "mlmovies"),
)


def tfidf_diff_counts(spark: SparkSession, sf: str, genre: str = GENRE, other: str = OTHER) -> DataFrame:
    """The variant by counts: taggings of the genre over all of them, times ln(movies of either genre / movies with the tag anywhere)."""
    bed = Bed(spark, sf)
    freq = _genre_rows(bed, genre).groupBy("tagid").agg(F.count("*").cast("double").alias("n"))
    tf = r.share_of_all(freq, "n", "tf").drop("n")
    df = v.document_frequency(bed.movie_tags(), "tagid", "movieid")
    return v.weighted(tf, v.inverse(df, bed.movies().filter(r.genre_is_any(genre, other)).agg(F.count("*")), F.ln), "tagid").select("tagid", out("tfidf"))


def _sql_variant(rows: DataFrame, weight: Column, df: DataFrame, total: DataFrame) -> DataFrame:
    tf = v.term_frequency(v.timed(rows, w.time_continuous), weight, "tagid")
    return v.weighted(tf, v.inverse(df, total, F.ln), "tagid").select("tagid", out("tfidf"))


def actor_tfidf_by_cast(spark: SparkSession, sf: str, actor: int = ACTOR, documents: int | None = None) -> DataFrame:
    """Rank over cast size plus time, unrounded; natural logarithm; the number of documents may be given."""
    bed = Bed(spark, sf)
    rows = v.ranked(bed.cast(), w.rank_by_cast).filter(F.col("actorid") == actor).join(bed.movie_tags(), "movieid")
    df = v.document_frequency(bed.cast().join(bed.movie_tags().select("movieid", "tagid").distinct(), "movieid"), "tagid", "actorid")
    total = bed.actors().agg(F.count("*")) if documents is None else spark.range(1).select(F.lit(documents))
    return _sql_variant(rows, F.col("rw") + F.col("tw"), df, total)


def user_tfidf_by_taggers(spark: SparkSession, sf: str, user: int = USER) -> DataFrame:
    """The user's own taggings; document frequencies count taggers."""
    bed = Bed(spark, sf)
    tags = bed.tags()
    return _sql_variant(tags.filter(F.col("userid") == user), F.col("tw"), v.document_frequency(tags, "tagid", "userid"), bed.users().agg(F.count("*")))


def genre_tfidf_ln(spark: SparkSession, sf: str, genre: str = GENRE) -> DataFrame:
    bed = Bed(spark, sf)
    each = r.genres(bed.movies())
    df = v.document_frequency(bed.movie_tags().select("movieid", "tagid").distinct().join(each, "movieid"), "tagid", "genre")
    return _sql_variant(_genre_rows(bed, genre), F.col("tw"), df, each.agg(F.countDistinct("genre")))


def actor_tfidf_per_movie(spark: SparkSession, sf: str, actor: int = ACTOR) -> DataFrame:
    """Per movie: each tag once, at its oldest time; time weights within the movie (0.9 if it has one tag); shares per movie, summed; idf = movies with tags / movies with the tag, without a logarithm."""
    from pyspark.sql.window import Window

    bed = Bed(spark, sf)
    oldest = bed.movie_tags().groupBy("movieid", "tagid").agg(F.min("us").alias("us"))
    by = Window.partitionBy("movieid")
    own = v.ranked(bed.cast(), w.rank_by_cast).filter(F.col("actorid") == actor).join(oldest, "movieid")
    own = own.withColumn("tw", F.when(F.count("*").over(by) == 1, F.lit(0.9)).otherwise(w.time_continuous(F.col("us"), F.min("us").over(by), F.max("us").over(by))))
    own = own.withColumn("x", F.col("rw") + F.col("tw")).withColumn("x", F.col("x") / F.sum("x").over(by))
    tf = own.groupBy("tagid").agg(F.sum("x").alias("tf"))
    df = v.document_frequency(bed.movie_tags(), "tagid", "movieid")
    total = F.broadcast(bed.movie_tags().agg(F.countDistinct("movieid").alias("n")))
    return tf.join(df, "tagid").crossJoin(total).withColumn("tfidf", F.col("tf") * F.col("n") / F.col("df")).select("tagid", out("tfidf"))


_DF_ACTORS = "d AS (SELECT tagid, count(DISTINCT actorid) AS df FROM movie_actor JOIN (SELECT DISTINCT movieid, tagid FROM mltags) USING (movieid) GROUP BY 1)"
_GENRES = "g AS (SELECT movieid, unnest(string_split(genres, '|')) AS genre FROM mlmovies)"
_DF_GENRES = "d AS (SELECT tagid, count(DISTINCT genre) AS df FROM (SELECT DISTINCT movieid, tagid FROM mltags) JOIN g USING (movieid) GROUP BY 1)"


def _final(total: str, log: str = "log10") -> str:
    return f"SELECT tagid, round(tf * {log}(({total})::DOUBLE / df), 6) AS tfidf FROM tf JOIN d USING (tagid)"


_EITHER = f"SELECT movieid FROM mlmovies WHERE contains(genres, '{GENRE}') OR contains(genres, '{OTHER}')"
_CAST_TF = [
    p.RANKS,
    f"own AS (SELECT r.*, t.tagid, t.us FROM ranks r JOIN mltags t USING (movieid) WHERE actorid = {ACTOR})",
    p.timed("ot", "own", p.tsw_c),
    "ow AS (SELECT tagid, sum(1 - rank::DOUBLE / (size + 1)::DOUBLE + tw) AS w FROM ot GROUP BY 1)",
    "tf AS (SELECT tagid, w / (SELECT sum(w) FROM ow) AS tf FROM ow)",
]
_TF = "SELECT tagid, round(tf, 6) AS tf FROM tf"
_CAST, _MOVIES, _RATED = ("mltags", "movie_actor", "actor_info"), ("mltags", "mlmovies"), ("mltags", "mlratings", "actor_info")

QUERIES = {
    "q1_actor_tf": (actor_tf, p.sql(*_ACTOR_TF, final=_TF, use=("mltags", "movie_actor"))),
    "q2_actor_tfidf": (actor_tfidf, p.sql(*_ACTOR_TF, _DF_ACTORS, final=_final("SELECT count(*) FROM actor_info"), use=_CAST)),
    "q3_genre_tf": (genre_tf, p.sql(*_GENRE_TF, final=_TF, use=_MOVIES)),
    "q4_genre_tfidf": (genre_tfidf, p.sql(*_GENRE_TF, _GENRES, _DF_GENRES, final=_final("SELECT count(DISTINCT genre) FROM g"), use=_MOVIES)),
    "q5_user_tf": (user_tf, p.sql(*_USER_TF, final=_TF, use=("mltags", "mlratings"))),
    "q6_user_tfidf": (user_tfidf, p.sql(*_USER_TF, "d AS (SELECT tagid, count(DISTINCT userid) AS df FROM (SELECT DISTINCT movieid, userid FROM mlratings) JOIN (SELECT DISTINCT movieid, tagid FROM mltags) USING (movieid) GROUP BY 1)", final=_final("SELECT count(*) FROM actor_info"), use=_RATED)),
    "q7_tfidf_diff": (tfidf_diff, p.sql(*_GENRE_TF, f"e AS ({_EITHER})", "d AS (SELECT tagid, count(DISTINCT movieid) AS df FROM mltags JOIN e USING (movieid) GROUP BY 1)", final=_final("SELECT count(*) FROM e"), use=_MOVIES)),
    "q8_p_diff1": (p_diff1, _pdiff_sql(GENRE, OTHER, GENRE, _XY1)),
    "q8_p_diff1_overlapping": (p_diff1_overlapping, _pdiff_sql(GENRE, BRAND, GENRE, _XY1)),
    "q9_p_diff2": (p_diff2, _pdiff_sql(GENRE, OTHER, OTHER, _XY2)),
    "q10_actor_tfidf_by_cast": (actor_tfidf_by_cast, p.sql(*_CAST_TF, _DF_ACTORS, final=_final("SELECT count(*) FROM actor_info", "ln"), use=_CAST)),
    "q10_genre_tfidf_ln": (genre_tfidf_ln, p.sql(*_GENRE_TF, _GENRES, _DF_GENRES, final=_final("SELECT count(DISTINCT genre) FROM g", "ln"), use=_MOVIES)),
    "q10_user_tfidf_by_taggers": (user_tfidf_by_taggers, p.sql(f"own AS (SELECT * FROM mltags WHERE userid = {USER})", *_USER_TF[1:], "d AS (SELECT tagid, count(DISTINCT userid) AS df FROM mltags GROUP BY 1)", final=_final("SELECT count(*) FROM actor_info", "ln"), use=("mltags", "actor_info"))),
    "q11_actor_tfidf_per_movie": (actor_tfidf_per_movie, p.sql(
        p.RANKS, "o AS (SELECT movieid, tagid, min(us) AS us FROM mltags GROUP BY 1, 2)",
        f"a AS (SELECT r.*, o.tagid, o.us, min(o.us) OVER m AS t0, max(o.us) OVER m AS t1, count(*) OVER m AS n FROM ranks r JOIN o USING (movieid) WHERE actorid = {ACTOR} WINDOW m AS (PARTITION BY movieid))",
        f"b AS (SELECT movieid, tagid, 1 - rank::DOUBLE / (size + 1)::DOUBLE + CASE WHEN n = 1 THEN 0.9::DOUBLE ELSE {p.tsw_c('us', 't0', 't1')} END AS x FROM a)",
        "c AS (SELECT tagid, x / sum(x) OVER (PARTITION BY movieid) AS x FROM b)", "tf AS (SELECT tagid, sum(x) AS tf FROM c GROUP BY 1)",
        "d AS (SELECT tagid, count(DISTINCT movieid) AS df FROM mltags GROUP BY 1)",
        final="SELECT tagid, round(tf * (SELECT count(DISTINCT movieid) FROM mltags) / df, 6) AS tfidf FROM tf JOIN d USING (tagid)", use=("mltags", "movie_actor"))),
    "q12_p_diff1_product": (p_diff_product, _pdiff_sql(GENRE, OTHER, GENRE, _XYP)),
    "q12_p_diff2_product": (p_diff2_product, _PDIFF2_PRODUCT),
    "q13_tfidf_diff_counts": (tfidf_diff_counts, p.sql(
        f"own AS (SELECT tagid, count(*)::DOUBLE AS n FROM mltags WHERE movieid IN (SELECT movieid FROM mlmovies WHERE contains(genres, '{GENRE}')) GROUP BY 1)",
        "tf AS (SELECT tagid, n / (SELECT sum(n) FROM own) AS tf FROM own)", "d AS (SELECT tagid, count(DISTINCT movieid) AS df FROM mltags GROUP BY 1)",
        final=_final(f"SELECT count(*) FROM ({_EITHER})", "ln"), use=_MOVIES)),
}
