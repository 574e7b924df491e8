"""Queries that show single relational operators: sources and sinks, projections, joins, aggregates, top-k, sets, scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import weights as w
from ..operators import relational as r
from ..operators.iterate import work_dir
from ..sources import readers
from ..sources.readers import Bed
from . import prelude as p
from .models import GENRE, OTHER


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Labels written as CSV with a header and read back with the fixed schema."""
    path = f"{work_dir(spark)}/csv-{uuid.uuid4().hex}"
    readers.write_csv(Bed(spark, sf).labels(), path)
    return readers.read_csv(spark, path, "mllabels")


def sql_query(spark: SparkSession, sf: str) -> DataFrame:
    """A statement with bound values over named relations."""
    return readers.query(spark, {"mlmovies": Bed(spark, sf).movies()}, "SELECT year, count(DISTINCT movieid) AS n FROM mlmovies WHERE genres LIKE :genre AND year != :year GROUP BY year ORDER BY year DESC", genre=f"%{GENRE}%", year=1980)


def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return readers.first_rows(Bed(spark, sf).tags(), 100, "us", "userid", "movieid", "tagid").select("userid", "movieid", "tagid", "us")


def string_to_float(spark: SparkSession, sf: str) -> DataFrame:
    rows = Bed(spark, sf).ratings().groupBy("movieid").agg(F.concat(F.lit(" "), F.max("rating").cast("string"), F.lit(" ")).alias("x"))
    return readers.numbers(rows, "x")


def tag_names(spark: SparkSession, sf: str) -> DataFrame:
    """Counts with the tag's name put after its id."""
    bed = Bed(spark, sf)
    return readers.named(bed.movie_tags().groupBy("tagid").agg(F.count("*").alias("n")), bed.tag_names(), "tagid")


def dense_codes(spark: SparkSession, sf: str) -> DataFrame:
    return r.dense(Bed(spark, sf).cast(), "actorid", "code", start=1)


def genre_regex(spark: SparkSession, sf: str) -> DataFrame:
    return Bed(spark, sf).movies().filter(r.genre_is(f"{GENRE}|{OTHER}", literal=False)).select("movieid", "genres")


def exploded_genres(spark: SparkSession, sf: str) -> DataFrame:
    return r.genres(Bed(spark, sf).movies())


def left_join_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Movies with their number of cast members, 0 where they have none."""
    bed = Bed(spark, sf)
    return bed.movies().select("movieid").join(bed.cast().groupBy("movieid").agg(F.count("*").alias("n")), "movieid", "left").fillna(0, ["n"])


def clashing_join(spark: SparkSession, sf: str) -> DataFrame:
    """Tags and ratings of the same movie and user, each with its own time."""
    bed = Bed(spark, sf)
    t, q = bed.tags().alias("t"), bed.ratings().alias("r")
    return t.join(q, (F.col("t.movieid") == F.col("r.movieid")) & (F.col("t.userid") == F.col("r.userid"))).groupBy(F.col("t.movieid").alias("movieid"), F.col("t.userid").alias("userid")).agg(F.max("t.us").alias("tag_us"), F.max("r.us").alias("rating_us"), F.count("*").alias("n"))


def semi_and_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Actors in a genre but in none of another."""
    bed = Bed(spark, sf)
    of = lambda g: bed.cast().join(bed.movies().filter(r.genre_is(g)).select("movieid"), "movieid", "left_semi").select("actorid").distinct()
    return of(GENRE).join(of(OTHER), "actorid", "left_anti")


def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    bed = Bed(spark, sf)
    return bed.ratings().select("userid", "movieid").unionByName(bed.tags().select("userid", "movieid")).dropDuplicates(["userid", "movieid"])


def spread_of_years(spark: SparkSession, sf: str) -> DataFrame:
    """Each tagging's user and movie pair with the movie's standard deviation of tag years (0 for one row)."""
    year = F.year(F.timestamp_micros("us"))
    rows = Bed(spark, sf).tags().withColumn("sd", F.coalesce(F.stddev_samp(year).over(Window.partitionBy("movieid")), F.lit(0.0)))
    return rows.groupBy("movieid").agg(F.round(F.max("sd"), 6).alias("sd"), F.count("*").alias("n"))


def mean_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Per movie: the mean of its ratings, and the mean over all users with missing ones as 0."""
    bed = Bed(spark, sf)
    users = F.broadcast(bed.users().agg(F.count("*").alias("users")))
    return bed.ratings().groupBy("movieid").agg(F.avg("rating").alias("a"), F.sum("rating").alias("s")).crossJoin(users).select("movieid", F.round("a", 6).alias("mean"), F.round(F.col("s") / F.col("users"), 6).alias("row_mean"))


def majority(spark: SparkSession, sf: str) -> DataFrame:
    """Per user the most frequent rating; of several the one with the latest time, then the least."""
    return r.majority(Bed(spark, sf).ratings(), "userid", "rating", "us")


def largest(spark: SparkSession, sf: str) -> DataFrame:
    """Per movie the tag with most taggings; ties go to the smallest tag."""
    return r.argmax(Bed(spark, sf).movie_tags().groupBy("movieid", "tagid").agg(F.count("*").alias("n")), "movieid", "n", "tagid")


def top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """The two latest ratings of each user."""
    return r.top_by(Bed(spark, sf).ratings(), 2, ["userid"], F.desc("us"), F.asc("movieid"), F.asc("rating")).select("userid", "movieid", "rating", "us")


def clamped(spark: SparkSession, sf: str) -> DataFrame:
    """Infinite scores take the largest and smallest finite ones."""
    n = Bed(spark, sf).movie_tags().groupBy("tagid").agg(F.count("*").cast("double").alias("n"))
    inf = F.lit(float("inf"))
    return r.clamp_infinite(n.select("tagid", F.when(F.col("tagid") % 7 == 0, inf).when(F.col("tagid") % 11 == 0, -inf).otherwise(F.col("n")).alias("x")), "x")


def scalar_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Every time and rank weight of each cast row's movie."""
    bed = Bed(spark, sf)
    by = Window.partitionBy("movieid")
    rank, us = F.col("actor_movie_rank"), F.col("us")
    times = bed.movie_tags().groupBy("movieid").agg(F.min("us").alias("t0"), F.max("us").alias("t1"), F.expr("cast(avg(us) AS bigint)").alias("us"))
    cast = bed.cast().withColumn("lo", F.min(rank).over(by)).withColumn("hi", F.max(rank).over(by)).withColumn("size", F.count("*").over(by))
    x = cast.join(times, "movieid")
    lo, hi, t0, t1 = F.col("lo"), F.col("hi"), F.col("t0"), F.col("t1")
    each = {"rw1": w.rank_linear(rank, lo, hi), "rw2": w.rank_smoothed(rank, lo, hi), "rw3": w.rank_by_cast(rank, F.col("size")), "days": w.time_days(us, t0, t1), "four": w.even4(w.rank_smoothed(rank, lo, hi))}
    return x.select("movieid", "actorid", *[F.round(c, 6).alias(n) for n, c in each.items()])


def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Percent of movies whose label is the most frequent one of its kind of year."""
    x = Bed(spark, sf).movies().join(Bed(spark, sf).labels(), "movieid")
    return r.accuracy(x.withColumn("same", F.split("genres", "[|]")[0]), "label", "same")


def bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Global aggregates on every row of a small relation."""
    n = Bed(spark, sf).movie_tags().groupBy("tagid").agg(F.count("*").alias("n"))
    return r.bounds(n, low=F.min("n"), high=F.max("n"), total=F.sum("n")).select("tagid", "n", "low", "high", "total")


_YEAR = "year(make_timestamp(us))"
QUERIES = {
    "p1_csv_round_trip": (csv_round_trip, p.sql(final="SELECT movieid, label FROM mllabels", use=("mllabels",))),
    "p2_sql_query": (sql_query, p.sql(final=f"SELECT year, count(DISTINCT movieid) AS n FROM mlmovies WHERE genres LIKE '%{GENRE}%' AND year <> 1980 GROUP BY 1", use=("mlmovies",))),
    "p3_first_rows": (first_rows, p.sql(final="SELECT userid, movieid, tagid, us FROM mltags ORDER BY us, userid, movieid, tagid LIMIT 100", use=("mltags",))),
    "p4_string_to_float": (string_to_float, p.sql(final="SELECT movieid, max(rating) AS x FROM mlratings GROUP BY 1", use=("mlratings",))),
    "p5_tag_names": (tag_names, p.sql(final="SELECT tagid, 'tag_' || tagid AS tag, count(*) AS n FROM mltags GROUP BY 1", use=("mltags",))),
    "p6_dense_codes": (dense_codes, p.sql(final="SELECT actorid, row_number() OVER (ORDER BY actorid) AS code FROM (SELECT DISTINCT actorid FROM movie_actor)", use=("movie_actor",))),
    "p7_genre_regex": (genre_regex, p.sql(final=f"SELECT movieid, genres FROM mlmovies WHERE regexp_matches(genres, '{GENRE}|{OTHER}')", use=("mlmovies",))),
    "p8_exploded_genres": (exploded_genres, p.sql(final="SELECT movieid, unnest(string_split(genres, '|')) AS genre FROM mlmovies", use=("mlmovies",))),
    "p9_left_join_fill": (left_join_fill, p.sql(final="SELECT movieid, coalesce(n, 0) AS n FROM mlmovies LEFT JOIN (SELECT movieid, count(*) AS n FROM movie_actor GROUP BY 1) USING (movieid)", use=("mlmovies", "movie_actor"))),
    "p10_clashing_join": (clashing_join, p.sql(final="SELECT t.movieid, t.userid, max(t.us) AS tag_us, max(r.us) AS rating_us, count(*) AS n FROM mltags t JOIN mlratings r ON t.movieid = r.movieid AND t.userid = r.userid GROUP BY 1, 2", use=("mltags", "mlratings"))),
    "p11_semi_and_anti": (semi_and_anti, p.sql(final=f"SELECT DISTINCT actorid FROM movie_actor JOIN mlmovies USING (movieid) WHERE contains(genres, '{GENRE}') AND actorid NOT IN (SELECT actorid FROM movie_actor JOIN mlmovies USING (movieid) WHERE contains(genres, '{OTHER}'))", use=("mlmovies", "movie_actor"))),
    "p12_union_distinct": (union_distinct, p.sql(final="SELECT userid, movieid FROM mlratings UNION SELECT userid, movieid FROM mltags", use=("mltags", "mlratings"))),
    "p13_spread_of_years": (spread_of_years, p.sql(final=f"SELECT movieid, round(coalesce(stddev_samp({_YEAR}), 0), 6) AS sd, count(*) AS n FROM mltags GROUP BY 1", use=("mltags",))),
    "p14_mean_ratings": (mean_ratings, p.sql(final="SELECT movieid, round(avg(rating), 6) AS mean, round(sum(rating) / (SELECT count(*) FROM actor_info), 6) AS row_mean FROM mlratings GROUP BY 1", use=("mlratings", "actor_info"))),
    "p15_majority": (majority, p.sql("v AS (SELECT userid, rating, count(*) AS n, max(us) AS best FROM mlratings GROUP BY 1, 2)", final="SELECT userid, rating FROM (SELECT *, row_number() OVER (PARTITION BY userid ORDER BY n DESC, best DESC, rating) AS i FROM v) WHERE i = 1", use=("mlratings",))),
    "p16_argmax": (largest, p.sql("c AS (SELECT movieid, tagid, count(*) AS n FROM mltags GROUP BY 1, 2)", final="SELECT movieid, tagid FROM (SELECT *, row_number() OVER (PARTITION BY movieid ORDER BY n DESC, tagid) AS i FROM c) WHERE i = 1", use=("mltags",))),
    "p17_top_per_group": (top_per_group, p.sql(final="SELECT userid, movieid, rating, us FROM (SELECT *, row_number() OVER (PARTITION BY userid ORDER BY us DESC, movieid, rating) AS i FROM mlratings) WHERE i <= 2", use=("mlratings",))),
    "p18_clamped": (clamped, p.sql("c AS (SELECT tagid, count(*)::DOUBLE AS n FROM mltags GROUP BY 1)", "f AS (SELECT min(n) AS lo, max(n) AS hi FROM c WHERE tagid % 7 <> 0 AND tagid % 11 <> 0)", final="SELECT tagid, CASE WHEN tagid % 7 = 0 THEN hi WHEN tagid % 11 = 0 THEN lo ELSE n END AS x FROM c, f", use=("mltags",))),
    "p19_scalar_weights": (scalar_weights, p.sql(
        p.RANKS, "t AS (SELECT movieid, min(us) AS t0, max(us) AS t1, CAST(trunc(avg(us)) AS BIGINT) AS us FROM mltags GROUP BY 1)",
        final=f"SELECT movieid, actorid, round({p.rw1('rank', 'lo', 'hi')}, 6) AS rw1, round({p.rw2('rank', 'lo', 'hi')}, 6) AS rw2, round(1 - rank::DOUBLE / (size + 1)::DOUBLE, 6) AS rw3, round({p.tsw_d('us', 't0', 't1')}, 6) AS days, round({p.even4(p.rw2('rank', 'lo', 'hi'))}, 6) AS four FROM ranks JOIN t USING (movieid)", use=("mltags", "movie_actor"))),
    "p20_accuracy": (accuracy, p.sql(final="SELECT avg(CASE WHEN label = string_split(genres, '|')[1] THEN 1.0::DOUBLE ELSE 0 END) * 100 AS accuracy FROM mlmovies JOIN mllabels USING (movieid)", use=("mlmovies", "mllabels"))),
    "p21_bounds": (bounds, p.sql("c AS (SELECT tagid, count(*) AS n FROM mltags GROUP BY 1)", final="SELECT tagid, n, (SELECT min(n) FROM c) AS low, (SELECT max(n) FROM c) AS high, CAST((SELECT sum(n) FROM c) AS BIGINT) AS total FROM c", use=("mltags",))),
}
