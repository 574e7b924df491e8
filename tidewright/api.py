"""An object interface to the vectors and discrimination models.

    engine = Engine(spark, "/root/testdata/sf0.01")
    engine.actor(7).tfidf()
    engine.genre("PROMO").p_diff1("ECONOMY")
    engine.user(7).recommend("PAGERANK")
    engine.neighbours(layers=6, hashes=3).query([0, 20], r=5)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lsh
from .plans import models, recommend, similarity
from .sources.readers import Bed, named


@dataclass(frozen=True)
class _Of:
    spark: SparkSession
    folder: str


@dataclass(frozen=True)
class Actor(_Of):
    actorid: int

    def tf(self) -> DataFrame:
        return models.actor_tf(self.spark, self.folder, self.actorid)

    def tfidf(self, by_cast: bool = False, documents: int | None = None) -> DataFrame:
        """by_cast: the variant with natural logarithms and ranks over the cast's size."""
        return models.actor_tfidf_by_cast(self.spark, self.folder, self.actorid, documents) if by_cast else models.actor_tfidf(self.spark, self.folder, self.actorid)

    def similar(self, n: int = 10, latent: bool = False) -> DataFrame:
        return (similarity.similar_actors_latent if latent else similarity.similar_actors)(self.spark, self.folder, self.actorid, n)


@dataclass(frozen=True)
class Genre(_Of):
    genre: str

    def tf(self) -> DataFrame:
        return models.genre_tf(self.spark, self.folder, self.genre)

    def tfidf(self) -> DataFrame:
        return models.genre_tfidf(self.spark, self.folder, self.genre)

    def tfidf_diff(self, other: str) -> DataFrame:
        return models.tfidf_diff(self.spark, self.folder, self.genre, other)

    def p_diff1(self, other: str) -> DataFrame:
        return models.p_diff1(self.spark, self.folder, self.genre, other)

    def p_diff2(self, other: str) -> DataFrame:
        return models.p_diff2(self.spark, self.folder, self.genre, other)

    def semantics(self, space: str = "tag", method: str = "svd") -> DataFrame:
        if method == "lda":
            return similarity.genre_topics(self.spark, self.folder, space, self.genre)
        return similarity.genre_semantics(self.spark, self.folder, space, method, self.genre)


@dataclass(frozen=True)
class User(_Of):
    userid: int

    def tf(self) -> DataFrame:
        return models.user_tf(self.spark, self.folder, self.userid)

    def tfidf(self, by_taggers: bool = False) -> DataFrame:
        return (models.user_tfidf_by_taggers if by_taggers else models.user_tfidf)(self.spark, self.folder, self.userid)

    def recommend(self, method: str = "ALL", relevant: tuple[int, ...] | None = None) -> DataFrame:
        """SVD, PCA, LDA, TENSORD, PAGERANK or ALL; movies marked relevant re-rank by feedback."""
        return recommend.recommend(self.spark, self.folder, method, relevant, self.userid)


@dataclass(frozen=True)
class Movie(_Of):
    movieid: int

    def related_actors(self, n: int = 10, latent: bool = False) -> DataFrame:
        return (similarity.related_actors_latent if latent else similarity.related_actors)(self.spark, self.folder, self.movieid, n)


class Neighbours:
    """Hashed nearest-neighbour search over the points of a folder. Fewer layers are a prefix of more."""

    def __init__(self, spark: SparkSession, folder: str, layers: int, hashes: int, width: float = 1.0, dimensions: int = 64, seed: int = 0):
        self.points, self.family = Bed(spark, folder).points(), lsh.Family(dimensions, layers, hashes, width, seed)

    def index(self, layers: int | None = None) -> DataFrame:
        return lsh.index(self.points, self.family, layers)

    def query(self, ids: list[int], r: int) -> DataFrame:
        return lsh.nearest(self.points, self.points.filter(F.col("id").isin(ids)), self.family, r)

    def touched(self, ids: list[int]) -> DataFrame:
        return lsh.touched(self.points, self.points.filter(F.col("id").isin(ids)), self.family)

    def feedback(self, relevant: list[int], r: int) -> DataFrame:
        chosen = self.points.filter(F.col("id").isin(relevant))
        return lsh.feedback(lsh.nearest(self.points, chosen, self.family, r), chosen, r)


class Engine(Bed):
    def actor(self, actorid: int) -> Actor:
        return Actor(self.spark, self.folder, actorid)

    def genre(self, genre: str) -> Genre:
        return Genre(self.spark, self.folder, genre)

    def user(self, userid: int) -> User:
        return User(self.spark, self.folder, userid)

    def movie(self, movieid: int) -> Movie:
        return Movie(self.spark, self.folder, movieid)

    def neighbours(self, layers: int, hashes: int, **options) -> Neighbours:
        return Neighbours(self.spark, self.folder, layers, hashes, **options)

    def tagged(self, vector: DataFrame) -> DataFrame:
        """A tag vector with the tags' names."""
        return named(vector, self.tag_names(), "tagid")
