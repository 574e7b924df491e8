"""Fixed schemas of the canonical relations; nothing is inferred."""

from pyspark.sql import types as T

L, I, D, S, TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


MOVIES = _schema(movieid=L, moviename=S, year=I, genres=S)
TAGS = _schema(userid=L, movieid=L, tagid=I, timestamp=TS)
RATINGS = _schema(movieid=L, userid=L, imdbid=L, rating=D, timestamp=TS)
TAG_NAMES = _schema(tagid=I, tag=S)
CAST = _schema(movieid=L, actorid=L, actor_movie_rank=I)
ACTORS = _schema(actorid=L, name=S, gender=S)
USERS = _schema(userid=L)
LABELS = _schema(movieid=L, label=S)
RELATIONS = {"mlmovies": MOVIES, "mltags": TAGS, "mlratings": RATINGS, "genome_tags": TAG_NAMES, "movie_actor": CAST, "imdb_actor_info": ACTORS, "mlusers": USERS, "mllabels": LABELS}
