"""DuckDB twins of the canonical relations, and of the scalar weights, for the oracle SQL."""

RELATIONS = {
    "mlmovies": "SELECT p_partkey AS movieid, p_name AS moviename, CAST(1970 + p_size AS INTEGER) AS year, p_type || '|' || p_brand AS genres FROM part",
    "mltags": "SELECT o_custkey AS userid, l_partkey AS movieid, CAST(l_quantity AS INTEGER) * 11 + CAST(round(l_discount * 100) AS INTEGER) AS tagid, epoch_us(l_shipdate) AS us FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "mlratings": "SELECT l_partkey AS movieid, o_custkey AS userid, CAST(1 + CAST(round(l_tax * 100) AS INTEGER) % 5 AS DOUBLE) AS rating, epoch_us(o_orderdate) AS us FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "movie_actor": "SELECT l_partkey AS movieid, o_custkey AS actorid, min(l_linenumber) AS actor_movie_rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2",
    "actor_info": "SELECT c_custkey AS actorid, c_name AS name, c_mktsegment AS gender FROM customer",
    "mllabels": "SELECT p_partkey AS movieid, p_type AS label FROM part WHERE p_partkey % 3 = 0",
}
DAY = 86400000000


def sql(*steps: str, final: str, use: tuple[str, ...] = ()) -> str:
    """WITH the named relations and steps ('name AS (...)'), the final SELECT."""
    parts = [f"{n} AS MATERIALIZED ({RELATIONS[n]})" for n in use] + list(steps)
    return f"WITH {', '.join(parts)} {final}"


def tsw_c(us: str, low: str, high: str) -> str:
    return f"(CASE WHEN {high} = {low} THEN 1.0::DOUBLE ELSE ({us} - {low})::DOUBLE / ({high} - {low})::DOUBLE END)"


def tsw_d(us: str, low: str, high: str) -> str:
    return f"(((({us} - {low}) // {DAY}) + 1)::DOUBLE / ((({high} - {low}) // {DAY}) + 1)::DOUBLE)"


def tsw_s(us: str, low: str, high: str) -> str:
    return f"(((({us} - {low}) // 1000000) + 1)::DOUBLE / ((({high} - {low}) // 1000000) + 1)::DOUBLE)"


def rw1(rank: str, low: str, high: str) -> str:
    return f"(CASE WHEN {high} > 1 AND {high} <> {low} THEN 1 - ({rank} - {low})::DOUBLE / ({high} - {low})::DOUBLE ELSE 1.0::DOUBLE END)"


def rw2(rank: str, low: str, high: str) -> str:
    return f"((1 + {high} - {rank})::DOUBLE / (1 + {high} - {low})::DOUBLE)"


def even4(x: str) -> str:
    return f"CAST(round_even({x}, 4) AS DOUBLE)"


def ratio(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / ({b})::DOUBLE)"


#: Ranks of a movie's cast, over all its actors.
RANKS = "ranks AS MATERIALIZED (SELECT movieid, actorid, actor_movie_rank AS rank, min(actor_movie_rank) OVER (PARTITION BY movieid) AS lo, max(actor_movie_rank) OVER (PARTITION BY movieid) AS hi, count(*) OVER (PARTITION BY movieid) AS size FROM movie_actor)"


def timed(name: str, source: str, weight=tsw_d) -> str:
    """A step that adds tw to the rows of a source with a column us."""
    return f"{name} AS (SELECT s.*, {weight('s.us', 'e.lo', 'e.hi')} AS tw FROM {source} s, (SELECT min(us) AS lo, max(us) AS hi FROM {source}) e)"


def movie_tags(source: str, weight=tsw_d, rounded: bool = False, name: str = "x") -> list[str]:
    """Steps that end with `name`(movieid, tagid, tfidf)."""
    value = even4("tw") if rounded else "tw"
    return [
        timed(f"{name}_t", source, weight),
        f"{name}_w AS (SELECT movieid, tagid, sum({value}) AS w FROM {name}_t GROUP BY 1, 2)",
        f"{name}_f AS (SELECT movieid, tagid, w / sum(w) OVER (PARTITION BY movieid) AS tf FROM {name}_w)",
        f"{name}_d AS (SELECT tagid, count(DISTINCT movieid) AS df FROM mltags GROUP BY 1)",
        f"{name} AS MATERIALIZED (SELECT movieid, tagid, tf * log10((SELECT count(*) FROM mlmovies)::DOUBLE / df) AS tfidf FROM {name}_f JOIN {name}_d USING (tagid))",
    ]


ACTOR_TAGS = [
    RANKS,
    timed("tt", "mltags"),
    f"aw AS MATERIALIZED (SELECT actorid, tagid, sum({even4(rw2('rank', 'lo', 'hi') + ' + tw')}) AS w FROM ranks JOIN tt USING (movieid) GROUP BY 1, 2)",
    "ad AS (SELECT tagid, count(*) AS df FROM aw GROUP BY 1)",
    "actor_tags AS MATERIALIZED (SELECT actorid, tagid, w / sum(w) OVER (PARTITION BY actorid) * log10((SELECT count(*) FROM actor_info)::DOUBLE / df) AS tfidf FROM aw JOIN ad USING (tagid))",
]
ACTOR_USE = ("mltags", "movie_actor", "actor_info")
