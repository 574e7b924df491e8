"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms around them.

Base spans are what four patterns find. Their distinct values are the protected entities. For each term of a document
that holds an entity, corpus co-occurrence tells how much it discloses: PMI(term; entity) / IC(entity), with whole
documents as the events; a term that occurs with the entity only has disclosure 1. All places of terms at or above
`generalise` in documents that hold their entity, outside base spans, become spans of kind `term`; in redacted text they
are generalised to a placeholder, and those at or above `remove` are removed. A term must stand in `support` different
texts with the entity, so copies of one text reveal nothing by themselves.

DataFrame operations only. A pattern's places come from the lengths of what it matches and of the pieces that a split
by it leaves, added up block by block; texts are put together again from blocks too, so a text's spans cost little more
than their number. The patterns use possessive loops, whose matching needs no stack, and start only where a run of their
first characters starts or the last match ended, so long runs cost no more than their length.

Defined cases: null text is empty, has no spans and, in `redacted`, stays null; repeated rows get equal results; without
entities that recur there are no terms; extra columns pass through `redacted` unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Table, fresh, hinted

# Kinds in the order of results, and their patterns.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone")

#: Different texts that a term and an entity must share; 1 assesses every pair.
SUPPORT = 3
#: Shares of an entity's information from which a term is generalised, or removed.
GENERALISE = 0.9
REMOVE = 1.0
#: A term: a run of letters and digits of any length.
TERM = r"[\p{L}\p{N}]++"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    n = F.length(_digits(value))
    if kind == "phone":
        return n.between(8, 15)
    return F.when(n.between(16, 19), F.call_function("luhn_check", _digits(value))).otherwise(False)


def _hint(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}[kind]


def let(value: Column, then) -> Column:
    """then(value), with the value computed once: inside a lambda an expression would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(values: Column, kind: str = "bigint", combine=lambda a, b: a + b, start=0) -> Column:
    """array: the inclusive running combination of an array. Built block by block, as adding to an array copies it: n^1.5 steps for n values."""

    def scan(items: Column) -> Column:
        first = F.struct(F.lit(start).cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            now = combine(acc["at"], x)
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(items, first, step, lambda acc: acc["out"])

    def shifted(blocks: Column) -> Column:
        before = F.concat(F.array(F.lit(start).cast(kind)), scan(F.transform(blocks, lambda b: F.element_at(b, -1))))
        return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, e: F.transform(b, lambda x: combine(x, e))))

    def cut_up(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda k: scan(F.slice(v, k * size + 1, size))), shifted)

    return let(values, lambda v: F.when(F.size(v) > 0, cut_up(v)).otherwise(F.array().cast(f"array<{kind}>")))


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all the pattern's matches, in code points."""
    pieces = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long")).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    ended = lambda p: running(F.transform(p, lambda x: x["gap"] + F.length(x["value"])))
    placed = lambda p: F.zip_with(p, ended(p), lambda x, e: F.struct((e - F.length(x["value"])).alias("start"), e.alias("end"), x["value"].alias("value")))
    return let(F.filter(pieces, lambda x: x["value"].isNotNull()), placed)


def spans_of(text: Column, pattern: str, hint: Column) -> Column:
    return F.when(hint, places(text, pattern)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))


#: Code points of a text that are looked up together.
_BLOCK = 1024


def blocks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start up to end of a text given by its blocks, reading only the blocks that hold them."""
    low, high = F.floor(start / _BLOCK).cast("int"), F.floor((end - 1) / _BLOCK).cast("int")

    def part(k: Column) -> Column:
        a = F.greatest(start - k * _BLOCK, F.lit(0))
        return F.substring(F.get(blocks, k), (a + 1).cast("int"), (F.least(end - k * _BLOCK, F.lit(_BLOCK)) - a).cast("int"))

    return F.when(end > start, F.array_join(F.transform(F.sequence(low, F.greatest(low, high)), part), "")).otherwise("")


def _between(text: Column, spans: Column, put) -> Column:
    """The text with each span (sorted by start) replaced by put(span, end of what earlier spans cover), and what lies between kept."""

    def made(blocks: Column, before: Column) -> Column:
        parts = F.zip_with(spans, F.slice(before, 1, F.size(spans)), lambda s, at: F.concat(cut(blocks, at, s["start"]), put(s, at)))
        return F.concat(F.array_join(parts, ""), cut(blocks, F.element_at(before, -1), F.length(text).cast("long")))

    ends = F.concat(F.array(F.lit(0).cast("long")), running(F.transform(spans, lambda s: s["end"]), combine=F.greatest))
    return let(blocks_of(text), lambda blocks: let(ends, lambda before: made(blocks, before)))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, put) replaced; overlaps take the first one's replacement."""
    return _between(text, spans, lambda s, at: F.when(s["start"] >= at, s["put"]).otherwise(""))


def blanked(text: Column, spans: Column) -> Column:
    """The text with what spans cover replaced by as many line ends, so that places stay."""
    return _between(text, spans, lambda s, at: F.repeat(F.lit("\n"), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)).cast("int")))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), and one array of valid spans per kind."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    for k in KINDS:
        d = d.withColumn(f"_{k}", spans_of(F.col("text"), kinds[k], _hint(k, F.col("text"))))

    def kept(k: str) -> Column:
        return F.filter(F.col(f"_{k}"), lambda x: _valid(k, x["value"])).alias(k)

    return d.select("doc_id", F.xxhash64("text").alias("h"), *[kept(k) for k in KINDS])


def mentions(base: DataFrame) -> DataFrame:
    """One row per span: doc_id, h, entity and the span's fields."""

    def of(k: str) -> Column:
        return F.transform(F.col(k), lambda x: F.struct(F.concat(F.lit(f"{k}:"), F.lower(x["value"])).alias("entity"), *[x[c].alias(c) for c in ("start", "end")]))

    every = F.concat(*[of(k) for k in KINDS])
    return base.filter(F.size(F.concat(*KINDS)) > 0).select("doc_id", "h", F.explode(every).alias("m")).select("doc_id", "h", "m.*")


def _terms(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(TERM), F.lit(0)), F.lower)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _of(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows (doc_id, h, ...) joined with keys (doc_id, h, ...)."""
    k = keys.withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    return rows.join(k, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).drop("_id", "_h")


def disclosing(docs: DataFrame, found: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """entity, term, disclosure: the terms whose share of an entity's information reaches the threshold."""
    total = F.broadcast(docs.agg(F.count("*").cast("double").alias("n_docs")))  # one row
    holders = found.select("doc_id", "h", "entity").distinct()
    entities = holders.groupBy("entity").agg(F.count_distinct("h").alias("texts"), F.count_distinct("doc_id").alias("n_entity")).filter(F.col("texts") >= support)
    # a term in more documents than this misses the threshold, even if it stands in all of the entity's
    most = F.col("n_entity") * F.pow(F.col("n_docs") / F.col("n_entity"), F.lit(1 - generalise)) * 1.000001
    entities = entities.filter("n_entity > 0").join(total).select("entity", "n_entity", "n_docs", most.alias("most"))
    held = Table(holders.join(entities, "entity"), "holders")
    keys = Table(held.df.select("doc_id", "h").distinct(), "holding")
    near = Table(_of(_texts(docs), hinted(keys, 32 << 20)).select("doc_id", "h", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).distinct(), "near")
    limit = F.broadcast(held.df.agg(F.max("most").alias("limit")))  # one row
    often = near.df.groupBy("term").agg(F.count_distinct("h").alias("texts"), F.count_distinct("doc_id").alias("at_least")).filter(F.col("texts") >= support)
    wanted = Table(often.join(limit).filter("at_least <= limit").select("term"), "terms")
    everywhere = docs.select(F.explode(F.array_distinct(_terms(F.coalesce("text", F.lit(""))))).alias("term"))
    n_term = everywhere.join(hinted(wanted, 32 << 20), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    rare = Table(n_term.join(limit).filter("n_term <= limit").drop("limit"), "rare")
    both = _of(near.df.join(hinted(rare, 32 << 20), "term"), held.df).filter("n_term <= most")
    pairs = both.groupBy("entity", "term", "n_term", "n_entity", "n_docs").agg(F.count_distinct("doc_id").alias("n_both"), F.count_distinct("h").alias("texts")).filter(F.col("texts") >= support)
    log = lambda n: F.log(F.col("n_docs") / F.col(n))
    pmi = F.log(F.col("n_docs") * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    return pairs.filter(log("n_entity") > 0).withColumn("disclosure", F.least(pmi / log("n_entity"), F.lit(1.0))).filter(F.col("disclosure") >= generalise).select("entity", "term", "disclosure")


def term_spans(docs: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, h, terms: array<struct<start, end, disclosure>> of the disclosing terms in documents that hold their entities, outside base spans (of a word that a base span cuts, what is left of it counts)."""
    known = found.select("doc_id", "h", "entity").distinct().join(terms, "entity").groupBy("doc_id", "h", "term").agg(F.max("disclosure").alias("disclosure"))
    known = Table(known, "known")
    base = found.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("base"))  # a text's own spans
    marked = Table(_of(base, known.df.select("doc_id", "h").distinct()), "marked")
    rows = _of(_texts(docs), hinted(marked, 32 << 20)).dropDuplicates(["doc_id", "h"])
    outside = Table(rows.select("doc_id", "h", F.explode(places(blanked(F.col("text"), F.col("base")), TERM)).alias("m")).select("doc_id", "h", "m.start", "m.end", F.lower("m.value").alias("term")), "words")
    k = hinted(known, 32 << 20).withColumnsRenamed({"doc_id": "_id", "h": "_h", "term": "_term"})
    hits = outside.df.join(k, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("term") == F.col("_term")))
    return hits.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))  # a text's own words


def analysed(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, h, the spans of each kind and `terms`."""
    base = Table(base_spans(docs), "spans")
    found = Table(mentions(base.df), "mentions")
    terms = Table(disclosing(docs, found.df), "disclosing")
    near = Table(term_spans(docs, found.df, hinted(terms, 32 << 20)), "term-spans")
    b, n = base.df.alias("b"), hinted(near, 32 << 20).alias("n")
    joined = b.join(n, F.col("b.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("b.h") == F.col("n.h")), "left")
    return joined.select("b.doc_id", "b.h", *[f"b.{k}" for k in KINDS], F.coalesce("n.terms", F.array().cast("array<struct<start:bigint,end:bigint,disclosure:double>>")).alias("terms"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans."""
    named = lambda k: F.transform(F.col(k), lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string")))
    base = F.concat(*[named(k) for k in KINDS])
    terms = F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["start"].cast("string"), x["end"].cast("string")))
    return analysed(docs).select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"))


def redacted(docs: DataFrame, remove: float = REMOVE) -> DataFrame:
    """docs with the same columns; in `text`, personal data and disclosing terms are generalised or removed."""
    put = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
    kind = "array<struct<start:bigint,end:bigint,put:string>>"
    by = lambda k: F.transform(F.col(k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(put[k]).alias("put")))
    each = [by(k) for k in KINDS]
    each.append(F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["disclosure"] >= remove, "").otherwise("<TERM>").alias("put"))))
    id_, h, spans_, key = fresh(docs, "_id", "_h", "_spans", "_key")
    spans = analysed(docs).select(F.col("doc_id").alias(id_), F.col("h").alias(h), F.array_sort(reduce(F.concat, [e.cast(kind) for e in each])).alias(spans_)).filter(F.size(spans_) > 0)
    spans = Table(spans.dropDuplicates([id_, h]), "redactions")
    known = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    found = known.join(hinted(spans), F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(h)), "left")
    text = F.when(F.col(spans_).isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col(spans_)))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
